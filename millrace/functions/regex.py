"""Python regular expressions on Spark's JVM functions.

A pattern is rewritten where the two dialects differ. What Java cannot express
is left to an Arrow-batched UDF over Python's ``re``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT_BODY, JAVA_SPACE_BODY, WORD_BODY

CLASSES = {"s": JAVA_SPACE_BODY, "w": WORD_BODY, "d": DIGIT_BODY}
WORD = f"[{WORD_BODY}]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NO_BOUNDARY = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
SAME_ESCAPES = set("AnrtfavxutbB") | set("123456789")


class NotInJava(ValueError):
    """The pattern has no faithful Java form."""


def _escape(char: str, in_class: bool) -> str:
    """The Java form of a backslash escape."""
    if char in CLASSES:
        return CLASSES[char] if in_class else f"[{CLASSES[char]}]"
    if char.lower() in CLASSES:
        if in_class:
            raise NotInJava(f"\\{char} inside a class")
        return f"[^{CLASSES[char.lower()]}]"
    if char == "b":
        return r"\x08" if in_class else BOUNDARY
    if char == "B":
        return NO_BOUNDARY
    if char == "Z":
        return r"\z"
    if char == "v":
        return r"\x0b"
    if char in SAME_ESCAPES or not char.isalnum():
        return "\\" + char
    raise NotInJava(f"\\{char}")


def _class(pattern: str, start: int) -> tuple[str, int]:
    """The Java form of the character class that opens at ``start``."""
    out, i = ["["], start + 1
    if pattern[i] == "^":
        out.append("^")
        i += 1
    first = True
    while first or pattern[i] != "]":
        char = pattern[i]
        if char == "\\":
            out.append(_escape(pattern[i + 1], in_class=True))
            i += 1
        else:
            out.append("\\" + char if char in "[]&^~" else char)
        i += 1
        first = False
    return "".join(out) + "]", i + 1


def to_java_pattern(pattern: str) -> str:
    """Rewrites a valid Python pattern; raises ``NotInJava`` if that is impossible."""
    compiled = re.compile(pattern)
    if compiled.flags & (re.ASCII | re.VERBOSE):
        raise NotInJava("flags a and x")
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            out.append(_escape(pattern[i + 1], in_class=False))
            i += 2
        elif char == "[":
            text, i = _class(pattern, i)
            out.append(text)
        elif pattern.startswith("(?P<", i):
            name = pattern[i + 4 : pattern.index(">", i)]
            if not (name.isascii() and name.isalnum()):
                raise NotInJava(f"group name {name}")
            out.append("(?<")
            i += 4
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{pattern[i + 4 : end]}>")
            i = end + 1
        elif pattern.startswith(("(?(", "(?#"), i):
            raise NotInJava(pattern[i : i + 3])
        elif char == "(" and (flags := re.match(r"\(\?([ims]*)(?:-([ims]+))?([:)])", pattern[i:])):
            on, off, end = flags.groups()
            out.append(f"(?{on}{'-' + off if off else ''}{end}")
            i += flags.end()
        elif char == "{":
            open_range = re.match(r"\{,(\d*)\}", pattern[i:])
            if open_range:
                out.append("{0," + open_range.group(1) + "}")
                i += open_range.end()
            elif re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
                out.append("{")
                i += 1
            else:
                out.append(r"\{")
                i += 1
        elif char == "}" and not re.search(r"\{\d*,?\d*$", pattern[:i]):
            out.append(r"\}")
            i += 1
        else:
            out.append(char)
            i += 1
    # d: only \n ends a line, as in Python. U: \s and case follow Unicode.
    return "(?dU)" + "".join(out)


def to_java_replacement(pattern: str, replacement: str) -> str:
    """Rewrites a Python replacement template for ``regexp_replace``."""
    group_count = re.compile(pattern).groups
    simple = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\\\"}
    out, i, after_group = [], 0, False
    while i < len(replacement):
        named = re.match(r"\\g<(\w+)>", replacement[i:])
        numbered = re.match(r"\\([1-9]\d?)", replacement[i:])
        if named or numbered:
            match = named or numbered
            name = match.group(1)
            if name.isdigit() and int(name) > group_count:
                raise ValueError(f"invalid group reference {name}")
            if not name.isdigit() and not (name.isascii() and name.isalnum()):
                raise NotInJava(f"group name {name}")
            out.append(f"${int(name)}" if name.isdigit() else "${" + name + "}")
            i += match.end()
            after_group = True
            continue
        char = replacement[i]
        if char == "\\":
            nxt = replacement[i + 1] if i + 1 < len(replacement) else ""
            if nxt not in simple or nxt == "":
                raise NotInJava(f"escape \\{nxt} in the replacement")
            out.append(simple[nxt])
            i += 2
        else:
            out.append("\\" + char if char == "$" or (after_group and char.isdigit()) else char)
            i += 1
        after_group = False
    return "".join(out)


def python_regex_replace(text: Column, pattern: str, replacement: str, engine: str = "auto") -> Column:
    """``re.sub`` on a column. ``engine``: auto, java or python."""
    if engine not in ("auto", "java", "python"):
        raise ValueError(f"Unknown engine '{engine}'")
    re.compile(pattern)
    if engine != "python":
        try:
            java = to_java_pattern(pattern), to_java_replacement(pattern, replacement)
            return F.regexp_replace(text, F.lit(java[0]), F.lit(java[1]))
        except NotInJava:
            if engine == "java":
                raise

    @F.pandas_udf("string")
    def substitute(batch: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return batch.map(lambda value: compiled.sub(replacement, value), na_action="ignore")

    return substitute(text)


def python_regex_search(text: Column, pattern: str, case_insensitive: bool = False) -> Column:
    """Whether ``re.search`` finds the pattern; null for null text."""
    full = "(?i)" + pattern if case_insensitive else pattern
    re.compile(full)
    try:
        return text.rlike(to_java_pattern(full))
    except NotInJava:

        @F.pandas_udf("boolean")
        def search(batch: pd.Series) -> pd.Series:
            compiled = re.compile(full)
            return batch.map(lambda value: compiled.search(value) is not None, na_action="ignore")

        return search(text)
