"""Text rules as built-in column expressions.

White space, word and digit classes follow Python's Unicode rules and are spelled
out, because the Java classes ``\\s`` and ``\\w`` cover ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, as a class body and as text.
SPACE_BODY = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Python's \w and \d as Unicode categories.
WORD_BODY = r"\p{L}\p{N}_"
DIGIT_BODY = r"\p{Nd}"
# Patterns of the HTML rules and of the sentence splitter.
TAG = "<[^>]+>"
TAG_OR_EMPTY = "<[^>]*>"
ENTITY = f"&[{WORD_BODY}]+;"
SENTENCE_END = "[.!?]+"
# Words that mark a text as English.
ENGLISH_WORDS = ("the", "and", "is", "of", "to", "in", "it", "you", "that")

SPACES = f"[{SPACE_BODY}]+"
# The same characters for Java: with (?U) its \s lacks only the four separators.
JAVA_SPACE_BODY = r"\s\x1c-\x1f"
JAVA_SPACES = f"(?U)[{JAVA_SPACE_BODY}]+"
# One of the English words between spaces or ends of text; stops at the first one.
ENGLISH = rf"(?U)(?<![^{JAVA_SPACE_BODY}])(?:{'|'.join(ENGLISH_WORDS)})(?![^{JAVA_SPACE_BODY}])"


def strip(text: Column) -> Column:
    """Python's ``str.strip()``."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, F.lit(JAVA_SPACES), F.lit(" "))


def squash(text: Column) -> Column:
    return collapse(strip(text))


def is_blank(value: Column, data_type: str = "string") -> Column:
    """Null, or text of white space only. Other types are blank only when null."""
    if data_type != "string":
        return value.isNull()
    return value.isNull() | (strip(value) == "")


def words(text: Column) -> Column:
    """Python's ``str.split()``: an array without empty items."""
    return F.array_remove(F.split(text, JAVA_SPACES), "")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, SENTENCE_END), strip)
    return F.array_remove(parts, "")


def strip_html(text: Column) -> Column:
    """Removes tags, then named entities."""
    return F.regexp_replace(F.regexp_replace(text, TAG, ""), ENTITY, "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG_OR_EMPTY, "")


def is_english(text: Column) -> Column:
    """Whether one of the words of the lower-cased text is a common English one."""
    return F.rlike(F.lower(text), F.lit(ENGLISH))
