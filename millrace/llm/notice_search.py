"""Licence notices found with a bounded number of edits: exact seeds, then a fuzzy match of the whole notice."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, extended, text_bytes

# Phrases whose places are counted, by label.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# Wordings of public licences, as words without punctuation, by label.
NOTICES = {
    "apache": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by": ["licensed under cc by", "creative commons attribution license"],
    "cc-by-nc": ["licensed under cc by nc"],
    "cc0": ["dedicated to the public domain"],
    "gpl": ["licensed under the gnu general public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose"],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy"],
    "mpl": ["subject to the terms of the mozilla public license"],
    "reserved": ["all rights reserved"],
}

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


class NoticeSearch:
    """Searches for (label, notice) pairs. A notice with up to e edits holds one of its e + 1 pieces unchanged."""

    def __init__(self, notices: dict[str, list[str]], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices = [(label, n, max(1, len(n) // chars_per_edit)) for label, ns in notices.items() for n in ns]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}") for _, n, e in self.notices]
        seeds = defaultdict(list)
        for number, (_, notice, edits) in enumerate(self.notices):
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds[notice[a:b]].append((number, b))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, places)
        self.seeds.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice number, start, end, edits) of the matches in normalised text, by notice and place."""
        windows = defaultdict(list)
        for last, places in self.seeds.iter(text):
            for number, offset in places:
                _, notice, edits = self.notices[number]
                begin = last + 1 - offset - edits
                end = begin + len(notice) + 2 * edits
                known = windows[number]
                if known and begin <= known[-1][1]:
                    known[-1] = (min(begin, known[-1][0]), max(end, known[-1][1]))
                else:
                    known.append((begin, end))
        found = []
        for number in sorted(windows):
            for begin, end in windows[number]:
                for match in self.patterns[number].finditer(text, max(0, begin), min(len(text), end)):
                    found.append((number, match.start(), match.end(), sum(match.fuzzy_counts)))
        return found


def normalise(text: bytes) -> list[bytes]:
    """Runs of digits, a to z and bytes beyond ASCII, after A to Z are lower-cased."""
    return text.translate(_WORD_BYTES).split()


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` stands in `` word word ... ``."""
    found, words, counted = [], 0, 0
    at = text.find(phrase)
    while at >= 0:
        words += text.count(b" ", counted, at)
        counted = at
        found.append(words)
        at = text.find(phrase, at + 1)
    return found


def _scan(item: str, text: str, phrases: dict[str, str], notices: dict[str, list[str]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices)
        wanted = [(label, f" {phrase} ".encode()) for label, phrase in phrases.items()]
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for value in text_bytes(batch.column(text)):
                words = normalise(value)
                line = b" %b " % b" ".join(words)
                places = {label: _places(line, phrase) for label, phrase in wanted}
                starts = [p for ps in places.values() for p in ps]
                base = sorted(label for label, ps in places.items() if ps)
                string = line.decode("utf-8", "replace")
                spans, best = [], 1.0 if base else 0.0
                for number, begin, end, edits in search.spans(string):
                    label, notice, _ = search.notices[number]
                    first = string.count(" ", 0, begin + 1) - (string[begin] != " ")
                    spans.append({"label": label, "first_word": first, "words": len(string[begin:end].split()), "edits": edits, "found": string[begin:end].strip()})
                    best = max(best, 1 - edits / len(notice))
                labels = sorted({*base, *(s["label"] for s in spans)})
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), best, spans)
                for values, x in zip(out, row, strict=True):
                    values.append(x)
            arrays = [pa.array(v, t) for v, t in zip(out, ARROW_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(item), *arrays], names=[item, *NAMES])

    return run


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("found", pa.string())])
ARROW_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]


def scan_notices(
    docs: DataFrame, item: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES
) -> DataFrame:
    """(item, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each whole text.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word`` are the outer ones (null if none).
    ``spans`` lists each fuzzy match with its first word, its words, its edits and the wording found; one edit is
    allowed for 12 characters. ``score`` is 1 for a phrase, else 1 less the edits by length of the best match, else 0.
    Null and empty texts have no words and no labels. Repeated rows give a row each; other columns are ignored.
    """
    schema = extended(
        docs.select(item).schema,
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double,"
        "spans array<struct<label:string,first_word:bigint,words:bigint,edits:bigint,found:string>>",
    )
    return arrow_map(docs.select(*dict.fromkeys([item, text])), _scan(item, text, phrases, notices), schema)
