"""Language identification by unigram pieces, with all segmentations of a word summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import few, written
from .common import arrow_map, blocks, extended, slices, text_strings

UNKNOWN = "und"
#: Documents that a model is fitted on, about, and the least of a language: a hash of text and id picks that share of
#: the labelled ones of each language.
FIT_DOCUMENTS, FIT_LEAST = 4000, 50
#: Rounds of expectation and maximisation, and the count that every piece starts with.
ROUNDS, PRIOR = 3, 0.1
#: Probability of a character that no piece covers, the same for every language.
STRAY = 1e-7
CACHE_WORDS = 200_000
#: Places after which sums are rescaled.
RESCALE = 16

#: A word is a letter and the letters and marks that follow. In texts of these characters `re` finds them faster.
_SIMPLE, _SIMPLE_WORDS = re.compile("[\0-\xff]*"), re.compile("[a-zªµºß-öø-ÿ]+")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, by the Unicode categories of letters and marks."""
    text = text.lower()
    return _SIMPLE_WORDS.findall(text) if _SIMPLE.fullmatch(text) else _WORDS.findall(text)


def vocabulary_pieces(path: str) -> list[str]:
    """The pieces of a SentencePiece model that can stand in a lower-cased word; ``▁`` starts a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p and p.lower() == p and regex.fullmatch(r"▁?[\p{L}\p{M}]*", p)})


class Lattice:
    """Pieces at every place of a word. The last number stands for a character that no piece covers."""

    def __init__(self, pieces: list[str]):
        self.numbers = {p: i for i, p in enumerate(pieces)}
        self.begins = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.stray, self.longest = len(pieces), max(map(len, pieces), default=1)

    def arcs(self, words: list[str]) -> np.ndarray:
        """(words, places, lengths) piece numbers for words of one length, -1 where there is no piece."""
        size = len(words[0]) + 1
        longest = min(self.longest, size)
        out = np.full((len(words), size, longest), -1, np.int32)
        numbers, begins = self.numbers, self.begins
        for n, word in enumerate(words):
            word = "▁" + word
            row = out[n]
            for i in range(size):
                for end in range(i + 1, min(i + longest, size) + 1):
                    part = word[i:end]
                    if part not in begins:
                        break
                    if (number := numbers.get(part)) is not None:
                        row[i, end - i - 1] = number
        single = out[:, :, 0]
        single[single < 0] = self.stray
        return out

    def forward(self, arcs: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations of each prefix (words, places + 1, languages), and the logarithms taken out of them.

        ``chances`` is (pieces + 2, languages); its last row is zero for the absent piece. Sums are rescaled when they
        get small, together with those of the last places, which are all that later sums need.
        """
        words, size, longest = arcs.shape
        sums = np.zeros((words, size + 1, chances.shape[1]))
        sums[:, 0] = 1
        scale = np.zeros((words, chances.shape[1]))
        for end in range(1, size + 1):
            for length in range(1, min(longest, end) + 1):
                sums[:, end] += sums[:, end - length] * chances[arcs[:, end - length, length - 1]]
            if end % RESCALE == 0 and end < size:
                low = np.maximum(sums[:, end], 1e-300)
                first = max(0, end - longest + 1)
                sums[:, first : end + 1] /= low[:, None]
                scale += np.log(low)
        return sums, scale


def _by_length(words: list[str], limit: int = 200_000) -> Iterator[list[int]]:
    """Numbers of words of one length, in groups of limited size."""
    groups: dict[int, list[int]] = {}
    for n, word in enumerate(words):
        groups.setdefault(len(word), []).append(n)
    for length, members in groups.items():
        step = max(1, limit // (length + 1))
        for at in range(0, len(members), step):
            yield members[at : at + step]


def word_scores(lattice: Lattice, chances: np.ndarray, words: list[str]) -> np.ndarray:
    """The logarithm of each word's probability in each language."""
    out = np.empty((len(words), chances.shape[1]))
    for members in _by_length(words):
        sums, scale = lattice.forward(lattice.arcs([words[n] for n in members]), chances)
        out[members] = np.log(np.maximum(sums[:, -1], 1e-300)) + scale
    return out


def _expect(lattice: Lattice, chances: np.ndarray, languages: dict[str, int]):
    """Expected uses of each piece in each language, from (lang, word, n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((lattice.stray + 1, len(languages)))
        for batch in batches:
            langs = np.array([languages[x] for x in batch.column("lang").to_pylist()])
            times = batch.column("n").to_numpy()
            words = batch.column("word").to_pylist()
            for members in _by_length(words):
                arcs = lattice.arcs([words[n] for n in members])
                for lang in np.unique(langs[members]):
                    rows = np.flatnonzero(langs[members] == lang)
                    own, part = chances[:, lang : lang + 1], arcs[rows]
                    (before, logs_before), (after, logs_after) = _scaled(part, own, False), _scaled(part, own, True)
                    whole = np.log(np.maximum(after[:, 0], 1e-300)) + logs_after[:, 0]
                    weight = times[np.array(members)[rows]]
                    size = part.shape[1]
                    for length in range(1, part.shape[2] + 1):
                        starts = np.arange(size - length + 1)
                        piece = part[:, starts, length - 1]
                        scale = np.exp(logs_before[:, starts] + logs_after[:, starts + length] - whole[:, None])
                        use = before[:, starts] * own[piece, 0] * after[:, starts + length] * scale * weight[:, None]
                        real = piece >= 0
                        np.add.at(counts[:, lang], piece[real], use[real])
        pieces, langs = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pieces, pa.int32()), pa.array(langs, pa.int32()), pa.array(counts[pieces, langs])], names=["piece", "lang", "uses"]
        )

    return run


def _scaled(arcs: np.ndarray, chances: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of each prefix of the words, or of each suffix, (words, places + 1) for one language,
    and the logarithms that have been taken out of each. Sums are rescaled with those that later sums need."""
    words, size, longest = arcs.shape
    sums, logs, scale = np.zeros((words, size + 1)), np.zeros((words, size + 1)), np.zeros(words)
    sums[:, size if backwards else 0] = 1
    for done in range(1, size + 1):
        at = size - done if backwards else done
        for length in range(1, min(longest, done) + 1):
            start = at if backwards else at - length
            sums[:, at] += sums[:, at + length if backwards else start] * chances[arcs[:, start, length - 1], 0]
        logs[:, at] = scale
        if done % RESCALE == 0:
            low = np.maximum(sums[:, at], 1e-300)
            near = slice(at, min(size, at + longest - 1) + 1) if backwards else slice(max(0, at - longest + 1), at + 1)
            sums[:, near] /= low[:, None]
            logs[:, near] += np.log(low)[:, None]
            scale += np.log(low)
    return sums, logs


class LanguageModel:
    """Piece probabilities by language, (pieces + 2, languages)."""

    def __init__(self, pieces: list[str], languages: list[str], chances: np.ndarray):
        self.pieces, self.languages, self.chances = pieces, languages, chances


def _chances(counts: np.ndarray) -> np.ndarray:
    smooth = counts[:-1] + PRIOR
    return np.vstack([smooth / smooth.sum(axis=0), np.full((1, counts.shape[1]), STRAY), np.zeros((1, counts.shape[1]))])


def _count_words(text: str, lang: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value, language in zip(text_strings(batch.column(text)), batch.column(lang).to_pylist(), strict=True):
                counts.update((language, w) for w in words_of(value))
        if counts:
            langs, words = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    return run


def fit(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", item: str = "doc_id", documents: int = FIT_DOCUMENTS) -> LanguageModel | None:
    """Fits piece probabilities by expectation and maximisation on about ``documents`` rows with text and language.

    The languages are those of all rows. Of each language the rows count whose hash falls into its share of
    ``documents``, or of ``FIT_LEAST`` if that is more, so a rare language is learned at every size. Every round reads
    the sample's word counts and returns one number per piece and language: the vocabulary is fixed, and the languages
    are few. Words of every length count. Rows without text or language are left out; None if no rows are left, or no
    words.
    """
    pieces = vocabulary_pieces(vocabulary)
    known = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(item).cast("string").alias("item")).where(
        "text is not null and lang is not null"
    )
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(rows)
    if not languages:
        return None
    whole = sum(rows.values())
    shares = {x: min(1.0, max(documents / whole, FIT_LEAST / n)) for x, n in rows.items()}
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, round(shares[x] * 1_000_000))])[F.col("lang")]
    picked = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(1_000_000)) < share)
    counted = arrow_map(picked.select("text", "lang"), _count_words("text", "lang"), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The sample is bounded, and every round reads its words: a file for each core serves best.
    words = written(few(counted, documents), "words")
    if words.isEmpty():
        return None
    lattice = Lattice(pieces)
    counts = np.ones((len(pieces) + 1, len(languages)))
    for _ in range(ROUNDS):
        step = _expect(lattice, _chances(counts), {x: i for i, x in enumerate(languages)})
        found = arrow_map(words, step, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses")).collect()
        counts = np.zeros_like(counts)
        for piece, language, uses in found:
            counts[piece, language] = uses
    return LanguageModel(pieces, languages, _chances(counts))


class Scorer:
    """Scores whole texts and keeps the scores of words for the texts to come."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.pieces)
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and its posterior probability, all languages being equally likely before."""
        found = [words_of(t) for t in texts]
        if len(self.places) > CACHE_WORDS:
            self._clear()
        new = list({w for words in found for w in words if w not in self.places})
        if new:
            self.places.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, word_scores(self.lattice, self.model.chances, new)])
        out = []
        for words in found:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.scores[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            out.append((self.model.languages[best], float(odds[best] / odds.sum())))
        return out


def _scores(model: LanguageModel | None, texts: list[str], scorer: Scorer | None) -> list[tuple[str, float]]:
    if scorer is None:
        return [(UNKNOWN, 0.0)] * len(texts)
    out = []
    for start, end in blocks(texts, 4_000_000):
        out += scorer.score(texts[start:end])
    return out


def identify(docs: DataFrame, model: LanguageModel | None, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, lang_pred, score) of each whole text: the likeliest language and its posterior probability.

    The probability of a word is the sum over all its segmentations into pieces, that of a text the product over its
    words, which are letters and marks in lower case. Null texts and texts without a letter are ``und`` with score 0, as
    is everything if there is no model. Repeated rows give a row each; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in slices(batches, 512):
            found = _scores(model, text_strings(batch.column(text)), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(item), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[item, "lang_pred", "score"],
            )

    return arrow_map(docs.select(*dict.fromkeys([item, text])), run, extended(docs.select(item).schema, "lang_pred string, score double"))


def accept(docs: DataFrame, model: LanguageModel | None, at_least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a probability of ``at_least``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in slices(batches, 512):
            found = _scores(model, text_strings(batch.column(text)), scorer)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= at_least for lang, score in found], pa.bool_()))

    return arrow_map(docs, run, docs.schema)

