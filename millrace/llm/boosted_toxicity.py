"""Toxicity by gradient-boosted trees over dense features of the text, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import arrow_map, extended, slices, text_strings

#: Labelled rows that a model is fitted on, about: a hash of text and id picks that share of them.
FIT_ROWS = 30_000
#: Documents of the lexicon's share that must hold a word of the lexicon, and its least log-odds.
LEXICON_DOCS, LEXICON_ODDS = 5, 2.0
TREES, DEPTH, FIT_TASKS = 20, 4, 8

# Pronouns of the second person in the languages of the documents.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Digits and signs that stand for letters inside a word.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = [
    "words", "lexicon", "strong", "strongest", "disguised", "near_you", "you", "capitals", "shouted", "marks", "exclaims",
    "odd_marks", "digits", "mixed", "repeats", "word_length",
]

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<!\S)(?=\S*[0-9@$!|*#%&])\S*[^\W\d_]\S*")
_ODD = re.compile(r"[$%&*#@|+=~^<>\\]")
_MARKS = re.compile(r"[^\w\s]")
_REPEATS = re.compile(r"(\S)\1\1")
_SHOUTED = re.compile(r"\b[A-ZÄÖÜÉÈÀÇÑ]{2,}\b")


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features of one text, all densities by word or character; zeros for a text without characters."""
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text.lower())
    n, size = max(len(words), 1), len(text)
    hits = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    mixed = _MIXED.findall(text)
    disguised = 0.0
    for token in mixed:
        plain = token.strip(".,!?;:\"'").lower()
        for form in (plain.translate(LOOKALIKES), re.sub(r"[\W\d_]+", "", plain)):
            if form != plain and form in lexicon:
                disguised += lexicon[form]
                break
    near = 0
    if hits:
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        if len(you):
            near = sum(int(np.abs(you - i).min() <= 5) for i, _ in hits)
    strengths = [s for _, s in hits]
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        log(1 + n),
        sum(strengths) / n,
        sum(s >= 2 * LEXICON_ODDS for s in strengths) / n,
        max(strengths, default=0.0),
        disguised / n,
        near / n,
        sum(map(SECOND_PERSON.__contains__, words)) / n,
        capitals / size,
        len(_SHOUTED.findall(text)) / n,
        len(_MARKS.findall(text)) / size,
        text.count("!") / size,
        len(_ODD.findall(text)) / size,
        sum(map(str.isdigit, text)) / size,
        len(mixed) / n,
        len(_REPEATS.findall(text)) / n,
        sum(map(len, words)) / n,
    ]


class ToxicityModel:
    """A lexicon, trees and a calibration; without trees every score is ``constant``."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant


def _with_features(docs: DataFrame, lexicon: dict[str, float], text: str, keep: list[str]) -> DataFrame:
    schema = extended(docs.select(*keep).schema, ", ".join(f"_f_{name} double" for name in FEATURES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t, lexicon) for t in text_strings(batch.column(text))]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *columns], names=[*keep, *(f"_f_{n}" for n in FEATURES)]
            )

    return arrow_map(docs.select(*dict.fromkeys([*keep, text])), run, schema)


def _assembled(df: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="_features", handleInvalid="keep").transform(df)
    return vectors.drop(*(f"_f_{n}" for n in FEATURES))


def _raw(trees, df: DataFrame) -> DataFrame:
    scored = trees.setProbabilityCol("_chances").setRawPredictionCol("_raw").setPredictionCol("_guess").transform(df)
    return scored.withColumn("_score", vector_to_array("_chances")[1]).drop("_chances", "_raw", "_guess", "_features")


def _word_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(text_strings(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            for word in set(_WORD.findall(text.lower())):
                counts.setdefault(word, [0, 0])[label] += 1
        values = list(counts.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())],
            names=["word", "clean", "toxic"],
        )


def fit(labelled: DataFrame, item: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> ToxicityModel:
    """Fits lexicon, trees and calibration on about ``rows`` labelled rows, picked by a hash of id and text.

    Each part learns from rows of its own: two fifths give the lexicon (words by their smoothed log-odds of standing in
    a toxic document, each distinct text once), two fifths the trees, one fifth the isotonic calibration. So words that
    only a few training rows share do not look better to the trees than they are. The lexicon is as bounded as its rows.
    Rows with null labels are left out. Without rows of both classes the score is the share of toxic rows, or 0.
    """
    known = labelled.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    place = F.pmod(F.xxhash64("item", "text"), F.lit(1_000_000))
    picked = written(known.where(place < round(share * 1_000_000)).withColumn("part", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(5))), "labelled")
    counts = picked.groupBy((F.col("part") / 2).cast("int").alias("part"), "label").count().collect()
    constant = sum(r["count"] for r in counts if r["label"]) / max(1, sum(r["count"] for r in counts))
    if not {(0, 0), (0, 1), (1, 0), (1, 1)} <= {(r["part"], r["label"]) for r in counts}:
        return ToxicityModel({}, constant=constant)
    texts = picked.where("part < 2").groupBy("text").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    words = arrow_map(texts, _word_sets, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon = {r["word"]: r["odds"] for r in words.where(F.col("toxic") >= LEXICON_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEXICON_ODDS).collect()}
    rest = picked.where("part >= 2")
    # The sample is bounded, and the trees pass over it some eighty times: few partitions serve best.
    seen = written(_with_features(rest, lexicon, "text", ["part", "label"]), "features").coalesce(FIT_TASKS)
    train = _assembled(seen.where("part < 4").withColumn("label", F.col("label").cast("double")))
    booster = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64)
    trees = booster.fit(train)
    last = seen.where("part = 4")
    checked = _raw(trees, _assembled(last.withColumn("label", F.col("label").cast("double"))))
    if not last.groupBy().count().first()[0]:
        return ToxicityModel(lexicon, trees, None, constant)
    return ToxicityModel(lexicon, trees, IsotonicRegression(labelCol="label", featuresCol="_score", predictionCol="_even").fit(checked), constant)


def _scored(docs: DataFrame, model: ToxicityModel, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``_score``, a probability."""
    if model.trees is None:
        return docs.select(*keep, F.lit(float(model.constant)).alias("_score"))
    raw = _raw(model.trees, _assembled(_with_features(docs, model.lexicon, text, keep)))
    if model.calibration is None:
        return raw
    # Steps of the calibration hold many raw scores each; a trace of the raw score keeps their order.
    even = model.calibration.transform(raw)
    return even.withColumn("_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_even") * 0.999 + F.col("_score") * 0.001))).drop("_even")


def score(docs: DataFrame, model: ToxicityModel, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, score, predicted) of each whole text: the calibrated probability, and 1 where it is 0.5 or more.

    A null text is an empty one and has the features 0. Repeated rows give a row each; other columns are ignored.
    """
    scored = _scored(docs.select(F.col(item).alias("_item"), F.col(text).cast("string").alias("_text")), model, "_text", ["_item"])
    return scored.select(F.col("_item").alias(item), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic. Columns of any name come back as they are."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = f"c{docs.columns.index(text)}"
    texts = plain.withColumn("_text", F.col(place).cast("string"))
    return _scored(texts, model, "_text", plain.columns).where("_score < 0.5").select(*plain.columns).toDF(*docs.columns)
