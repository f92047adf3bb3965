"""Quality by positive-unlabelled learning: trusted positives and unlabelled text, with the non-negative unbiased risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log, sqrt
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import arrow_map, extended, slices, text_bytes

#: Positives and unlabelled rows that a model is fitted on, about, each: a hash of text and id picks that share of them.
FIT_ROWS = 20_000
#: Tasks that share those rows, passes over them at most, and the weight of the squared coefficients.
FIT_TASKS, PASSES, RIDGE = 8, 25, 1e-3
#: Bins of scores that the class prior is read off, their width in the logit, and the chance that its bound fails.
BINS, BIN_WIDTH, DELTA = 1000, 0.05, 0.1

_SENTENCE, _ODD = b".?", b"$%&*#@^~<>=_+\\/"
FEATURES = [
    "words", "word_length", "richness", "repeats", "pairs", "commonest", "lines", "same_lines", "capitals", "exclaims",
    "bars", "odd_marks", "sentence_marks", "commas", "digits", "other_marks", "high_bytes", "controls",
]
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "!|,.?$%&*#@^~<>=_+\\/"]


def features(text: bytes) -> list[float]:
    """The features of one text as UTF-8: roots of shares by word or byte; zeros for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = Counter(words)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line]
    shares = [
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
        counts.most_common(1)[0][1] / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        bytes_[65:91].sum() / size,
        bytes_[33] / n,
        bytes_[124] / n,
        bytes_[list(_ODD)].sum() / n,
        bytes_[list(_SENTENCE)].sum() / n,
        bytes_[44] / n,
        bytes_[48:58].sum() / size,
        bytes_[_OTHER].sum() / n,
        bytes_[128:].sum() / size,
        (bytes_[:9].sum() + bytes_[14:32].sum() + bytes_[127]) / size,
    ]
    return [log(1 + n), sqrt(size / n), log(1 + len(counts)) / log(1 + n), *(sqrt(float(s)) for s in shares)]


@dataclass
class QualityModel:
    """Coefficients over centred and scaled features, the last one constant, and the class prior they stand on.

    Without coefficients every score is ``constant``.
    """

    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.0
    constant: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.constant)
        return _sigmoid(_design(rows, self.centre, self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _design(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    scaled = np.clip((rows - centre) / scale, -8, 8)
    return np.hstack([scaled, np.ones((len(rows), 1))])


def _packed_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to tiles: the features of up to a slice of rows of one kind, as doubles."""
    for batch in slices(batches):
        kinds = batch.column("positive").to_pylist()
        halves = batch.column("half").to_pylist()
        tiles: dict[tuple, list] = {}
        for text, positive, half in zip(text_bytes(batch.column("text")), kinds, halves, strict=True):
            tiles.setdefault((positive, half), []).append(features(text))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in tiles], pa.bool_()),
                pa.array([k[1] for k in tiles], pa.int32()),
                pa.array([np.array(rows).tobytes() for rows in tiles.values()], pa.binary()),
            ],
            names=["positive", "half", "tile"],
        )


def _rows(tile: bytes) -> np.ndarray:
    return np.frombuffer(tile, np.float64).reshape(-1, len(FEATURES))


def _summed(tiles: DataFrame, work) -> np.ndarray:
    """The sum of ``work(rows, positive)``, an array of fixed size, over all tiles: one array per task comes back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for tile, positive in zip(batch.column("tile").to_pylist(), batch.column("positive").to_pylist(), strict=True):
                part = work(_rows(tile), positive)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = arrow_map(tiles.select("tile", "positive"), run, "sums binary").collect()
    return sum(np.frombuffer(r["sums"], np.float64) for r in found)


def _pass(tiles: DataFrame, model: tuple[np.ndarray, np.ndarray], weights: np.ndarray):
    """Sums over positives and unlabelled rows at ``weights``: for each kind its rows, the loss as a negative and as a
    positive, their gradients, and the curvature."""
    d = len(weights)

    def work(rows: np.ndarray, positive: bool) -> np.ndarray:
        x = _design(rows, *model)
        z = x @ weights
        s = _sigmoid(z)
        as_negative = np.logaddexp(0, z).sum()
        part = np.concatenate([[len(x), as_negative, as_negative - z.sum()], s @ x, (s - 1) @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])
        out = np.zeros((2, part.size))
        out[int(positive)] = part
        return out.ravel()

    sums = _summed(tiles, work).reshape(2, -1)
    kinds = []
    for row in sums:
        n = max(row[0], 1.0)
        kinds.append((row[1] / n, row[2] / n, row[3 : 3 + d] / n, row[3 + d : 3 + 2 * d] / n, row[3 + 2 * d :].reshape(d, d) / n))
    return kinds


def _ridge(weights: np.ndarray) -> np.ndarray:
    return RIDGE * np.append(weights[:-1], 0.0)


def _separator(tiles: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Logistic regression of positives against unlabelled rows, both kinds of equal weight, by Newton's method."""
    weights = np.zeros(len(FEATURES) + 1)
    for _ in range(PASSES):
        (_, _, as_negative, _, bend_u), (_, _, _, as_positive, bend_p) = _pass(tiles, model, weights)
        gradient = as_negative + as_positive + _ridge(weights)
        step = np.linalg.solve(bend_u + bend_p + RIDGE * np.eye(len(weights)), gradient)
        weights = weights - step / max(1.0, np.linalg.norm(step) / 4)
        if np.abs(step).max() < 1e-4:
            break
    return weights


def _prior(tiles: DataFrame, model: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> float:
    """The share of positives among unlabelled rows, by the best bin: where only positives score high, the unlabelled
    rows above a score are that share of the positives above it. The score is the one of the least upper bound."""

    def work(rows: np.ndarray, positive: bool) -> np.ndarray:
        z = _design(rows, *model) @ weights
        bins = np.clip((z / BIN_WIDTH + BINS / 2).astype(np.int64), 0, BINS - 1)
        out = np.zeros((2, BINS))
        out[int(positive)] = np.bincount(bins, minlength=BINS)
        return out.ravel()

    unlabelled, positive = _summed(tiles, work).reshape(2, -1)
    if not unlabelled.sum() or not positive.sum():
        return 0.5
    above_u, above_p = (np.cumsum(x[::-1]) / x.sum() for x in (unlabelled, positive))
    slack = sqrt(log(4 / DELTA) / (2 * unlabelled.sum())) + sqrt(log(4 / DELTA) / (2 * positive.sum()))
    some = above_p > 0
    best = np.argmin((above_u[some] + slack) / above_p[some])
    return float(np.clip(above_u[some][best] / above_p[some][best], 0.01, 0.99))


def _minimised(tiles: DataFrame, model: tuple[np.ndarray, np.ndarray], prior: float) -> np.ndarray:
    """The coefficients of the least non-negative unbiased risk: prior * P(loss as positive) + max(0, N), where
    N = U(loss as negative) - prior * P(loss as negative) is the risk on the negatives that nobody labelled.

    While N is not below zero the steps are Newton's; the logistic loss makes the whole convex. Once N is below zero,
    which no real risk is, a step raises N again, and the search ends where neither gains.
    """
    weights, best, least = np.zeros(len(FEATURES) + 1), None, np.inf
    for _ in range(PASSES):
        (as_n_u, _, slope_u, _, bend_u), (as_n_p, as_p_p, slope_n, slope_p, bend_p) = _pass(tiles, model, weights)
        negatives = as_n_u - prior * as_n_p
        risk = prior * as_p_p + max(0.0, negatives) + 0.5 * weights @ _ridge(weights)
        if risk < least:
            best, least = weights, risk
        if negatives >= 0:
            # The curvature of the two losses of a positive cancels.
            gradient = prior * slope_p + slope_u - prior * slope_n + _ridge(weights)
            step = np.linalg.solve(bend_u + RIDGE * np.eye(len(weights)), gradient)
        else:
            gradient = prior * slope_n - slope_u
            step = np.linalg.solve(bend_u + prior * bend_p + RIDGE * np.eye(len(weights)), gradient)
        weights = weights - step / max(1.0, np.linalg.norm(step) / 4)
        if np.abs(step).max() < 1e-4:
            break
    return best


def _sampled(docs: DataFrame, item: str, text: str, rows: int) -> DataFrame:
    picked = docs.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    share = min(1.0, rows / max(picked.count(), 1))
    place = F.pmod(F.xxhash64("item", "text"), F.lit(1_000_000))
    half = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(2)).cast("int").alias("half")
    return picked.where(place < round(share * 1_000_000)).select("text", half)


def fit(positives: DataFrame, unlabelled: DataFrame, item: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> QualityModel:
    """Fits a model on the texts of trusted ``positives`` and of ``unlabelled`` rows, about ``rows`` of each, picked by a
    hash of id and text. No negative is ever read.

    Half of the texts give a first separator of the two kinds; on the other half its scores give the class prior; then
    all give the coefficients. Sums over the rows are made by tasks, a pass each. Without positives every score is 0,
    without unlabelled rows it is 1. Null texts are empty.
    """
    both = _sampled(positives, item, text, rows).withColumn("positive", F.lit(True)).unionByName(
        _sampled(unlabelled, item, text, rows).withColumn("positive", F.lit(False))
    )
    tiles = written(arrow_map(both, _packed_features, "positive boolean, half int, tile binary"), "tiles").coalesce(FIT_TASKS)
    kinds = {r[0] for r in tiles.select("positive").distinct().collect()}
    if kinds != {True, False}:
        return QualityModel(constant=float(True in kinds))
    width = len(FEATURES)
    sums = _summed(
        tiles.where("not positive"), lambda x, _: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
    )
    centre = sums[1 : 1 + width] / sums[0]
    spread = np.sqrt(np.maximum(sums[1 + width :] / sums[0] - centre**2, 0))
    model = centre, np.where(spread > 1e-6, spread, 1.0)
    prior = _prior(tiles.where("half = 1"), model, _separator(tiles.where("half = 0"), model))
    return QualityModel(*model, _minimised(tiles, model, prior), prior)


def score(docs: DataFrame, model: QualityModel, item: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(item, score, predicted) of each whole text: the probability of a positive, and 1 where it is ``threshold`` or more.

    A null text is an empty one and has the features 0. Repeated rows give a row each; other columns are ignored; an
    empty table gives no rows.
    """
    picked = docs.select(F.col(item).alias("_item"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.scores(np.array([features(t) for t in text_bytes(batch.column("_text"))]).reshape(-1, len(FEATURES)))
            predicted = pa.array((found >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("_item"), pa.array(found), predicted], names=["_item", "score", "predicted"])

    schema = extended(picked.select("_item").schema, "score double, predicted int")
    return arrow_map(picked, run, schema).withColumnRenamed("_item", item)
