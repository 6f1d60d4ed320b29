"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, pairs of neighbours and pairs
with one word between. Training takes a bounded sample of labelled texts; each coordinate
has its own learning rate, and L1 keeps only the weights that matter, so that what is
shipped to every scoring task is a few hundred numbers, ``2 ** BITS`` at most whatever the
corpus. A part of the sample that training does not see calibrates the score.

Defined cases: null and empty texts have no feature and score by the bias alone; labels
that are null, or of documents that are not in the table, teach nothing; a document with
several labels counts as toxic if one says so; repeated rows are scored each; without any
usable label every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feature space: 2 ** BITS weights at most.
BITS = 20
#: Labelled documents that training uses at most, chosen by hash of their id.
MAX_TRAIN = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.0
#: Words whose hashes a worker keeps.
KNOWN = 300_000
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


_hashes = _Hashes()
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers of a text; 0 is the bias and always there."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    one, two, skip = _MULTIPLIERS
    mixed = np.concatenate([h * one, h[:-1] * one + h[1:] * two, h[:-2] * one + h[2:] * skip])
    return np.unique(np.concatenate([[0], (mixed >> np.uint64(64 - bits)).astype(np.int64)]))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def train_rows(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, weights) that are not zero after ``EPOCHS`` passes of FTRL-proximal."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1 * (at > 0), 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, label in rows:
            w = weights(at)
            g = _sigmoid(w.sum()) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    every = np.flatnonzero(z)
    w = weights(every)
    return every[w != 0], w[w != 0]


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through held-back margins, by Newton steps; a
    unit prior keeps them near (1, 0) where there are few labels."""
    x = np.array([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(at @ x, -30, 30)))
        gradient = x @ (p - labels) + (at - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.eye(2), gradient)
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 1e-3), float(at[1])


class Model(NamedTuple):
    at: np.ndarray  # numbers of the features kept
    weights: np.ndarray
    slope: float
    shift: float


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic).

    The sample of labels, ``max_train`` rows at most, is broadcast to the documents, whose
    features are made where they lie. One task learns from four fifths of the sample, so
    the bound also bounds its memory; the rest calibrates the score.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic is not null")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect()
    if not sample:
        return Model(np.zeros(0, np.int64), np.zeros(0), 1.0, 0.0)
    chosen = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in sample], "doc_id bigint, toxic int")
    taught = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    held_back = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "found"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        rows.sort()
        order = np.random.default_rng(7).permutation(len(rows))
        at, w = train_rows([(np.frombuffer(rows[i][2], "<i4"), rows[i][1]) for i in order])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    described = taught.where(~held_back).mapInArrow(describe, "doc_id bigint, toxic int, found binary")
    learned = described.repartition(1).mapInArrow(learn, "at bigint, w double").collect()
    raw = Model(np.array([r["at"] for r in learned], np.int64), np.array([r["w"] for r in learned], float), 1.0, 0.0)
    checked = margins(taught.where(held_back), raw, "toxic").collect()
    seen = np.array([[r["margin"], r["toxic"]] for r in checked], float).reshape(-1, 2)
    slope, shift = calibrate(seen[:, 0], np.minimum(seen[:, 1], 1.0))
    return raw._replace(slope=slope, shift=shift)


class Scorer:
    def __init__(self, model: Model, bits: int = BITS):
        self.dense = np.zeros(1 << bits, np.float32)
        self.dense[model.at] = model.weights
        self.model = model

    def margin(self, text: str | None) -> float:
        return float(self.dense[features(text)].sum(dtype=np.float64))

    def __call__(self, text: str | None) -> float:
        if not len(self.model.at):
            return 0.0
        return float(_sigmoid(self.model.slope * self.margin(text) + self.model.shift))


def margins(docs: DataFrame, model: Model, label_col: str) -> DataFrame:
    """(margin, label) of (text, label) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.margin(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], ["margin", label_col])

    return docs.select("text", F.col(label_col).cast("int").alias(label_col)).mapInArrow(
        run, f"margin double, {label_col} int"
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose ``text`` scores below ``below``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < below for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
