"""Language identification by nearest centroid over hashed TF-IDF character n-grams.

A text's vector counts its 1- to 3-byte grams (lower case, runs of other characters than
letters as one blank), damped by logarithm, weighted by inverse document frequency over all
documents to learn from and normalised. Each language has several centroids from spherical k-means over a bounded
sample, so that a language with different registers is not squeezed into one mean. The
nearest centroid by cosine decides. ``reject_below`` turns a text away as ``und`` when even
that cosine is smaller, which is distance-based rejection.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text with
letters that shares no gram with any centroid gets the language with the most sampled
documents, score 0, or ``und`` under rejection; ties go to the first language by code
point; repeated rows are labelled each; with nothing to learn from all texts are ``und``;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the hashed gram space.
SLOTS = 1 << 14
#: Documents a language is learned from, about (chosen by hash), or all where there are fewer.
MAX_TRAIN = 1000
#: Bytes of a text that one block of work takes.
BLOCK = 1 << 18
CENTROIDS, ROUNDS = 4, 6
#: Tasks that add up the frequencies of the tasks that counted them; one array each to the driver.
ADDERS = 16
_BETWEEN = re.compile(r"[\W\d_]+")
_ODD, _ODDER = np.uint32(2654435761), np.uint32(2246822519)


class Model(NamedTuple):
    languages: list[str]
    of: np.ndarray  # language number per centroid
    centroids: np.ndarray  # (centroids, SLOTS), rows of length 1
    idf: np.ndarray
    fallback: int


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counts(text: str) -> np.ndarray:
    """Counts of the hashed grams of the whole text, block by block."""
    letters = f" {_BETWEEN.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass")
    raw = np.frombuffer(letters, np.uint8).astype(np.uint32)
    total = np.zeros(SLOTS, np.int64)
    for i in range(0, len(raw), BLOCK):
        one = raw[i : i + BLOCK + 2]  # with the bytes that end this block's last grams
        two = one[:-1] | one[1:] << np.uint32(8)
        three = two[:-1] | one[2:] << np.uint32(16)
        grams = np.concatenate([g[:BLOCK] * _ODD + np.uint32(40503 * n) for n, g in enumerate((one, two, three))])
        total += np.bincount(grams * _ODDER >> np.uint32(18), minlength=SLOTS)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)).astype(np.float32) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _k_means(rows: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started from rows far from each other."""
    chosen = [rows.sum(axis=0)]
    chosen = [rows[int((rows @ chosen[0]).argmax())]]
    while len(chosen) < min(k, len(rows)):
        nearest = (rows @ np.array(chosen).T).max(axis=1)
        chosen.append(rows[int(nearest.argmin())])
    centroids = np.array(chosen)
    for _ in range(ROUNDS):
        own = (rows @ centroids.T).argmax(axis=1)
        sums = np.array([rows[own == c].sum(axis=0) for c in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from (doc_id, text, lang) rows: document frequencies of all of them, centroids of
    ``max_train`` documents a language, chosen by hash of id, text and place, about, so that rows of
    one id or without one are chosen one by one. Only counts and centroids come to the driver."""
    usable = docs.where("lang is not null and text is not null and rlike(text, '\\\\p{L}')")
    spread = usable.select("lang", "text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(11)).alias("h"))
    limits = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sorted(limits.items()):
        share = F.when(F.col("lang") == lang, F.lit(max_train / n)).otherwise(share)
    sample = spread.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share * float(1 << 30))
    languages = sorted(limits)
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, SLOTS), np.float32), np.ones(SLOTS, np.float32), 0)
    return _fit(sample, languages, limits, _idf(usable.select("text")))


def _idf(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows, added up in two steps."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += counts(text.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([seen.astype("<i8").tobytes()], pa.binary()), pa.array([n], pa.int64())], ["seen", "n"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for part, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen += np.frombuffer(part.as_py(), "<i8")
                n += k
        yield pa.RecordBatch.from_arrays(
            [pa.array([seen.astype("<i8").tobytes()], pa.binary()), pa.array([n], pa.int64())], ["seen", "n"]
        )

    kinds = "seen binary, n bigint"
    rows = texts.mapInArrow(frequencies, kinds).repartition(ADDERS).mapInArrow(added, kinds).collect()
    total = sum((np.frombuffer(r["seen"], "<i8") for r in rows), np.zeros(SLOTS, np.int64))
    n = sum(r["n"] for r in rows)
    return (np.log((1.0 + n) / (1.0 + total)) + 1.0).astype(np.float32)


def _fit(sample: DataFrame, languages: list[str], limits: dict[str, int], idf: np.ndarray) -> Model:
    def cluster(group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("h", "ascending"), ("text", "ascending")])
        vectors = np.array([vector(t.as_py(), idf) for t in ordered["text"]])
        centroids = _k_means(vectors, CENTROIDS)
        return pa.Table.from_arrays(
            [
                pa.array([ordered["lang"][0].as_py()] * len(centroids), pa.string()),
                pa.array([c.astype("<f4").tobytes() for c in centroids], pa.binary()),
            ],
            ["lang", "centroid"],
        )

    found = sample.groupBy("lang").applyInArrow(cluster, "lang string, centroid binary").collect()
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    of = np.array([languages.index(r["lang"]) for r in found], np.int64)
    centroids = np.array([np.frombuffer(r["centroid"], "<f4") for r in found]).reshape(len(found), SLOTS)
    fallback = languages.index(max(sorted(limits), key=lambda k: limits[k]))
    return Model(languages, of, centroids, idf, fallback)


def predict(docs: DataFrame, model: Model, reject_below: float | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1):
                text = value.as_py()
                name, best = "und", 0.0
                if len(model.of) and has_letter(text):
                    cosines = model.centroids @ vector(text, model.idf)
                    at = int(cosines.argmax())
                    best = float(min(max(cosines[at], 0.0), 1.0))
                    if reject_below is None or best >= reject_below:
                        name = model.languages[int(model.of[at]) if best else model.fallback]
                names.append(name)
                scores.append(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
