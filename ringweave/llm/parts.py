"""Documents in parts that passes come back to, and questions that parts ask each other.

An operator that compares all documents with all others reads them several times, and
between the passes each part of the input learns what other parts hold. The table of parts
is written once, bucketed by part, so that the answers to a part's questions join its
documents without another shuffle of the texts. Questions are sorted 64-bit keys in one
binary value per part and range of keys: what many parts hold is asked once by each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.llm.common import partitions
from ringweave.session import checkpoint_dir


#: Rows of a part at most: what one task holds at a time.
PART_ROWS = 2048


def parted(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``docs`` with the columns ``_part``, ``part_rows`` rows that one task read, and ``_at``, a row's place.

    A bucketed table under the checkpoint folder; no shuffle, one file a task.
    """
    spark = docs.sparkSession
    name = f"parts_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}"
    at = F.monotonically_increasing_id()  # the task above 33 bits of the row's number
    rows = docs.select("*", F.floor(at / part_rows).alias("_part"), at.alias("_at"))
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(partitions(spark), "_part").saveAsTable(name)
    return spark.table(name)


def per_part(parts: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, answers: DataFrame | None = None) -> DataFrame:
    """``run`` on every part's rows in order, with the answers to the part where given."""
    if answers is None:
        return parts.groupBy("_part").applyInArrow(lambda rows: run(rows.sort_by("_at")), schema)

    def both(rows: pa.Table, told: pa.Table) -> pa.Table:
        return run(rows.sort_by("_at") if rows.num_rows else rows, told)

    return parts.groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(both, schema)


def split_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted uint64 keys are cut into ``n`` equal ranges of the key space."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of every range in this task; ranges are told apart by their first column."""
    by_range: dict[int, list] = {}
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        for number in np.unique(numbers).tolist():
            by_range.setdefault(number, []).append(batch.filter(pa.array(numbers == number)))
    yield from by_range.values()


ASKED = "range int, _part bigint, keys binary, several binary"


def ask_repeated(part: int, keys: np.ndarray, n: int) -> pa.Table:
    """Questions of a part: which of its keys are held twice, by it or by another part?"""
    unique, counts = np.unique(keys, return_counts=True)
    cuts = split_keys(unique, n)
    spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pa.Table.from_arrays(
        [
            pa.array([i for i, _, _ in spans], pa.int32()),
            pa.array([part] * len(spans), pa.int64()),
            pa.array([unique[a:b].astype("<u8").tobytes() for _, a, b in spans], pa.binary()),
            pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in spans], pa.binary()),
        ],
        ["range", "_part", "keys", "several"],
    )


def answer_repeated(asked: DataFrame, n: int) -> DataFrame:
    """(_part, kind, keys): the keys that are held twice, per part."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_ranges(batches):
            table = pa.Table.from_batches(rows)
            lists = [np.frombuffer(k, "<u8") for k in table["keys"].to_pylist()]
            several = [
                np.unpackbits(np.frombuffer(b, "u1"), count=len(k)).astype(bool)
                for b, k in zip(table["several"].to_pylist(), lists, strict=True)
            ]
            keys = np.concatenate(lists)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            same = ordered[1:] == ordered[:-1]
            twice = np.zeros(len(keys), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            twice |= np.concatenate(several)
            ends = np.cumsum([len(k) for k in lists])[:-1]
            told = [k[t].tobytes() for k, t in zip(lists, np.split(twice, ends), strict=True)]
            parts = table["_part"].combine_chunks()
            kinds = pa.array([1] * len(told), pa.int32())
            yield pa.RecordBatch.from_arrays([parts, kinds, pa.array(told, pa.binary())], ["_part", "kind", "keys"])

    dealt = asked.repartitionById(n, F.col("range"))
    return dealt.mapInArrow(judge, "_part bigint, kind int, keys binary")


def told_keys(told: pa.Table, kind: int) -> np.ndarray:
    """Sorted keys of the answers of one kind."""
    values = [v for k, v in zip(told["kind"].to_pylist(), told["keys"].to_pylist(), strict=True) if k == kind]
    return np.sort(np.frombuffer(b"".join(values), "<u8"))


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.searchsorted(known, keys).clip(max=len(known) - 1)] == keys


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
