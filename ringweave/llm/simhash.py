"""SimHash near-duplicates: fingerprints linked by the generalised pigeonhole principle.

Two fingerprints that differ in at most T bits must, for any split of the bits into m
partitions with thresholds that add up to T - m + 1, differ by at most its threshold in
one partition. Bits that go together in a sample share a partition, so that a partition
repeats what others say as little as possible, and dynamic programming gives each
partition the threshold (-1 leaves it out) for which the fewest candidates are expected.
Equal fingerprints are one row from then on. Candidates share a partition's value, or a
variant of it within the threshold, and every candidate is verified.

A value that more than ``BUCKET`` fingerprints share is resolved another exact way: two
fingerprints are within two bits exactly if a third is within one bit of both, and no
third has more than 65 such neighbours. No group of near copies is expanded into pairs.

Defined cases: texts without a word (null and empty ones too) have fingerprint zero and
link like any other; repeated rows get equal fingerprints and one component; a null
doc_id gets the component of its fingerprint, null if no document with an id is in it;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.llm.common import stage
from ringweave.llm.components import components

#: Fingerprints, at most about, that the split of the bits is learned from on the driver.
SAMPLE = 8192
#: Fingerprints of one partition value that are compared pair by pair.
BUCKET = 64
_BYTES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, least bit first."""
    counts = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = hashes[i : i + 255 * 64]
        lanes = (part[None, :] >> _SHIFTS) & _BYTES  # bit 8 * byte + shift, one per byte
        lanes = np.pad(lanes, ((0, 0), (0, -len(part) % 255))).reshape(8, -1, 255).sum(axis=2)
        counts += np.ascontiguousarray(lanes).view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64).T
    return counts.ravel()


def fingerprint(text: bytes, size: int = 3) -> int:
    """Majority of the XXH64 (seed 42) of all shingles of ``size`` lower-cased words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    shingles = zip(starts, ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(whole[s:e], 42) for s, e in shingles], np.uint64)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, key_col: str | None = None
) -> DataFrame:
    """(doc_id, fp[, key_col]) with the fingerprint, and the key of the row, as signed BIGINT."""
    keys = [key_col] if key_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", size) for t in texts], np.uint64)
            columns = [batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *keys])

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(k).cast("bigint") for k in keys)
    )
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["doc_id", "fp", *keys]))


def _grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Equal parts of the 64 bits; each starts with the bit that goes most with the rest."""
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    bits /= np.maximum(bits.std(axis=0), 1e-9)
    together = np.abs(bits.T @ bits) / max(1, len(sample))
    free, out = set(range(64)), []
    for i in range(parts):
        goal = len(free) // (parts - i)
        rest = sorted(free)
        group = [max(rest, key=lambda b: together[b, rest].sum())]
        while len(group) < goal:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: together[b, group].sum()))
        free -= set(group)
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _flips(bits: list[int], most: int) -> list[int]:
    return [_mask(list(c)) for n in range(1, most + 1) for c in combinations(bits, n)]


def _cost(sample: np.ndarray, n: int, bits: list[int], threshold: int) -> float:
    """Expected candidates of a partition, plus the rows written for it."""
    if threshold < 0:
        return 0.0
    values, counts = np.unique(sample & np.uint64(_mask(bits)), return_counts=True)
    pairs = float((counts * (counts - 1)).sum())
    flips = _flips(bits, threshold)
    for flip in flips:
        at = np.searchsorted(values, values ^ np.uint64(flip)).clip(max=len(values) - 1)
        pairs += float((counts * counts[at] * (values[at] == values ^ np.uint64(flip))).sum())
    share = max(pairs / max(1, len(sample)) ** 2, (1 + len(flips)) / 2.0 ** len(bits))
    return share * n * n / 2 + n * (1 + len(flips))


def split(sample: np.ndarray, n: int, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) per partition with the least expected cost among 1 to most + 2 partitions."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, most + 3):
        groups = _grouped_bits(sample, parts)
        costs = [{t: _cost(sample, n, g, t) for t in range(-1, most + 1)} for g in groups]
        # reach[s]: least cost of the partitions so far whose thresholds add up to s
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in reach.items():
                for t, more in cost.items():
                    if s + t not in step or c + more < step[s + t][0]:
                        step[s + t] = (c + more, [*chosen, t])
            reach = step
        total, chosen = reach[most - parts + 1]
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _entries(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, own): each fingerprint under its values and, not own, their variants."""

    def entry(part: int, bits: list[int], flip: int) -> Column:
        return F.struct(
            F.lit(part).alias("part"),
            F.lit(_signed(_mask(bits))).cast("bigint").alias("mask"),
            F.lit(_signed(flip)).cast("bigint").alias("flip"),
        )

    all_entries = F.array(*(entry(i, b, f) for i, (b, t) in enumerate(plan) for f in [0, *_flips(b, t)]))
    value = F.col("fp").bitwiseAND(F.col("e.mask")).bitwiseXOR(F.col("e.flip"))
    return fps.select("fp", F.explode(all_entries).alias("e")).select(
        "e.part", value.alias("value"), "fp", (F.col("e.flip") == 0).alias("own")
    )


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for members in batch.column(0).to_pylist():
                fps = np.array([m["fp"] for m in members], np.int64)
                own = np.array([m["own"] for m in members])
                bits = fps.view(np.uint64)
                near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most
                a, b = np.nonzero(near & own[:, None] & (fps[:, None] != fps[None, :]))
                found[0].extend(fps[a].tolist())
                found[1].extend(fps[b].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return run


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that differ in at most
    ``most`` (0 to 2) bits, directly or over others in the table."""
    if not 0 <= most <= 2:
        raise ValueError("at most two differing bits")
    n = max(1, fps.count())
    some = fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(max(1, n // SAMPLE))) == 0)
    sample = np.array([r.fp for r in some.collect()], np.int64).view(np.uint64)
    entries = _entries(fps, split(sample, n, most))
    sizes = entries.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where(
        "n > 1 and any"
    )
    kept = stage(entries.join(sizes, ["part", "value"]).drop("any"), "entries")
    small = (
        kept.where(F.col("n") <= BUCKET)
        .groupBy("part", "value")
        .agg(F.collect_list(F.struct("fp", "own")).alias("members"))
        .select("members")
        .mapInArrow(_verify(most), "a bigint, b bigint")
    )
    # Around a shared neighbour everything is within two bits, so the least one links them.
    # With fewer bits allowed, neighbours are counted from the fingerprints themselves.
    crowded = kept.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(*(F.lit(_signed(f)) for f in [0] + [1 << b for b in range(64)] * (most > 0)))
    around = crowded.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), (F.col("flip") == 0).alias("self")
    )
    if most == 1:
        # Only a middle that is itself a fingerprint links its neighbours, and only to itself.
        centres = crowded.select(F.col("fp").alias("middle"))
        large = around.join(centres, "middle", "left_semi").where(~F.col("self")).select("fp", "middle")
    elif most == 0:
        large = around.select("fp", "middle").where("false")
    else:
        least = around.groupBy("middle").agg(F.min("fp").alias("root"), F.count(F.lit(1)).alias("k")).where("k > 1")
        large = around.join(least, "middle").where("fp <> root").select("fp", "root")
    return small.union(large)


def near_duplicates(fps: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id, root) from staged (doc_id, fp) rows; further columns are kept.

    ``root`` is a fingerprint that names the component, also where ids repeat or are null."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), most)).toDF("fp", "root")
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    names = labelled.join(firsts, "root").select("fp", "component_id", "root")
    return fps.join(names, "fp")
