"""Embedding near-duplicates by randomised-rotation binary codes with error bounds.

Equal vectors are one row with a count. Every vector is rotated at random and kept as the
signs of its components with a correction factor, its inner product with its own code. A
code and another vector's rotated components, rounded to four bits at random, give an
unbiased estimate of their cosine, and the factor bounds its error. Sign patterns of random
planes bring candidates together: as many tables as make the chance that a pair at the
threshold shares none smaller than ``MISS``. In every bucket the estimates decide which
vectors may have a partner there; only these are fetched and compared in double precision.

Buckets are compared in tiles of two blocks, so that a large group of near copies is
spread over many tasks, and a tile returns sums and a spanning forest, never its pairs. A
pair counts in the first table that it shares, so it is counted once.

Defined cases: vectors that are null, zero, or hold null, NaN or infinite components, and
rows with a null id, link with nothing (n_links 0, a component of their own); vectors of
different length do not link; repeated rows are separate vectors that link; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.llm.common import contiguous, stage
from ringweave.llm.components import components

#: Chance, at most, that a pair at the threshold meets in no table.
MISS = 1e-3
#: Distinct vectors a bucket has on average if none are near, and those of one block of a tile.
BUCKET, BLOCK = 16, 256
#: Standard errors of an estimate that its bound allows.
SURE = 5.0
SEED = 20_240


def tables_for(n: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a pattern, tables) for ``n`` vectors and cosine ``least``."""
    bits = min(28, max(2, math.ceil(math.log2(max(2, n) / BUCKET))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree)) if agree < 1 else 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def patterns(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): sign patterns against random planes, the same for a dimension."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).normal(size=(vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _rotation(dim: int, width: int) -> np.ndarray:
    full = np.random.default_rng([SEED + 1, dim]).normal(size=(width, width))
    return np.linalg.qr(full)[0][:dim]


def codes(units: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits, correction factor, four-bit components (two a byte) and their step."""
    width = -(-units.shape[1] // 64) * 64
    rotated = units @ _rotation(units.shape[1], width)
    factor = np.abs(rotated).sum(axis=1) / math.sqrt(width)
    step = 2 * np.abs(rotated).max(axis=1) / 15
    # Rounded up or down at random, so that errors have mean zero; the id seeds the choice.
    chance = np.array([np.random.default_rng([SEED + 2, abs(int(i))]).random(width) for i in ids])
    levels = np.floor(rotated / step[:, None] + 7.5 + chance).clip(0, 15).astype(np.uint8)
    return np.packbits(rotated > 0, axis=1), factor, levels[:, ::2] << 4 | levels[:, 1::2], step


def estimates(bits: np.ndarray, factor: np.ndarray, four: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, bound) of the cosine of every code (row) with every rounded vector (column)."""
    signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
    width = signs.shape[1]
    levels = np.empty((len(four), width), np.float32)
    levels[:, ::2], levels[:, 1::2] = four >> 4, four & 15
    rounded = (levels - 7.5) * step[:, None].astype(np.float32)
    products = signs @ rounded.T / math.sqrt(width)
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / max(1, width - 1))
    bound = SURE * (spread[:, None] + step[None, :] / 2) / factor[:, None]
    return products / factor[:, None], bound


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """Equally long binary values as rows of numbers."""
    return np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(table.num_rows, -1)


def _may_link(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous(batches, 5):
            bits, four = _column(group, "bits", "u1"), _column(group, "four", "u1")
            factor, step = group["factor"].to_numpy(), group["step"].to_numpy()
            middle, bound = estimates(bits, factor, four, step)
            near = middle + bound >= least
            near &= near.T
            block, ids = group["block"].to_numpy(), group["id"].to_numpy()
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            near &= ids[:, None] != ids[None, :]
            if i != j:
                near &= block[:, None] != block[None, :]
            some = pa.array(near.any(axis=1))
            names = ["dim", "spot", "pattern", "id"]
            yield pa.RecordBatch.from_arrays(
                [group[c].combine_chunks().filter(some) for c in names], names
            )

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member reachable of each of ``n`` rows by the links (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        label = label[label]
        if (label == before).all():
            return label


def _linked(least: float, bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous(batches, 5):
            ids, copies, block = (group[c].to_numpy() for c in ("id", "copies", "block"))
            units = _column(group, "unit", "<f8")
            i, j, spot = (group[c][0].as_py() for c in ("i", "j", "spot"))
            near = units @ units.T >= least - 1e-9
            near &= ids[:, None] != ids[None, :]
            if i != j:
                near &= block[:, None] != block[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            exact = np.einsum("ij,ij->i", units[a], units[b]) >= least
            a, b = a[exact], b[exact]
            shared = patterns(units, bits, tables)
            first = (shared[a] == shared[b]).argmax(axis=1) == spot
            a, b = a[first], b[first]
            root = _forest(a, b, len(ids))
            links = np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["id", "links", "other"]
            )

    return run


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows of a bucket dealt to its tiles: pairs of blocks (i, j) with i <= j."""
    bucket = ["dim", "spot", "pattern"]
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    last = F.col("blocks") - 1
    tile = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")),
    )
    placed = (
        rows.join(sizes, bucket)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
        .withColumn("tile", F.explode(tile))
    )
    keys = ["dim", "spot", "pattern", "i", "j"]
    rest = [c for c in rows.columns if c not in bucket]
    dealt = placed.select(*bucket, "tile.i", "tile.j", "block", *rest)
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(usable, v).alias("v"))
    # Distinct vectors have keys of their own, as rows of one id may hold unlike vectors.
    alike = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = stage(alike.withColumn("id", F.monotonically_increasing_id()), "vectors")
    bits, tables = tables_for(distinct.count(), least)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = batch.column(2).flatten().to_numpy().astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                units = _unit(flat[starts[at][:, None] + np.arange(dim)])
                sign, factor, four, step = codes(units, ids[at])
                spots = patterns(units, bits, tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at]),
                        pa.array(copies[at]),
                        pa.array([dim] * len(at), pa.int32()),
                        pa.array([x.tobytes() for x in units], pa.binary()),
                        pa.array([x.tobytes() for x in sign], pa.binary()),
                        pa.array(factor),
                        pa.array([x.tobytes() for x in four], pa.binary()),
                        pa.array(step),
                        pa.array(list(spots), pa.list_(pa.int64())),
                    ],
                    ["id", "copies", "dim", "unit", "bits", "factor", "four", "step", "patterns"],
                )

    coded = stage(
        distinct.select("id", "copies", "v").mapInArrow(
            encode,
            "id bigint, copies bigint, dim int, unit binary, bits binary, factor double, four binary, step double, "
            "patterns array<bigint>",
        ),
        "codes",
    )
    light = coded.select("dim", F.posexplode("patterns").alias("spot", "pattern"), "id", "bits", "factor", "four", "step")
    hopeful = _tiles(light).mapInArrow(_may_link(least), "dim int, spot int, pattern bigint, id bigint").distinct()
    full = hopeful.join(coded.select("id", "copies", "unit"), "id").select(
        "dim", "spot", "pattern", "id", "copies", "unit"
    )
    found = stage(
        _tiles(full).mapInArrow(_linked(least, bits, tables), "id bigint, links bigint, other bigint"), "links"
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select("id", "other")).toDF("id", "root")
    rooted = distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    known = (
        rooted.join(named, "root")
        .join(links, "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    )
    return (
        rows.join(known, "v", "left")
        .withColumn("component_id", F.coalesce("component", "vec_id"))
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            "component_id",
            F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        )
    )
