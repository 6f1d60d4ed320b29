"""Exact top-k search by inner product: tiles of queries and shards, merged by a tree.

Queries and candidates are cut into blocks of bounded size. A tile is one block of
queries against one shard of candidates: a matrix product, then a partial selection of k
per query. Lists of at most k entries are merged per query in rounds of ``FAN_IN``
lists, so no task ever holds more than FAN_IN * k entries of a query.

Defined cases: vectors that are null or hold null, NaN or infinite components take no
part, neither do rows with a null id; vectors of another length than the query's are not
compared with it (length is part of the tile key); ties go to the smaller id, then to
nothing, as repeated ids are separate candidates; with fewer than k candidates all are
returned; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard and of a query block, about: they bound a tile to a few MB.
SHARD_ROWS = 2048
QUERY_ROWS = 2048
#: Lists that one merge step brings together.
FAN_IN = 8


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as BIGINT; null where the vector takes no part."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.when(
        vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    )


def _tile(queries: list, candidates: list, k: int) -> list[tuple[int, int, int, int]]:
    """(row of the query, its id, id of the candidate, score); both sides are (row, id, vector)."""
    candidates.sort(key=lambda r: r[1])
    ids = np.array([r[1] for r in candidates], np.int64)
    rows = np.array([r[0] for r in candidates], np.int64)
    vectors = np.array([r[2] for r in candidates], np.int64).reshape(len(candidates), -1)
    asked = np.array([r[2] for r in queries], np.int64).reshape(len(queries), -1)
    # Products and sums below 2^53 are exact in double precision; beyond it, use integers.
    bound = float(np.abs(asked).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float64 if bound < 2.0**53 else np.int64
    scores = (asked.astype(kind) @ vectors.astype(kind).T).astype(np.int64)
    out = []
    for (query_row, query, _), row in zip(queries, scores, strict=True):
        others = np.flatnonzero(rows != query_row)
        row = row[others]
        if len(row) > k:
            worst = np.partition(row, len(row) - k)[len(row) - k]
            above, level = np.flatnonzero(row > worst), np.flatnonzero(row == worst)
            # Candidates are in order of id, so the first ones at the level win ties.
            chosen = np.concatenate([above, level[: k - len(above)]])
        else:
            chosen = np.arange(len(row))
        out += [(query_row, query, int(ids[others[i]]), int(row[i])) for i in chosen]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) from (row, vec_id, v) and (row, query_id, v) with BIGINT arrays.

    ``row`` is a BIGINT key of its side's rows. The candidate in the query's own row, told by an
    equal key, is left out; other rows of the query's id are candidates. Every query row gets a list
    of its own, also where ids repeat.
    """
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    queries = queries.where(F.col("query_id").isNotNull() & F.col("v").isNotNull())
    shards = -(-vectors.count() // SHARD_ROWS) or 1
    blocks = -(-queries.count() // QUERY_ROWS) or 1
    left = queries.select(
        F.col("row").alias("at"),
        F.col("query_id").alias("id"),
        F.col("v").alias("asked"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.size("v").alias("dim"),
    )
    right = vectors.select(
        F.col("row").alias("at"),
        F.col("vec_id").alias("id"),
        F.col("v").alias("held"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("row", F.lit(2)), F.lit(shards)).cast("int").alias("shard"),
        F.size("v").alias("dim"),
    )

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        rows = []
        if q.num_rows and c.num_rows:
            asked, held = (
                list(zip(t["at"].to_pylist(), t["id"].to_pylist(), t[name].to_pylist(), strict=True))
                for t, name in ((q, "asked"), (c, "held"))
            )
            rows = _tile(asked, held, k)
        shard = (q if q.num_rows else c)["shard"][0].as_py()
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([shard] * len(rows), pa.int32())]
        arrays += [pa.array(columns[i], pa.int64()) for i in (2, 3)]
        return pa.Table.from_arrays(arrays, ["row", "query_id", "shard", "vec_id", "score"])

    keys = ("block", "shard", "dim")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        tile, "row bigint, query_id bigint, shard int, vec_id bigint, score bigint"
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    group = ["row", "query_id", (F.col("shard") / FAN_IN).cast("int").alias("shard")]
    merged = lists.groupBy(*group).agg(best.alias("best"))
    flat = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    groups = -(-shards // FAN_IN)
    while groups > 1:
        merged = merged.groupBy(*group).agg(flat.alias("best"))
        groups = -(-groups // FAN_IN)
    return merged.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.s")).alias("score"),
    )
