"""Sharding: exact sizes, gapless slots, the law of the matrix and of the order."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringweave.llm import sharding
from ringweave.llm.queries import op12_sharding


def _check(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs
    )
    held = Counter(r.shard for r in rows)
    assert set(held) <= set(range(shards))
    assert max(held.values(), default=0) - min((held[i] for i in range(shards)), default=0) <= 1
    for s, n in held.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


@pytest.mark.parametrize("rows,parts,shards", [(0, 1, 24), (5, 3, 24), (24, 2, 24), (1000, 40, 24), (777, 7, 5)])
def test_every_row_once_in_even_shards(spark, rows, parts, shards):
    texts = [None, "", "é" * 5, "same"]
    docs = [(i // 2 if i % 9 else None, texts[i % 4]) for i in range(rows)]
    table = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id bigint, text string, shard int, slot string")
    _check(sharding.shard(table.repartition(parts), shards).collect(), docs, shards)


def test_small_blocks_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 16)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    monkeypatch.setattr(sharding, "FAN_OUT", 2)
    docs = [(i, str(i % 10)) for i in range(600)]
    _check(sharding.shard(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9), 7).collect(), docs, 7)


def test_query_on_documents_and_reruns(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op12_sharding(spark, sf).collect()
    _check(rows, docs, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, op12_sharding(spark, sf).collect()), key=str)


@pytest.mark.parametrize("n,good,drawn", [(30, 12, 9), (50, 49, 25), (7, 3, 7), (7, 0, 3), (1000, 30, 500), (90, 60, 80)])
def test_draws_follow_the_law(spark, n, good, drawn):
    draws = 20_000
    u = sharding._uniform(n, F.col("id"))
    got = spark.range(draws).select(sharding.hypergeometric(F.lit(n), F.lit(good), F.lit(drawn), u).alias("k"))
    held = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    least, most = max(0, drawn + good - n), min(good, drawn)
    assert least <= min(held) and max(held) <= most
    for k in range(least, most + 1):
        p = math.comb(good, k) * math.comb(n - good, drawn - k) / math.comb(n, drawn)
        assert abs(held.get(k, 0) - draws * p) <= 5 * math.sqrt(draws * p * (1 - p)) + 3


def test_draws_of_large_numbers_have_mean_and_spread(spark):
    n, good, drawn = 10**10, 4 * 10**9, 10**4
    u = sharding._uniform(3, F.col("id"))
    k = sharding.hypergeometric(F.lit(n), F.lit(good), F.lit(drawn), u)
    mean, spread = spark.range(2000).select(k.alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert abs(mean - 4000) < 5 * 49 / math.sqrt(2000) and abs(spread - 49) < 5


def test_matrix_has_the_sums_asked_for(spark):
    blocks = spark.createDataFrame([(t, t * 10 + b, 3 + (t * b) % 50) for t in range(37) for b in range(3)], "task bigint, block bigint, rows bigint")
    matrix = {r.block: r.counts for r in sharding.communication_matrix(blocks, 6, seed=4).collect()}
    rows = {r.block: r.rows for r in blocks.collect()}
    assert {b: sum(c) for b, c in matrix.items()} == rows
    columns = [sum(c[i] for c in matrix.values()) for i in range(6)]
    assert sum(columns) == sum(rows.values()) and max(columns) - min(columns) <= 1


def test_seeds_give_other_orders(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(12)], "doc_id bigint, text string").coalesce(1)
    orders = set()
    for seed in (0, 1):
        rows = sharding.shard(docs, 2, seed=seed).collect()
        orders.add(tuple(r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))))
    assert len(orders) == 2
