"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, reproducible order (MD5 of the
document id), repeated up to ``max_repeats`` times. A copy's virtual finish time is the
number of words its source has served with it, divided by the source's target. Served in
order of finish time, all queues advance in proportion to their targets, and at virtual
time 1 the mix has served exactly the budget: the global order is cut there. A document
in service at the cut gives the words up to it, so a source misses its target by less
than one word. ``served`` is that order: copies range-sorted by finish time over the whole
corpus, with the budget truncated from its end; what a document gives is the sum over its copies.

Defined cases: null text counts as empty (size 0, nothing taken); a null source is a
source of its own, ordered last; rows without a doc_id are shuffled by their place; repeated
rows are separate documents, ties in the shuffle are broken by doc_id, size and place; an empty
table gives an empty mix; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import few, n_words, prefix_sums, stage

#: Words that one bucket of the shuffled order holds about; it bounds what one window task sorts.
BUCKET_ROWS = 256
#: Hex digits of the shuffle key that can name a bucket.
MAX_DIGITS = 6


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(key, source_size, n_docs, target) per source from (key, source, size) rows.

    Weights repeat along the sources in code point order. All words are shared out by
    weight; a source stops at ``max_repeats`` times its size and the excess is shared
    again among the others. Sources are taken in order of cap over weight: as long as an
    equal level over those left would exceed a source's cap, it is capped. The windows
    without a key run over one row per source.
    """
    by_source = sizes.groupBy("key", "source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    whole = Window.partitionBy()
    weighed = by_source.select(
        "*",
        F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1)
        .cast("decimal(38,0)")
        .alias("w"),
        (F.col("source_size") * max_repeats).cast("decimal(38,0)").alias("cap"),
    ).withColumns({"budget": F.sum("source_size").over(whole), "all_w": F.sum("w").over(whole)})
    earlier = Window.orderBy((F.col("cap") / F.col("w")).cast("double"), "key").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = weighed.withColumns(
        {
            "num": (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).cast("double"),
            "den": (F.col("all_w") - F.coalesce(F.sum("w").over(earlier), F.lit(0))).cast("double"),
            "weight": F.col("w").cast("double"),
            "limit": F.col("cap").cast("double"),
        }
    ).withColumn("free", F.col("num") * F.col("weight") < F.col("limit") * F.col("den"))
    level = left.withColumns(
        {
            "num": F.max(F.when(F.col("free"), F.struct("den", "num"))).over(whole)["num"],
            "den": F.max(F.when(F.col("free"), F.col("den"))).over(whole),
        }
    )
    return level.select(
        "key",
        "source_size",
        "n_docs",
        F.when(F.col("free"), F.col("weight") * F.col("num") / F.col("den"))
        .otherwise(F.col("limit"))
        .alias("target"),
    )


def queues(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One staged row per document: size, source_size, target, ``before``, the words of its source
    that precede it in the shuffled order, and ``_place``, which tells rows apart. Columns in
    ``keep`` are passed through."""
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), source_col), F.lit("null")).alias("key"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.monotonically_increasing_id()))).alias("shuffle"),
        F.monotonically_increasing_id().alias("_place"),
        *keep,
    )
    sizes = stage(sizes, "sizes")  # texts are read once
    plan = stage(targets(sizes, weights, max_repeats), "targets")
    # Enough digits that a bucket of this source holds about BUCKET_ROWS rows, at any size.
    digits = F.least(
        F.greatest(F.ceil(F.log2(F.col("n_docs") / BUCKET_ROWS) / 4), F.lit(0)), F.lit(MAX_DIGITS)
    ).cast("int")
    with_plan = sizes.drop("source").join(few(plan), "key").withColumn("digits", digits)
    queued = prefix_sums(
        with_plan,
        "key",
        ["shuffle", "doc_id", "size", "_place"],
        F.expr("substring(shuffle, 1, digits)"),
        F.col("size"),
    )
    return stage(queued.select("doc_id", "size", "source_size", "target", "before", "shuffle", "_place", *keep), "queues")


def served(queued: DataFrame, max_repeats: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """(_place, copy, words, finish): every copy that the mix serves, range-sorted by finish time,
    with the columns in ``keep``.

    A copy starts where its queue has served what is before it, and gives all its words if it
    finishes by virtual time 1. Of those in service then, one per source at most, the words up
    to that time count; copies that start later are past the budget.
    """
    goal = F.round("target").cast("bigint")
    epochs = F.filter(
        F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: e * F.col("source_size") + F.col("before") < goal
    )
    started = queued.where("size > 0").select("*", F.explode(epochs).alias("copy"))
    start = F.col("copy") * F.col("source_size") + F.col("before")
    copies = started.select(
        "_place",
        "copy",
        F.least(F.col("size"), goal - start).alias("words"),
        ((start + F.col("size")) / F.col("target")).alias("finish"),
        *keep,
    )
    order = ["finish", "_place", "copy"]
    return stage(copies.repartitionByRange(*order).sortWithinPartitions(*order), "served")


def mix(docs: DataFrame, max_repeats: int = 3, **columns) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and ``taken``, the words that the
    served copies of it hold. Takes the options of ``queues``."""
    queued = queues(docs, max_repeats=max_repeats, **columns)
    taken = served(queued, max_repeats).groupBy("_place").agg(F.sum("words").alias("taken"))
    return queued.join(taken, "_place", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
