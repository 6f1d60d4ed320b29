"""What several operators share: staged tables, word splitting, ranks without hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.session import checkpoint_dir

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage: what follows reads files that every executor reaches, so a lost
    executor costs its running tasks only. ``group_bytes`` bounds a Parquet row group
    where single values are large.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.size", group_bytes)
    writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.staged_at = path
    return written


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; what was not staged is left alone."""
    for table in tables:
        place = getattr(table, "staged_at", None)
        if place:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A staged table marked for broadcast if it is counted to have ``rows`` rows at most."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def prefix_sums(df: DataFrame, group: str, order: list[str], bucket: Column, value: Column) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of ``group`` that come earlier.

    Rows are ordered by (bucket, order). Sums per bucket are made map side, added up over
    the small table of buckets, and joined back, so that a window holds one bucket of a
    group and never a whole group. Neither ``group`` nor ``bucket`` may be null.
    """
    keyed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(group, "_bucket")
        .agg(F.sum("_value").alias("_sum"))
        .select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return (
        local.join(offsets, [group, "_bucket"])
        .withColumn("before", F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_value", "_local", "_offset")
    )


def contiguous(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The groups of rows sorted by their first ``n_keys`` integer columns, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)
