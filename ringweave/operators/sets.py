"""Set difference, maxima with ties, and dense numbering."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.session import materialise


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have.

    ``left`` is made distinct before the join, so a frequent key is one row there.
    """
    keys = list(keys)
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


#: Groups whose largest value so far a task remembers.
KNOWN_GROUPS = 100_000


def _rising(groups: list[str], value: str):
    """Rows that are not below the largest value their task has seen in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            seen = rows.select([*groups, value]).rename_columns([*groups, "top"])
            both = seen if known is None else pa.concat_tables([known, seen])
            known = both.group_by(groups).aggregate([("top", "max")]).rename_columns([*groups, "top"])
            best = rows.join(known, groups, join_type="inner")
            yield from best.filter(pc.equal(best[value], best["top"])).select(batch.schema.names).to_batches()
            if known.num_rows > KNOWN_GROUPS:
                known = None

    return run


def top_with_ties(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Every row that ties for the largest ``value`` of its group; null groups and values have none.

    One pass over ``df``: every task drops rows below the largest value it has met in their
    group, in bounded memory, and what is left is written. The maxima come from there (partial
    before the shuffle), and the rows that reach them. ``df`` is computed once, and no task ever
    holds a whole group, as a rank window would.
    """
    groups = list(groups)
    left = df.mapInArrow(_rising(groups, value), df.schema)
    left = materialise(left, f"rising-{uuid.uuid4().hex}")
    best = left.groupBy(*groups).agg(F.max(value).alias(value))
    return left.join(best, groups + [value], "left_semi")


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """``df`` with numbers 0, 1, ... without gaps in the order of ``order``.

    Two passes over a range-sorted table: rows are numbered within their partition while it
    is written; the partitions' sizes, one row each, then give every partition its offset. With
    an ``order`` that tells all rows apart reruns give the same numbers.
    """
    order = list(order)
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the row's number in it
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    written = materialise(ranged, f"indexed-{uuid.uuid4().hex}")
    at = written.withColumn("_part", F.shiftright("_place", 33))
    sizes = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    numbered = at.join(F.broadcast(offsets), "_part")  # one row per partition
    number = F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, number).drop("_part", "_place", "_offset")
