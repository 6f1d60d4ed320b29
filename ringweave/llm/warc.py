"""WARC fixity: where a replica of an archive differs, found by comparing Merkle trees.

Every replica builds its own tree, alone. The leaves of a file's tree are fixed ranges of
``RANGE_IDS`` record ids, so a lost record does not shift its neighbours; a leaf's digest covers
the digests and lengths of its records, and an inner node those of its ``FAN_OUT`` children in
order. With the sums of lengths a node also stands for a range of offsets. Roots are compared
first, then only the children of nodes that differ. Records are joined only under leaves that
differ: those of the reference that the replica lost, changed or resized, and those it added.

A leaf's digest is made of sums over its records' digests, which add up map side, so neither
many copies of one id nor many records without one have to be brought together.

Defined cases: null url and html are empty; a null file is the file "null"; records without an id
stand first, spread over leaves by their digest; copies of one id are told apart by digest order;
a lost record is ``missing``, one of another length ``resized``, else ``changed``; what only the
replica has is ``extra`` and has no offset; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import few, stage

#: Children of a node of the tree.
FAN_OUT = 16
#: Record ids of a leaf.
RANGE_IDS = 256
#: Leaves per file that records without an id are spread over.
NULL_LEAVES = 64


def response_record(record_id: Column, url: Column, payload: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """One WARC response record as text; nulls are empty. ``date`` is when it was captured."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def hashed(records: DataFrame) -> DataFrame:
    """(file, node, record_id, length, digest) of (file, record_id, content) rows."""
    content = F.coalesce(F.col("content"), F.lit(""))
    rows = records.select(
        F.coalesce(F.col("file").cast("string"), F.lit("null")).alias("file"),
        F.col("record_id").cast("bigint").alias("record_id"),
        F.octet_length(content).cast("bigint").alias("length"),
        F.sha2(content.cast("binary"), 256).alias("digest"),
    )
    spread = -1 - F.pmod(F.xxhash64("digest"), F.lit(NULL_LEAVES))
    return rows.withColumn("node", F.coalesce(F.floor(F.col("record_id") / RANGE_IDS), spread).cast("bigint"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, node, bytes, digest): the leaves of a replica's trees, from its ``hashed`` records."""
    # Sums of 60-bit parts of a hash of id, length and digest, exact in DECIMAL.
    own = F.sha2(F.concat_ws(" ", F.coalesce(F.col("record_id").cast("string"), F.lit("null")), "length", "digest"), 256)
    parts = [F.conv(F.substring(own, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = records.groupBy("file", "node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts))
    )
    return sums.select("file", "node", "bytes", F.sha2(F.concat_ws(" ", "n", "bytes", *(f"s{i}" for i in range(4))), 256).alias("digest"))


def _parents(nodes: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    named = F.transform(children, lambda c: F.concat_ws(" ", c["node"], c["digest"]))
    return nodes.groupBy("file", F.floor(F.col("node") / FAN_OUT).cast("bigint").alias("node")).agg(
        F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws(",", named), 256).alias("digest")
    )


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Staged node tables (file, node, bytes, digest) from the leaves up."""
    levels = [stage(leaves(records), "leaves")]
    for _ in range(height):
        levels.append(stage(_parents(levels[-1]), "nodes"))
    return levels


def differing(mine: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, node) of the leaves that differ, found from the roots down."""
    suspects = None
    for ours, other in zip(reversed(mine), reversed(theirs), strict=True):
        ours, other = (t.select("file", "node", F.col("digest").alias(d)) for t, d in ((ours, "own"), (other, "other")))
        if suspects is not None:
            parent = F.floor(F.col("node") / FAN_OUT).cast("bigint")
            ours, other = (t.withColumn("parent", parent).join(few(suspects), ["file", "parent"], "left_semi").drop("parent") for t in (ours, other))
        wrong = ours.join(other, ["file", "node"], "full").where(~F.col("own").eqNullSafe(F.col("other")))
        suspects = stage(wrong.select("file", F.col("node").alias("parent")), "suspects")
    return suspects.withColumnRenamed("parent", "node")


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, record_id, copy, kind, offset, length) of every record that the replica lost,
    changed or added. Both are (file, record_id, content) tables."""
    listed, held = stage(hashed(reference), "reference"), stage(hashed(replica), "replica")
    height = 0
    most = max(t.agg(F.max(F.abs("node"))).first()[0] or 0 for t in (listed, held))
    while most > 1:
        most, height = -(-most // FAN_OUT), height + 1
    mine = tree(listed, height)
    wrong = differing(mine, tree(held, height))

    # Where the leaves that differ begin: the bytes of the leaves before them in their file.
    before = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    starts = mine[0].select("file", "node", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    few_wrong = few(wrong)
    ordered = Window.partitionBy("file", "node").orderBy("record_id", "digest")
    copy = F.row_number().over(Window.partitionBy("file", "node", "record_id").orderBy("digest"))

    def under(records: DataFrame) -> DataFrame:
        return records.join(few_wrong, ["file", "node"], "left_semi").withColumn("copy", copy)

    offset = F.coalesce(F.sum("length").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ours = under(listed).withColumn("within", offset).join(starts.join(few_wrong, ["file", "node"], "left_semi"), ["file", "node"])
    theirs = under(held)
    key = ["file", "record_id", "copy"]
    ours = ours.select(*key, "length", "digest", (F.col("start") + F.col("within")).alias("offset"))
    theirs = theirs.select(*(F.col(k).alias(f"their_{k}") for k in key), F.col("length").alias("found"), F.col("digest").alias("other"))
    same = [F.col(k).eqNullSafe(F.col(f"their_{k}")) for k in key]
    kind = (
        F.when(F.col("digest").isNull(), "extra")
        .when(F.col("other").isNull(), "missing")
        .when(F.col("found") != F.col("length"), "resized")
        .otherwise("changed")
    )
    both = ours.join(theirs, same, "full").where(~F.col("digest").eqNullSafe(F.col("other")))
    mine_first = lambda c: F.when(F.col("digest").isNull(), F.col(f"their_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*map(mine_first, key), kind.alias("kind"), "offset", F.coalesce("length", "found").alias("length"))
