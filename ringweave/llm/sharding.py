"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

A uniform permutation of N rows, dealt into shards of fixed sizes, sends from every block of
the input a number of rows to every shard; these numbers follow a multivariate hypergeometric
law and can be drawn before any row moves. So the work is

1. count the rows of every block of the input (rows that one task read next to each other),
2. draw the matrix blocks x shards with these row sums and the shard sizes as column sums,
   down a tree over the blocks whose nodes have bounded fan-out: every node deals the numbers
   it got out to its children,
3. permute every block on its own and give its first rows to shard 0, the next to shard 1 ...,
4. exchange the rows, and permute every shard again, which gives the slots.

All of it is DataFrame and SQL functions: a number is drawn by inversion from the mode of its
law, walking up and then down with ratios of neighbouring probabilities until the rest of the
mass is below what a double can tell.

Texts are read once; what is shuffled are narrow rows. A random 64-bit key orders a block or a
shard, ties by the row's place in the input. Shards are ordered bucket by bucket of that key,
so no task holds a whole shard.

Defined cases: null text has no bytes (size 8, checksum 0); repeated rows, rows of one id and
rows without an id are rows like any other; fewer rows than shards leave shards empty; an
empty table gives no rows; further columns are not read. Runs over the same files with the
same splits agree: keys come from ``seed`` and the row's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import few, prefix_sums, stage

#: Rows of a block at most: what one window of the first permutation holds.
BLOCK_ROWS = 65_536
#: Rows that one bucket of a shard's order holds, about.
BUCKET_ROWS = 4096
#: Children of a node of the tree over the tasks that read the input.
FAN_OUT = 16


def _uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) that is fixed by ``parts``."""
    columns = [F.lit(p).cast("bigint") if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _walk(law: Column, up: bool, goal: Column | None) -> Column:
    """Walk from the mode of the law, whose weight is 1, to one end.

    Without ``goal`` the weights passed are added up; with it the number of the step is returned
    at which their sum reaches it (the last one, should rounding miss it).
    """
    a, b, c, d = (law[x] for x in ("abcd" if up else "efgh"))
    steps = law["up" if up else "down"]

    def weight(s: Column, i: Column) -> Column:
        return s["w"] * (((a - i) * (b - i)) / ((c + i) * (d + i)))

    def total(s: Column, i: Column) -> Column:
        return _bind(weight(s, i), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

    def search(s: Column, i: Column) -> Column:
        found = _bind(
            weight(s, i),
            lambda w: F.struct(
                w.alias("w"), (s["sum"] + w).alias("sum"), F.when(s["sum"] + w >= goal, i).alias("at")
            ),
        )
        return F.when(s["at"].isNotNull(), s).otherwise(found)

    zero = [F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")]
    if goal is None:
        walked = F.aggregate(F.sequence(F.lit(1), steps), F.struct(*zero), total)["sum"]
        return F.when(steps >= 1, walked).otherwise(F.lit(0.0))
    start = F.struct(*zero, F.lit(None).cast("int").alias("at"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), steps), start, search)["at"], steps)


def hypergeometric(n: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` rows among ``n`` are in a sample of ``drawn``, at the uniform ``u``."""

    def law(mode: Column) -> Column:
        # The ratio of neighbouring weights is (a - i)(b - i) / (c + i)(d + i) at the i-th step up,
        # and the same with e, f, g, h at the i-th step down. Beyond nine deviations and sixty
        # steps less than a double's last bit of the mass is left.
        share = good / n
        wide = F.ceil(F.sqrt(drawn * share * (1 - share) * ((n - drawn) / F.greatest(n - 1, F.lit(1)))) * 9) + 60
        rest = n - good - drawn + mode
        numbers = {
            "a": good - mode + 1, "b": drawn - mode + 1, "c": mode, "d": rest,
            "e": mode + 1, "f": rest + 1, "g": good - mode, "h": drawn - mode,
        }
        return F.struct(
            *(x.cast("double").alias(k) for k, x in numbers.items()),
            F.least(F.least(good, drawn) - mode, wide).cast("int").alias("up"),
            F.least(mode - least, wide).cast("int").alias("down"),
            mode.alias("mode"),
        )

    def drawn_from(law: Column) -> Column:
        sums = F.struct(_walk(law, True, None).alias("up"), _walk(law, False, None).alias("down"))
        return _bind(
            sums,
            lambda s: _bind(
                u * (s["up"] + s["down"] + 1) - 1,
                lambda goal: F.when(goal < 0, law["mode"])
                .when(goal < s["up"], law["mode"] + _walk(law, True, goal))
                .otherwise(law["mode"] - F.when(law["down"] >= 1, _walk(law, False, goal - s["up"])).otherwise(0)),
            ),
        )

    least, most = F.greatest(F.lit(0), drawn + good - n).cast("bigint"), F.least(good, drawn).cast("bigint")
    # (drawn + 1) * (good + 1) may pass 64 bits; a mode that is off by rounding only starts the walk beside it.
    mode = F.floor((drawn + 1.0) * ((good + 1.0) / (n + 2.0))).cast("bigint")
    found = _bind(F.least(F.greatest(mode, least), most), lambda m: _bind(law(m), drawn_from))
    return F.when(least >= most, least).otherwise(found.cast("bigint"))


def _dealt(left: Column, rows: Column, key: Column, seed: int) -> Column:
    """How many rows of every shard a child with ``rows`` rows gets, where ``left`` is to be dealt."""
    whole = F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.struct(
        whole.alias("n"), rows.alias("drawn"), F.array().cast("array<bigint>").alias("out")
    )

    def shard(s: Column, good: Column) -> Column:
        count = hypergeometric(s["n"], good, s["drawn"], _uniform(seed, key, F.size(s["out"]).cast("bigint")))
        step = F.transform(
            F.array(count),
            lambda c: F.struct(
                (s["n"] - good).alias("n"), (s["drawn"] - c).alias("drawn"), F.concat(s["out"], F.array(c)).alias("out")
            ),
        )
        return step[0]

    return F.aggregate(left, start, shard, lambda s: s["out"])


def _children(nodes: DataFrame, below: DataFrame, seed: int) -> DataFrame:
    """(node, counts) of the children: every node deals its counts out, one child after the other.

    ``nodes`` has node and counts, ``below`` parent, node and rows.
    """
    families = below.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("node", "rows"))).alias("children"))
    joined = families.join(nodes.withColumnRenamed("node", "parent"), "parent")
    start = F.struct(
        F.col("counts").alias("left"),
        F.array().cast("array<struct<node:bigint,counts:array<bigint>>>").alias("out"),
    )

    def child(s: Column, c: Column) -> Column:
        step = F.transform(
            F.array(_dealt(s["left"], c["rows"], c["node"], seed)),
            lambda got: F.struct(
                F.zip_with(s["left"], got, lambda a, b: a - b).alias("left"),
                F.concat(s["out"], F.array(F.struct(c["node"].alias("node"), got.alias("counts")))).alias("out"),
            ),
        )
        return step[0]

    dealt = joined.select(F.explode(F.aggregate("children", start, child, lambda s: s["out"])).alias("c"))
    return dealt.select("c.node", "c.counts")


def communication_matrix(blocks: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(block, counts): how many rows every block gives every shard, drawn at random.

    ``blocks`` has task, block and rows, one row per block. The tree has the blocks of a task
    below the task, and tasks in groups of ``FAN_OUT``, so its depth grows with the logarithm
    of the number of tasks. Collected to the driver: the number of rows and of tasks.
    """
    tasks = stage(blocks.groupBy("task").agg(F.sum("rows").alias("rows")), "tasks")
    total = tasks.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.max("task"), F.lit(0)).alias("t")).first()
    sizes = [total.n // shards + (i < total.n % shards) for i in range(shards)]
    height = 0
    while FAN_OUT**height <= total.t:
        height += 1

    def level(h: int) -> DataFrame:
        node = F.floor(F.col("task") / FAN_OUT**h).cast("bigint")
        return tasks.groupBy(node.alias("node")).agg(F.sum("rows").alias("rows"))

    parents = level(height).select("node", F.array(*(F.lit(s).cast("bigint") for s in sizes)).alias("counts"))
    for h in reversed(range(height)):
        below = level(h).withColumn("parent", F.floor(F.col("node") / FAN_OUT).cast("bigint"))
        parents = stage(_children(parents, below, seed * 64 + h + 1), "matrix")
    leaves = blocks.select(F.col("task").alias("parent"), F.col("block").alias("node"), "rows")
    return stage(_children(parents, leaves, seed * 64), "matrix").withColumnRenamed("node", "block")


def shard(
    docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of ``shards`` shards of equal
    numbers of rows (at most one apart), in an order that is uniform among all."""
    at = F.monotonically_increasing_id()  # the task above 33 bits of the row's number in it
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        at.alias("_at"),
    )
    rows = stage(rows, "rows")
    block = F.floor(F.col("_at") / BLOCK_ROWS).cast("bigint")
    placed = rows.select("*", F.shiftright("_at", 33).alias("task"), block.alias("block"))
    blocks = stage(placed.groupBy("task", "block").agg(F.count(F.lit(1)).alias("rows")), "blocks")
    matrix = communication_matrix(blocks, shards, seed)

    # First permutation: a block's rows in random order; the first counts[0] go to shard 0, and so on.
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "_at"), "_at")
    ends = F.transform(
        F.sequence(F.lit(1), F.size("counts")),
        lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )
    dealt = (
        placed.drop("task")
        .withColumn("_rank", F.row_number().over(order).cast("bigint"))
        .join(few(matrix.select("block", ends.alias("ends"))), "block")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("_rank"))))
        .select("doc_id", "size", "text_crc32", "_at", "shard")
    )
    dealt = stage(dealt, "dealt")

    # Second permutation: a shard's rows in the order of another key, bucket by bucket of its top bits.
    most = -(-(rows.count()) // max(1, shards))
    bits = max(0, (most // BUCKET_ROWS).bit_length())
    keyed = dealt.withColumn("_key", F.xxhash64(F.lit(seed), F.lit(2), "_at"))
    bucket = F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("bigint")
    ranked = prefix_sums(keyed, "shard", ["_key", "_at"], bucket, F.lit(1).cast("bigint"))
    return ranked.select("doc_id", "size", "text_crc32", "shard", F.col("before").cast("bigint").alias("slot"))
