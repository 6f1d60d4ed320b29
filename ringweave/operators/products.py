"""Matrix products as DataFrame operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.functions import batches, gates, matrices, ring
from ringweave.functions.bits import pin
from ringweave.functions.matrices import NARROW, Lanes
from ringweave.operators.levels import rebalance
from ringweave.session import materialise


#: Rows whose matrices are held at once: some 600 bytes each, several times.
_ROWS = 4096


def word_products(df: DataFrame, left: str, right: str) -> DataFrame:
    """Replaces the words ``left`` and ``right`` by lde, int_plane and sqrt2_plane of matrix(left) * matrix(right).

    For one product per row: words are what is shuffled, and matrices exist in arrays only.
    """
    names = [c for c in df.columns if c not in (left, right)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                one, two = (batches.of_words(batch.column(c)) for c in (left, right))
                made = batches.reduced(batches.multiply(one, two))
                numbers = [pa.array(x, pa.int64()) for x in (made.k, *batches.planes(made))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *numbers], [*names, *PLANES])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names]
    return df.mapInArrow(run, ", ".join([*kept, *(f"{c} bigint" for c in PLANES)]))


PLANES = ("lde", "int_plane", "sqrt2_plane")


def counted_planes(generators: DataFrame, stored: DataFrame) -> DataFrame:
    """(lde, int_plane, n): how many pairs of a generator and a stored word have a product with that
    exponent and plane; not yet added up over batches.

    ``generators`` is distributed; ``stored`` is a small set (every task holds it). Both have gates.
    A generator's matrix is made once and multiplied with all stored ones by one array product.
    """
    listed = stored.agg(F.collect_list("gates").alias("stored"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            if not whole.num_rows:
                continue
            right = batches.of_words(whole.column(1).slice(0, 1).flatten())
            step = max(1, 8 * _ROWS // max(1, len(right.k)))
            for start in range(0, whole.num_rows, step):
                left = batches.of_words(whole.slice(start, step).column(0))
                made = batches.reduced(batches.all_products(left, right))
                found, n = np.unique(made.k << 36 | batches.planes(made)[0], return_counts=True)
                arrays = [pa.array(x, pa.int64()) for x in (found >> 36, found & (1 << 36) - 1, n)]
                yield pa.RecordBatch.from_arrays(arrays, ["lde", "int_plane", "n"])

    paired = generators.select("gates").crossJoin(F.broadcast(listed))
    return paired.mapInArrow(run, "lde bigint, int_plane bigint, n bigint")


def word_signatures(df: DataFrame, gates_col: str = "gates") -> DataFrame:
    """(lde, signature, n): how many words of a batch have each class signature; not yet added up over batches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, _ROWS):
                made = batches.reduced(batches.of_words(whole.slice(start, _ROWS).column(0)))
                rows = np.rec.fromarrays([made.k, batches.signatures(made)], names="lde,signature")
                found, n = np.unique(rows, return_counts=True)
                texts = [x.ljust(576, b"\0") for x in found["signature"].tolist()]
                arrays = [pa.array(found["lde"], pa.int64()), pa.array(texts, pa.binary()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lde", "signature", "n"])

    return df.select(gates_col).mapInArrow(run, "lde bigint, signature binary, n bigint")


def to_long(df: DataFrame, key: str, lanes: Lanes = NARROW) -> DataFrame:
    """(key, row, col, a, b, e) with zero entries left out."""
    return (
        df.select(key, F.explode(matrices.entries("m", lanes)).alias("cell"))
        .select(key, "cell.*")
        .where("a <> 0")
    )


def multiply_long(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left * right per key, both in long form: join on the inner index, sum by cell.

    For matrices that exist only as entries. A key's product has 36 cells and at
    most 216 terms; the terms combine before the shuffle of the sum.
    """
    l = left.select(
        key, "row", F.col("col").alias("inner"), *[F.col(c).alias(f"l{c}") for c in "abe"]
    )
    r = right.select(
        key, F.col("row").alias("inner"), "col", *[F.col(c).alias(f"r{c}") for c in "abe"]
    )
    term = ring.mul(ring.Element.of("la", "lb", "le"), ring.Element.of("ra", "rb", "re"))
    terms = l.join(r, [key, "inner"]).select(
        key, "row", "col", *[v.alias(n) for n, v in zip("abe", term)]
    )
    return sum_elements(terms, [key, "row", "col"]).where("a <> 0")


def sum_elements(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact sum of ring elements (columns a, b, e) per key, reduced.

    Elements of one exponent add as integers, which is what combines before the
    shuffle; the few exponents of a key are then brought together.
    """
    by_exponent = df.groupBy(*keys, "e").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    per_key = by_exponent.groupBy(*keys).agg(
        F.collect_list(F.struct("a", "b", "e")).alias("parts"), F.max("e").alias("e")
    )
    lifted = per_key.select(
        *keys,
        "e",
        F.transform(
            "parts",
            lambda p: F.struct(
                *[
                    v.alias(n)
                    for n, v in zip("ab", ring.lift(ring.Element(p["a"], p["b"], p["e"]), F.col("e")))
                ]
            ),
        ).alias("parts"),
    )
    add_up = lambda f: F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p[f])
    summed = lifted.select(*keys, add_up("a").alias("a"), add_up("b").alias("b"), "e")
    reduced = ring.reduce(ring.Element.of("a", "b", "e"))
    return summed.select(*keys, *[v.alias(n) for n, v in zip("abe", reduced)])


def generator_edges(generators: DataFrame) -> DataFrame:
    """The generators' words as the edges of their prefix tree: node, gate, child, whole.

    Nodes are prefixes written as text; ``whole`` marks children that are words themselves,
    as one word may begin another.
    """
    prefix = lambda n: F.array_join(
        F.slice(F.col("gates").cast("array<string>"), F.lit(1), n), " "
    )
    return (
        generators.select("gates", F.posexplode("gates").alias("at", "gate"))
        .groupBy(prefix(F.col("at")).alias("node"), "gate", prefix(F.col("at") + 1).alias("child"))
        .agg(
            F.max(F.col("at") + 1 == F.size("gates")).alias("whole"),
            F.first(F.col("at") + 1).alias("depth"),
            F.max(F.size("gates")).alias("reach"),
        )
    )


def generator_graph(generators: DataFrame) -> DataFrame:
    """The prefix tree of words with how many words each stands for: node, gate, child, whole, n.

    ``generators`` has gates and n. Words are brought to their normal form, so words that
    differ by swaps of commuting gates are one path; ``n`` of a whole word adds up theirs.
    """
    normal = generators.select(pin(gates.normal_word(F.col("gates"))).alias("gates"), "n")
    merged = normal.groupBy("gates").agg(F.sum("n").alias("n"))
    prefix = lambda n: F.array_join(F.slice(F.col("gates").cast("array<string>"), F.lit(1), n), " ")
    last = F.col("at") + 1 == F.size("gates")
    return (
        merged.select("gates", "n", F.posexplode("gates").alias("at", "gate"))
        .groupBy(prefix(F.col("at")).alias("node"), "gate", prefix(F.col("at") + 1).alias("child"))
        .agg(
            F.max(last).alias("whole"),
            F.sum(F.when(last, F.col("n")).otherwise(0)).alias("n"),
            F.max(F.col("at") + 1).alias("depth"),
            F.max(F.size("gates")).alias("reach"),
        )
    )


def counted_products(stored: DataFrame, generators: DataFrame, lanes: Lanes = NARROW) -> tuple[DataFrame, list[int]]:
    """(m, n): the matrices of all products generator * stored with how many pairs give each,
    and the rows that every step of the walk had.

    ``stored`` has m and n, ``generators`` gates and n, each row standing for ``n`` of its kind.
    The walk is that of ``free_multiply``, over normal forms. Rows are (matrix, node, n): equal
    ones are one before the walk begins and whole products are added up per matrix after every
    step, so that what is kept is bounded by the distinct matrices, not by the pairs.
    """
    edges = materialise(generator_graph(generators), f"edges-{uuid.uuid4().hex}")
    reach = edges.agg(F.max("reach")).first()[0]
    if reach is None:
        raise ValueError("the generating set is empty")
    rows = stored.groupBy("m").agg(F.sum("n").alias("n")).select("m", "n", pin(F.lit("")).alias("node"))
    rows, made, steps = materialise(rows, f"products-{uuid.uuid4().hex}"), None, []
    n_rows = rows.count()
    for step in range(1, reach + 1):
        own = edges.where(F.col("depth") == step).select("node", "gate", "child", "whole", F.col("n").alias("words"))
        spread = rebalance(rows, n_rows)
        stepped = spread.join(own, "node").select(
            pin(matrices.apply_gate("m", "gate", lanes)).alias("m"), "n", F.col("child").alias("node"), "whole", "words"
        )
        rows = materialise(stepped, f"products-{uuid.uuid4().hex}")
        n_rows = rows.count()
        steps.append(n_rows)
        whole = rows.where("whole").groupBy("m").agg(F.sum(F.col("n") * F.col("words")).alias("n"))
        made = whole if made is None else made.unionByName(whole)
        rows = rows.select("m", "n", "node")
    return made.groupBy("m").agg(F.sum("n").alias("n")), steps


def free_multiply(stored: DataFrame, generators: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """All products generator * stored, by walking the generators' prefix tree.

    ``generators`` holds words in ``gates`` of any length; the empty word adds nothing.
    Each step extends every row along the at most fifteen edges leaving its node, so
    shared prefixes are multiplied once and no pairing of the two sets is ever joined as
    such. How the edges are joined is left to adaptive execution, which knows the size of
    the written table. Without any generator there is nothing to multiply by, which raises.
    """
    edges = materialise(generator_edges(generators), f"edges-{uuid.uuid4().hex}")
    reach = edges.agg(F.max("reach"), F.min(F.when(F.col("whole"), F.col("depth")))).first()
    if reach[0] is None:
        raise ValueError("the generating set is empty")
    longest, shortest = reach
    # Few bytes per row but much work on each: spread before the fan-out.
    # Pinned, or the literal node turns the first step into a join without a key.
    rows = rebalance(stored.select("gates", "m"), 0).withColumn("node", pin(F.lit("")))
    made = None
    for step in range(1, longest + 1):
        rows = rows.join(edges.select("node", "gate", "child", "whole"), "node").select(
            F.array_append("gates", F.col("gate")).alias("gates"),
            pin(matrices.apply_gate("m", "gate", lanes)).alias("m"),
            F.col("child").alias("node"),
            "whole",
        )
        if step >= shortest:
            if step < longest:
                rows = materialise(rows, f"products-{uuid.uuid4().hex}")
            whole = rows.where("whole").select("gates", "m")
            made = whole if made is None else made.unionByName(whole)
        rows = rows.drop("whole")
    return made
