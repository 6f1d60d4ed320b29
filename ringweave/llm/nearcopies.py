"""Near copies by SimHash probing: texts whose sets of word shingles are at least 0.8 alike.

Two texts at that similarity differ in one bit of seven of their SimHash, more than a scheme
that must find every pair within a fixed radius can afford. But the bits that differ are those
whose votes were close. So a fingerprint of 192 bits is cut into partitions, bits that go
together in a sample side by side, and every text stands under the value of a partition and
under its variants with any of the partition's closest ``t`` bits turned. Two texts meet where
all bits they differ in are among the closest of either. The thresholds ``t`` are allotted per
partition by dynamic programming: the least expected number of candidates, estimated on the
sample, for which a pair at the least similarity is missed with probability ``MISSED`` at most.

Equal texts are one from the start. An entry of a bucket is shuffled once, with parity bits in
number as the text is long, and never kept: ``_meeting`` compares a bucket's texts with each other
and keeps the pairs that sizes and parity bits do not prove to be less alike. Of these, candidates
are verified by the shingles themselves. First, for ``ROUNDS`` rounds or until one joins nothing,
every text is paired with its nearest texts of other components: that joins a group of near copies
by a number of pairs that follows its size. Then all that is left is compared: any two texts that
meet in a bucket, are of different components, were not compared yet and are not proved less
alike. The entries of a bucket of more than ``CROWDED`` texts, or of one in which more than ``DENSE``
pairs a text would be left, are kept; there the rounds look into random blocks, and ``_rest`` pairs
block by block. So two texts that are alike and meet in a bucket are
of one component in the end, however crowded the bucket is. Whether alike texts meet is the
scheme's recall, which is measured in the tests.

Defined cases: words are lower-cased as in ``simhash``; texts of fewer words than a shingle are
one shingle, texts without words are all equal; repeated rows are equal texts; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import few, stage, unstage
from ringweave.llm.components import components
from ringweave.llm.parts import mixed
from ringweave.llm.simhash import bit_counts

BITS = 192
#: Texts, at most about, whose votes the plan is learned from on the driver.
SAMPLE = 2048
#: Chance that a pair at the least similarity meets in no partition.
MISSED = 0.01
#: Closest bits of a partition that may be turned, at most.
MOST_TURNED = 5
#: Texts of a bucket that are all compared with each other in one task, at most; what has more is kept in blocks.
CROWDED = 256
#: Pairs that a bucket may leave for each of its texts, without being treated as a crowded one.
DENSE = 4
#: Texts of one block of a crowded bucket.
BUCKET = 64
#: Pairs of a bucket whose parity bits are compared at a time.
PAIRS = 1 << 15
#: Nearest texts of other components that a text is paired with in a block and round; ``_rest`` takes the others.
NEAREST = 2
#: Rounds of pairing with the nearest, before ``_rest``.
ROUNDS = 2
#: BIGINTs of a text's parity bits, and of the wider ones of a text of more than ``LONG`` shingles.
PARITY_WORDS, WIDE_WORDS, LONG = 8, 64, 400
#: How much more an entry in a bucket costs, shuffled and kept, than a comparison there.
ENTRY_COST = 12.0
#: Components up to which the table of roots is broadcast.
FEW_ROOTS = 500_000
#: Of the first 64 bits, those that the nearest may differ in: at a similarity of 0.8 ten on average, three deviation.
NEAR_64 = 20
#: Thousandths of their shingles that the nearest may have apart by the parity bits: 111 at a similarity of 0.8.
NEAR_SHARE = 200


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` lower-cased words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    spans = zip(starts, ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(whole[s:e], 42) for s, e in spans], np.uint64))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For every bit, how many hashes have it minus how many do not."""
    lanes = (hashes, mixed(hashes), mixed(hashes + np.uint64(0x9E3779B97F4A7C15)))
    return 2 * np.concatenate([bit_counts(x) for x in lanes]) - len(hashes)


def parity(hashes: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Of every bit, whether an odd number of the distinct hashes fall on it.

    A hash that two sets share turns the same bit of both, so two sets have at least as many
    hashes apart as parity bits.
    """
    bits = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words)
    return np.packbits((bits & 1).astype(bool), bitorder="little").view("<i8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parity bits on fewer words, a power of two: the same as if they had been made on them."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def words_for(n: int, least: float) -> int:
    """Words, a power of two up to ``WIDE_WORDS``, on which texts of ``n`` shingles with none in common
    have more parity bits apart, by three deviations, than texts that are ``least`` alike."""
    words = 1
    while words < WIDE_WORDS and 32 * words - 12 * math.sqrt(words) < 2 * n * (1 - least) / (1 + least):
        words *= 2
    return words


def _turns(t: int) -> np.ndarray:
    """All subsets of ``t`` bits, as rows of booleans."""
    return (np.arange(1 << t)[:, None] >> np.arange(t) & 1).astype(bool)


def probes(cast: np.ndarray, plan: list[tuple[list[int], int]]) -> np.ndarray:
    """(text, probe) matrix of bucket keys for a matrix of votes."""
    out = []
    for number, (bits, t) in enumerate(plan):
        own = cast[:, bits]
        weights = np.int64(1) << np.arange(len(bits), dtype=np.int64)
        value = (own > 0) @ weights
        close = np.argsort(np.abs(own), axis=1, kind="stable")[:, :t]
        masks = weights[close] @ _turns(t).T.astype(np.int64) if t else np.zeros((len(own), 1), np.int64)
        out.append((value[:, None] ^ masks) | np.int64(number) << np.int64(56))
    return np.concatenate(out, axis=1) if out else np.zeros((len(cast), 0), np.int64)


def _grouped(sample: np.ndarray, parts: int, width: int) -> list[list[int]]:
    """Partitions of ``width`` bits; each begins with a free bit and takes those that go most with it."""
    bits = (sample > 0).astype(float)
    bits -= bits.mean(axis=0)
    bits /= np.maximum(bits.std(axis=0), 1e-9)
    together = np.abs(bits.T @ bits)
    free, out = list(range(BITS)), []
    for _ in range(parts):
        group = [max(free, key=lambda b: together[b, free].sum())]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(together[np.ix_(rest, group)].sum(axis=1).argmax())])
        free = [b for b in free if b not in group]
        out.append(group)
    return out


def learned_plan(sample: np.ndarray, n: int, least: float) -> list[tuple[list[int], int]]:
    """(bits, turned) per partition for ``n`` texts, from the votes of some of them."""
    if len(sample) < 2:
        sample = np.vstack([sample.reshape(-1, BITS), np.ones((2, BITS))])
    rng = np.random.default_rng(0)
    kept = 2 * least / (1 + least)  # of either text's shingles, where both are of one size
    spread = np.sqrt((sample.astype(float) ** 2).mean(axis=1, keepdims=True))
    other = kept * sample + math.sqrt(1 - kept**2) * spread * rng.standard_normal(sample.shape)
    differ = (sample > 0) != (other > 0)
    goal = math.ceil(-math.log(MISSED) / 0.05)
    pairs = len(sample) * (len(sample) - 1) / 2
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for width in {min(48, max(12, math.ceil(math.log2(max(2, n))) + more)) for more in (-3, -1, 1, 3, 5, 7)}:
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        groups = _grouped(sample, BITS // width, width)
        for bits in groups:
            ranks = [np.abs(x[:, bits]).argsort(axis=1).argsort(axis=1) for x in (sample, other)]
            options = [(0.0, 0, -1)]
            for t in range(MOST_TURNED + 1):
                met = (~differ[:, bits] | (ranks[0] < t) | (ranks[1] < t)).all(axis=1).mean()
                counts = np.unique(probes(sample, [(bits, t)]), return_counts=True)[1].astype(float)
                share = max((counts * (counts - 1) / 2).sum() / pairs, 4.0**t / 2.0**width)
                units = math.floor(-math.log(max(1 - met, 1e-9)) / 0.05)
                options.append((share * n * n / 2 + ENTRY_COST * n * 2.0**t, units, t))
            step: dict[int, tuple[float, list[int]]] = {}
            for have, (cost, chosen) in reach.items():
                for more, units, t in options:
                    total = min(goal, have + units)
                    if total not in step or cost + more < step[total][0]:
                        step[total] = (cost + more, [*chosen, t])
            reach = step
        most = max(reach)
        cost, chosen = reach[most]
        cost += (goal - most) * n * 1000.0  # a plan that misses the goal is taken only if none meets it
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _sketches(docs: DataFrame, size: int, plan: list[tuple[list[int], int]] | None, least: float = 0.8) -> DataFrame:
    """Per row (key, digest, n, f, parity, wide, bits, probes); without a plan (key, votes).

    ``bits`` are parity bits on ``words_for`` words, ``parity`` on ``PARITY_WORDS`` and ``wide``, of
    long texts only, on ``WIDE_WORDS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                sets = [shingles(t, size) for t in texts]
                cast = np.array([votes(s) for s in sets], np.int64).reshape(-1, BITS)
                if plan is None:
                    columns = {"votes": pa.array([v.astype("<i4").tobytes() for v in cast], pa.binary())}
                else:
                    first = np.packbits(cast[:, :64] > 0, axis=1, bitorder="little").view("<i8").ravel()
                    found = probes(cast, plan)
                    full = np.array([parity(s, WIDE_WORDS) for s in sets], "<i8").reshape(-1, WIDE_WORDS)
                    bits = [folded(x[None], words_for(len(s), least)).tobytes() for x, s in zip(full, sets, strict=True)]
                    columns = {
                        "digest": pa.array([xxh3_128_digest(b" ".join(t.lower().split())) for t in texts], pa.binary()),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "f": pa.array(first, pa.int64()),
                        "parity": pa.array(list(folded(full, PARITY_WORDS)), pa.list_(pa.int64())),
                        "wide": pa.array([x if len(s) > LONG else None for x, s in zip(full, sets, strict=True)], pa.list_(pa.int64())),
                        "bits": pa.array(bits, pa.binary()),
                        "probes": pa.array(list(found), pa.list_(pa.int64())),
                    }
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], ["key", *columns])

    columns = "votes binary" if plan is None else "digest binary, n bigint, f bigint, parity array<bigint>, wide array<bigint>, bits binary, probes array<bigint>"
    return docs.mapInArrow(run, f"key bigint, {columns}")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(key, set): 32 bits of every distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                sets = [np.unique((shingles(t, size) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], ["key", "set"])

    return docs.mapInArrow(run, "key bigint, set array<int>")


def pairs_of(values: np.ndarray, n: np.ndarray, bits: pa.Array, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Places (i, j) of one value that may be ``least`` alike, and thousandths of their shingles apart by parity.

    Rows are sorted by value and ``n``, so that what is too long for a row stays so for the rows after it.
    """
    offsets = np.frombuffer(bits.buffers()[1], "<i4", len(bits) + 1, bits.offset * 4).astype(np.int64) // 8
    flat = np.frombuffer(bits.buffers()[2] or b"", "<u8", offsets[-1])
    words = np.diff(offsets)
    on: dict[int, np.ndarray] = {}  # all rows' bits on so many words, where they have them
    for width in np.unique(words).tolist():
        rows = np.flatnonzero(words == width)
        own = flat[offsets[rows][:, None] + np.arange(width)]
        for fewer in (1 << k for k in range(width.bit_length())):
            on.setdefault(fewer, np.zeros((len(words), fewer), np.uint64))[rows] = folded(own, fewer)

    def compared(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        width = np.minimum(words[i], words[j])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            for start in range(0, len(at), PAIRS):
                a, b = i[at[start : start + PAIRS]], j[at[start : start + PAIRS]]
                apart = np.bitwise_count(on[w][a] ^ on[w][b]).sum(axis=1, dtype=np.int64)
                both = n[a] + n[b]
                may = apart <= (1 - least) / (1 + least) * both + 1e-9
                a, b, apart, both = a[may], b[may], apart[may], both[may]
                hashes = -32 * w * np.log(np.maximum(1 - apart / (32 * w), 1e-3))  # that leave so many bits odd
                yield a, b, np.minimum(1000 * hashes / both, 1000).astype(np.int32)

    i, held, count = np.arange(len(values)), [], 0
    for distance in range(1, len(values)):
        i = i[i + distance < len(values)]
        j = i + distance
        i = i[(values[i] == values[j]) & (n[i] >= least * n[j] - 1e-9)]
        if not len(i):
            break
        held.append((i, i + distance))
        count += len(i)
        if count >= 8 * PAIRS:
            yield from compared(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [], 0
    if held:
        yield from compared(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _meeting(entries: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b, apart) of all texts that meet in a bucket and may be ``least`` alike; for a
    bucket that would leave more than ``DENSE`` pairs a text its (value, held) instead.

    ``entries`` (value, vertex, n, bits) has ``CROWDED`` rows of a value at most.
    """

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        value, vertex, n = (rows[c].to_numpy() for c in ("value", "vertex", "n"))
        pairs = list(pairs_of(value, n, rows["bits"].combine_chunks(), least))
        if not pairs:
            return
        i, j, apart = (np.concatenate(x) for x in zip(*pairs, strict=True))
        bucket = np.cumsum(value != np.append(value[:1], value[:-1]))
        held = np.bincount(bucket)
        dense = np.bincount(bucket[i], minlength=len(held)) > DENSE * held
        few = ~dense[bucket[i]]
        one, two = vertex[i[few]], vertex[j[few]]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))[dense]
        columns = [np.minimum(one, two), np.maximum(one, two), apart[few]], [value[first], held[dense]]
        empty = [pa.nulls(len(first), k) for k in (pa.int64(), pa.int64(), pa.int32())], [pa.nulls(len(one), pa.int64())] * 2
        names = ["a", "b", "apart", "value", "held"]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns[0]), *empty[1]], names)
        yield pa.RecordBatch.from_arrays([*empty[0], *map(pa.array, columns[1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held else rows
            value = held["value"].to_numpy()
            whole = int(np.searchsorted(value, value[-1]))  # the last bucket may go on in the next batch
            yield from found(held.slice(0, whole).combine_chunks())
            held = held.slice(whole)
        if held:
            yield from found(held.combine_chunks())

    dealt = entries.repartition("value").sortWithinPartitions("value", "n")
    return dealt.mapInArrow(run, "a bigint, b bigint, apart int, value bigint, held bigint").distinct()


def _unjoined(near: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs of different components."""
    if roots is None:
        return near
    told = few(roots, FEW_ROOTS)
    for side in "ab":
        near = near.join(told.toDF(side, f"root_{side}"), side, "left")
    return near.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def _nearest_of(near: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of every text with its nearest."""
    both = near.where(F.col("apart") <= NEAR_SHARE).select("*", F.explode(F.array("a", "b")).alias("of"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy("apart", "a", "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select("a", "b").distinct()


def _nearest(members: Column, most: int) -> Column:
    """Pairs (a, b) of every member of a bucket with its nearest members of other components."""

    def others(x: Column) -> Column:
        apart = F.transform(
            F.filter(members, lambda y: (y["root"] != x["root"]) & (5 * F.least(x["n"], y["n"]) >= 4 * F.greatest(x["n"], y["n"]))),
            lambda y: F.struct(F.bit_count(x["f"].bitwiseXOR(y["f"])).alias("apart"), y["vertex"].alias("vertex")),
        )
        near = F.slice(F.array_sort(F.filter(apart, lambda p: p["apart"] <= NEAR_64)), 1, most)
        return F.transform(
            near, lambda p: F.struct(F.least(x["vertex"], p["vertex"]).alias("a"), F.greatest(x["vertex"], p["vertex"]).alias("b"))
        )

    return F.flatten(F.transform(members, others))


def _with_roots(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("root", F.col("vertex"))
    return entries.join(few(roots, FEW_ROOTS), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))


def _candidates(entries: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that are near each other in a block of a bucket."""
    rows = _with_roots(entries, roots)
    blocks = F.ceil(F.col("held") / BUCKET)
    members = rows.select(
        "value", F.pmod(F.xxhash64("vertex", F.lit(turn)), blocks).alias("block"), F.struct("vertex", "f", "root", "n").alias("m"), "held"
    )
    # Of a bucket in several blocks the least text stands in all of them.
    leads = (
        members.where(F.col("held") > BUCKET)
        .groupBy("value")
        .agg(F.min("m").alias("m"), F.max(F.ceil(F.col("held") / BUCKET)).alias("blocks"))
        .select("value", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "m")
    )
    dealt = members.drop("held").unionByName(leads)
    lists = dealt.groupBy("value", "block").agg(F.collect_set("m").alias("members")).where("size(members) > 1")
    return lists.select(F.explode(_nearest(F.col("members"), NEAREST)).alias("p")).select("p.a", "p.b").distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with the root of the largest, ``main``."""
    parts = rows.groupBy("value", "root").agg(F.count(F.lit(1)).alias("size"))
    several = parts.groupBy("value").agg(
        F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")
    )
    return rows.join(several.where("parts > 1").drop("parts"), "value")


def _apart(one: str, two: str, words: int) -> Column:
    """In how many parity bits two texts differ."""
    differ = lambda i: F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(two, F.lit(i))))
    return sum((differ(i) for i in range(1, words)), differ(0))


def _most_apart(least: float) -> Column:
    """How many shingles two texts that are ``least`` alike have apart at most."""
    return F.lit((1 - least) / (1 + least)) * (F.col("n_a") + F.col("n_b")) + 1e-9


def _not_apart(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """``pairs`` without those of long texts whose wide parity bits show that they are less alike."""
    wide = sketches.where("wide is not null")
    for side in "ab":
        pairs = pairs.join(wide.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}")), side, "left")
    less = _apart("wide_a", "wide_b", WIDE_WORDS) > _most_apart(least)
    return pairs.where(~F.coalesce(less, F.lit(False))).select("a", "b")


def _rest(mixed: DataFrame, least: float) -> DataFrame:
    """All distinct pairs (a, b) of different components that meet in a bucket and may be ``least`` alike.

    In a bucket, texts outside its largest component are paired with all texts, block by block,
    so that no task holds more than a block and one large component costs nothing. Left out are
    pairs whose sizes or parity bits show that they are less alike.
    """
    inside = mixed.withColumn("last", F.ceil(F.col("held") / BUCKET) - 1)
    one = inside.where("root <> main").select(
        "value", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("block"),
        F.col("vertex").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"),
    )
    two = inside.select(
        "value", F.pmod(F.xxhash64("vertex"), F.col("last") + 1).alias("block"),
        F.col("vertex").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"),
        (F.col("root") == F.col("main")).alias("in_main"),
    )
    once = (F.col("root_a") != F.col("root_b")) & (F.col("in_main") | (F.col("a") < F.col("b")))
    sizes = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9
    may = _apart("parity_a", "parity_b", PARITY_WORDS) <= _most_apart(least)
    return (
        one.join(two, ["value", "block"])
        .where(once & sizes & may)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def near_copies(docs: DataFrame, key_col: str, text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """(key, root) for every row of staged ``docs``, whose ``key_col`` is a unique BIGINT; rows are
    of one component if texts reach each other over pairs that are ``least`` alike."""
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    total = rows.count()
    chosen = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(max(1, total // SAMPLE))) == 0
    sample = [np.frombuffer(r.votes, "<i4") for r in _sketches(rows.where(chosen), size, None).select("votes").collect()]
    plan = learned_plan(np.array(sample, np.int64).reshape(-1, BITS), total, least)

    sketches = stage(_sketches(rows, size, plan, least), "sketches")
    # Equal texts are one: the least of their keys stands for them.
    vertices = stage(sketches.groupBy("digest").agg(F.min("key").alias("vertex")), "vertices")
    distinct = stage(sketches.join(vertices.select(F.col("vertex").alias("key")), "key", "left_semi").drop("digest"), "distinct")
    under = distinct.select(F.col("key").alias("vertex"), F.col("n").cast("int").alias("n"), "bits", F.explode("probes").alias("value"))
    held = under.groupBy("value").agg(F.count(F.lit(1)).alias("held"))
    crowds = stage(held.where(F.col("held") > CROWDED), "crowds")
    met = stage(_meeting(under.join(few(crowds), "value", "left_anti"), least), "near")
    near = met.where("value is null").select("a", "b", "apart")
    blocked = stage(crowds.union(met.where("value is not null").select("value", "held")), "blocked")
    tables = [sketches, vertices, distinct, crowds, met, blocked]
    entries = None
    if not blocked.isEmpty():
        crowded = under.select("vertex", "value").join(few(blocked), "value")
        told = distinct.select(F.col("key").alias("vertex"), "f", "n", "parity")
        entries = stage(crowded.join(told, "vertex"), "buckets")
        tables.append(entries)

    links, tested, roots, turn = None, None, None, 0
    while turn <= ROUNDS:
        pairs = _unjoined(near, roots)
        if turn < ROUNDS:
            pairs = _nearest_of(pairs, NEAREST)
            if entries is not None:
                pairs = pairs.union(_candidates(entries, roots, turn)).distinct()
        else:
            pairs = pairs.select("a", "b")
            if entries is not None:
                inside = stage(_mixed(_with_roots(entries, roots)), "mixed")
                tables.append(inside)
                pairs = pairs.union(_not_apart(_rest(inside, least), distinct, least)).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        needed = stage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "needed")
        sets = stage(_sets(rows.join(few(needed, FEW_ROOTS), "key", "left_semi"), size), "sets")
        one, two = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        both = F.size(F.array_intersect("set_a", "set_b"))
        alike = both >= F.lit(least) * (F.size("set_a") + F.size("set_b") - both) - 1e-9
        found = stage(pairs.join(one, "a").join(two, "b").where(alike).select("a", "b"), "links")
        unstage(sets, needed)
        tables += [pairs, found]
        tested = pairs if tested is None else tested.union(pairs)
        if found.isEmpty():
            turn = max(turn + 1, ROUNDS)  # nothing near is left to join
            continue
        links = found if links is None else links.union(found)
        roots = stage(components(links).toDF("vertex", "root"), "roots")
        tables.append(roots)
        turn += 1
    named = vertices.withColumn("root", F.col("vertex"))
    if roots is not None:
        named = vertices.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    out = stage(sketches.select("key", "digest").join(named.select("digest", "root"), "digest").select("key", "root"), "named")
    unstage(*tables)
    return out
