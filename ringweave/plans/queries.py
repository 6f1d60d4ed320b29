"""The registered queries: (spark, sf_dir) -> DataFrame, each over whole tables.

Inputs are ring elements, 72-bit words, patterns and gate words derived from the
tables by the small functions at the top; ``oracles.py`` derives the same inputs
in SQL and computes the same results another way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions import canonical, gates, matrices, patterns, ring, signs, words72
from ringweave.functions.bits import lit64, pin
from ringweave.functions.matrices import MEDIUM, NARROW
from ringweave.functions.patterns import Pattern
from ringweave.functions.ring import Element
from ringweave.functions.words72 import Word72
from ringweave.operators import levels, lines, orbits, products, sets, targets
from ringweave.operators.levels import rebalance
from ringweave.operators.words import with_matrix, with_pattern
from ringweave.plans.config import SearchConfig
from ringweave.plans.search import search
from ringweave.session import checkpoint_dir, materialise, materialise_bucketed, prepare
from ringweave.sources.lines import circuit_lines, csv_pattern_lines, pattern_lines
from ringweave.sources.lines_source import register
from ringweave.sources.tables import customer_words, nation_words, order_words, table, user_month_words


def _long(**columns) -> list[Column]:
    """Named BIGINT outputs."""
    return [c.cast("bigint").alias(n) for n, c in columns.items()]


def _parts(prefix: str, x: Element) -> list[Column]:
    return _long(**{f"{prefix}{n}": v for n, v in zip("abe", x)})


# --- inputs -----------------------------------------------------------------


def ring_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Two ring elements x, y per line item, zeros and unreduced ones among them."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        (F.col("l_quantity").cast("bigint") - 25).alias("xa"),
        (F.col("l_suppkey") % 9 - 4).alias("xb"),
        (F.col("l_partkey") % 5).cast("int").alias("xe"),
        (F.col("l_suppkey") % 5 - 2).alias("ya"),
        (F.col("l_partkey") % 7 - 3).alias("yb"),
        (F.col("l_orderkey") % 4).cast("int").alias("ye"),
    )


X, Y = ("xa", "xb", "xe"), ("ya", "yb", "ye")
KEYS = ("l_orderkey", "l_linenumber")


KEY_RANGE = 1 << 20


def word_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Two 72-bit words x, y and a position per line item."""
    # Keys are cut to 20 bits before they are multiplied: products of any key fit in BIGINT.
    limb = lambda *terms: sum((F.col(c) % KEY_RANGE * f for c, f in terms), F.lit(0)).bitwiseAND(
        lit64(words72.LIMB)
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        limb(("l_orderkey", 2654435761), ("l_partkey", 104729)).alias("xhi"),
        limb(("l_partkey", 2246822519), ("l_suppkey", 15485863)).alias("xlo"),
        limb(("l_suppkey", 3266489917), ("l_orderkey", 32452843)).alias("yhi"),
        limb(("l_partkey", 668265263), ("l_orderkey", 374761393)).alias("ylo"),
        (F.col("l_partkey") % 80).cast("int").alias("n"),
    )


def _word_columns() -> tuple[Word72, Word72]:
    return Word72(F.col("xhi"), F.col("xlo")), Word72(F.col("yhi"), F.col("ylo"))


def plane_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns with weights around 9, 14 and 18, where the case rules differ."""
    x, y = F.col("xhi"), F.col("yhi")
    mixed = (
        F.when(F.col("n") % 3 == 0, x.bitwiseAND(y))
        .when(F.col("n") % 3 == 1, x.bitwiseAND(y.bitwiseOR(F.col("xlo"))))
        .otherwise(x)
    )
    return word_inputs(spark, sf).select(
        *KEYS, "n", mixed.alias("int_plane"), F.col("ylo").alias("sqrt2_plane")
    )


def order_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return with_pattern(with_matrix(order_words(spark, sf)))


def customer_matrices(spark: SparkSession, sf: str) -> DataFrame:
    return with_matrix(customer_words(spark, sf))


def customer_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return with_pattern(customer_matrices(spark, sf))


# --- ring elements ----------------------------------------------------------


def ring_reduce(spark, sf):
    return ring_inputs(spark, sf).select(*KEYS, *_parts("r", ring.reduce(Element.of(*X))))


def ring_add_sub(spark, sf):
    x, y = Element.of(*X), Element.of(*Y)
    sums = ring_inputs(spark, sf).select(
        *KEYS,
        ring.add_unreduced(x, y).struct().alias("s"),
        ring.sub_unreduced(x, y).struct().alias("d"),
    )
    return sums.select(
        *KEYS,
        *_parts("s", ring.reduce(Element.field("s"))),
        *_parts("d", ring.reduce(Element.field("d"))),
    )


def ring_multiply(spark, sf):
    x, y = Element.of(*X), Element.of(*Y)
    return ring_inputs(spark, sf).select(
        *KEYS,
        *_parts("p", ring.mul(x, y)),
        *_parts("n", ring.neg(x)),
        *_parts("h", ring.over_root2(x)),
    )


def ring_divide(spark, sf):
    x, y = Element.of(*X), Element.of(*Y)
    rows = ring_inputs(spark, sf).select(
        *KEYS,
        ring.reduce(x).struct().alias("x"),
        ring.reduce(y).struct().alias("y"),
        ring.mul(x, y).struct().alias("xy"),
    )
    reduced = rows.withColumn("xy", ring.reduce(Element.field("xy")).struct())
    return reduced.select(
        *KEYS,
        *_parts("q", ring.divide(Element.field("x"), Element.field("y"))),
        *_parts("back", ring.divide(Element.field("xy"), Element.field("y"))),
    )


def ring_order(spark, sf):
    x, y = Element.of(*X), Element.of(*Y)
    return ring_inputs(spark, sf).select(
        *KEYS,
        *_parts("abs", ring.absolute(x)),
        *_long(
            negative=ring.is_negative(x).cast("int"),
            cmp=ring.compare(x, y),
            less=ring.less(x, y).cast("int"),
            same=ring.equals(x, y).cast("int"),
            cmp_int=ring.compare_int(x, F.col("ya")),
            same_int=ring.equals_int(x, F.col("ya")).cast("int"),
        ),
    )


def ring_text(spark, sf):
    return ring_inputs(spark, sf).select(*KEYS, ring.text(Element.of(*X)).alias("x_text"))


def ring_sum(spark, sf):
    """Exact sum of all x per supplier digit, through partial sums per exponent."""
    rows = ring_inputs(spark, sf).select(
        (F.col("l_orderkey") % 1000).alias("grp"),
        F.col("xa").alias("a"),
        F.col("xb").alias("b"),
        F.col("xe").alias("e"),
    )
    total = products.sum_elements(rows, ["grp"])
    return total.select("grp", *_parts("t", Element.of("a", "b", "e")))


# --- 72-bit words -----------------------------------------------------------


def word72_arith(spark, sf):
    x, y = _word_columns()
    named = {
        "conj": words72.bit_and(x, y),
        "disj": words72.bit_or(x, y),
        "inv": words72.bit_not(x),
        "total": words72.add(x, y),
        "diff": words72.sub(x, y),
    }
    out = {f"{n}_{limb}": getattr(w, limb) for n, w in named.items() for limb in ("hi", "lo")}
    return word_inputs(spark, sf).select(
        *KEYS,
        *_long(**out, ones=words72.popcount(x), same=words72.equals(x, y).cast("int")),
    )


def word72_shift(spark, sf):
    x, _ = _word_columns()
    left, right = words72.shl(x, F.col("n")), words72.shr(x, F.col("n"))
    return word_inputs(spark, sf).select(
        *KEYS, *_long(left_hi=left.hi, left_lo=left.lo, right_hi=right.hi, right_lo=right.lo)
    )


def word72_window(spark, sf):
    x, _ = _word_columns()
    pos = F.col("n") % 71
    bit = words72.set_bit(x, pos, F.col("ylo"))
    pair = words72.set_pair(x, pos, F.col("ylo"))
    return word_inputs(spark, sf).select(
        *KEYS,
        *_long(
            bit=words72.get_bit(x, pos),
            pair=words72.get_pair(x, pos),
            bits16=words72.get_bits16(x, pos),
            bit_hi=bit.hi,
            bit_lo=bit.lo,
            pair_hi=pair.hi,
            pair_lo=pair.lo,
        ),
    )


def word72_text(spark, sf):
    x, _ = _word_columns()
    low, high = words72.to_64_8(x)
    again = words72.from_64_8(low, high)
    ints, roots = words72.to_planes(x)
    return word_inputs(spark, sf).select(
        *KEYS,
        words72.binary_text(x).alias("binary"),
        words72.pattern_text(x).alias("pattern"),
        *_long(int_plane=ints, sqrt2_plane=roots, hi=again.hi, lo=again.lo, high8=high),
    )


# --- patterns ---------------------------------------------------------------


def _document_bits(spark, sf) -> DataFrame:
    """72 characters of 0/1 per document, from the digest of its whole text."""
    digest = F.sha2(F.col("text"), 256)
    part = lambda start: F.lpad(F.conv(F.substring(digest, start, 9), 16, 2), 36, "0")
    return table(spark, sf, "documents").select("doc_id", F.concat(part(1), part(10)).alias("value"))


def pattern_text_scan(spark, sf):
    lines_ = _document_bits(spark, sf).select("value")
    return pattern_lines(lines_).select(
        *_long(
            int_plane=F.col("int_plane"),
            sqrt2_plane=F.col("sqrt2_plane"),
            case_num=patterns.case_num(Pattern.field()),
        )
    )


def pattern_source_scan(spark, sf):
    """The documents' bits written as pattern files and read back through the data source."""
    path = f"{checkpoint_dir(spark)}/patterns-{uuid.uuid4().hex}"
    _document_bits(spark, sf).select("value").write.text(path)
    rows = register(spark).read.format("ringweave").option("kind", "patterns").option("lines", "good").load(path)
    return rows.select(
        *_long(
            int_plane=F.col("int_plane"),
            sqrt2_plane=F.col("sqrt2_plane"),
            case_num=patterns.case_num(Pattern.field()),
        )
    )


def pattern_csv_scan(spark, sf):
    pair = lambda i: F.conv(F.substring(F.col("value"), i * 2 + 1, F.lit(2)), 2, 10)
    csv = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(35)), pair), ",")
    return csv_pattern_lines(_document_bits(spark, sf).select(csv.alias("value"))).select(
        *_long(int_plane=F.col("int_plane"), sqrt2_plane=F.col("sqrt2_plane"))
    )


def pattern_case(spark, sf):
    p = Pattern.field()
    return plane_inputs(spark, sf).select(
        *KEYS, *_long(weight=patterns.weight(p), case_num=patterns.case_num(p))
    )


def pattern_cells(spark, sf):
    p = Pattern.field()
    row, col = (F.col("l_linenumber") % 6).cast("int"), F.col("n") % 6
    after = patterns.set_value(p, row, col, F.col("n") % 4)
    raw = patterns.set_bit(p, F.col("n") % 72, F.col("l_linenumber"))
    i, s = patterns.get_bits(p, row, col)
    return plane_inputs(spark, sf).select(
        *KEYS,
        *_long(
            int_bit=i,
            sqrt2_bit=s,
            value=patterns.get_value(p, row, col),
            set_ints=after.ints,
            set_roots=after.roots,
            raw_ints=raw.ints,
            raw_roots=raw.roots,
            row2=patterns.masked_row(p, 2),
            col3=patterns.masked_column(p, 3),
            sig1=patterns.column_signature(p, 1),
        ),
    )


def pattern_mods(spark, sf):
    p = Pattern.field()
    row = (F.col("l_linenumber") % 6).cast("int")
    order = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda r: (r + F.col("n")) % 6)
    moved = patterns.permute_rows(p, "order")
    flipped = patterns.transpose(p)
    return (
        plane_inputs(spark, sf)
        .withColumn("order", order)
        .select(
            *KEYS,
            *_long(
                all_roots=patterns.mod_all(p).roots,
                row_roots=patterns.mod_row(p, row).roots,
                moved_ints=moved.ints,
                moved_roots=moved.roots,
                flip_ints=flipped.ints,
                flip_roots=flipped.roots,
            ),
        )
    )


def pattern_orbit(spark, sf):
    """Size and checksums of the orbit of one pattern per supplier."""
    prepare(spark)
    key = F.col("s_suppkey")
    mask = F.when(key % 3 == 0, lit64(sum(patterns.ROW_MASKS[:4]))).otherwise(lit64(patterns.FULL))
    plane = lambda f: (key % KEY_RANGE * f).bitwiseAND(mask)
    rows = table(spark, sf, "supplier").select(
        "s_suppkey",
        plane(2654435761 * 17).alias("int_plane"),
        plane(2246822519 * 13).alias("sqrt2_plane"),
    )
    found = orbits.orbit_digests(rows.withColumn("closed_size", patterns.orbit_size(Pattern.field())), 1000003)
    return found.select(
        "s_suppkey",
        *_long(
            members=F.col("members"),
            closed_size=F.col("closed_size"),
            least_ints=F.col("least_ints"),
            roots_xor=F.col("roots_xor"),
            roots_sum=F.col("roots_sum"),
        ),
    )


def pattern_orbit_classes(spark, sf):
    """How many distinct patterns and orbits the order words reach per case."""
    distinct = order_patterns(spark, sf).select("case_num", "int_plane", "sqrt2_plane").distinct()
    keyed = distinct.withColumn("orbit", pin(patterns.orbit_key(Pattern.field())))
    per_orbit = keyed.groupBy("case_num", "orbit").agg(F.count(F.lit(1)).alias("n"))
    return per_orbit.groupBy("case_num").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("o")).select(
        *_long(case_num=F.col("case_num"), n_patterns=F.col("n"), n_orbits=F.col("o"))
    )


def pattern_grid_text(spark, sf):
    return plane_inputs(spark, sf).select(*KEYS, patterns.text(Pattern.field()).alias("grid"))


# --- circuits ---------------------------------------------------------------


def circuit_text(spark, sf):
    """Whole documents as circuits (gate = token length mod 15), through every text form."""
    tokens = F.filter(F.split("text", " "), lambda t: F.length(t) > 0)
    words = table(spark, sf, "documents").select(
        "doc_id", F.transform(tokens, lambda t: (F.length(t) % 15).cast("tinyint")).alias("gates")
    )
    texts = words.select("doc_id", "gates", pin(gates.word_text(F.col("gates"))).alias("circuit"))
    parsed = texts.select(
        "doc_id", "gates", "circuit", pin(gates.parse_word(F.col("circuit"))).alias("parsed")
    )
    packed = parsed.withColumn("packed", pin(gates.pack_word(F.col("parsed"))))
    return packed.select(
        "doc_id",
        F.size("parsed").cast("bigint").alias("n_gates"),
        F.md5(F.col("circuit")).alias("circuit_md5"),
        F.md5(F.hex("packed")).alias("packed_md5"),
        (gates.unpack_word(F.col("packed")) == F.col("gates")).cast("bigint").alias("round_trip"),
    )


def circuit_replay(spark, sf):
    return order_patterns(spark, sf).select(
        "l_orderkey",
        gates.word_text(F.col("gates")).alias("circuit"),
        *_long(
            lde=F.col("lde"),
            int_plane=F.col("int_plane"),
            sqrt2_plane=F.col("sqrt2_plane"),
            case_num=F.col("case_num"),
        ),
    )


def circuit_case_histogram(spark, sf):
    """Flagship: every order's circuit replayed exactly, counted by case and exponent."""
    counted = order_patterns(spark, sf).groupBy("case_num", "lde").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *_long(case_num=F.col("case_num"), lde=F.col("lde"), n_words=F.col("n"))
    )


def circuit_replay_months(spark, sf):
    """Up to 31 gates per user and month, in the medium lanes."""
    rows = with_pattern(with_matrix(user_month_words(spark, sf), MEDIUM), MEDIUM)
    return rows.select(
        "user_id",
        "month",
        *_long(
            n_gates=F.size("gates"),
            lde=F.col("lde"),
            int_plane=F.col("int_plane"),
            sqrt2_plane=F.col("sqrt2_plane"),
            case_num=F.col("case_num"),
        ),
    )


def packed_replay(spark, sf):
    """Customer words packed to bytes, unpacked, replayed."""
    packed = customer_words(spark, sf).select(
        "o_custkey", pin(gates.pack_word(F.col("gates"))).alias("packed")
    )
    rows = packed.select("o_custkey", "packed", gates.unpack_word(F.col("packed")).alias("gates"))
    return with_pattern(with_matrix(rows)).select(
        "o_custkey",
        F.hex("packed").alias("packed_hex"),
        *_long(lde=F.col("lde"), case_num=F.col("case_num")),
    )


# --- matrices ---------------------------------------------------------------


def matrix_elements(spark, sf):
    """All nonzero entries of the customer matrices, in lowest terms."""
    cells = products.to_long(customer_matrices(spark, sf), "o_custkey")
    return cells.select(
        "o_custkey", *_long(**{c: F.col(c) for c in ("row", "col", "a", "b", "e")})
    )


def matrix_product(spark, sf):
    """Each order's matrix times its customer's matrix."""
    prepare(spark)
    by_order = order_words(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), F.col("gates").alias("left"))
    by_customer = customer_words(spark, sf).select("o_custkey", F.col("gates").alias("right"))
    owner = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    paired = by_order.join(owner, "o_orderkey").join(by_customer, "o_custkey").select("o_orderkey", "left", "right")
    multiplied = products.word_products(paired, "left", "right")
    return multiplied.withColumn("case_num", patterns.case_num(Pattern.field())).select(
        "o_orderkey",
        *_long(
            lde=F.col("lde"),
            int_plane=F.col("int_plane"),
            sqrt2_plane=F.col("sqrt2_plane"),
            case_num=F.col("case_num"),
        ),
    )


def matrix_square_long(spark, sf):
    """Customer matrices squared in long form: equi-join on the inner index, then sums."""
    cells = products.to_long(customer_matrices(spark, sf), "o_custkey")
    squared = products.multiply_long(cells, cells, "o_custkey")
    return squared.select(
        "o_custkey", *_long(**{c: F.col(c) for c in ("row", "col", "a", "b", "e")})
    )


def matrix_transforms(spark, sf):
    """Planes after transposing, moving, negating lines of the customer matrices."""
    n = F.col("o_custkey").cast("int")
    six = lambda f: F.transform(F.sequence(F.lit(0), F.lit(5)), f)
    rows = customer_matrices(spark, sf).select(
        "o_custkey",
        "m",
        (n % 6).alias("at"),
        six(lambda i: (i + n) % 6).alias("shift"),
        six(lambda i: F.when((i + n) % 3 == 0, -1).otherwise(1)).alias("signs"),
    )
    changed = {
        "t": matrices.transpose("m"),
        "r": matrices.permute_rows("m", "shift"),
        "c": matrices.permute_columns("m", "shift"),
        "n": matrices.negate_row("m", "at"),
        "s": matrices.apply_signs("m", "signs", "signs"),
    }
    staged = rows.select("o_custkey", *[pin(m).alias(k) for k, m in changed.items()])
    cell = lambda k, r, c: ring.text(matrices.entry(k, r, c))
    return staged.select(
        "o_custkey",
        *_long(
            **{f"{k}_ints": matrices.int_plane(k) for k in "trc"},
            **{f"{k}_roots": matrices.sqrt2_plane(k) for k in "trc"},
        ),
        *[
            F.concat_ws(" ", *[cell(k, i, (2 * i + 1) % 6) for i in range(6)]).alias(f"{k}_cells")
            for k in "ns"
        ],
    )


def matrix_text(spark, sf):
    return customer_matrices(spark, sf).select("o_custkey", matrices.text("m").alias("grid"))


def matrix_text_columns(spark, sf):
    """Three columns of each customer matrix, chosen and ordered by customer key."""
    at = lambda k: f"cast((o_custkey + {k}) % 6 as int)"
    shown = f"array({at(4)}, {at(0)}, {at(3)})"
    return customer_matrices(spark, sf).select("o_custkey", matrices.text("m", columns=shown).alias("grid"))


def matrix_from_pattern(spark, sf):
    """A matrix with each pattern of the order words, and the pattern it has itself."""
    distinct = order_patterns(spark, sf).select("int_plane", "sqrt2_plane").distinct()
    built = distinct.select(
        F.col("int_plane").alias("ints"),
        F.col("sqrt2_plane").alias("roots"),
        pin(matrices.from_planes("int_plane", "sqrt2_plane")).alias("m"),
    )
    return built.select(
        *_long(
            ints=F.col("ints"),
            roots=F.col("roots"),
            k=F.expr("m.k"),
            int_plane=matrices.int_plane("m"),
            sqrt2_plane=matrices.sqrt2_plane("m"),
        ),
        ring.text(matrices.entry("m", 0, 0)).alias("corner"),
    )


# --- canonical form ---------------------------------------------------------


def line_classes(spark, sf):
    """Rows and columns of the customer matrices grouped by their absolute entries."""
    rows = lines.with_cells(customer_matrices(spark, sf))
    out = []
    for by_row, kind in ((True, "row"), (False, "column")):
        out.append(
            lines.equivalence_classes(rows, "o_custkey", by_row).select(
                "o_custkey",
                F.lit(kind).alias("kind"),
                "entries",
                F.array_join(F.col("members").cast("array<string>"), " ").alias("members"),
            )
        )
    return out[0].unionByName(out[1])


def column_order(spark, sf):
    """Column numbers of each customer matrix in signed order under all-positive rows."""
    rows = lines.with_cells(customer_matrices(spark, sf)).select(
        "o_custkey", pin(lines.lines("cells", by_row=False)).alias("columns")
    )
    factors = signs.factors(F.lit(signs.ALL_POSITIVE))
    keyed = F.transform(
        "columns",
        lambda col, i: F.struct(signs.line_order_key(col, factors).alias("key"), i.alias("c")),
    )
    ordered = F.transform(F.array_sort(keyed), lambda x: x["c"].cast("string"))
    return rows.select("o_custkey", F.array_join(ordered, " ").alias("columns"))


def column_order_signed(spark, sf):
    """The same under one of the 32 choices of row signs, by customer key."""
    choice = F.get(signs.row_choices(), (F.col("o_custkey") % 32).cast("int"))
    rows = lines.with_cells(customer_matrices(spark, sf)).select(
        "o_custkey", pin(lines.lines("cells", by_row=False)).alias("columns"), pin(choice).alias("mask")
    )
    keyed = F.transform(
        "columns",
        lambda col, i: F.struct(signs.line_order_key(col, signs.factors(F.col("mask"))).alias("key"), i.alias("c")),
    )
    ordered = F.transform(F.array_sort(keyed), lambda x: x["c"].cast("string"))
    return rows.select("o_custkey", signs.text(F.col("mask")).alias("mask_text"), F.array_join(ordered, " ").alias("columns"))


def sign_propagation(spark, sf):
    """Signs that make all entries of each customer matrix positive, and entries that forbid it."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.signum(F.get(F.col("cells"), (i % 6) * 6 + F.floor(i / 6))["a"]))
    rows = lines.with_cells(customer_matrices(spark, sf)).select("o_custkey", pin(cells.cast("array<int>")).alias("s"))
    found = rows.select("o_custkey", pin(signs.propagated(F.col("s"))).alias("p"))
    return found.select(
        "o_custkey",
        signs.text(F.col("p.row_mask")).alias("rows"),
        signs.text(F.col("p.col_mask")).alias("columns"),
        *_long(conflicts=F.col("p.conflicts")),
    )


def sign_masks(spark, sf):
    """Column signs implied by a positive row 0, and the mask operations on them."""
    rows = lines.with_cells(customer_matrices(spark, sf)).select(
        "o_custkey", pin(lines.first_row_column_mask("cells")).alias("mask")
    )
    at = (F.col("o_custkey") % 6).cast("int")
    changed = signs.set_sign(F.col("mask"), at, (F.col("o_custkey") % 4).cast("int"))
    return rows.select(
        "o_custkey",
        signs.text(F.col("mask")).alias("mask_text"),
        signs.text(signs.reverse(F.col("mask"))).alias("reversed_text"),
        *_long(changed=changed, code=signs.mask_at(F.col("mask"), at)),
    )


def majority_votes(spark, sf):
    """Votes are taken once per word in normal form, of which five gates make 276,736 at most, and joined to customers."""
    words = customer_words(spark, sf).select("o_custkey", pin(gates.normal_word(F.col("gates"))).alias("gates"))
    words = materialise(words, f"customer-words-{uuid.uuid4().hex}")
    distinct = words.select("gates").distinct()
    rows = lines.with_cells(with_matrix(rebalance(distinct, 0))).withColumn(
        "col_mask", pin(lines.first_row_column_mask("cells"))
    )
    votes = lines.majority_votes(rows, "gates").select("gates", *_long(row=F.col("row"), sign=F.col("sign")))
    return words.join(votes, "gates").select("o_custkey", "row", "sign")


def canonical_signatures(spark, sf):
    """Number of words and of distinct class signatures per exponent."""
    prepare(spark)
    signed = products.word_signatures(order_words(spark, sf))
    per_sig = signed.groupBy("lde", "signature").agg(F.sum("n").alias("n"))
    return per_sig.groupBy("lde").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s")).select(
        *_long(lde=F.col("lde"), n_words=F.col("n"), n_signatures=F.col("s"))
    )


def canonical_classes(spark, sf):
    """Customers by the class of their matrix: least member, size, case, exponent."""
    prepare(spark)
    # One key per distinct word, however many customers have it.
    words = (
        customer_words(spark, sf)
        .groupBy("gates")
        .agg(F.min("o_custkey").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    keyed = levels.with_key(with_pattern(with_matrix(words)))
    classes = keyed.groupBy("canon_key").agg(
        F.min("first").alias("first"),
        F.sum("n").alias("n"),
        F.min("lde").alias("lde"),
        F.min("case_num").alias("low_case"),
        F.max("case_num").alias("high_case"),
    )
    return classes.select(
        *_long(
            first_custkey=F.col("first"),
            members=F.col("n"),
            lde=F.col("lde"),
            low_case=F.col("low_case"),
            high_case=F.col("high_case"),
        )
    )


def _order_classes(spark, sf) -> DataFrame:
    """Distinct classes of the order words, each with its least word."""
    prepare(spark)
    words = order_words(spark, sf).select("gates").distinct()
    return levels.one_per_class_of_words(levels.with_key(with_matrix(words)))


def level_distinct(spark, sf):
    """Distinct classes among the order words, by exponent and case."""
    classes = with_pattern(_order_classes(spark, sf))
    return classes.groupBy("lde", "case_num").agg(F.count(F.lit(1)).alias("n")).select(
        *_long(lde=F.col("lde"), case_num=F.col("case_num"), n_classes=F.col("n"))
    )


def level_expand(spark, sf):
    """Every customer matrix times every gate, counted by gate, exponent and case."""
    step = levels.expand(customer_matrices(spark, sf))
    r1, r2 = gates.gate_rows(F.col("gate"))
    counted = (
        with_pattern(step)
        .select("gate", r1.alias("r1"), r2.alias("r2"), "lde", "case_num")
        .groupBy("gate", "r1", "r2", "lde", "case_num")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        *_long(**{c: F.col(c) for c in ("gate", "r1", "r2", "lde", "case_num", "n")})
    )


def level_anti_prior(spark, sf):
    """Classes one gate away from a customer class that no customer has."""
    prepare(spark)
    words = customer_words(spark, sf).select("gates").distinct()
    classes = levels.one_per_class_of_words(levels.with_key(with_matrix(words)))
    # Used twice, and too costly to key twice; in buckets, so that the anti join reads it where it lies.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    current = materialise_bucketed(classes, f"customer-classes-{uuid.uuid4().hex}", "canon_key", buckets)
    fresh = with_pattern(levels.next_level_of_words(current, current))
    return fresh.groupBy("lde", "case_num").agg(F.count(F.lit(1)).alias("n")).select(
        *_long(lde=F.col("lde"), case_num=F.col("case_num"), n_classes=F.col("n"))
    )


# --- targets, sets, products ------------------------------------------------


def target_load(spark, sf):
    """Targets from the customers' patterns: one per case, case 0 dropped."""
    loaded = targets.build_targets(customer_patterns(spark, sf))
    return loaded.select(
        *_long(**{c: F.col(c) for c in ("case_num", "int_plane", "sqrt2_plane")})
    )


def target_semi_join(spark, sf):
    """Order words whose case the users' months also reach, by case."""
    months = with_pattern(with_matrix(user_month_words(spark, sf), MEDIUM), MEDIUM)
    hits = targets.matching(order_patterns(spark, sf), targets.build_targets(months))
    return hits.groupBy("case_num").agg(F.count(F.lit(1)).alias("n")).select(
        *_long(case_num=F.col("case_num"), n_words=F.col("n"))
    )


def target_orbit_match(spark, sf):
    """Order words whose pattern lies in the orbit of a customer's pattern, by case."""
    open_targets = targets.build_targets(customer_patterns(spark, sf), targets.ORBIT)
    counted = order_patterns(spark, sf).groupBy("int_plane", "sqrt2_plane", "case_num").agg(
        F.count(F.lit(1)).alias("n")
    )
    hits = targets.matching(counted, open_targets, targets.ORBIT)
    return hits.groupBy("case_num").agg(F.sum("n").alias("n")).select(
        *_long(case_num=F.col("case_num"), n_words=F.col("n"))
    )


def target_bloom_match(spark, sf):
    """``target_orbit_match`` with a Bloom filter of the open orbits before the join."""
    open_targets = materialise(targets.build_targets(customer_patterns(spark, sf), targets.ORBIT), f"targets-{uuid.uuid4().hex}")
    counted = order_patterns(spark, sf).groupBy("int_plane", "sqrt2_plane", "case_num").agg(F.count(F.lit(1)).alias("n"))
    hits = targets.matching(counted, open_targets, targets.ORBIT, open_targets.count())
    return hits.groupBy("case_num").agg(F.sum("n").alias("n")).select(*_long(case_num=F.col("case_num"), n_words=F.col("n")))


def target_witness(spark, sf):
    """Least circuit of each length that reaches each case, over the order words."""
    rows = order_patterns(spark, sf).where(F.size("gates") > 0).select(
        F.size("gates").alias("t"), "case_num", "gates"
    )
    coded = rows.where("case_num <> 0").select("t", "case_num", gates.word_code(F.col("gates")).alias("code"))
    best = coded.groupBy("t", "case_num").agg(F.min("code").alias("code"))
    best = best.withColumn("gates", gates.code_word(F.col("code")))
    return best.select(
        *_long(t=F.col("t"), case_num=F.col("case_num")),
        gates.word_text(F.col("gates")).alias("circuit"),
    )


def target_delete(spark, sf):
    """Pattern orbits of the order words that no customer word reaches."""
    open_targets = targets.build_targets(order_patterns(spark, sf), targets.ORBIT)
    found = targets.build_targets(customer_patterns(spark, sf), targets.ORBIT)
    left = targets.delete_matched(open_targets, found, targets.ORBIT)
    return left.select(*_long(**{c: F.col(c) for c in ("case_num", "int_plane", "sqrt2_plane")}))


def circuit_delete(spark, sf):
    """Pattern orbits of the order words left after the customers' circuits, read as text lines."""
    lines = customer_words(spark, sf).select(pin(gates.word_text(F.col("gates"))).alias("value"))
    open_targets = targets.build_targets(order_patterns(spark, sf), targets.ORBIT)
    left = targets.delete_by_circuits(circuit_lines(lines), open_targets, targets.ORBIT)
    return left.select(*_long(**{c: F.col(c) for c in ("case_num", "int_plane", "sqrt2_plane")}))


def set_difference(spark, sf):
    """Patterns of order words that no customer word has."""
    keys = ["int_plane", "sqrt2_plane"]
    left = sets.difference(order_patterns(spark, sf), customer_patterns(spark, sf), keys)
    return left.select(*_long(**{c: F.col(c) for c in keys}))


def top_with_ties(spark, sf):
    """The orders whose word has the largest exponent of its case."""
    rows = order_patterns(spark, sf).select("case_num", "l_orderkey", "lde")
    return sets.top_with_ties(rows, ["case_num"], "lde").select(
        *_long(case_num=F.col("case_num"), l_orderkey=F.col("l_orderkey"), lde=F.col("lde"))
    )


def coset_filter(spark, sf):
    """Coset generators out of the customer words, under both suffix rules."""
    rows = customer_matrices(spark, sf).where(F.size("gates") > 0)
    out = []
    for legacy in (False, True):
        kept = with_pattern(levels.coset_generators(rows, legacy_suffix=legacy))
        out.append(
            kept.groupBy("lde", "case_num")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(
                *_long(legacy=F.lit(int(legacy)), lde=F.col("lde"), case_num=F.col("case_num"), n=F.col("n"))
            )
        )
    return out[0].unionByName(out[1])


def coset_index(spark, sf):
    """The coset generators of the customer words, numbered without gaps in the order of words."""
    words = customer_words(spark, sf).select("gates").distinct().where(F.element_at("gates", -1) != 0)
    numbered = sets.dense_index(words, ["gates"])
    return numbered.select(F.col("idx").cast("bigint"), gates.word_text(F.col("gates")).alias("circuit"))


def free_multiply(spark, sf):
    """Coset generators of all order words, whatever their length, times the nations' words.

    Both sides grow with no more than their tables: the generators with orders, the stored side
    with the nations. Order words times customer words would grow with the square.
    """
    prepare(spark)
    words = order_words(spark, sf).select("gates").distinct().where(F.element_at("gates", -1) != 0)
    generators = words.select(gates.append(F.col("gates"), F.lit(0)).alias("gates"))
    made = products.counted_planes(generators, nation_words(spark, sf).select("gates").distinct())
    planes = made.groupBy("lde", "int_plane").agg(F.sum("n").alias("n"))
    cases = planes.select("lde", patterns.case_num(Pattern(F.col("int_plane"), lit64(0))).alias("case_num"), "n")
    return cases.groupBy("lde", "case_num").agg(F.sum("n").alias("n")).select(
        *_long(lde=F.col("lde"), case_num=F.col("case_num"), n=F.col("n"))
    )


def free_multiply_customers(spark, sf):
    """Coset generators of the nations' words times the distinct customer words, each product with its word."""
    prepare(spark)
    generators = levels.coset_generators(with_matrix(nation_words(spark, sf).select("gates").distinct()))
    stored = with_matrix(customer_words(spark, sf).select("gates").distinct())
    made = with_pattern(products.free_multiply(stored, generators))
    return made.groupBy("lde", "case_num").agg(F.count(F.lit(1)).alias("n")).select(
        *_long(lde=F.col("lde"), case_num=F.col("case_num"), n=F.col("n"))
    )


# --- search -----------------------------------------------------------------


def search_first_level(spark, sf):
    """First gate count at which each case of the order words shows up; the search ends
    when all have been met."""
    config = SearchConfig(target=8, stop_when_done=True)
    result = search(spark, config, order_patterns(spark, sf))
    if result.open_targets.count():
        raise RuntimeError("a case of the order words takes more than eight gates")
    return result.witnesses.select(*_long(case_num=F.col("case_num"), t=F.col("t")))


def search_from_customers(spark, sf):
    """Two levels of search from all customer classes at once, counted per level."""
    prepare(spark)
    words = customer_words(spark, sf).select("gates").distinct()
    roots = levels.one_per_class_of_words(levels.with_key(with_matrix(words)))
    result = search(spark, SearchConfig(target=2, stored=2), roots=roots)
    out = None
    for t, level in result.levels.items():
        if t == 0:
            continue
        counted = level.groupBy("lde", "case_num").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.select(
            *_long(t=F.lit(t), lde=F.col("lde"), case_num=F.col("case_num"), n_classes=F.col("n"))
        )
        out = counted if out is None else out.unionByName(counted)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        ring_reduce,
        ring_add_sub,
        ring_multiply,
        ring_divide,
        ring_order,
        ring_text,
        ring_sum,
        word72_arith,
        word72_shift,
        word72_window,
        word72_text,
        pattern_text_scan,
        pattern_source_scan,
        pattern_csv_scan,
        pattern_case,
        pattern_cells,
        pattern_mods,
        pattern_orbit,
        pattern_orbit_classes,
        pattern_grid_text,
        circuit_text,
        circuit_replay,
        circuit_case_histogram,
        circuit_replay_months,
        packed_replay,
        matrix_elements,
        matrix_product,
        matrix_square_long,
        matrix_transforms,
        matrix_text,
        matrix_text_columns,
        matrix_from_pattern,
        line_classes,
        column_order,
        column_order_signed,
        sign_masks,
        sign_propagation,
        majority_votes,
        canonical_signatures,
        canonical_classes,
        level_distinct,
        level_expand,
        level_anti_prior,
        target_load,
        target_semi_join,
        target_orbit_match,
        target_bloom_match,
        target_witness,
        target_delete,
        circuit_delete,
        set_difference,
        top_with_ties,
        coset_filter,
        coset_index,
        free_multiply,
        free_multiply_customers,
        search_first_level,
        search_from_customers,
    )
}
