import pytest
from pyspark.sql import functions as F

from ringweave.functions import matrices as M
from ringweave.operators.words import with_matrix, with_pattern
from ringweave.plans.config import EXPAND, FIRST_GATE, PRODUCT, SearchConfig, parse_args
from ringweave.plans.search import search
from ringweave.sources.lines import read_circuits, read_patterns
from ringweave.functions import words72

# Distinct classes per gate count, and their split by case.
CLASSES = {1: 1, 2: 2, 3: 6, 4: 19, 5: 77, 6: 371}
CASES = {
    1: {1: 1},
    2: {1: 1, 5: 1},
    3: {1: 3, 2: 2, 7: 1},
    4: {1: 9, 2: 6, 3: 1, 4: 1, 5: 2},
    5: {1: 44, 2: 26, 3: 4, 5: 1, 6: 2},
    6: {1: 228, 2: 110, 3: 14, 4: 9, 5: 9, 8: 1},
}
EXPONENTS = {4: {2: 6, 3: 8, 4: 5}, 6: {2: 1, 3: 38, 4: 97, 5: 139, 6: 96}}
FIRST_T = {1: 1, 5: 2, 2: 3, 7: 3, 3: 4, 4: 4, 6: 5, 8: 6}


def _targets(spark, t_max=6):
    """One pattern of every case 1..8, by the words a search finds for them."""
    words = [[0], [0, 9], [0, 1, 6], [0, 9, 14], [0, 9, 1, 6], [0, 1, 12, 6], [0, 1, 12, 6, 14], [0, 9, 1, 14, 7, 13]]
    return with_pattern(with_matrix(spark.createDataFrame([(w,) for w in words], "gates array<tinyint>")))


@pytest.fixture(scope="module")
def full(spark):
    return search(spark, SearchConfig(target=6), _targets(spark))


def test_level_sizes_and_splits(full):
    assert {r.t: r.new_classes for r in full.reports} == CLASSES
    for t, level in full.levels.items():
        if t == 0:
            continue
        assert {r[0]: r[1] for r in level.groupBy("case_num").count().collect()} == CASES[t]
        if t in EXPONENTS:
            assert {r[0]: r[1] for r in level.groupBy("lde").count().collect()} == EXPONENTS[t]


def test_each_case_is_found_once_at_its_first_level(full):
    rows = full.witnesses.collect()
    assert {r.case_num: r.t for r in rows} == FIRST_T
    assert len(rows) == 8 and full.open_targets.count() == 0
    assert full.reports[-1].open_targets == 0


def test_witnesses_replay_to_their_case(spark, full):
    from ringweave.sources.lines import circuit_lines

    lines = full.witnesses.select("case_num", F.col("circuit").alias("value")).withColumnRenamed("case_num", "want")
    for r in with_pattern(with_matrix(circuit_lines(lines))).collect():
        assert r.case_num == r.want
        assert len(r.gates) == FIRST_T[r.want]


def test_stored_matrices_are_what_their_words_say(full):
    again = full.levels[5].withColumn("again", M.apply_word("gates"))
    assert again.where("again <> m").count() == 0


def test_without_targets_nothing_is_recorded(spark):
    result = search(spark, SearchConfig(target=2))
    assert result.witnesses is None and [r.new_classes for r in result.reports] == [1, 2]


def test_product_mode_reaches_the_levels_by_multiplication(spark):
    config = SearchConfig(target=5, stored=3, beyond=PRODUCT)
    result = search(spark, config, _targets(spark))
    found = {r.case_num: r.t for r in result.witnesses.collect()}
    assert {c: t for c, t in FIRST_T.items() if t <= 3}.items() <= found.items()
    assert all(t >= FIRST_T[c] for c, t in found.items())
    assert [r.new_classes for r in result.reports] == [1, 2, 6, None, None]


def test_first_gate_mode_stops_after_one_step(spark):
    result = search(spark, SearchConfig(target=5, stored=3, beyond=FIRST_GATE), _targets(spark))
    assert [r.t for r in result.reports] == [1, 2, 3, 4]


def test_stop_when_done_and_orbit_matching(spark):
    two = spark.createDataFrame([([0],), ([9, 0],)], "gates array<tinyint>")
    targets = with_pattern(with_matrix(two))
    result = search(spark, SearchConfig(target=5, stop_when_done=True), targets)
    assert [r.t for r in result.reports] == [1, 2]
    exact = search(spark, SearchConfig(target=2, match="orbit"), targets)
    assert {r.case_num for r in exact.witnesses.collect()} <= {1, 5}


def test_root_circuit_is_honoured(spark):
    result = search(spark, SearchConfig(target=2, root="0 9"))
    # One step back to the single-gate class, and on to the three-gate classes.
    level = result.levels[1]
    assert level.where("size(gates) = 3").count() == level.count()
    assert level.where("case_num = 1 AND lde = 1").count() == 1


def test_files_in_and_out(spark, tmp_path):
    pattern = words72.pattern_text(words72.from_planes(F.col("int_plane"), F.col("sqrt2_plane")))
    _targets(spark).select(pattern.alias("value")).write.text(str(tmp_path / "patterns"))
    targets = read_patterns(spark, str(tmp_path / "patterns"))
    config = SearchConfig(target=3, out_path=str(tmp_path / "out"))
    search(spark, config, targets)
    back = read_circuits(spark, str(tmp_path / "out"))
    assert {r.t: r["count"] for r in back.groupBy("t").count().collect()} == {1: 1, 2: 1, 3: 2}


@pytest.mark.parametrize(
    "target,stored,repaired",
    [(8, 0, (8, 7)), (8, 3, (8, 4)), (8, 9, (8, 7)), (7, 1, (7, 4)), (1, 0, (1, 1)), (0, 5, (1, 1))],
)
def test_depths_are_repaired(target, stored, repaired):
    c = SearchConfig(target=target, stored=stored).repaired()
    assert (c.target, c.stored) == repaired
    assert c.free_depth == c.target - c.stored and c.generating_sets >= 0


def test_command_line():
    c = parse_args(["-t", "6", "-s", "4", "-f", "p.txt", "-r", "0 1", "-c", "-n", "max"])
    assert (c.target, c.stored, c.pattern_path, c.root, c.record_beyond) == (6, 4, "p.txt", "0 1", False)
    assert parse_args([]).target == 8 and parse_args([]).beyond == EXPAND


def test_several_roots_against_enumeration(spark):
    """Two roots of different parity against all words of up to two more gates."""
    from ringweave.operators import levels

    roots = [[0], [0, 9]]
    words = [(0, r) for r in roots]
    words += [(1, r + [g]) for r in roots for g in range(15)]
    words += [(2, r + [g, h]) for r in roots for g in range(15) for h in range(15)]
    rows = with_matrix(spark.createDataFrame(words, "t int, gates array<tinyint>"))
    first = (
        levels.with_key(rows)
        .groupBy("canon_key")
        .agg(F.min("t").alias("t"))
        .groupBy("t")
        .count()
    )
    expected = {r.t: r["count"] for r in first.collect()}
    start = with_matrix(spark.createDataFrame([(r,) for r in roots], "gates array<tinyint>"))
    result = search(
        spark, SearchConfig(target=2, stored=2), roots=levels.with_key(start)
    )
    assert {t: level.count() for t, level in result.levels.items()} == expected
    result.discard(spark)


def _products(level_words, step_words):
    return sorted(w + g for w in level_words for g in step_words)


@pytest.mark.parametrize("root", ["", "0 9"])
def test_products_are_stored_words_times_coset_steps(spark, root):
    """Every product of the second free level, not just some of them."""
    from ringweave.operators import products
    from ringweave.plans.search import step_generators

    result = search(spark, SearchConfig(target=4, stored=4, root=root))
    prefix = len(root.split())
    level1 = [r.coset_word[prefix:] for r in result.levels[1].collect() if r.coset_word]
    got = step_generators(result.levels[1], 1)
    assert sorted(r.gates for r in got.collect()) == sorted([*w, 0] for w in level1) != []
    stored = result.levels[2]
    made = products.free_multiply(stored, got)
    want = _products([r.gates for r in stored.collect()], [[*w, 0] for w in level1])
    assert sorted(r.gates for r in made.collect()) == want
    assert made.withColumn("again", M.apply_word("gates")).where("again <> m").count() == 0
    result.discard(spark)


def test_products_with_words_of_several_lengths_and_two_roots(spark):
    from ringweave.operators import levels, products

    start = with_matrix(spark.createDataFrame([([0],), ([0, 9],)], "gates array<tinyint>"))
    words = [[3], [3, 0], [3, 0, 7], [5, 5, 2, 0]]
    generators = spark.createDataFrame([(w,) for w in words], "gates array<tinyint>")
    made = products.free_multiply(levels.with_key(start), generators)
    assert sorted(r.gates for r in made.collect()) == _products([[0], [0, 9]], words)
    assert made.withColumn("again", M.apply_word("gates")).where("again <> m").count() == 0
    with pytest.raises(ValueError, match="empty"):
        products.free_multiply(start, generators.where("false"))


def test_level_sizes_to_seven_gates(spark):
    result = search(spark, SearchConfig(target=7))
    assert [r.new_classes for r in result.reports] == [1, 2, 6, 19, 77, 371, 2159]
    result.discard(spark)


def test_roots_keep_their_layout_or_are_refused(spark):
    from ringweave.operators import levels
    from ringweave.plans.search import lanes_of

    words = spark.createDataFrame([([0, 9, 1],)], "gates array<tinyint>")
    for lanes in (M.NARROW, M.MEDIUM, M.WIDE):
        roots = levels.with_key(with_matrix(words, lanes), lanes)
        assert lanes_of(roots, 3) == lanes
    with pytest.raises(ValueError, match="do not fit"):
        lanes_of(levels.with_key(with_matrix(words)), 30)


def test_every_level_folder_is_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    search(spark, SearchConfig(target=3, out_path=out), _targets(spark))
    assert read_circuits(spark, out).count() == 4
    few = with_pattern(with_matrix(spark.createDataFrame([([0],)], "gates array<tinyint>")))
    search(spark, SearchConfig(target=3, out_path=out, stop_when_done=True), few)
    assert read_circuits(spark, out).count() == 1
    search(spark, SearchConfig(target=3, out_path=out))
    assert read_circuits(spark, out).count() == 0
