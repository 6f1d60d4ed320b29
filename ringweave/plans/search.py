"""The search: levels of distinct classes, targets matched and deleted on the way."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce as fold_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions import gates, matrices
from ringweave.functions.bits import pin
from ringweave.functions.matrices import Lanes, lanes_for
from ringweave.operators import levels, products, targets as target_ops
from ringweave.operators.words import with_pattern
from ringweave.plans.config import EXPAND, PRODUCT, SearchConfig, parse_args
from ringweave.session import discard, local_session, materialise, materialise_bucketed, prepare
from ringweave.sources.lines import read_patterns
from ringweave.sources.sinks import duration_text, observed, write_witnesses


@dataclass
class LevelReport:
    t: int
    new_classes: int | None
    open_targets: int
    milliseconds: int

    def text(self) -> str:
        found = "" if self.new_classes is None else f"{self.new_classes} new classes, "
        return f"t={self.t}: {found}{self.open_targets} targets open, {duration_text(self.milliseconds)}"


@dataclass
class SearchResult:
    levels: dict[int, DataFrame]
    reports: list[LevelReport] = field(default_factory=list)
    witnesses: DataFrame | None = None
    open_targets: DataFrame | None = None
    run: str = ""

    def discard(self, spark: SparkSession) -> None:
        """Delete the run's tables from the checkpoint folder; its DataFrames end with them."""
        discard(spark, self.run)


def lanes_of(roots: DataFrame, more_gates: int) -> Lanes:
    """The layout that given roots are in; it must have room for the gates to come."""
    size, k = roots.agg(F.max(F.size("m.a")), F.max("m.k")).first()
    if size is None:
        return lanes_for(more_gates)
    lanes = next(x for x in (matrices.NARROW, matrices.MEDIUM, matrices.WIDE) if x.size == size)
    if k + more_gates > lanes.max_k:
        raise ValueError(
            f"roots of exponent {k} and {more_gates} more gates do not fit their layout of {size} words; "
            f"build them with {lanes_for(k + more_gates)}"
        )
    return lanes


def words_tell_all(roots: DataFrame, more_gates: int, lanes: Lanes) -> bool:
    """Whether every root is the matrix of its word and words stay within a code's fifteen gates."""
    longest = roots.agg(F.max(F.size("gates"))).first()[0] or 0
    if longest + more_gates > gates.CODE_GATES:
        return False
    return roots.where(F.col("m") != matrices.apply_word("gates", lanes=lanes)).isEmpty()


def root_level(spark: SparkSession, circuit: str, lanes: Lanes) -> DataFrame:
    """Level 0: the matrix of one circuit (the identity by default), with an empty word.

    Words found later extend the root circuit, so they start with its gates.
    """
    words = spark.createDataFrame([(circuit,)], "value string").select(
        gates.parse_word(F.col("value")).alias("gates")
    )
    rows = words.withColumn("m", matrices.apply_word("gates", lanes=lanes))
    return levels.with_key(rows, lanes)


def step_generators(level: DataFrame, t: int, legacy_suffix: bool = False) -> DataFrame:
    """Words of the last ``t`` gates of the coset words of level ``t``, each followed by gate 0.

    A root's own gates come before these and are no part of a generator.
    """
    steps = F.slice(F.col("coset_word"), -t, t)
    words = level.where("coset_word is not null").select(steps.alias("gates"))
    if legacy_suffix:
        words = words.where(F.element_at(F.col("gates"), -1) != 10)
    return words.distinct().select(gates.append(F.col("gates"), F.lit(0)).alias("gates"))


def search(
    spark: SparkSession,
    config: SearchConfig,
    targets: DataFrame | None = None,
    roots: DataFrame | None = None,
) -> SearchResult:
    """Runs the levels 1..target.

    ``targets``: rows with int_plane and sqrt2_plane; none means that nothing is
    recorded. ``roots``: distinct classes with canon_key, gates and m; default is
    the one root of the config. Every level is a table in the checkpoint folder.
    """
    prepare(spark)
    config = config.repaired()
    root_gates = len(config.root.split())
    lanes = lanes_for(config.target + root_gates)
    if roots is None:
        current = root_level(spark, config.root, lanes)
    else:
        current, lanes = roots, lanes_of(roots, config.target)
    run = f"search-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def store(level: DataFrame, t: int) -> DataFrame:
        return materialise_bucketed(level, f"{run}/level={t}", "canon_key", buckets)

    current = store(current, 0)
    coded = words_tell_all(current, config.target, lanes)
    result = SearchResult({0: current}, run=run)

    open_targets, n_open = None, 0
    if targets is not None:
        open_targets = materialise(
            target_ops.build_targets(targets, config.match), f"{run}/targets=0"
        )
        n_open = open_targets.count()
    found: list[DataFrame] = []
    written: set[int] = set()

    def record(rows: DataFrame, t: int) -> None:
        nonlocal open_targets, n_open
        if open_targets is None:
            return
        if n_open == 0:
            return
        # The filter is made anew for every level: it holds what is still open.
        hits = target_ops.matching(rows, open_targets, config.match, n_open)
        level_found = materialise(target_ops.witnesses(hits, t, coded), f"{run}/found={t}")
        open_targets = target_ops.delete_matched(open_targets, level_found, config.match)
        # One row per deleted target, counted from the file footers.
        n_open -= level_found.count()
        found.append(level_found)
        if config.out_path:
            write_witnesses(level_found, config.out_path, t)
            written.add(t)

    def report(t: int, started: float, new_classes: int | None) -> bool:
        elapsed = int((time.time() - started) * 1000)
        result.reports.append(LevelReport(t, new_classes, n_open, elapsed))
        return config.stop_when_done and targets is not None and n_open == 0

    generators: dict[int, DataFrame] = {}
    expanded = config.target if config.beyond == EXPAND else config.stored
    # A step from level t leads to t-1 and t+1 only, as gate counts of one class
    # have one parity. Several roots may differ in parity: then t is excluded too.
    single_root = roots is None
    prior: DataFrame | None = None
    done = False
    for t in range(1, expanded + 1):
        started = time.time()
        seen = [d for d in (prior, None if single_root else current) if d is not None]
        step = levels.next_level_of_words if coded else levels.next_level
        fresh, seen_rows = observed(with_pattern(step(current, *seen, lanes=lanes), lanes), f"level {t}")
        level = store(fresh, t)
        record(level, t)
        if config.beyond == PRODUCT and t <= config.generating_sets:
            generators[t - 1] = step_generators(level, t, config.legacy_suffix)
        prior, current = current, level
        result.levels[t] = level
        done = report(t, started, seen_rows.get["rows"])
        if done:
            break

    for t in range(expanded + 1, config.target + 1):
        if done:
            break
        started = time.time()
        offset = t - config.stored - 1
        if offset == 0:
            rows = current.select(
                gates.append(F.col("gates"), F.lit(0)).alias("gates"),
                pin(matrices.apply_gate("m", "0", lanes)).alias("m"),
            )
        elif config.beyond == PRODUCT and offset - 1 in generators:
            rows = products.free_multiply(current, generators[offset - 1], lanes=lanes)
        else:
            break
        if config.record_beyond:
            record(with_pattern(rows, lanes), t)
        done = report(t, started, None)

    if config.out_path:
        # Every level leaves its folder, so that none of an earlier run stays in its place.
        nothing = spark.createDataFrame([], "circuit string")
        for t in sorted(set(range(1, config.target + 1)) - written):
            write_witnesses(nothing, config.out_path, t)
    if found:
        result.witnesses = fold_left(DataFrame.unionByName, found)
    result.open_targets = open_targets
    return result


def main(argv: list[str] | None = None) -> None:
    """Command line entry: ``python -m ringweave.plans.search -t 6 -f patterns.txt -o out``."""
    config = parse_args(argv)
    active = SparkSession.getActiveSession()
    spark = prepare(active) if active else local_session()
    targets = read_patterns(spark, config.pattern_path) if config.pattern_path else None
    for line in search(spark, config, targets).reports:
        print(line.text())


if __name__ == "__main__":
    main()
