"""The data source: ranges of files, bad lines, filters, commit and abort."""

import os
import random

import pytest
from ringweave.sources import lines_source
from ringweave.sources.lines import read_circuits, read_csv_patterns, read_patterns


@pytest.fixture(scope="module")
def source(spark):
    return lines_source.register(spark)


def _read(spark, path, kind):
    return spark.read.format("ringweave").option("kind", kind).load(str(path))


@pytest.mark.parametrize("split", [1 << 25, 50, 73, 1000])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_patterns_are_those_of_the_line_reader(source, tmp_path, split, ending, monkeypatch):
    monkeypatch.setattr(lines_source, "SPLIT_BYTES", split)  # of the driver, which cuts the files
    rng = random.Random(3)
    good = ["".join(rng.choices("01", k=72)) for _ in range(40)]
    (tmp_path / "a.txt").write_text(ending.join(good[:25]) + ending, newline="")
    (tmp_path / "b.txt").write_text(ending.join(good[25:]), newline="")  # no end of line at the end
    (tmp_path / "_skipped").write_text("x")
    want = sorted(map(tuple, read_patterns(source, str(tmp_path)).collect()))
    made = _read(source, tmp_path, "patterns")
    assert sorted((r.int_plane, r.sqrt2_plane) for r in made.collect()) == want and len(want) == 40


def test_bad_lines_are_rows_and_can_be_chosen(source, tmp_path):
    good = ["01" * 36, "10" * 36]
    bad = ["", "01", "2" * 72, "0" * 73]
    (tmp_path / "p.txt").write_text("\n".join(good + bad) + "\n")
    rows = _read(source, tmp_path, "patterns")
    assert sorted(r.bad for r in rows.where("bad is not null").collect()) == sorted(bad)
    assert rows.where("bad is null").count() == 2 and rows.count() == 6
    chosen = {n: source.read.format("ringweave").option("lines", n).load(str(tmp_path)) for n in ("good", "bad", "all")}
    assert {n: df.count() for n, df in chosen.items()} == {"good": 2, "bad": 4, "all": 6}
    assert chosen["bad"].where("bad is null").count() == 0


def test_csv_and_circuits(source, tmp_path):
    rng = random.Random(4)
    cells = [",".join(str(rng.randrange(4)) for _ in range(36)) for _ in range(10)]
    (tmp_path / "c.csv").write_text("\n".join(cells) + "\n")
    want = sorted(map(tuple, read_csv_patterns(source, str(tmp_path / "c.csv")).collect()))
    assert sorted((r.int_plane, r.sqrt2_plane) for r in _read(source, tmp_path / "c.csv", "csv").collect()) == want
    (tmp_path / "w.txt").write_text("0 14 3\n\n  7\n15\n1 x\n")
    rows = _read(source, tmp_path / "w.txt", "circuits").collect()
    assert sorted(r.gates for r in rows if r.bad is None) == [[], [0, 14, 3], [7]]
    assert sorted(r.bad for r in rows if r.bad is not None) == ["1 x", "15"]


def test_circuits_written_are_read_back_and_summed(source, tmp_path):
    path = str(tmp_path / "out")
    words = [[i % 15] * (i % 4) for i in range(50)]
    df = source.createDataFrame([(w,) for w in words], "gates array<tinyint>").repartition(3)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("ringweave").option("kind", "circuits").mode(mode).save(path)
        got = sorted(r.gates for r in read_circuits(source, path).select("gates").collect())
        assert got == sorted(words * times)
        assert lines_source.summary(path) == {"files": 3, "rows": 50, "gates": sum(map(len, words))}
    assert not [n for n in os.listdir(path) if n.startswith("_job")]


def test_a_failed_job_leaves_what_was_there(source, tmp_path):
    path = str(tmp_path / "out")
    good = source.createDataFrame([([1, 2],)], "gates array<tinyint>")
    good.write.format("ringweave").option("kind", "circuits").mode("append").save(path)
    before = sorted(os.listdir(path))
    bad = source.createDataFrame([([1, 2],)] * 30 + [([1, 99],)], "gates array<tinyint>").repartition(4)
    with pytest.raises(Exception, match="other than gates"):
        bad.write.format("ringweave").option("kind", "circuits").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == before
    assert read_circuits(source, path).select("gates").collect()[0].gates == [1, 2]


def test_options_are_checked(source, tmp_path):
    with pytest.raises(Exception, match="kind must be"):
        _read(source, tmp_path, "other").collect()
    with pytest.raises(Exception):
        _read(source, tmp_path / "missing", "patterns").collect()
    with pytest.raises(Exception, match="lines must be"):
        source.read.format("ringweave").option("lines", "some").load(str(tmp_path)).collect()
