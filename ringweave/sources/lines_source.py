"""Pattern, CSV and circuit files as a Spark data source, read in parts and written with a commit.

    register(spark)
    spark.read.format("ringweave").option("kind", "patterns").load("file:///data/patterns")
    words.write.format("ringweave").option("kind", "circuits").mode("overwrite").save(path)

Reading: files are cut into byte ranges and a line belongs to the range it starts in. A line that is
not well formed is a row with the line in ``bad`` and nulls elsewhere. Option ``lines`` (``all``, ``good``,
``bad``) chooses in the reader, before rows are made. It is an option and no pushed filter because Spark
4.1 keeps the filters of one query with the loaded table, and a second query over it would miss rows.

Writing (circuits): tasks write under a folder of the job's own. Only the commit moves their files
into place and leaves ``_summary.json`` with the numbers of rows and gates that the tasks reported;
a job that fails leaves neither files nor the folder, and what stood there before stays.

Paths are reached through pyarrow's file systems (local paths, ``file:``, ``hdfs:``, ``s3:`` ...).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from ringweave.session import prepare

#: Bytes of a file that one task reads.
SPLIT_BYTES = 32 << 20
#: Rows of a batch.
BATCH_ROWS = 8192

SCHEMAS = {
    "patterns": "int_plane bigint, sqrt2_plane bigint, bad string",
    "csv": "int_plane bigint, sqrt2_plane bigint, bad string",
    "circuits": "gates array<tinyint>, bad string",
}
LINES = {"all": None, "good": True, "bad": False}
_ARROW = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "array<tinyint>": pa.list_(pa.int8()),
}
_GATE = re.compile(r"\d|1[0-4]")


def _planes(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    ints = sum(1 << i for i, (a, _) in enumerate(pairs) if a)
    return ints, sum(1 << i for i, (_, b) in enumerate(pairs) if b)


def parse(kind: str, line: str) -> tuple | None:
    """The columns before ``bad`` of a line, or None where it is not well formed."""
    if kind == "patterns":
        if len(line) != 72 or set(line) - {"0", "1"}:
            return None
        return _planes([(int(line[i]), int(line[i + 1])) for i in range(0, 72, 2)])
    if kind == "csv":
        cells = line.split(",")
        if len(cells) != 36 or any(c.strip() not in ("0", "1", "2", "3") for c in cells):
            return None
        return _planes([(int(c) >> 1, int(c) & 1) for c in cells])
    words = line.split()
    return None if not all(map(_GATE.fullmatch, words)) else ([int(w) for w in words],)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class LinesReader(DataSourceReader):
    def __init__(self, path: str, kind: str, keep: bool | None):
        self.path, self.kind, self.keep = path, kind, keep  # keep: good lines, bad ones, or None for all

    def partitions(self) -> list[Range]:
        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info]
        if info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(path, recursive=True))
            files = [f for f in inside if f.is_file and not f.base_name.startswith(("_", "."))]
        return [
            Range(f.path, at, min(f.size, at + SPLIT_BYTES)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, SPLIT_BYTES)
        ] or [Range("", 0, 0)]

    def _lines(self, part: Range) -> Iterator[str]:
        if not part.path:
            return
        system = _filesystem(self.path)[0]
        with system.open_input_file(part.path) as file:
            # A line that starts before the range belongs to the one before.
            file.seek(max(0, part.start - 1))
            left = b"" if part.start == 0 else None
            at = max(0, part.start - 1)
            while True:
                block = file.read(1 << 20)
                if not block:
                    break
                if left is None:
                    cut = block.find(b"\n")
                    at += len(block) if cut < 0 else cut + 1
                    if cut < 0:
                        continue
                    left, block = b"", block[cut + 1 :]
                lines = (left + block).split(b"\n")
                left = lines.pop()
                for line in lines:
                    if at >= part.end:
                        return
                    at += len(line) + 1
                    yield line.removesuffix(b"\r").decode("utf-8", "replace")
                if at >= part.end:
                    return
            if left and at < part.end:
                yield left.removesuffix(b"\r").decode("utf-8", "replace")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split(" ") for c in SCHEMAS[self.kind].split(", ")), strict=True)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in rows], _ARROW[k]) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for line in self._lines(partition):
            found = parse(self.kind, line)
            if self.keep is None or self.keep == (found is not None):
                rows.append((*found, None) if found is not None else (*[None] * (len(names) - 1), line))
            if len(rows) == BATCH_ROWS:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    gates: int


class CircuitsWriter(DataSourceArrowWriter):
    """Circuits as lines; see the module's text for what commit and abort leave."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _filesystem(self.path)
        folder, name = f"{path}/{self.job}", f"part-{uuid.uuid4().hex}.txt"
        system.create_dir(folder, recursive=True)
        rows = gates = 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                words = batch.column(batch.schema.get_field_index("gates")).to_pylist()
                if any(w is None or not all(0 <= g <= 14 for g in w) for w in words):
                    raise ValueError("a circuit is null or has something other than gates 0..14")
                out.write("".join(" ".join(map(str, w)) + "\n" for w in words).encode())
                rows, gates = rows + len(words), gates + sum(map(len, words))
        return Written(name, rows, gates)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        done = [m for m in messages if m is not None]
        before = [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file]
        for m in done:
            if m.rows:
                system.move(f"{path}/{self.job}/{m.file}", f"{path}/{m.file}")
        for f in before if self.overwrite else ():
            system.delete_file(f.path)
        summary = {"files": sum(m.rows > 0 for m in done), "rows": sum(m.rows for m in done), "gates": sum(m.gates for m in done)}
        with system.open_output_stream(f"{path}/_summary.json") as out:
            out.write(json.dumps(summary).encode())
        self._drop(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*_filesystem(self.path))

    def _drop(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.job}")


class LinesSource(DataSource):
    """Options: ``path``, ``kind`` (patterns, csv or circuits) and ``lines`` (all, good or bad)."""

    @classmethod
    def name(cls) -> str:
        return "ringweave"

    @property
    def _kind(self) -> str:
        kind = self.options.get("kind", "patterns")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}, not {kind!r}")
        return kind

    @property
    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return self.options["path"].rstrip("/")

    def schema(self) -> str:
        return SCHEMAS[self._kind]

    def reader(self, schema) -> LinesReader:
        lines = self.options.get("lines", "all")
        if lines not in LINES:
            raise ValueError(f"lines must be one of {', '.join(LINES)}, not {lines!r}")
        return LinesReader(self._path, self._kind, LINES[lines])

    def writer(self, schema, overwrite: bool) -> CircuitsWriter:
        if self._kind != "circuits":
            raise ValueError("only circuits are written")
        if "gates" not in schema.names:
            raise ValueError("a column gates is needed")
        return CircuitsWriter(self._path, overwrite)


def summary(path: str) -> dict:
    """Files, rows and gates of the last commit."""
    system, place = _filesystem(path.rstrip("/"))
    with system.open_input_file(f"{place}/_summary.json") as file:
        return json.loads(file.read())


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    prepare(spark)
    spark.dataSource.register(LinesSource)
    return spark
