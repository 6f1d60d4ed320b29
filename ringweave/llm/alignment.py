"""Alignment of two tokenizers: which tokens of one go with which of the other, and how widely.

Both tokenizers cut the same bytes, a space and the text. Where tokens of both end at one byte
they close a group; inside a group the tokens whose byte ranges overlap are linked. The score
of a pair of ids is the number of documents of the corpus that hold it linked.

The scores come from an inverted index. Documents are numbered inside containers (rows that
one task read, at most ``CONTAINER_ROWS``). Every container has, per pair of ids, a compressed
bitmap of its documents and bit planes of the further links: plane k holds the documents whose
number of links beyond the first has bit k set. What a container finds comes in fragments
whose bitmaps are OR-merged; popcounts give the documents and, weighted by their planes, the
links of a pair, and sums over containers give those of the corpus. Then every posting takes
its pair's score back to the documents in its bitmap.

Texts are cut at single spaces between other characters, which neither tokenizer joins to what
stands before them, so that equal chunks are encoded and aligned once.

Defined cases: null, empty and not exactly represented texts (as with U+2581, which stands for
a space) have no tokens, zeros and '' for the groups; repeated rows and rows of one id are
separate documents; an id may be null; strings of special tokens in a text are plain text;
texts of any length are read whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.llm.common import few, stage
from ringweave.llm.packing import encoder

#: Documents of a container at most.
CONTAINER_ROWS = 2048
#: Chunks after which a container's links are brought into a fragment.
FRAGMENT_CHUNKS = 1 << 20
#: Aligned chunks after which a worker's table of them is emptied.
CHUNKS = 600_000
#: Pairs up to which their scores are broadcast.
FEW_PAIRS = 400_000
#: Documents up to which a bitmap is written as a list of their numbers.
SPARSE = CONTAINER_ROWS // 16
_BITS_B = 16


class Tokenizers:
    """Ids and token bytes of both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        chunks = encoder(path_a)
        self.encode_a = chunks.encode
        self.bytes_a = {i: token for token, i in chunks.ranks.items()}
        pieces = SentencePieceProcessor(model_file=path_b)
        self.encode_b = pieces.encode
        self.bytes_b = [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)])
            if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(pieces.get_piece_size())
        ]
        if len(self.bytes_b) > 1 << _BITS_B:
            raise ValueError("too many pieces for a pair of ids")
        if any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b))):
            raise ValueError("pieces that go on after a space")


def align(a: list[int], b: list[int], bytes_a, bytes_b) -> tuple[list[int], list[str]]:
    """Codes of all links in order, and the groups as text. Both lists cover the same bytes."""
    links, groups = [], []
    i = j = first_a = first_b = 0
    end_a, end_b = len(bytes_a[a[0]]), len(bytes_b[b[0]])
    while True:
        links.append(a[i] << _BITS_B | b[j])
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            groups.append(f"{','.join(map(str, a[first_a : i + 1]))}|{','.join(map(str, b[first_b : j + 1]))}")
            first_a, first_b = i + 1, j + 1
        i, j = i + step_a, j + step_b
        if i == len(a) or j == len(b):
            return links, groups
        if step_a:
            end_a += len(bytes_a[a[i]])
        if step_b:
            end_b += len(bytes_b[b[j]])


class Chunks(dict):
    """Number of every chunk (the text after its first space), aligned when first asked for."""

    def __init__(self, tokenizers: Tokenizers):
        super().__init__()
        self.tokenizers = tokenizers
        self.empty()

    def empty(self) -> None:
        self.clear()
        #: Five numbers per chunk: tokens of both, groups, links, and whether both cover its bytes.
        self.numbers = array("q")
        self.ends, self.links, self.groups = array("q", [0]), array("q"), []

    def __missing__(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError("white space beside a space")
        return self.add(word)

    def add(self, chunk: str) -> int:
        t = self.tokenizers
        whole = b" " + chunk.encode()
        a, b = t.encode_a(" " + chunk), t.encode_b(chunk)
        good = b"".join(map(t.bytes_a.__getitem__, a)) == whole == b"".join(map(t.bytes_b.__getitem__, b))
        links, groups = align(a, b, t.bytes_a, t.bytes_b) if good else ([], [])
        self.numbers.extend([len(a), len(b), len(groups), len(links), int(good)])
        self.links.extend(links)
        self.ends.append(len(self.links))
        self.groups.append(";".join(groups))
        self[chunk] = number = len(self.groups) - 1
        return number

    def sums(self, chunks: np.ndarray) -> list[int]:
        return np.frombuffer(self.numbers, np.int64).reshape(-1, 5)[chunks].sum(axis=0).tolist()

    def of(self, text: str) -> list[int]:
        words = text.split(" ")
        try:
            return list(map(self.__getitem__, words))
        except ValueError:
            return [self[c] if c in self else self.add(c) for c in _cut(words)]


def _cut(words: list[str]) -> Iterator[str]:
    """Words joined again where white space stands beside the space between them."""
    held = words[:1]
    for word in words[1:]:
        if word and not word[0].isspace() and held[-1] and not held[-1][-1].isspace():
            yield " ".join(held)
            held = [word]
        else:
            held.append(word)
    yield " ".join(held)


@cache
def _chunks(path_a: str, path_b: str) -> Chunks:
    """One per worker process, so that its chunks serve all of the worker's tasks."""
    return Chunks(Tokenizers(path_a, path_b))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts added: documents are OR-ed, links are added."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(count, starts)


def packed(numbers: np.ndarray) -> bytes:
    """Sorted document numbers as a bitmap: a list of them where few, bits where many."""
    if len(numbers) <= SPARSE:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER_ROWS, bool)
    bits[numbers] = True
    return np.packbits(bits).tobytes() + b"\0"  # an odd length tells bits from a list


def unpacked(bitmap: bytes) -> np.ndarray:
    if len(bitmap) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)[:-1]))
    return np.frombuffer(bitmap, "<u2").astype(np.int64)


class Container:
    """Links of the documents of one container, gathered in fragments."""

    def __init__(self, chunks: Chunks):
        self.chunks = chunks
        self.rows, self.pending, self.waiting = 0, [], 0
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64)]

    def add(self, numbers: np.ndarray) -> int:
        """The document's number; its chunks are kept for the next fragment."""
        row = self.rows
        self.rows += 1
        for start in range(0, len(numbers), FRAGMENT_CHUNKS):
            own = numbers[start : start + FRAGMENT_CHUNKS]
            self.pending.append(own * CONTAINER_ROWS + row)
            self.waiting += len(own)
            if self.waiting >= FRAGMENT_CHUNKS:
                self.fragment()
        return row

    def fragment(self) -> None:
        if self.pending:
            keys, times = np.unique(np.concatenate(self.pending), return_counts=True)
            chunk, row = np.divmod(keys, CONTAINER_ROWS)
            ends = np.frombuffer(self.chunks.ends, np.int64)
            links = np.frombuffer(self.chunks.links, np.int64)
            sizes = ends[chunk + 1] - ends[chunk]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = links[np.repeat(ends[chunk], sizes) + within]
            key, count = _merged([code * CONTAINER_ROWS + np.repeat(row, sizes)], [np.repeat(times, sizes)])
            del ends, links  # the arrays grow again
            self.keys.append(key)
            self.counts.append(count)
            if sum(map(len, self.keys)) > 4 * len(self.keys[0]) + 8 * FRAGMENT_CHUNKS:
                key, count = _merged(self.keys, self.counts)
                self.keys, self.counts = [key], [count]
        self.pending, self.waiting = [], 0

    def postings(self) -> tuple[list, list, list, list, list]:
        """(code, documents, planes, number of documents, number of links) per pair of ids."""
        self.fragment()
        key, count = _merged(self.keys, self.counts)
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        if not len(key):
            return out
        code, row = np.divmod(key, CONTAINER_ROWS)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])).tolist()
        further = count - 1
        for a, b in zip(starts, [*starts[1:], len(code)], strict=True):
            rows, more = row[a:b], further[a:b]
            planes = [rows[more >> k & 1 > 0] for k in range(int(more.max()).bit_length())]
            out[0].append(int(code[a]))
            out[1].append(packed(rows))
            out[2].append([packed(p) for p in planes])
            out[3].append(b - a)
            out[4].append(b - a + sum(len(p) << k for k, p in enumerate(planes)))
        return out


DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
INDEXED = (
    "container bigint, row int, "
    + ", ".join(f"{c} bigint" for c in DOCUMENT)
    + ", groups_sha256 string, code bigint, documents binary, planes array<binary>, n_documents bigint, links bigint"
)
_TYPES = [
    pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(),
    pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64(),
]
_NAMES = [c.split()[0] for c in INDEXED.split(", ")]


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def index(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (``row`` set) and one per container and pair (``code`` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(path_a, path_b)
        own, container = TaskContext.get().partitionId() << 33, None
        rows: list[list] = [[] for _ in range(7)]

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal own
            if container is not None and container.rows:
                yield _batch({"container": [own] * len(rows[0]), **dict(zip(["row", *DOCUMENT, "groups_sha256"], rows, strict=True))})
                found = container.postings()
                names = ["code", "documents", "planes", "n_documents", "links"]
                for at in range(0, len(found[0]), 10_000):
                    part = {c: x[at : at + 10_000] for c, x in zip(names, found, strict=True)}
                    yield _batch({"container": [own] * len(part["code"]), **part})
                own += 1
                for column in rows:
                    column.clear()
            if len(chunks) > CHUNKS:
                chunks.empty()

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if container is None or container.rows == CONTAINER_ROWS:
                    yield from closed()
                    container = Container(chunks)
                text = value.as_py()
                numbers = chunks.of(text) if text else []
                found = np.array(numbers, np.int64)
                *sums, good = chunks.sums(found) if numbers else [0] * 5
                if good < len(numbers):
                    numbers, found, sums = [], found[:0], [0] * 4
                groups = ";".join(map(chunks.groups.__getitem__, numbers))
                digest = hashlib.sha256(groups.encode()).hexdigest() if numbers else ""
                for column, x in zip(rows, (container.add(found), doc, *sums, digest), strict=True):
                    column.append(x)
        yield from closed()

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, INDEXED)


def pair_scores(postings: DataFrame) -> DataFrame:
    """(code, id_a, id_b, documents, links, best): popcounts of every pair over all containers;
    ``best`` is the highest number of documents of a pair with the same first id."""
    pairs = postings.groupBy("code").agg(F.sum("n_documents").alias("documents"), F.sum("links").alias("links"))
    named = pairs.select(
        "*", F.shiftright("code", _BITS_B).alias("id_a"), (F.col("code") % (1 << _BITS_B)).alias("id_b")
    )
    best = named.groupBy("id_a").agg(F.max("documents").alias("best"))
    return named.join(best, "id_a")


def _scored(docs: pa.Table, postings: pa.Table) -> pa.Table:
    """The documents of a container with what its postings return to them."""
    n_best, count_sum = np.zeros(CONTAINER_ROWS, np.int64), np.zeros(CONTAINER_ROWS, np.int64)
    names = ["bitmap", "planes", "score", "is_best"]
    for batch in postings.select(names).to_batches(max_chunksize=4096) if postings.num_rows else ():
        for bitmap, planes, score, best in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for times, rows in ((1, bitmap), *((1 << k, p) for k, p in enumerate(planes))):
                at = unpacked(rows)
                count_sum[at] += times * score
                if best:
                    n_best[at] += times
    row = docs["row"].to_numpy()
    digest = docs["groups_sha256"].combine_chunks().cast(pa.string())
    columns = {c: docs[c].combine_chunks() for c in DOCUMENT}
    columns |= {"n_best": pa.array(n_best[row]), "count_sum": pa.array(count_sum[row]), "groups_sha256": digest}
    return pa.table(columns)


def alignment(docs: DataFrame, path_a: str, path_b: str, **columns) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    held = stage(index(docs, path_a, path_b, **columns), "index")
    postings = held.where("code is not null").select(
        F.col("container").alias("of"), "code", F.col("documents").alias("bitmap"), "planes", "n_documents", "links"
    )
    scores = stage(pair_scores(postings), "scores").select(
        "code", F.col("documents").alias("score"), (F.col("documents") == F.col("best")).alias("is_best")
    )
    returned = postings.select("of", "code", "bitmap", "planes").join(few(scores, FEW_PAIRS), "code").drop("code")
    rows = held.where("row is not null").select("container", "row", *DOCUMENT, "groups_sha256")
    schema = ", ".join(f"{c} bigint" for c in [*DOCUMENT, "n_best", "count_sum"]) + ", groups_sha256 string"
    return rows.groupBy("container").cogroup(returned.groupBy("of")).applyInArrow(_scored, schema)
