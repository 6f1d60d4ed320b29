"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenized once; what exceeds ``max_len`` is cut into full pieces and one
rest. The histogram of piece lengths has at most ``max_len`` rows whatever the corpus
size, and it alone decides: lengths are placed longest first, each into the pack pattern
with the most room, and only the counts of patterns change. Pieces then find their place
by their rank among the pieces of their length, ranked bucket by bucket of a hash of the row.

Texts are first split at the tokenizer's added tokens (as ``<|endoftext|>``), which get
their own ids wherever they stand, as the library does by default.

Defined cases: null text is an empty text, which is the end token alone; repeated rows are
packed as separate documents; ties in rank are broken by doc_id, start, checksum and place; a
null doc_id is kept; an empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.llm.common import prefix_sums, stage

#: Pieces of one length and bucket that a ranking task sorts, about.
BUCKET_ROWS = 256
#: Entries after which the table of encoded chunks is emptied; it bounds a worker's memory.
CHUNKS = 600_000


class _Chunks(dict):
    """Ids of the chunk that a word makes with the space before it, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError("white space beside a space")
        if len(self) >= CHUNKS:
            self.clear()
        found = self[word] = self.encode(" " + word)
        return found


class ChunkEncoder:
    """Token ids of a text as little-endian bytes, with equal chunks encoded once.

    The vocabulary's splitting pattern never joins a character other than white space
    with a single space after it that another such character follows, so texts can be
    cut before these spaces. Texts with other white space next to a space are cut less.
    Added tokens are ordinary text to it; see ``TextEncoder``.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tiktoken import Encoding
        from tokenizers import pre_tokenizers

        # A byte-level vocabulary numbers its tokens in the order of their merges, so that
        # its ids are ranks, and short chunks are merged several times faster by rank.
        printable = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in visible]
        byte = dict(zip(printable, visible + hidden, strict=True))
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if byte.keys() >= set(t)}
        special = "<|endoftext|>"
        ranks = {t: i for t, i in ranks.items() if t != special.encode()}
        self.ranks = ranks
        self.encode = Encoding(
            "chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.chunks = _Chunks(self.ids)

    def ids(self, chunk: str) -> bytes:
        return array("I", self.encode(chunk)).tobytes()

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if not rest or not first or first[-1].isspace():
                raise ValueError("no space to cut at")
            return self.ids(first) + b"".join(map(self.chunks.__getitem__, rest))
        except ValueError:
            return b"".join(map(self.ids, self._parts(first, rest)))

    @staticmethod
    def _parts(first: str, rest: list[str]) -> Iterator[str]:
        held = [first]
        for word in rest:
            if word and not word[0].isspace() and held[-1] and not held[-1][-1].isspace():
                yield " ".join(held)
                held = ["", word]
            else:
                held.append(word)
        yield " ".join(held)


@cache
def encoder(path: str) -> ChunkEncoder:
    """One per worker process, so that its chunks serve all of the worker's tasks."""
    return ChunkEncoder(path)


class TextEncoder:
    """Token ids of a whole text as little-endian bytes: added tokens, and the text between them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            tokens = json.load(file).get("added_tokens") or []
        flags = ("single_word", "lstrip", "rstrip")
        if any(t.get(flag) for t in tokens for flag in flags):
            raise ValueError("added tokens that depend on what stands beside them")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens}
        # Of tokens that begin at one place the longest is taken.
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, longest))})").split if longest else lambda text: [text]
        self.between = encoder(path)

    def __call__(self, text: str) -> bytes:
        first, *rest = self.split(text)
        ids = self.between(first)
        for token, after in zip(rest[::2], rest[1::2], strict=True):
            ids += self.added[token] + self.between(after)
        return ids


@cache
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def tokenized_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    max_len: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) per piece of at most ``max_len`` ids."""
    columns = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in columns) + ", ids binary" * keep_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, max_len):
                    own = ids[4 * start : 4 * (start + max_len)]
                    row = [doc, start, len(own) // 4, zlib.crc32(own), n] + [own] * keep_ids
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            types = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            names = ["doc_id", *columns] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        pieces, schema
    )


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many packs) by shortest-pack-first. The number of patterns depends on
    the number of distinct lengths only."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            room = max(packs, default=-1)
            if room < length:
                # Of the new packs each is filled before the next is opened: it has the most room.
                per = max_len // length
                for held, count in (((length,) * per, left // per), ((length,) * (left % per), 1)):
                    if held and count:
                        placed.append((max_len - len(held) * length, held, count))
                break
            held, count = packs[room].pop()
            if not packs[room]:
                del packs[room]
            used = min(left, count)
            if used < count:
                packs.setdefault(room, []).append((held, count - used))
            placed.append((room - length, (*held, length), used))
            left -= used
            # A pack with room for more stays in the running for the rest of this length.
            if room - length >= length and left:
                packs.setdefault(room - length, []).append(placed.pop()[1:])
        for room, held, count in placed:
            packs.setdefault(room, []).append((held, count))
    return [(held, count) for room in sorted(packs) for held, count in packs[room]]


def pack(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to staged pieces, whose ``_at`` tells rows apart.

    Collected to the driver: one count per length, at most ``max_len`` rows. Broadcast: one row
    per pattern and length in it; both follow from the histogram, whatever the number of pieces.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for held, count in patterns(histogram, max_len):
        offset = 0
        for length, run in groupby(held):
            times = len(list(run))
            slots.append((length, ranks[length], ranks[length] + count * times, sequence, offset, times))
            ranks[length] += count * times
            offset += length * times
        sequence += count
    slot_table = spark.createDataFrame(
        slots, "slot_length bigint, first bigint, beyond bigint, sequence bigint, place bigint, times bigint"
    )
    counts = spark.createDataFrame(list(histogram.items()), "length bigint, n bigint")
    spread = pieces.join(F.broadcast(counts), "length").withColumn("n", F.ceil(F.col("n") / BUCKET_ROWS))
    ranked = prefix_sums(
        spread,
        "length",
        ["doc_id", "start", "ids_crc32", "_at"],
        F.pmod(F.xxhash64("_at"), F.col("n")),
        F.lit(1).cast("bigint"),
    ).drop("n")
    here = (
        (F.col("length") == F.col("slot_length"))
        & (F.col("before") >= F.col("first"))
        & (F.col("before") < F.col("beyond"))
    )
    return (
        ranked.join(F.broadcast(slot_table), here)
        .withColumn("sequence_id", F.col("sequence") + F.expr("(before - first) div times"))
        .withColumn("offset", F.expr("place + ((before - first) % times) * length"))
        .drop("slot_length", "first", "beyond", "sequence", "place", "times", "before", "_at")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, **options) -> DataFrame:
    """Tokenize, cut and pack. ``keep_ids`` returns the ids of every piece as well."""
    pieces = tokenized_pieces(docs, tokenizer_path, max_len=max_len, **options)
    return pack(stage(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces"), max_len)
