"""Substring dedup by recompression: repeats found through symbols that name token runs.

Rounds of recompression replace runs of equal symbols, and then pairs of a left and a right
symbol, by new symbols. A symbol is left or right by a bit of its name, and the name of a
new symbol is a hash of what it stands for, so every part of the corpus gives equal strings
the same names without asking: naming is global and needs no shuffle. Equal strings get
equal interior symbols. Only the first and last symbols of a window can depend on what
surrounds it; each round leaves them out, and what is left at the highest level that has
any is determined by the window alone.

The least such symbol is the window's witness. Spark counts witnesses: where a witness
stands once in the corpus, its windows are unique. Windows with a shared witness are
verified by a 96-bit hash of their words, for which the least document id is looked up.

Defined cases: null text has no words; texts with fewer words than a window lose nothing;
a null doc_id counts as larger than all others; repeated rows with one doc_id do not
remove each other's words; an empty table gives no rows; further columns are passed
through by ``cut``; those named ``_part``, ``_at`` or like what it adds are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from ringweave.llm.common import partitions, stage
from ringweave.llm.parts import (
    ASKED,
    _whole_ranges,
    among,
    answer_repeated,
    ask_repeated,
    mixed,
    parted,
    per_part,
    split_keys,
    told_keys,
)

#: Rounds of run and pair compression.
ROUNDS = 4
#: Words of one piece of work; longer texts are worked through in overlapping pieces.
PIECE = 1 << 17
#: Bytes that one step of hashing takes, about.
BLOCK = 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SALTS = np.arange(ROUNDS + 1, dtype=np.uint64) * _B
_NO_ID = np.iinfo(np.int64).max


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    up, down = np.full(n, _A, np.uint64), np.full(n, pow(int(_A), -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_UP, _DOWN = _powers(2 * BLOCK)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    raw = np.frombuffer(text, np.uint8)
    blank = _BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    out, at = [], 0
    while at < len(starts):
        # Whole words of about BLOCK bytes, so that the powers needed are bounded but for longer words.
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + BLOCK)))
        high = starts[to] if to < len(starts) else len(raw)
        n = int(high - low)
        up, down = (_UP, _DOWN) if n <= len(_UP) else _powers(n)
        values = (raw[low:high] + np.uint64(1)) * up[:n]
        values[blank[low:high]] = 0
        own = starts[at:to] - low
        out.append(mixed(np.add.reduceat(values, own) * down[own]))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Chunk(NamedTuple):
    words: np.ndarray  # hashes
    piece: np.ndarray  # piece number of every word
    row: np.ndarray  # of every piece
    base: np.ndarray  # number of the piece's first word in its text
    begin: np.ndarray  # place of the piece in the chunk


def chunks(texts: list[bytes | None], size: int) -> Iterator[Chunk]:
    """Word hashes of the texts in pieces that share ``size - 1`` words."""
    held: list[tuple[int, int, np.ndarray]] = []
    total = 0

    def flush() -> Chunk:
        lengths = np.array([len(h) for _, _, h in held])
        return Chunk(
            np.concatenate([h for _, _, h in held]),
            np.repeat(np.arange(len(held)), lengths),
            np.array([r for r, _, _ in held]),
            np.array([b for _, b, _ in held]),
            np.cumsum(lengths) - lengths,
        )

    for row, text in enumerate(texts):
        hashed = word_hashes(text or b"")
        for base in range(0, len(hashed) - size + 1, PIECE):
            piece = hashed[base : base + PIECE + size - 1]
            if held and total + len(piece) > PIECE + size:
                yield flush()
                held, total = [], 0
            held.append((row, base, piece))
            total += len(piece)
    if held:
        yield flush()


def _runs(symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names after run compression, and the new symbol that every old one became part of."""
    new = np.ones(len(symbols), bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (piece[1:] != piece[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(symbols))).astype(np.uint64)
    names = symbols[begin]
    return np.where(length > 1, mixed(names * _A + length), names), np.cumsum(new) - 1


def _is_right(symbols: np.ndarray, level: int) -> np.ndarray:
    return (mixed(symbols + np.uint64(level)) & np.uint64(1)).astype(bool)


def _pairs(symbols: np.ndarray, piece: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names after pairs of a left and a right symbol are joined, and the new symbol of every old one."""
    right = _is_right(symbols, level)
    joined = np.zeros(len(symbols), bool)  # with the symbol before
    joined[1:] = ~right[:-1] & right[1:] & (piece[1:] == piece[:-1])
    begin = np.flatnonzero(~joined)
    second = np.minimum(begin + 1, len(symbols) - 1)
    pair = joined[second] & (second > begin)
    names = np.where(pair, mixed(symbols[begin] * _A + mixed(symbols[second] + _B)), symbols[begin])
    return names, np.cumsum(~joined) - 1


def _range_min(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least key in every closed range, by a table of doubling widths."""
    width = high - low + 1
    out = np.empty(len(low), np.uint64)
    table, step, level = keys, 1, 0
    powers = np.frexp(width)[1] - 1
    top = int(powers.max(initial=-1))
    while level <= top:
        some = np.flatnonzero(powers == level)
        out[some] = np.minimum(table[low[some]], table[high[some] - step + 1])
        if level < top:
            table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        step, level = step * 2, level + 1
    return out


def window_starts(piece: np.ndarray, size: int) -> np.ndarray:
    start = np.arange(max(0, len(piece) - size + 1))
    return start[piece[start] == piece[start + size - 1]]


def witnesses(words: np.ndarray, piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, their witnesses' names)."""
    start = window_starts(piece, size)
    names = np.zeros(len(start), np.uint64)
    low, high = start, start + size - 1  # the symbols that the window determines
    alive = np.arange(len(start))
    symbols, places = words, piece
    for level in range(ROUNDS + 1):
        own, first, last = alive, low, high
        keys = symbols
        if level < ROUNDS:
            # The first and last run may be longer than what the window shows of it.
            shorter, into = _runs(symbols, places)
            places = places[np.flatnonzero(np.diff(into, prepend=-1))]
            low, high = into[low] + 1, into[high] - 1
            # A right symbol in front may join what precedes it, a left one at the end what follows.
            right = _is_right(shorter, level)
            some = low <= high
            low, high, alive = low[some], high[some], alive[some]
            low, high = low + right[low], high - ~right[high]
            some = low <= high
            low, high, alive = low[some], high[some], alive[some]
            symbols, into = _pairs(shorter, places, level)
            places = places[np.flatnonzero(np.diff(into, prepend=-1))]
            low, high = into[low], into[high]
            # A window's witness is of the highest level that leaves it a symbol.
            ends = np.ones(len(start), bool)
            ends[alive] = False
            stays = ends[own]
            own, first, last = own[stays], first[stays], last[stays]
        if len(own):
            names[own] = _range_min(mixed(keys + _SALTS[level]), first, last)
    return start, names


def window_hashes(words: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys and 32-bit checks of the windows at ``start``."""
    out = []
    for odd, salt in ((_A, np.uint64(3)), (_B, np.uint64(5))):
        base = pow(int(odd), -1, 1 << 64)
        up = np.full(len(words), odd, np.uint64)
        down = np.full(len(words), base, np.uint64)
        if len(words):
            up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words + salt) * down, dtype=np.uint64)])
        out.append(mixed((sums[start + size] - sums[start]) * up[start]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


class Windows(NamedTuple):
    """Candidate windows of a part, and the distinct ones with their least document."""

    row: np.ndarray
    start: np.ndarray
    number: np.ndarray  # of the distinct window
    key: np.ndarray
    check: np.ndarray
    least: np.ndarray


def _shared(shared: np.ndarray, size: int) -> Callable[[Chunk], np.ndarray]:
    """Which windows of a chunk have a shared witness?"""
    return lambda c: among(witnesses(c.words, c.piece, size)[1], shared)


def _as_noted(bits: np.ndarray, size: int) -> Callable[[Chunk], np.ndarray]:
    """The same, from the answers of an earlier pass put end to end."""
    at = 0

    def pick(c: Chunk) -> np.ndarray:
        nonlocal at
        n = len(window_starts(c.piece, size))
        at += n
        return bits[at - n : at]

    return pick


def _windows(
    texts: list[bytes | None], ids: np.ndarray, pick: Callable[[Chunk], np.ndarray], size: int
) -> tuple[Windows, np.ndarray]:
    """The windows of a part that ``pick`` takes, and its answers."""
    rows, starts, keys, checks = ([np.zeros(0, k)] for k in (np.int64, np.int64, np.uint64, np.uint32))
    picked = [np.zeros(0, bool)]
    for c in chunks(texts, size):
        picked.append(pick(c))
        start = window_starts(c.piece, size)[picked[-1]]
        key, check = window_hashes(c.words, start, size)
        piece = c.piece[start]
        rows.append(c.row[piece])
        starts.append(start - c.begin[piece] + c.base[piece])
        keys.append(key)
        checks.append(check)
    row, start, key, check = (np.concatenate(x) for x in (rows, starts, keys, checks))
    order = np.lexsort((check, key))
    new = np.ones(len(order), bool)
    k, c = key[order], check[order]
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[row[order]], first) if len(first) else np.zeros(0, np.int64)
    return Windows(row, start, number, k[first], c[first], least), np.concatenate(picked)


ASKED_LEAST = "range int, _part bigint, keys binary, checks binary, least binary"


def _ask_least(part: int, w: Windows, picked: np.ndarray, n: int) -> pa.Table:
    """Questions of a part, and a note to itself of the windows they are about."""
    cuts = split_keys(w.key, n)
    spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    blobs = [[x[a:b].tobytes() for _, a, b in spans] for x in (w.key, w.check, w.least)]
    blobs = [blobs[0] + [np.packbits(picked).tobytes()], blobs[1] + [None], blobs[2] + [None]]
    return pa.Table.from_arrays(
        [pa.array([i for i, _, _ in spans] + [part % n], pa.int32()), pa.array([part] * (len(spans) + 1), pa.int64())]
        + [pa.array(b, pa.binary()) for b in blobs],
        ["range", "_part", "keys", "checks", "least"],
    )


def _answer_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part and range: for each of its windows, does a smaller document hold it elsewhere?"""
    for rows in _whole_ranges(batches):
        every = pa.Table.from_batches(rows)
        notes = every.filter(every["least"].is_null())
        yield pa.RecordBatch.from_arrays(
            [notes[c].combine_chunks() for c in ("_part", "range", "keys")], ["_part", "kind", "keys"]
        ).set_column(1, "kind", pa.array([0] * notes.num_rows, pa.int32()))
        table = every.filter(every["least"].is_valid())
        if not table.num_rows:
            continue
        keys, checks, least = (
            np.concatenate([np.frombuffer(b, kind) for b in table[c].to_pylist()])
            for c, kind in (("keys", "<u8"), ("checks", "<u4"), ("least", "<i8"))
        )
        lengths = [len(b) // 8 for b in table["keys"].to_pylist()]
        order = np.lexsort((least, checks, keys))
        k, c = keys[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        smallest = least[order][first][np.cumsum(new) - 1]
        smaller = np.empty(len(order), bool)
        smaller[order] = smallest < least[order]
        told = [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(lengths)[:-1])]
        yield pa.RecordBatch.from_arrays(
            [
                table["_part"].combine_chunks(),
                # After the kinds below 2: the range's number, to put the answers in order.
                pa.array([2 + r for r in table["range"].to_pylist()], pa.int32()),
                pa.array(told, pa.binary()),
            ],
            ["_part", "kind", "keys"],
        )


def _smaller(told: pa.Table, w: Windows, n: int) -> np.ndarray:
    """For every distinct window of a part: is it in a smaller document of another part?"""
    out = np.zeros(len(w.key), bool)
    cuts = split_keys(w.key, n)
    for kind, bits in zip(told["kind"].to_pylist(), told["keys"].to_pylist(), strict=True):
        if kind >= 2:
            a, b = cuts[kind - 2], cuts[kind - 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, "u1"), count=b - a)
    return out


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """``docs`` without the words of windows that a document with a smaller id has too: the
    words kept are joined by one space in ``text_col``; n_words, n_removed and kept_sha256
    are added."""
    n = partitions(docs.sparkSession)
    docs = docs.drop("_part", "_at", "n_words", "n_removed", "kept_sha256")
    parts = parted(docs)
    narrow = parts.select("_part", "_at", id_col, text_col)

    def texts(rows: pa.Table) -> list[bytes | None]:
        return rows[text_col].cast(pa.binary()).to_pylist()

    def ids(rows: pa.Table) -> np.ndarray:
        return rows[id_col].cast(pa.int64()).fill_null(_NO_ID).to_numpy()

    def ask(rows: pa.Table) -> pa.Table:
        names = [np.zeros(0, np.uint64)]
        for c in chunks(texts(rows), size):
            start, own = witnesses(c.words, c.piece, size)
            # Neighbouring windows of one document share witnesses; one of each is asked for.
            piece = c.piece[start]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])
            names.append(own[new])
        return ask_repeated(rows["_part"][0].as_py(), np.concatenate(names), n)

    shared = stage(answer_repeated(per_part(narrow, ask, ASKED), n), "symbols")

    def verify(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows or not told.num_rows:
            return pa.Table.from_arrays(
                [pa.array([], pa.int32()), pa.array([], pa.int64())] + [pa.array([], pa.binary())] * 3,
                ["range", "_part", "keys", "checks", "least"],
            )
        w, picked = _windows(texts(rows), ids(rows), _shared(told_keys(told, 1), size), size)
        return _ask_least(rows["_part"][0].as_py(), w, picked, n)

    asked = per_part(narrow, verify, ASKED_LEAST, shared)
    least = stage(
        asked.repartitionById(n, F.col("range")).mapInArrow(_answer_least, "_part bigint, kind int, keys binary"), "least"
    )
    columns = docs.columns
    text_at = columns.index(text_col)
    schema = StructType(list(docs.schema.fields))
    schema = schema.add("n_words", LongType()).add("n_removed", LongType()).add("kept_sha256", StringType())
    empty = to_arrow_schema(schema)

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], schema=empty)
        own, own_ids = texts(rows), ids(rows)
        row = start = np.zeros(0, np.int64)
        if told.num_rows:
            note = next(v for k, v in zip(told["kind"].to_pylist(), told["keys"].to_pylist(), strict=True) if k == 0)
            bits = np.unpackbits(np.frombuffer(note, "u1")).astype(bool)
            w, _ = _windows(own, own_ids, _as_noted(bits, size), size)
            gone = _smaller(told, w, n)[w.number] | (w.least[w.number] < own_ids[w.row])
            row, start = w.row[gone], w.start[gone]
        order = np.argsort(row, kind="stable")
        row, start = row[order], start[order]
        edges = np.searchsorted(row, np.arange(rows.num_rows + 1))
        kept_texts, facts = [], []
        for i, text in enumerate(own):
            words = (text or b"").split()
            a, b = edges[i], edges[i + 1]
            kept = words
            if b > a:
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start[a:b], 1)
                np.add.at(depth, start[a:b] + size, -1)
                covered = np.cumsum(depth[:-1]) > 0
                kept = [x for x, c in zip(words, covered.tolist(), strict=True) if not c]
            joined = b" ".join(kept)
            facts.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
            kept_texts.append(None if text is None else joined.decode("utf-8", "replace"))
        out = rows.select(columns).set_column(text_at, text_col, pa.array(kept_texts, pa.string()))
        kinds = (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()))
        for k, (name, kind) in enumerate(kinds):
            out = out.append_column(name, pa.array([f[k] for f in facts], kind))
        return out

    return per_part(parts, finish, schema, least)
