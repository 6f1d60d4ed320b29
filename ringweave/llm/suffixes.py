"""Suffix-array dedup: a distributed merge sort of suffixes that knows common prefixes.

Which bytes does a string of ``size`` bytes cover that also starts somewhere else? Every
such string (a window) has an anchor, the least of its ``GRAM``-byte substrings by hash,
which depends on nothing but the window; equal windows have their anchors at the same
offset. So only suffixes at anchors are sorted, each with the bytes before it that its
windows need, and only anchors whose gram occurs twice at all.

Every part of the input sorts its suffixes into a run with the common prefix of each with
the one before. Runs are cut at sampled splitters, exchanged front-coded (a suffix without
the prefix it shares with its predecessor) in small blocks, and merged by a loser tree that remembers how
far each waiting suffix agrees with the last one put out, so no known prefix is compared
again. In the merged order, windows are equal exactly if their suffixes agree to the
window's end and the bytes before their anchors agree to its start: two arrays of common
prefixes, one forward and one backward, tell for every offset. Equal suffixes of a part
are sent once. A splitter may part equal windows; those that agree with a splitter as far
as the window reaches are compared by a 128-bit hash; of those found equal within a range,
one speaks for all.

Defined cases: null text is empty; texts shorter than a window lose nothing; texts of any
length are worked through in overlapping pieces; repeated rows and ids are separate
documents and repeat each other; an empty table gives no rows; further columns are passed
through by ``cut``; those named ``_part``, ``_at`` or like what it adds are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.llm.common import partitions, stage
from ringweave.llm.parts import (
    ASKED,
    among,
    answer_repeated,
    ask_repeated,
    mixed,
    parted,
    per_part,
    sliding_min,
    split_keys,
    told_keys,
)

#: Bytes of the substring by which windows are anchored.
GRAM = 64
#: Bytes of a text that one piece of work holds.
PIECE = 1 << 19
#: Sampled suffixes per range that splitters are chosen from.
SAMPLES = 20
#: Bytes of a block of a front-coded run: what one row of a table or an exchange holds.
BLOCK = 1 << 16
#: Bytes asked for a Parquet row group of blocks. Parquet looks every 100 rows, so it is 6.5 MB in fact.
ROW_GROUP = 4 << 20
#: Bytes of front-coded suffixes that a range holds on average, if that makes more ranges than shuffle partitions.
RANGE = 8 << 20
_PLACE = np.uint64(21)  # bits of a position in a chunk of at most two pieces
_ODD = 0x9E3779B97F4A7C15


class Anchors(NamedTuple):
    """Anchors of a chunk: gram hash, position, and first and last window start."""

    gram: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _ODD, np.uint64)
    down = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 21)


def anchors(raw: np.ndarray, ends: np.ndarray, size: int) -> Anchors:
    """Anchors of all windows of a chunk; ``ends`` gives for every byte its piece's end."""
    n = len(raw)
    if n < size:
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none, none, none)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(raw.astype(np.uint64) * _DOWN[:n], dtype=np.uint64)])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * _UP[: n - GRAM + 1])
    keys = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, size - GRAM + 1)  # one per window start
    at = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
    start = np.flatnonzero(np.arange(len(at)) + size <= ends[: len(at)])
    at, piece = at[start], ends[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    begin = np.flatnonzero(new)
    finish = np.concatenate([begin[1:], [len(start)]])[: len(begin)] - 1
    return Anchors(grams[at[begin]], at[begin], start[begin], start[finish])


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """What anchors are asked for by. Their hashes are least ones, and crowd the low end of the key space."""
    return mixed(grams)


class Chunk(NamedTuple):
    raw: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # of every piece
    base: np.ndarray  # offset of the piece in its text
    begin: np.ndarray  # offset of the piece in the chunk


def chunks(texts: list[bytes | None], size: int) -> Iterator[Chunk]:
    """The texts in pieces that share ``size - 1`` bytes, so that every window is in one."""
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def flush() -> Chunk:
        lengths = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(lengths)
        return Chunk(
            np.frombuffer(b"".join(p for _, _, p in held), np.uint8),
            np.repeat(ends, lengths),
            np.array([r for r, _, _ in held]),
            np.array([b for _, b, _ in held]),
            ends - lengths,
        )

    for row, text in enumerate(texts):
        for base in range(0, max(0, len(text or b"") - size + 1), PIECE):
            piece = text[base : base + PIECE + size - 1]
            if total + len(piece) > PIECE + size and held:
                yield flush()
                held, total = [], 0
            held.append((row, base, piece))
            total += len(piece)
    if held:
        yield flush()


def _common(rows: list[bytes], width: int) -> np.ndarray:
    """Common prefix of every string with the one before it."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 8192):
        part = rows[i - 1 : i + 8192]
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in part), np.uint8).reshape(len(part), width)
        lengths = np.array([len(r) for r in part])
        differ = np.concatenate([flat[1:] != flat[:-1], np.ones((len(part) - 1, 1), bool)], axis=1)
        out[i : i + len(part) - 1] = np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1]))
    return out


class Run(NamedTuple):
    """Sorted suffixes with their common prefixes, what precedes them, and where they are."""

    suffix: list[bytes]
    common: list[int]
    before: list[bytes]  # reversed: nearest byte first
    row: np.ndarray
    at: np.ndarray


def encode(run: Run, start: int, end: int) -> bytes:
    """Front-coded slice of a run; its first suffix is whole."""
    common = [0, *run.common[start + 1 : end]][: end - start]
    suffix, before = run.suffix[start:end], run.before[start:end]
    parts = [
        np.array([end - start], "<u4").tobytes(),
        np.array(common, "<u2").tobytes(),
        np.array([len(s) for s in suffix], "<u2").tobytes(),
        np.array([len(b) for b in before], "<u2").tobytes(),
        run.row[start:end].astype("<i8").tobytes(),
        run.at[start:end].astype("<i8").tobytes(),
        b"".join(s[c:] for s, c in zip(suffix, common, strict=True)),
        b"".join(before),
    ]
    return b"".join(parts)


def decode(blob: bytes) -> Run:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    common, length, ahead = np.frombuffer(blob, "<u2", 3 * n, 4).reshape(3, n)
    row, at = np.frombuffer(blob, "<i8", 2 * n, 4 + 6 * n).reshape(2, n)
    place = 4 + 22 * n
    suffix, before, last = [], [], b""
    for c, size in zip(common.tolist(), length.tolist(), strict=True):
        last = last[:c] + blob[place : place + size - c]
        suffix.append(last)
        place += size - c
    for size in ahead.tolist():
        before.append(blob[place : place + size])
        place += size
    return Run(suffix, common.tolist(), before, row, at)


def blocks(run: Run, size: int) -> list[bytes]:
    """A run front-coded in blocks of about ``size`` bytes."""
    sent = [22 + len(s) - c + len(b) for s, c, b in zip(run.suffix, run.common, run.before, strict=True)]
    cuts = np.flatnonzero(np.diff(np.cumsum(sent) // size)) + 1
    cuts = [0, *cuts.tolist(), len(sent)]
    return [encode(run, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def joined(coded: list[bytes]) -> Run:
    """The run of the blocks of one part, which come in any order."""
    runs = sorted((decode(b) for b in coded), key=lambda r: (r.suffix[0], r.before[0]))
    whole = Run([], [], [], np.concatenate([r.row for r in runs]), np.concatenate([r.at for r in runs]))
    for r in runs:
        first = _agree(whole.suffix[-1], r.suffix[0], 0) if whole.suffix else 0
        whole.suffix.extend(r.suffix)
        whole.common.extend([first, *r.common[1:]])
        whole.before.extend(r.before)
    return whole


def sliced(blob: bytes, splitters: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(range, block) of a block; one that no splitter cuts goes on as it is."""
    run = decode(blob)
    low, high = bisect_right(splitters, run.suffix[0]), bisect_right(splitters, run.suffix[-1])
    if low == high:
        yield low, blob
        return
    cuts = [0, *(bisect_left(run.suffix, s) for s in splitters[low:high]), len(run.suffix)]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), low):
        if b > a:
            yield number, encode(run, a, b)


def _agree(a: bytes, b: bytes, known: int) -> int:
    """Common prefix of two strings that agree in ``known`` bytes."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 8
    while low + step < high and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def merge(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """(run, index, common prefix with the one before) of all suffixes in order.

    A loser tree. ``known[r]``: how far run r's waiting suffix agrees with the suffix put
    out last, or with the winner that beat it, which on the path replayed is the same. Of
    two candidates the one that agrees further is smaller; only if both agree equally far
    are bytes compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[bytes | None] = [r.suffix[0] if r.suffix else None for r in runs] + [None] * (width - len(runs))
    known = [0 if h is not None else -1 for h in heads]
    index = [0] * width
    losers = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = heads[a], heads[b]
        agreed = _agree(x, y, known[a])
        if agreed == len(x) or (agreed < len(y) and x[agreed] < y[agreed]):
            known[b] = agreed
            return a, b
        known[a] = agreed
        return b, a

    level = list(range(width))
    while len(level) > 1:
        # Nodes of a level follow each other in the heap order of the tree.
        nodes = len(level) // 2
        won = [play(level[2 * i], level[2 * i + 1]) for i in range(nodes)]
        losers[nodes : 2 * nodes] = [b for _, b in won]
        level = [a for a, _ in won]
    top = level[0]
    of, at, common = [], [], []
    while known[top] >= 0:
        i = index[top]
        of.append(top)
        at.append(i)
        common.append(known[top])
        run, i = runs[top], i + 1
        index[top] = i
        if i < len(run.suffix):
            heads[top], known[top] = run.suffix[i], run.common[i]
        else:
            heads[top], known[top] = None, -1
        node = (top + width) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2
    return of, at, common


def _sorted_run(rows: list[tuple[bytes, bytes, int, int]], width: int) -> Run:
    rows.sort(key=lambda r: (r[0], r[1]))
    suffix = [r[0] for r in rows]
    return Run(
        suffix,
        _common(suffix, width).tolist(),
        [r[1] for r in rows],
        np.array([r[2] for r in rows], np.int64),
        np.array([r[3] for r in rows], np.int64),
    )


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return np.array([row, start, end], "<i8").tobytes()


def _repeats(run: Run, size: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, offset) matrices: windows found equal to another, and those left open: they may
    repeat beyond a splitter. Of equal windows only one is left open, for those in other ranges.

    ``edge``: how far a suffix agrees with the nearer splitter.
    """
    n, offsets = len(run.suffix), size - GRAM + 1
    least = size - np.array([len(s) for s in run.suffix])  # of the offsets of an item's windows
    most = np.array([len(b) for b in run.before])
    ahead = np.array(run.common)
    order = np.array(sorted(range(n), key=run.before.__getitem__), np.int64)
    behind = _common([run.before[i] for i in order], size)
    reach = np.maximum(ahead, np.append(ahead[1:], 0))
    back = np.empty(n, np.int64)
    back[order] = np.maximum(behind, np.append(behind[1:], 0))
    equal, left_open = np.zeros((n, offsets), bool), np.zeros((n, offsets), bool)
    said = np.zeros((n, offsets), bool)  # equal to one that comes earlier by key
    left = np.empty(n, np.int64)
    for o in range(offsets):
        own = (least <= o) & (o <= most)
        left_open[:, o] = own & (edge >= size - o)
        some = np.flatnonzero(own & (reach >= size - o) & (back >= o))
        if len(some) < 2:
            continue
        right = np.cumsum(ahead < size - o)
        left[order] = np.cumsum(behind < o)
        key = right[some] * (n + 1) + left[some]
        by_key = np.argsort(key)
        same = key[by_key][1:] == key[by_key][:-1]
        equal[some[by_key[1:][same]], o] = True
        equal[some[by_key[:-1][same]], o] = True
        said[some[by_key[1:][same]], o] = True
    return equal, left_open & ~said


def _merged(batches: Iterator[pa.RecordBatch], size: int, splitters: list[bytes], ranges: int) -> Iterator[pa.RecordBatch]:
    """Merges the runs of each range; returns spans per part and open windows."""
    by_range: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for number, part, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            by_range.setdefault(number, {}).setdefault(part, []).append(blob)
    for number in list(by_range):
        sent = by_range.pop(number)
        parts = list(sent)
        runs = [joined(sent.pop(p)) for p in parts]  # coded and decoded, a part is held once
        of, index, common = merge(runs)
        whole = Run(
            [runs[r].suffix[i] for r, i in zip(of, index, strict=True)],
            common,
            [runs[r].before[i] for r, i in zip(of, index, strict=True)],
            np.array([runs[r].row[i] for r, i in zip(of, index, strict=True)]),
            np.array([runs[r].at[i] for r, i in zip(of, index, strict=True)]),
        )
        del runs
        part = np.array(parts)[of]
        low = [splitters[number - 1]] if number else []
        high = splitters[number : number + 1]
        edge = np.zeros(len(of), np.int64)
        for splitter, step in ((low, 1), (high, -1)):
            if splitter:
                first = _agree(whole.suffix[::step][0], splitter[0], 0)
                chain = whole.common[1:] if step == 1 else whole.common[:0:-1]
                edge = np.maximum(edge, np.minimum.accumulate([first, *chain])[::step])
        equal, left_open = _repeats(whole, size, edge)
        # Offsets downwards are window starts upwards; runs of them make one span.
        flat = np.pad(equal[:, ::-1], ((0, 0), (1, 1))).astype(np.int8)
        turns = np.diff(flat, axis=1)
        item, first = np.nonzero(turns == 1)
        last = np.nonzero(turns == -1)[1]
        most = equal.shape[1] - 1
        start = whole.at[item] - (most - first)
        end = whole.at[item] - (most - last + 1) + size
        rows: list[tuple] = []
        for p in np.unique(part[item]).tolist():
            mine = part[item] == p
            rows.append((p, _spans(whole.row[item[mine]], start[mine], end[mine]), None, None))
        item, offset = np.nonzero(left_open)
        digests = b"".join(
            hashlib.blake2b(whole.before[i][:o][::-1] + whole.suffix[i][: size - o], digest_size=16).digest()
            for i, o in zip(item.tolist(), offset.tolist(), strict=True)
        )
        open_windows = np.empty((len(item), 5), "<i8")
        open_windows[:, :2] = np.frombuffer(digests, "<i8").reshape(-1, 2)
        open_windows[:, 2:] = np.array([part[item], whole.row[item], whole.at[item] - offset]).T
        keys = open_windows[:, 0].view("<u8")
        open_windows = open_windows[np.argsort(keys)]
        cuts = split_keys(open_windows[:, 0].view("<u8"), ranges)
        rows += [
            (None, None, i, open_windows[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a
        ]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
            ["_part", "spans", "range", "windows"],
        )


def _close(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Spans per part of the open windows that several ranges sent, by equal digests."""
    blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
    found = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 5)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    same = (found[1:, :2] == found[:-1, :2]).all(axis=1)
    twice = np.zeros(len(found), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = found[twice]
    parts = np.unique(found[:, 2])
    spans = [_spans(mine[:, 3], mine[:, 4], mine[:, 4] + size) for mine in (found[found[:, 2] == p] for p in parts)]
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(spans, pa.binary())], ["_part", "spans"])


def _covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    depth = np.zeros(length + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0


def cut(docs: DataFrame, text_col: str = "text", size: int = 200) -> DataFrame:
    """``docs`` with every repeated byte taken out of ``text_col``, and n_bytes, n_removed,
    n_spans and kept_sha256. Where a cut splits a character, its other bytes go from the
    text as well; the digest is of the bytes kept."""
    if size <= GRAM:
        raise ValueError(f"windows need more than {GRAM} bytes")
    spark = docs.sparkSession
    n, block, range_bytes = partitions(spark), BLOCK, RANGE
    docs = docs.drop("_part", "_at", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    parts = parted(docs)

    def texts(rows: pa.Table) -> list[bytes | None]:
        return rows[text_col].cast(pa.binary()).to_pylist()

    def ask(rows: pa.Table) -> pa.Table:
        found = [anchors(c.raw, c.ends, size).gram for c in chunks(texts(rows), size)]
        part = rows["_part"][0].as_py()
        return ask_repeated(part, gram_keys(np.concatenate([np.zeros(0, np.uint64), *found])), n)

    narrow = parts.select("_part", "_at", text_col)
    told = stage(answer_repeated(per_part(narrow, ask, ASKED), n), "grams")

    def runs(rows: pa.Table, answers: pa.Table) -> pa.Table:
        twice = told_keys(answers, 1) if answers.num_rows else np.zeros(0, np.uint64)
        items: dict[tuple[bytes, bytes], tuple[int, int]] = {}
        again: list[tuple[int, int, int]] = []
        part = rows["_part"][0].as_py() if rows.num_rows else 0
        for c in chunks(texts(rows), size) if len(twice) else ():
            a = anchors(c.raw, c.ends, size)
            some = np.flatnonzero(among(gram_keys(a.gram), twice))
            raw = c.raw.tobytes()
            piece = np.searchsorted(c.begin, a.at[some], side="right") - 1
            shift = c.base[piece] - c.begin[piece]
            for at, first, last, row, add in zip(
                *(x.tolist() for x in (a.at[some], a.first[some], a.last[some], c.row[piece], shift)), strict=True
            ):
                key = (raw[at : last + size], raw[first:at][::-1])
                other = items.setdefault(key, (row, at + add))
                if other != (row, at + add):
                    again.append((row, first + add, last + add + size))
                    row, at = other  # its windows are repeated as well, once said
                    again.append((row, at - len(key[1]), at + len(key[0])))
        run = _sorted_run([(s, b, r, a) for (s, b), (r, a) in items.items()], size)
        every = max(1, len(run.suffix) // SAMPLES)
        sample = run.suffix[every // 2 :: every]
        spans = np.unique(np.array(again, np.int64).reshape(-1, 3), axis=0).T
        # What is read apart has columns of its own: samples and spans are read without the runs.
        made_rows: list[tuple] = [(part, len(b), b, None, None) for b in blocks(run, block)]
        if spans.size:
            made_rows.append((part, None, None, _spans(*spans), None))
        made_rows += [(part, None, None, None, s) for s in sample]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays(
            [pa.array([r[k] for r in made_rows], kind) for k, kind in enumerate(kinds)],
            ["_part", "n_bytes", "run", "spans", "sample"],
        )

    made_columns = "_part bigint, n_bytes bigint, run binary, spans binary, sample binary"
    made = stage(per_part(narrow, runs, made_columns, told), "runs", group_bytes=ROW_GROUP)
    n_ranges = max(n, -(-(made.agg(F.sum("n_bytes")).first()[0] or 0) // range_bytes))
    # A fixed number of sampled suffixes per part, thinned to a bound that follows the number of ranges.
    some = made.where("sample is not null").select("sample")
    some = some.orderBy(F.xxhash64("sample")).limit(SAMPLES * n_ranges * 10).collect()
    sample = sorted(bytes(r["sample"]) for r in some)
    splitters = sorted({sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)}) if sample else []

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["range", "_part", "run"])

        held: list[tuple] = []
        for batch in batches:
            for part, blob in zip(batch.column(0), batch.column(1), strict=True):
                held += [(number, part.as_py(), cut_off) for number, cut_off in sliced(blob.as_py(), splitters)]
                if sum(len(r[2]) for r in held) >= 16 * block:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    dealt = (
        made.where("run is not null")
        .select("_part", "run")
        .mapInArrow(slices, "range int, _part bigint, run binary")
        .repartitionById(n_ranges, F.col("range"))
    )
    found = stage(
        dealt.mapInArrow(
            lambda batches: _merged(batches, size, splitters, n),
            "_part bigint, spans binary, range int, windows binary",
        ),
        "spans",
    )
    late = (
        found.where("windows is not null")
        .select("range", "windows")
        .repartitionById(n, F.col("range"))
        .mapInArrow(lambda batches: _close(batches, size), "_part bigint, spans binary")
    )
    spans = (
        found.where("spans is not null")
        .select("_part", "spans")
        .union(made.where("spans is not null").select("_part", "spans"))
        .union(late)
    )
    columns = docs.columns
    text_at = columns.index(text_col)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = rows.select(columns) if rows.num_rows else None
        if own is None:
            return pa.Table.from_pylist([], schema=empty)
        held = [np.zeros((3, 0), np.int64)]
        if answers.num_rows:
            held += [np.frombuffer(b, "<i8").reshape(3, -1) for b in answers["spans"].to_pylist()]
        row, start, end = np.concatenate(held, axis=1)
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        edges = np.searchsorted(row, np.arange(rows.num_rows + 1))
        kept_texts, facts = [], []
        for i, text in enumerate(texts(rows)):
            a, b = edges[i], edges[i + 1]
            raw = text or b""
            kept, removed, runs_of = raw, 0, 0
            if b > a:
                gone = _covered(len(raw), start[a:b], end[a:b])
                removed = int(gone.sum())
                runs_of = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            facts.append((len(raw), removed, runs_of, hashlib.sha256(kept).hexdigest()))
            kept_texts.append(None if text is None else kept.decode("utf-8", "ignore"))
        own = own.set_column(text_at, text_col, pa.array(kept_texts, pa.string()))
        kinds = [pa.int64()] * 3 + [pa.string()]
        for k, (name, kind) in enumerate(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), kinds, strict=True)):
            own = own.append_column(name, pa.array([f[k] for f in facts], kind))
        return own

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(list(docs.schema.fields))
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, LongType())
    schema = schema.add("kept_sha256", StringType())
    empty = to_arrow_schema(schema)
    return per_part(parts, finish, schema, spans)
