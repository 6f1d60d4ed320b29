"""Phrase collocations by weighted acyclic automata.

Words that stand together more often than their parts do alone: every phrase of two to
``longest`` words with at least ``least`` occurrences is cut in two at every place, and scored
by the share of its parts' occurrences at the cut that explains it worst.

Counts live in count transducers: acyclic automata over words whose arcs carry weights, the
weight of the last arc of a phrase being its count. Every part of the input

0. splits its texts into words once and keeps their numbers, which every pass reads.
1. asks which of its words, then pairs, then triples are frequent in the corpus (sums of 40-bit
   keys by range); a phrase with an infrequent one inside is infrequent, so these are left out
   before longer ones are counted. Keys that collide only keep more than needed. The answer is
   a bit for every key in the order asked, as a part finds the same keys again.
2. sorts its phrases and builds transducers from them incrementally: when the next phrase
   leaves a path, the states behind are frozen, and equal ones become one state.

A phrase belongs to the range of the hash of its first three words, so that ranges stay even
whatever pair of words is common, and whatever extends a phrase of three words is with it.
A range unites the transducers of all parts and adds their weights, walking them together and
leaving branches whose sum is below ``least``; what remains is the range's transducer of
frequent phrases. The parts of its candidates may belong to other ranges: each range asks every
other for them once, with an automaton of the parts, which is composed with the transducer
there; the counts come back in the automaton's order.

Phrases of a longer candidate that has most of their occurrences are dropped, and the best per
language are taken in two steps, so that no task ranks all phrases of a language.

Defined cases: null text is empty; null languages are ``und``; words are compared as UTF-8 bytes
after A-Z are lower-cased; no phrase crosses a piece (cut at ``.,;:!?`` and line ends) or a
document; repeated rows count again; texts of any length are read whole; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import few, partitions, stage
from ringweave.llm.parts import PART_ROWS, mixed, parted, per_part

#: Bytes of text whose phrases one range unites, about.
RANGE_BYTES = 256 << 20
#: Tasks of a language in the first step of ranking.
RANK_TASKS = 64
_BREAK = b"\xff"  # a byte that no UTF-8 text has
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words of one language, numbered from a counter that all languages of a part share."""

    def __init__(self, lang: bytes, known: list[tuple[bytes, bytes]]):
        super().__init__({_BREAK: -1})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.known)
        self.known.append((self.lang, word))
        return number


class Words(NamedTuple):
    """The words of a part: numbers in reading order, -1 where a piece ends, and what they stand for."""

    numbers: np.ndarray
    known: list[tuple[bytes, bytes]]  # (language, word)
    hashes: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Words:
        known: list[tuple[bytes, bytes]] = []
        langs: dict[bytes, _Numbers] = {}
        numbers = array("i", [-1])
        for lang, text in zip(rows["lang"].cast(pa.binary()).to_pylist(), rows["text"].cast(pa.binary()), strict=True):
            pieces = (text.as_py() or b"").lower().translate(_CUTS).replace(b"\n", b" " + _BREAK + b" ")
            numbers.extend(map(langs.setdefault(lang, _Numbers(lang, known)).__getitem__, pieces.split()))
            numbers.append(-1)
        return cls(np.array(numbers, np.int64), known, _word_hashes(known))

    def stored(self) -> dict[str, object]:
        """Columns of ``STORED``: words are numbered anew, the most frequent first, and numbers cut into byte planes."""
        order = np.argsort(-self.counts(), kind="stable")
        number = np.zeros(len(order) + 1, "<u4")  # the last for -1
        number[order] = np.arange(1, len(order) + 1)
        langs = sorted({lang for lang, _ in self.known})
        place = {lang: i for i, lang in enumerate(langs)}
        known = [self.known[i] for i in order.tolist()]
        return {
            "numbers": np.ascontiguousarray(number[self.numbers].view(np.uint8).reshape(-1, 4).T).tobytes(),
            "words": b"\n".join(word for _, word in known),
            "langs": langs,
            "lang_of": np.array([place[lang] for lang, _ in known], "<u4").tobytes(),
        }

    @classmethod
    def read(cls, rows: pa.Table) -> Words:
        """The words of a part of ``STORED`` rows."""
        numbers, words, langs, lang_of = (rows[c][0].as_py() for c in ("numbers", "words", "langs", "lang_of"))
        planes = np.frombuffer(numbers, np.uint8).reshape(4, -1)
        own = [langs[i] for i in np.frombuffer(lang_of, "<u4").tolist()]
        known = list(zip(own, words.split(b"\n"), strict=True)) if own else []
        return cls(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64) - 1, known, _word_hashes(known))

    def counts(self) -> np.ndarray:
        return np.bincount(self.numbers[self.numbers >= 0], minlength=len(self.known))

    def grams(self, told: list[np.ndarray], n: int) -> Iterator[Grams]:
        """Phrases of one word, two, ...: one length more than ``told`` has answers of ``n`` ranges, each of
        frequent phrases only in what is inside it (and the last of all lengths before)."""
        frequent = _answered(self.hashes, told[0], n) if told else np.ones(len(self.known), bool)
        good = np.append(frequent, False)[self.numbers]
        place = np.flatnonzero(good)
        code = self.numbers[place]
        counts = np.bincount(code, minlength=len(self.known))
        every = np.flatnonzero(counts)
        rank = np.cumsum(counts > 0) - 1
        where, hashes = rank[code], self.hashes[every]
        yield Grams(None, every, hashes, counts[every], frequent[every])
        for length in range(2, len(told) + 2):
            if length > 2:  # phrases of the last length whose key is frequent
                kept = frequent[where]
                good = np.zeros(len(self.numbers), bool)
                good[place[kept]] = True
                place, where = place[kept], where[kept]
            more = good[np.minimum(place + 1, len(good) - 1)] & (place + 1 < len(good))
            place, where = place[more], where[more]
            codes = where * len(self.known) + self.numbers[place + length - 1]
            if length <= len(told):
                codes, where, counts = np.unique(codes, return_inverse=True, return_counts=True)
            else:  # nothing is built on the last length
                codes, counts = np.unique(codes, return_counts=True)
            before, word = np.divmod(codes, max(1, len(self.known)))
            hashes = _extended(hashes[before], self.hashes[word])
            frequent = _answered(hashes, told[length - 1], n) if length <= len(told) else np.ones(len(word), bool)
            yield Grams(before, word, hashes, counts, frequent)


STORED = "size bigint, numbers binary, words binary, langs array<binary>, lang_of binary"


def stored_words(rows: DataFrame) -> DataFrame:
    """One row of ``STORED`` for at most ``PART_ROWS`` rows (lang, text) that one task reads: their text is split once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                part = pa.Table.from_batches([batch.slice(start, PART_ROWS)])
                size = pc.sum(pc.binary_length(part["text"].cast(pa.binary()))).as_py() or 0
                made = {"size": size} | Words.of(part).stored()
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
                columns = [pa.array([x], k) for x, k in zip(made.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, list(made))

    return rows.mapInArrow(run, STORED)


class Grams(NamedTuple):
    """The distinct phrases of one length: each without its last word (a place among those of the
    length before), that word, a hash, how often it stands in the part, and whether it may be
    frequent by what the part was told."""

    before: np.ndarray | None
    word: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    frequent: np.ndarray


def _word_hashes(words: list[tuple[bytes, bytes]]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(lang + b"\0" + word) for lang, word in words), np.uint64, len(words))


def _extended(start: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase that goes on with a word."""
    return mixed(start * _ODD + word)


def _range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of 64-bit values each is in."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.searchsorted(edges, hashes, side="right")


# --- counting which phrases are frequent, by 40-bit keys

COUNTED = "range int, _part bigint, counted binary"


def _keys(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(24)


def _in_ranges(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes their order, and in that order their ranges, their keys, and where another key or range begins."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    numbers, keys = _range_of(ordered, n), _keys(ordered)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1])
    return order, numbers, keys, new


def _answered(hashes: np.ndarray, told: np.ndarray, n: int) -> np.ndarray:
    """The answers, one for every key that ``_counted`` asked about, dealt out to the hashes."""
    order, _, _, new = _in_ranges(hashes, n)
    if np.count_nonzero(new) != len(told):
        raise ValueError(f"{len(told)} answers to {np.count_nonzero(new)} keys")
    out = np.empty(len(hashes), bool)
    out[order] = told[np.cumsum(new) - 1]
    return out


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that high bytes that are zero take no room."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _sorted_blob(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _sorted_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob), dtype=np.uint64)


def _counted(part: int, grams: Grams | None, n: int) -> pa.Table:
    """What a part asks: sorted keys and their counts, cut into ``n`` ranges."""
    out: list[tuple[int, int, bytes]] = []
    if grams is not None and len(grams.word):
        order, numbers, keys, new = _in_ranges(grams.hashes, n)
        starts = np.flatnonzero(new)
        numbers, keys, sums = numbers[starts], keys[starts], np.add.reduceat(grams.counts[order], starts).astype(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(numbers)], strict=True):
            blob = _sorted_blob(keys[a:b])
            out.append((int(numbers[a]), part, len(blob).to_bytes(8, "little") + blob + _planes(sums[a:b])))
    kinds = {"range": pa.int32(), "_part": pa.int64(), "counted": pa.binary()}
    return pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(kinds.items())})


def _frequent(counted: DataFrame, least: int, kind: int) -> DataFrame:
    """``TOLD``: of a part's keys in a range, in their order, whether all parts together hold them ``least`` times."""

    def judge(rows: pa.Table) -> pa.Table:
        lists, counts = [], []
        for blob in rows["counted"].to_pylist():
            end = 8 + int.from_bytes(blob[:8], "little")
            lists.append(_sorted_keys(blob[8:end]))
            counts.append(_from_planes(blob[end:]))
        every, where = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate(counts), minlength=len(every))
        good = (sums >= least)[where]
        ends = np.cumsum([len(k) for k in lists])[:-1]
        told = [_bits(g) for g in np.split(good, ends)]
        kinds = pa.array([kind] * len(told), pa.int32())
        columns = [rows["_part"].combine_chunks(), kinds, rows["range"].combine_chunks(), pa.array(told, pa.binary())]
        return pa.table(dict(zip(("_part", "kind", "range", "kept"), columns, strict=True)))

    return counted.groupBy("range").applyInArrow(judge, TOLD)


TOLD = "_part bigint, kind int, range int, kept binary"


def _bits(kept: np.ndarray) -> bytes:
    return len(kept).to_bytes(8, "little") + zlib.compress(np.packbits(kept).tobytes(), 1)


def _from_bits(blob: bytes) -> np.ndarray:
    packed = np.frombuffer(zlib.decompress(blob[8:]), np.uint8)
    return np.unpackbits(packed, count=int.from_bytes(blob[:8], "little")).astype(bool)


def _told(answers: pa.Table, lengths: int) -> list[np.ndarray]:
    """The answers to a part's keys for phrases of one word, two, ..., in the order of ``_in_ranges``."""
    lists: list[list[np.ndarray]] = [[np.zeros(0, bool)] for _ in range(lengths)]
    if answers.num_rows:
        columns = (answers[c].to_pylist() for c in ("kind", "range", "kept"))
        for kind, _, blob in sorted(zip(*columns, strict=True), key=lambda row: row[:2]):
            lists[kind - 1].append(_from_bits(blob))
    return [np.concatenate(x) for x in lists]


# --- transducers


class Transducer(NamedTuple):
    """States with arcs (label, weight, state); labels stand for ``words``. The last state is the start."""

    words: list[bytes]
    first: list[int]  # of the arcs of every state, and their end
    label: list[int]
    weight: list[int]
    target: list[int]

    def arcs(self, state: int) -> range:
        return range(self.first[state], self.first[state + 1])

    @property
    def start(self) -> int:
        return len(self.first) - 2


class Builder:
    """A minimal weighted automaton from phrases in sorted order."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.path: list[int] = []
        self.weights: list[int] = []
        self.open: list[list[int]] = [[]]

    def _freeze(self, depth: int) -> None:
        while len(self.path) > depth:
            arcs = tuple(self.open.pop())
            state = self.register.setdefault(arcs, len(self.register))
            self.open[-1] += (self.path.pop(), self.weights.pop(), state)

    def add(self, phrase: tuple[int, ...], weight: int) -> None:
        """Labels that are greater than those before in lexicographic order."""
        same = 0
        for a, b in zip(self.path, phrase, strict=False):
            if a != b:
                break
            same += 1
        self._freeze(same)
        for label in phrase[same:]:
            self.path.append(label)
            self.weights.append(0)
            self.open.append([])
        self.weights[-1] = weight

    def encoded(self, words: list[bytes]) -> bytes:
        """The automaton as bytes; only words on its arcs are written."""
        self._freeze(0)
        states = [*self.register, tuple(self.open[0])]  # the start is never shared
        arcs = np.array([x for s in states for x in s], "<i8").reshape(-1, 3)
        used, labels = np.unique(arcs[:, 0], return_inverse=True)
        own = [words[i] for i in used.tolist()]
        sizes = np.array([len(s) // 3 for s in states], "<i8")
        # States stand after those they lead to, most of them shortly after.
        back = np.repeat(np.arange(len(states)), sizes) - arcs[:, 2]
        columns = [sizes, labels, arcs[:, 1], back, np.array([len(w) for w in own], "<i8")]
        blobs = [_narrow(c) for c in columns]
        head = np.array([len(b) for b in blobs], "<i8").tobytes()
        return zlib.compress(head + b"".join(blobs) + b"".join(own), 1)


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, after that number of bytes."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind.newbyteorder("<")).tobytes()


def decoded(blob: bytes) -> Transducer:
    raw = zlib.decompress(blob)
    columns, place = [], 40
    for n in np.frombuffer(raw, "<i8", 5).tolist():
        columns.append(np.frombuffer(raw, f"<u{raw[place]}", (n - 1) // raw[place], place + 1).astype(np.int64))
        place += n
    sizes, label, weight, back, lengths = columns
    ends = (place + np.cumsum(lengths)).tolist()
    words = [raw[a:b] for a, b in zip([place, *ends], ends, strict=False)]
    target = np.repeat(np.arange(len(sizes)), sizes) - back
    return Transducer(words, [0, *np.cumsum(sizes).tolist()], label.tolist(), weight.tolist(), target.tolist())


def united(transducers: list[Transducer], least: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """Phrases in order with the sums of their weights, without branches below ``least``.

    A weight of zero says that the phrase belongs to another range; what follows it may not.
    """

    def walk(states: list[tuple[Transducer, int]], path: tuple[bytes, ...]) -> Iterator[tuple[tuple[bytes, ...], int]]:
        sums: dict[bytes, int] = {}
        below: dict[bytes, list[tuple[Transducer, int]]] = {}
        for t, state in states:
            words, label, weight, target, first = t.words, t.label, t.weight, t.target, t.first
            for i in range(first[state], first[state + 1]):
                word = words[label[i]]
                sums[word] = sums.get(word, 0) + weight[i]
                after = target[i]
                if first[after] < first[after + 1]:
                    below.setdefault(word, []).append((t, after))
        for word in sorted(sums):
            total = sums[word]
            if total and total < least:
                continue
            phrase = (*path, word)
            if total:
                yield phrase, total
            if word in below:
                yield from walk(below[word], phrase)

    yield from walk([(t, t.start) for t in transducers], ())


def phrases(t: Transducer, state: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """All phrases of a transducer with their weights, in order."""
    for i in t.arcs(t.start if state is None else state):
        phrase = (*path, t.words[t.label[i]])
        if t.weight[i]:
            yield phrase, t.weight[i]
        yield from phrases(t, t.target[i], phrase)


def composed(asked: Transducer, counts: Transducer) -> list[int]:
    """The counts of the phrases of ``asked``, in its order; 0 for those that ``counts`` has not."""
    out: list[int] = []

    def walk(state: int, other: int | None) -> None:
        known = {} if other is None else {counts.words[counts.label[i]]: i for i in counts.arcs(other)}
        for i in asked.arcs(state):
            found = known.get(asked.words[asked.label[i]])
            if asked.weight[i]:
                out.append(0 if found is None else counts.weight[found])
            walk(asked.target[i], None if found is None else counts.target[found])

    walk(asked.start, counts.start)
    return out


def transducer(entries: list[tuple[tuple[bytes, ...], int]]) -> bytes:
    """A transducer of sorted phrases."""
    words = sorted({w for phrase, _ in entries for w in phrase})
    number = {w: i for i, w in enumerate(words)}
    builder = Builder()
    for phrase, weight in entries:
        builder.add(tuple(number[w] for w in phrase), weight)
    return builder.encoded(words)


def _owners(parts: list[tuple[bytes, ...]], n: int) -> np.ndarray:
    """The range of every (language, word, ...): by its first three words, or by its language alone."""
    one = _word_hashes([(p[0], p[1] if len(p) > 1 else b"") for p in parts])
    for k in (2, 3):
        longer = np.array([i for i, p in enumerate(parts) if len(p) > k], np.int64)
        one[longer] = _extended(one[longer], _word_hashes([(parts[i][0], parts[i][k]) for i in longer.tolist()]))
    return _range_of(one, n)


# --- a part's transducers


def _part_transducers(words: Words, told: list[np.ndarray], longest: int, n: int) -> Iterator[tuple[int, bytes]]:
    """(range, transducer) of the phrases of a part that may be frequent."""
    known = words.known
    levels = list(words.grams(told, n))[:longest]
    order = sorted(levels[0].word.tolist(), key=known.__getitem__)
    langs = sorted({lang for lang, _ in known})
    # Labels sort as (language, word) do, and languages come first.
    lang_label = {lang: i for i, lang in enumerate(langs)}
    names = langs + [known[i][1] for i in order]
    label = np.full(len(known), -1, np.int64)
    label[order] = np.arange(len(order)) + len(langs)

    of_lang = np.bincount(
        [lang_label[lang] for lang, _ in known],
        weights=np.bincount(words.numbers[words.numbers >= 0], minlength=len(known)),
        minlength=len(langs),
    ).astype(np.int64)
    rows = np.full((len(langs), longest + 1), -1, np.int64)
    rows[:, 0] = np.arange(len(langs))
    tables, weights, hashes = [rows], [of_lang], [_word_hashes([(lang, b"") for lang in langs])]
    owner = np.zeros(0, np.uint64)
    for k, level in enumerate(levels):
        if k == 0:
            rows = np.full((len(level.word), longest + 1), -1, np.int64)
            rows[:, 0] = [lang_label[known[i][0]] for i in level.word.tolist()]
        else:
            rows = tables[-1][level.before]
        rows[:, k + 1] = label[level.word]
        owner = owner[level.before] if k > 2 else level.hashes  # by the first three words
        tables.append(rows)
        weights.append(level.counts)
        hashes.append(owner)
    rows, weight = np.concatenate(tables), np.concatenate(weights)
    # Of a length that was asked about, what is infrequent goes; it was needed to number longer ones.
    kept = [np.ones(len(langs), bool), *(level.frequent for level in levels)]
    some = np.flatnonzero(np.concatenate(kept) & (weight > 0))
    rows, weight, ranges = rows[some], weight[some], _range_of(np.concatenate(hashes)[some], n)
    order = np.lexsort((*rows.T[::-1], ranges))
    rows, weight, ranges = rows[order], weight[order], ranges[order]
    sizes = (rows >= 0).sum(axis=1)
    edges = np.concatenate([np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])), [len(ranges)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if len(ranges) else ():
        builder = Builder()
        for phrase, size, times in zip(map(tuple, rows[a:b].tolist()), sizes[a:b].tolist(), weight[a:b].tolist(), strict=True):
            builder.add(phrase[:size], times)
        yield int(ranges[a]), builder.encoded(names)


# --- candidates of a range


def _cuts(phrase: tuple[bytes, ...]) -> list[tuple[tuple[bytes, ...], tuple[bytes, ...]]]:
    """The two parts of (language, word, word, ...) at every cut, with the language each."""
    return [(phrase[: k + 1], (phrase[0], *phrase[k + 1 :])) for k in range(1, len(phrase) - 1)]


def _questions(t: Transducer, n: int) -> dict[int, list[tuple[bytes, ...]]]:
    """Sorted parts of all candidates of a range, by the range that knows them."""
    parts = sorted({part for phrase, _ in phrases(t) if len(phrase) > 2 for cut in _cuts(phrase) for part in cut})
    asked: dict[int, list[tuple[bytes, ...]]] = {}
    for part, owner in zip(parts, _owners(parts, n).tolist(), strict=True):
        asked.setdefault(owner, []).append(part)
    return asked


UNITED = "range int, asks int, blob binary"


def _candidates(t: Transducer, counts: dict[tuple[bytes, ...], int], scale: int) -> Iterator[tuple]:
    for phrase, a in phrases(t):
        if len(phrase) > 2:
            scored = []
            for k, (first, rest) in enumerate(_cuts(phrase), 1):
                left, right = counts[first], counts[rest]
                scored.append((scale * a // (left + right), k, left, right))
            score, _, left, right = min(scored)
            words = b" ".join(phrase[1:]).decode()
            yield phrase[0].decode(), words, len(phrase) - 1, a, left, right, score


CANDIDATES = "lang string, phrase string, size int, a bigint, l bigint, r bigint, score bigint"


def candidates(
    docs: DataFrame, least: int = 30, longest: int = 4, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """Staged (lang, phrase, size, a, l, r, score) of all phrases with ``least`` occurrences, and
    (lang, n) with the words of every language."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    parts = parted(stored_words(rows), 1)
    spark = docs.sparkSession
    size = parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(partitions(spark), -(-size // RANGE_BYTES))
    told = None
    for length in range(1, longest):

        def ask(rows: pa.Table, answers: pa.Table | None = None, length: int = length) -> pa.Table:
            if not rows.num_rows:
                return _counted(0, None, n)
            known = _told(answers, length - 1) if answers is not None else []
            return _counted(rows["_part"][0].as_py(), list(Words.read(rows).grams(known, n))[-1], n)

        found = stage(_frequent(per_part(parts, ask, COUNTED, told), least, length), "frequent")
        told = found if told is None else told.union(found)

    def build(rows: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        if rows.num_rows:
            made = list(_part_transducers(Words.read(rows), _told(answers, longest - 1), longest, n))
        return pa.table({"range": pa.array([r for r, _ in made], pa.int32()), "blob": pa.array([b for _, b in made], pa.binary())})

    counted = per_part(parts, build, "range int, blob binary", told)

    def unite(rows: pa.Table) -> pa.Table:
        own = rows["range"][0].as_py()
        entries = list(united([decoded(b) for b in rows["blob"].to_pylist()], least))
        blob = transducer(entries)
        asked = _questions(decoded(blob), n) if entries else {}
        out = [(-1, blob), *((to, transducer([(p, 1) for p in parts])) for to, parts in asked.items())]
        return pa.table(
            {
                "range": pa.array([own] * len(out), pa.int32()),
                "asks": pa.array([a for a, _ in out], pa.int32()),
                "blob": pa.array([b for _, b in out], pa.binary()),
            }
        )

    made = stage(counted.groupBy("range").applyInArrow(unite, UNITED), "united")
    counts = made.where("asks < 0").select("range", "blob")
    questions = made.where("asks >= 0").select(F.col("asks").alias("of"), F.col("range").alias("asker"), F.col("blob").alias("parts"))

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        told: list[tuple] = []
        if asked.num_rows:
            t = decoded(known["blob"][0].as_py())
            for asker, of, blob in zip(*(asked[c].to_pylist() for c in ("asker", "of", "parts")), strict=True):
                told.append((asker, of, np.array(composed(decoded(blob), t), "<i8").tobytes()))
        kinds = {"asker": pa.int32(), "of": pa.int32(), "counts": pa.binary()}
        return pa.table({c: pa.array([x[i] for x in told], k) for i, (c, k) in enumerate(kinds.items())})

    answers = (
        counts.groupBy("range").cogroup(questions.groupBy("of")).applyInArrow(answer, "asker int, of int, counts binary")
    )

    def score(known: pa.Table, answers: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if answers.num_rows:
            t = decoded(known["blob"][0].as_py())
            asked = _questions(t, n)
            number: dict[tuple[bytes, ...], int] = {}
            for of, blob in zip(answers["of"].to_pylist(), answers["counts"].to_pylist(), strict=True):
                number.update(zip(asked[of], np.frombuffer(blob, "<i8").tolist(), strict=True))
            found = list(_candidates(t, number, scale))
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        names = [c.split()[0] for c in CANDIDATES.split(", ")]
        return pa.Table.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)

    scored = counts.groupBy("range").cogroup(answers.groupBy("asker")).applyInArrow(score, CANDIDATES)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for blob in batch.column(1).to_pylist():
                t = decoded(blob)
                found += [(t.words[t.label[i]].decode(), t.weight[i]) for i in t.arcs(t.start) if t.weight[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], ["lang", "n"]
            )

    return stage(scored, "candidates"), stage(counts.mapInArrow(totals, "lang string, n bigint"), "totals")


def without_covered(found: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates that no longer candidate covers with at least ``percent`` of their occurrences."""
    words = F.split("phrase", " ")
    starts = F.sequence(F.lit(1), F.col("size"))
    inner = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.filter(starts, lambda k: (k >= 2) & (k < F.col("size")) & (i + k - 1 <= F.col("size"))),
                lambda k: F.array_join(F.slice(words, i, k), " "),
            ),
        )
    )
    longer = (
        found.where("size > 2")
        .select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    covered = F.expr(f"cast(longer as decimal(38,0)) * 100 >= cast(a as decimal(38,0)) * {percent}")
    return found.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered).drop("longer")


def best(found: DataFrame, keep: int = 2000) -> DataFrame:
    """Adds ``rank`` and keeps the first ``keep`` of every language, ranked in two steps."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = found.withColumn("_task", F.pmod(F.xxhash64("phrase"), F.lit(RANK_TASKS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_task").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return some.where(F.col("rank") <= keep).drop("_task").withColumn("rank", rank).where(F.col("rank") <= keep)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, keep: int = 2000, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language."""
    found, totals = candidates(docs, least, longest, **columns)
    ranked = best(without_covered(found, percent), keep)
    return ranked.join(few(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
