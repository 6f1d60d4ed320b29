"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ringweave.llm import phrases
from ringweave.llm.queries import op13_phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least=30, longest=4, percent=80, keep=2000):
    """rows: [(lang, text)]; the same result by counting everything."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {}
    for phrase, a in counts.items():
        if len(phrase) > 2 and a >= least:
            cuts = []
            for k in range(2, len(phrase)):
                left, right = counts[phrase[:k]], counts[(phrase[0], *phrase[k:])]
                cuts.append((2_000_000 * a // (left + right), k, left, right))
            found[phrase] = (a, *min(cuts))
    dropped = set()
    for phrase, (a, *_) in found.items():
        for size in range(2, len(phrase) - 1):
            for i in range(1, len(phrase) - size + 1):
                inner = (phrase[0], *phrase[i : i + size])
                if inner in found and 100 * a >= percent * found[inner][0]:
                    dropped.add(inner)
    out = []
    for lang in totals:
        own = [(-f[1], -f[0], " ".join(p[1:]).encode(), f) for p, f in found.items() if p[0] == lang and p not in dropped]
        for rank, (_, _, text, (a, score, _, left, right)) in enumerate(sorted(own)[:keep], 1):
            out.append((lang, rank, text.decode(), a, left, right, totals[lang], score))
    return sorted(out)


def _got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "ab", "Été", "été", "x", "yy", "z\xa0z", "日本", "\x1cq", "w" * 30, "<a>"]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ;", "!?"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choices(words, weights=range(len(words), 0, -1))[0] + rng.choice(marks) for _ in range(rng.randint(0, 60))))
    return out


@pytest.mark.parametrize("least,percent", [(3, 80), (30, 50), (1, 100)])
def test_collocations_match_plain_counting(spark, least, percent):
    odd = [None, "", " ", "...", "one", "A B", "A b A b A b " * 40, "a,b,a b", "long " * 3000]
    rows = [(i, t, ["en", None, "und", "fr ä"][i % 4], 1, "p") for i, t in enumerate(odd + texts(1, 80) + texts(2, 40) * 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, rank int, phrase string").repartition(5)
    want = plain([(r[2], r[1]) for r in rows], least, 4, percent, 50)
    assert _got(phrases.collocations(docs, least=least, percent=percent, keep=50)) == want
    assert want


def test_query_on_documents(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert _got(op13_phrases(spark, sf)) == plain(rows)


@pytest.mark.parametrize("n", [1, 13])
def test_other_numbers_of_ranges_and_parts(spark, n, monkeypatch):
    monkeypatch.setattr("ringweave.llm.parts.PART_ROWS", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        rows = [("en", t) for t in texts(4, 60)]
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert _got(phrases.collocations(docs, least=5)) == plain(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_and_nothing_frequent(spark):
    schema = "doc_id bigint, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b c d", None)], schema)).count() == 0


def test_transducers_keep_weights_and_share_states():
    rng = random.Random(2)
    entries = sorted({tuple(rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 4))) for _ in range(90)})
    weighed = [(e, rng.randint(1, 3)) for e in entries]
    t = phrases.decoded(phrases.transducer(weighed))
    assert list(phrases.phrases(t)) == weighed
    fork = [((a, b, b"z"), 5) for a in (b"a", b"b", b"c") for b in (b"x", b"y")]
    assert len(phrases.decoded(phrases.transducer(fork)).first) - 1 == 4  # one state per depth
    both = phrases.decoded(phrases.transducer(fork)), t
    sums = Counter(dict(weighed)) + Counter(dict(fork))
    assert list(phrases.united(list(both), 1)) == sorted(sums.items())
    asked = [(b"a",), *(e for e, _ in weighed[::3]), (b"q", b"r")]
    answers = phrases.composed(phrases.decoded(phrases.transducer([(e, 1) for e in sorted(set(asked))])), t)
    known = dict(weighed)
    assert answers == [known.get(e, 0) for e in sorted(set(asked))]


def test_owner_follows_the_first_three_words():
    parts = [(b"en",), (b"en", b"a"), (b"en", b"a", b"b"), (b"en", b"a", b"b", b"c"), (b"en", b"a", b"b", b"c", b"d")]
    owners = phrases._owners(parts, 1 << 20)
    assert owners[3] == owners[4] and len(set(owners.tolist())) == 4
    assert np.array_equal(owners, [phrases._owners([p], 1 << 20)[0] for p in parts])


def test_stored_words_are_the_words_of_the_texts():
    texts = ["the cat, THE dog\tthe\n\nend", None, "", "dog dog dog é \x0b ü! 1", "the the the"]
    rows = pa.table({"lang": ["en", "en", "und", "fr", "und"], "text": pa.array(texts, pa.string())})
    for part in (rows, rows.slice(1, 2), rows.slice(0, 0)):
        words = phrases.Words.of(part)
        read = phrases.Words.read(pa.table({k: pa.array([v]) for k, v in words.stored().items()}))
        named = lambda w: [w.known[i] if i >= 0 else None for i in w.numbers.tolist()]
        assert named(read) == named(words) and sorted(read.known) == sorted(words.known)
        assert (np.diff(read.counts()) <= 0).all()


def test_texts_are_split_into_words_once(spark, monkeypatch):
    kept = []
    parted = phrases.parted
    monkeypatch.setattr(phrases, "parted", lambda *args: kept.append(parted(*args)) or kept[-1])
    docs = spark.createDataFrame([("one two three. one two", "en")] * 40, "text string, lang string").coalesce(1)
    found, _ = phrases.candidates(docs)
    assert {(r.phrase, r.a) for r in found.collect()} >= {("one two", 80), ("two three", 40), ("one two three", 40)}
    # What every pass reads has words as numbers, and no text to split.
    assert [(t.count(), "text" in t.columns, "numbers" in t.columns) for t in kept] == [(1, False, True)]


def test_answers_are_a_bit_for_every_key_asked(spark):
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    asked = []
    for part in range(3):
        hashes = np.concatenate([shared, rng.integers(0, 1 << 63, 17000).astype(np.uint64) * np.uint64(2)])[rng.permutation(20000)]
        hashes[1] = hashes[0] ^ np.uint64(1)  # one key
        counts = rng.integers(1, 4, len(hashes))
        asked.append(phrases.Grams(None, np.arange(len(hashes)), hashes, counts, np.ones(len(hashes), bool)))
    rows = [r for part, grams in enumerate(asked) for r in phrases._counted(part, grams, 5).to_pylist()]
    assert sum(len(r["counted"]) for r in rows) < 4.2 * 60000  # counts take some 0.3 bytes of it
    table = spark.createDataFrame([(r["range"], r["_part"], r["counted"]) for r in rows], phrases.COUNTED)
    told = phrases._frequent(table, 5, 1).toArrow()
    assert sum(len(x) for x in told["kept"].to_pylist()) < 60000 / 4
    sums = Counter()
    for grams in asked:
        for key, count in zip((grams.hashes >> np.uint64(24)).tolist(), grams.counts.tolist(), strict=True):
            sums[key] += count
    for part, grams in enumerate(asked):
        own = told.filter(pa.array([p == part for p in told["_part"].to_pylist()]))
        got = phrases._answered(grams.hashes, phrases._told(own, 1)[0], 5)
        assert got.tolist() == [sums[key] >= 5 for key in (grams.hashes >> np.uint64(24)).tolist()]
        with pytest.raises(ValueError):
            phrases._answered(grams.hashes[:-5], phrases._told(own, 1)[0], 5)
