"""Operators against plain versions, on small tables with every odd case."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringweave.llm import (
    langid,
    mixing,
    packing,
    simhash,
    substrings,
    suffixes,
    topk,
    toxicity,
    vectors,
    warc,
)
from ringweave.llm.common import stage
from ringweave.llm.components import components
from ringweave.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, score double, size int, component_id string"


def passages(seed, n=60, words=40):
    """Documents that share passages in all ways: whole, shifted, at both ends, repeated inside."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(words)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 140))) for _ in range(6)]
    docs = []
    for _ in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        for passage in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 40)
            parts += [passage[cut:], " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))]
        docs.append(" ".join(parts))
    return docs


def odd_texts():
    return [
        None, "", " ", "\n\t", "one", "a b", "a b c", "A B c", "x " * 400, "é" * 500, "ab" * 700,
        "same text of a few words", "same text of a few words", "  two  blanks\n\nand lines ", "12 34 !!",
    ]


def frame(spark, texts, parts=3):
    rows = [
        (i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s10"][i % 4], 0.5, None, "c") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts, F.col("doc_id"))


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts() + passages(1) + passages(2)[:20] + passages(1)[:20]
    return stage(frame(spark, texts, 5), "docs")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- suffixes and substrings


def test_suffix_cut_matches_counting_every_window(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cut(docs).collect()}
    want = brute.byte_windows(rows)
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("size", [80, 200])
def test_suffix_cut_where_many_documents_share_one_line(spark, size):
    rng = random.Random(5)
    line = "this line stands in very many documents " * 4

    def noise():
        return "".join(rng.choices("abc ", k=rng.randint(0, 150)))

    texts = [noise() + line + noise() for _ in range(300)]
    out = suffixes.cut(frame(spark, texts, 12), size=size)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert got == brute.byte_windows(list(enumerate(texts)), size)


def test_suffix_cut_where_splitters_part_groups_of_three(spark):
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choices("abcdefgh", k=n))

    texts = []
    for _ in range(40):
        passage = noise(rng.randint(205, 280))
        texts += [noise(rng.randint(0, 40)) + passage + noise(230) for _ in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")  # ranges, so many splitters
    try:
        out = suffixes.cut(frame(spark, texts, 6)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert got == brute.byte_windows(list(enumerate(texts)))


def test_suffix_cut_of_text_longer_than_a_piece(spark):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh ", k=suffixes.PIECE + 3000))
    text = text + text[suffixes.PIECE - 500 : suffixes.PIECE + 300]
    got = suffixes.cut(frame(spark, [text, "short"])).where("doc_id = 0").first()
    assert (got.n_bytes, got.n_removed, got.n_spans) == (len(text), 1600, 2)


def test_windows_are_the_same_in_pieces_of_any_size(monkeypatch):
    text = passages(9)[0].encode() * 3
    whole = {
        (int(g), int(at - c.begin[0] + c.base[0]))
        for c in suffixes.chunks([text], 200)
        for g, at in zip(*suffixes.anchors(c.raw, c.ends, 200)[:2], strict=True)
    }
    monkeypatch.setattr(suffixes, "PIECE", 97)
    cut = set()
    for c in suffixes.chunks([text], 200):
        a = suffixes.anchors(c.raw, c.ends, 200)
        piece = np.searchsorted(c.begin, a.at, side="right") - 1
        cut |= set(zip(a.gram.tolist(), (a.at - c.begin[piece] + c.base[piece]).tolist(), strict=True))
    assert whole == cut


def test_runs_survive_front_coding_and_merge_in_order():
    rng = random.Random(2)
    items = [
        ("".join(rng.choices("ab", k=rng.randint(1, 12))).encode(), b"x" * rng.randint(0, 3), i, 10 * i)
        for i in range(500)
    ]
    runs = [suffixes._sorted_run(items[i::7], 12) for i in range(7)] + [suffixes._sorted_run([], 12)]
    coded = [suffixes.decode(suffixes.encode(r, 0, len(r.suffix))) for r in runs]
    assert [c.suffix for c in coded] == [r.suffix for r in runs]
    of, at, common = suffixes.merge(coded)
    merged = [coded[r].suffix[i] for r, i in zip(of, at, strict=True)]
    assert merged == sorted(i[0] for i in items)
    assert common == suffixes._common(merged, 12).tolist()


def suffix_run(n):
    rng = random.Random(6)
    items = {
        ("".join(rng.choices("ab", k=rng.randint(1, 12))).encode(), "".join(rng.choices("xyz", k=rng.randint(0, 5))).encode())
        for _ in range(n)
    }
    return suffixes._sorted_run([(s, b, i, 10 * i) for i, (s, b) in enumerate(sorted(items))], 12)


def test_blocks_of_a_run_are_small_and_join_in_any_order():
    run = suffix_run(5000)
    blocks = suffixes.blocks(run, 500)
    assert len(blocks) > 50
    assert max(map(len, blocks)) < 500 + 100
    random.Random(1).shuffle(blocks)
    got = suffixes.joined(blocks)
    assert (got.suffix, got.common, got.before) == (run.suffix, run.common, run.before)
    assert got.row.tolist() == run.row.tolist() and got.at.tolist() == run.at.tolist()
    assert suffixes.blocks(suffixes._sorted_run([], 12), 500) == []


def test_blocks_are_sliced_at_splitters():
    run = suffix_run(3000)
    splitters = sorted({b"a", *run.suffix[100::700], b"bbab", b"c", b"d"})
    by_range: dict[int, list[bytes]] = {}
    for block in suffixes.blocks(run, 800):
        for number, piece in suffixes.sliced(block, splitters):
            by_range.setdefault(number, []).append(piece)
    joined = [suffixes.joined(by_range[k]) for k in sorted(by_range)]
    assert [s for r in joined for s in r.suffix] == run.suffix
    edges = [b"", *splitters, b"\xff"]
    for number, r in zip(sorted(by_range), joined, strict=True):
        assert edges[number] <= r.suffix[0] and r.suffix[-1] < edges[number + 1]


def test_suffix_cut_in_small_blocks_and_many_ranges(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    monkeypatch.setattr(suffixes, "RANGE", 4000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cut(docs).collect()}
    assert got == brute.byte_windows(rows)


def test_anchors_are_asked_for_evenly_over_ranges():
    text = "".join(random.Random(4).choices("abcdefgh ", k=200_000)).encode()
    (chunk,) = suffixes.chunks([text], 200)
    keys = np.unique(suffixes.gram_keys(suffixes.anchors(chunk.raw, chunk.ends, 200).gram))
    sizes = np.diff(suffixes.split_keys(keys, 20))
    assert sizes.sum() > 1000 and sizes.max() < 2 * sizes.mean()


def test_substring_cut_matches_comparing_every_window(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut(docs).collect()}
    want = brute.word_windows(rows)
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


def test_substring_cut_of_runs_and_null_ids(spark):
    texts = ["a " * 300, "b " + "a " * 120 + "c", "c " * 60 + "a b " * 80, "a b " * 60, "x"]
    data = frame(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut(data).collect()}
    assert got == brute.word_windows(list(enumerate(texts)))
    unnamed = data.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    out = {r.doc_id: r.n_removed for r in substrings.cut(unnamed).collect()}
    assert out[None] == 300 and out[1] == 0


def test_words_are_hashed_alike_in_blocks_of_any_size(monkeypatch):
    text = b"  a bb\ta\x0bbb\x0cccc\r\n" + b"x" * 5000 + "é\u00a0é".encode() + b" a"
    words = text.split()
    for block in (4, 64, 1 << 17):
        monkeypatch.setattr(substrings, "BLOCK", block)
        hashed = substrings.word_hashes(text).tolist()
        assert len(hashed) == len(words)
        assert len(set(zip(words, hashed, strict=True))) == len(set(words)) == len(set(hashed))
    assert not len(substrings.word_hashes(b"")) and not len(substrings.word_hashes(b" \n"))


def test_equal_windows_have_equal_witnesses():
    rng = random.Random(4)
    words = np.array([rng.randrange(5) for _ in range(3000)] * 2, np.uint64)
    start, names = substrings.witnesses(words, np.zeros(len(words), np.int64), 50)
    seen = {}
    for s, name in zip(start.tolist(), names.tolist(), strict=True):
        assert seen.setdefault(words[s : s + 50].tobytes(), name) == name


# --- SimHash and vectors


def test_simhash_components(docs, rows):
    out = simhash.near_duplicates(stage(simhash.fingerprints(docs), "fps"))
    got = {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in out.collect()}
    assert got == brute.simhash_components(rows)


@pytest.mark.parametrize(("n", "most"), [(400, 2), (400, 1), (150, 0)])
def test_close_fingerprints_in_crowded_buckets(spark, n, most):
    rng = random.Random(n + most)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(n):
        v = centre
        for b in rng.sample(range(12), rng.randint(0, 6)):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = stage(spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id bigint, fp bigint"), "fps")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(fps, most).collect()}
    union = brute.Union()
    bits = np.array(signed, np.int64).view(np.uint64)
    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= most):
            union.join(i, int(j))
    assert got == {i: union.find(i) for i in range(len(bits))}


def test_thresholds_follow_the_generalised_pigeonhole():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    for n in (10, 10**5, 10**9, 10**12):
        plan = simhash.split(sample, n, 2)
        bits = [b for group, _ in plan for b in group]
        assert len(bits) == len(set(bits)) and plan
        # Partitions left out have threshold -1, so what is used adds up to 2 - used + 1 at least.
        assert sum(t + 1 for _, t in plan) == 3


@pytest.mark.parametrize("bound", [400_000, 50])
def test_components_of_paths_and_stars(spark, monkeypatch, bound):
    monkeypatch.setattr("ringweave.llm.components.TASK_EDGES", bound)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(1000, 1500)] + [(5, 5), (3, 4)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = dict.fromkeys(range(100, 161), 100) | dict.fromkeys([7, *range(1000, 1500)], 7) | {3: 3, 4: 3}
    assert got == want


VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("links", T.StringType())]
)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 24))
    near = [base[i % 3] + rng.normal(scale=0.06 + 0.03 * (i % 4), size=24) for i in range(400)]
    some = [v.astype(np.float32).tolist() for v in [*base, *near]]
    some += [some[0], some[0], [2 * x for x in some[1]], [0.0] * 24, None, [float("nan")] * 24]
    some += [[None, *some[0][1:]], [float("inf"), *some[0][1:]], some[0][:5], []]
    return [(i * 5, v, "x") for i, v in enumerate(some)]


def test_vector_links(spark, vector_rows):
    data = spark.createDataFrame(vector_rows, VECTORS).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(data).collect()}
    assert got == brute.vector_links([(i, v) for i, v, _ in vector_rows if v is None or len(v) == 24]) | {
        i: (0, i) for i, v, _ in vector_rows if v is not None and len(v) != 24
    }
    assert max(n for n, _ in got.values()) > 100


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    units = vectors._unit(rng.normal(size=(600, 64)))
    middle, bound = vectors.estimates(*vectors.codes(units, np.arange(600)))
    error = middle - units @ units.T
    off = ~np.eye(600, dtype=bool)
    assert abs(error[off].mean()) < 0.002
    assert (np.abs(error)[off] <= bound[off]).mean() > 0.9999


def test_top_k_with_ties_and_odd_vectors(spark, vector_rows):
    data = spark.createDataFrame(vector_rows, VECTORS).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", topk.quantized(F.col("embedding")).alias("v")
    )
    asked = data.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(map(tuple, topk.top_k(data, asked, 10).collect()))
    good = {
        i: np.floor(np.array(v, float) * 1024).astype(np.int64)
        for i, v, _ in vector_rows
        if v is not None and None not in v and np.all(np.isfinite(v))
    }
    want = []
    for q, a in good.items():
        if q % 100 == 0:
            scores = sorted((-int(a @ b), i) for i, b in good.items() if i != q and len(b) == len(a))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])]
    assert got == sorted(want)


def test_top_k_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i // 2 * 50, rng.integers(-9, 9, 6).tolist()) for i in range(40)] + [(40, None, [1] * 6)]
    data = spark.createDataFrame(rows, "row bigint, vec_id bigint, v array<bigint>").repartition(3)
    asked = data.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    want = []
    for at, i, v in rows:
        if i is not None and i % 100 == 0:
            others = sorted((-int(np.dot(v, w)), j) for k, j, w in rows if k != at and j is not None)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(others[:5])]
    assert sorted(map(tuple, topk.top_k(data, asked, 5).collect())) == sorted(want)


def test_vector_links_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    a, b, c = (rng.normal(size=24) for _ in range(3))
    near = lambda v: (v + rng.normal(size=24) * 0.01).tolist()
    # Rows of id 1 hold unlike vectors: each links with its own like only.
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, near(a), 0), (3, near(b), 0), (4, c.tolist(), 0), (4, near(c), 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]


def test_links_found_among_planted_pairs(spark):
    """Recall of pairs at cosine 0.95 and a little above, where a miss is likeliest."""
    rng = np.random.default_rng(10)
    rows, pairs = [], 1500
    for i in range(pairs):
        v = rng.normal(size=48)
        u = rng.normal(size=48)
        u -= u @ v / (v @ v) * v
        cosine = 0.9501 + 0.01 * rng.random()
        w = cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u)
        rows += [(2 * i, v.tolist(), 0), (2 * i + 1, w.tolist(), 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4)).where("vec_id % 2 = 1 and n_links > 0").count()
    assert got >= 0.995 * pairs


def test_languages_are_learned_from_rows_of_one_id_and_of_none(spark):
    rows = [(7, f"the house number {i} stands there and was sold by them", "en") for i in range(3000)]
    rows += [(None, f"la maison numéro {i} est vendue avec les meubles", "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["en", "fr"]
    predicted = langid.predict(docs, model).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r.doc_id, r.lang_pred) for r in predicted if r["count"] > 60} == {(7, "en"), (None, "fr")}


def test_packing_identical_rows_and_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "one two three")] * 3000 + [(5, "")] * 50, "doc_id bigint, text string").repartition(3)
    out = packing.pack_documents(docs, tokenizer_path(), max_len=64).collect()
    assert len(out) == 3050
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert places[-1][0] + places[-1][1] <= 64


def test_packs_are_those_of_plain_shortest_pack_first(spark):
    """The number of sequences at 2048 is that of a plain version: longest piece first, into the
    open pack with the most room, or a new one."""
    rng = random.Random(12)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(1500)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(room)), key=room.__getitem__, default=None)
        if best is None or room[best] < n:
            room.append(2048 - n)
        else:
            room[best] -= n
    made = packing.patterns(histogram, 2048)
    assert sum(count for _, count in made) == len(room)
    assert sorted(2048 - sum(held) for held, count in made for _ in range(count)) == sorted(room)


# --- scoring, languages, mixing, packing, archives


def test_toxicity_learns_words_it_was_shown(spark):
    rng = random.Random(8)
    words = ["w" + str(i) for i in range(200)]
    texts = [" ".join(rng.choices(words, k=60)) + (" awful" if i % 4 == 0 else "") for i in range(800)]
    data = frame(spark, texts)
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (1, None), (99999, 1)], "doc_id bigint, toxic int"
    )
    model = toxicity.train(data, labels)
    got = {r.doc_id: r.score for r in toxicity.score(data, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(600, 800))
    assert len(model.at) < 1000
    kept = toxicity.keep_clean(data, model)
    assert kept.columns == data.columns
    assert all(r.doc_id % 4 for r in kept.where("doc_id >= 600").collect())


def test_toxicity_of_odd_texts(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    shown = spark.createDataFrame([(20, 1), (21, 0), (22, 0)], "doc_id bigint, toxic int")
    scores = [r.score for r in toxicity.score(docs, toxicity.train(docs, shown)).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(nothing, model).count() == 0


def test_language_of_odd_texts(spark, nothing):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "12 !!", "日本"] * 20
    rows = [(i, t, {0: "en", 1: "fr"}.get(i % 6)) for i, t in enumerate(texts)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(data.where("doc_id < 60"))
    got = {r.doc_id % 6: (r.lang_pred, r.score) for r in langid.predict(data, model).where("doc_id >= 60").collect()}
    assert got[0][0] == "en" and got[1][0] == "fr"
    assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[5][0] in ("en", "fr")
    away = langid.predict(data, model, reject_below=0.5).where("doc_id = 65").first()
    assert away.lang_pred == "und"
    none = langid.train(nothing)
    assert {r.lang_pred for r in langid.predict(data, none).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_language_weights_cover_all_documents(spark):
    rng = random.Random(12)
    words = {"en": ["the", "house", "green"], "fr": ["le", "chat", "vert"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=3)), lang) for i in range(120) for lang in ["en" if i % 6 else "fr"]]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    seen = sum((langid.counts(t) > 0).astype(int) for _, t, _ in rows)
    want = np.log((1.0 + len(rows)) / (1.0 + seen)) + 1.0
    assert np.allclose(langid.train(data, max_train=10).idf, want)


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(passages(3))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert (langid.counts(text) == whole).all()


def test_mix_reaches_its_targets(docs, nothing):
    plan = [r for r in mixing.mix(docs).collect()]
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    by_source = {}
    for r in plan:
        assert 0 <= r.taken <= 3 * r.size
        by_source.setdefault(sources[r.doc_id], []).append(r)
    total = 0
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
        assert sum(r.size for r in rows) == rows[0].source_size
        assert rows[0].target <= 3 * rows[0].source_size
        total += rows[0].target
    assert abs(total - sum(r.size for r in plan)) < 1e-6
    assert mixing.mix(nothing).count() == 0


def test_copies_are_served_in_order_of_finish_time(docs):
    queued = mixing.queues(docs)
    served = mixing.served(queued, keep=["size", "target", "source_size", "before"])
    rows = served.collect()  # of range-sorted files, in order of the ranges
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    late = [r for r in rows if r.finish > 1]
    # Beyond virtual time 1 is the end of one copy in service per source, or what rounding adds.
    assert len(late) <= len({(r.target, r.source_size) for r in rows})
    assert all(r.words == r.size for r in rows if r.finish <= 1)
    for r in rows:
        assert r.finish * r.target == pytest.approx(r.copy * r.source_size + r.before + r.size)
    taken = {r._place: 0 for r in queued.collect()}
    for r in rows:
        taken[r._place] += r.words
    assert taken == {r._place: r.taken for r in mixing.mix(docs).collect()}


def test_rows_without_an_id_are_spread(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 400, "doc_id bigint, text string, source string").repartition(4)
    assert mixing.queues(docs).select("shuffle").distinct().count() == 400


def test_packing_keeps_every_token(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    pieces = packing.pack_documents(docs, tokenizer_path(), max_len=64, keep_ids=True).collect()
    texts, spans, whole = dict(rows), {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        whole.setdefault(p.doc_id, {})[p.start] = p.ids
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, text in texts.items():
        ids = b"".join(v for _, v in sorted(whole[doc].items()))
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert ids == np.array(want, "<u4").tobytes()
    for held in spans.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


def test_patterns_hold_the_whole_histogram():
    rng = random.Random(6)
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 2049), 300)}
    found = packing.patterns(histogram, 2048)
    back = {}
    for held, count in found:
        assert sum(held) <= 2048 and count > 0
        for n in held:
            back[n] = back.get(n, 0) + count
    assert back == histogram
    tokens = sum(n * c for n, c in histogram.items())
    assert tokens / (2048 * sum(c for _, c in found)) > 0.95


def test_chunks_of_odd_white_space_tokenize_alike():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    encode = packing.encoder(tokenizer_path())
    rng = random.Random(1)
    texts = ["", "  ", " a  b ", "it's 'll x", "<|endoftext|> x", "x y  z", "日本 語"]
    texts += ["".join(rng.choices(" \n\ta'sé日1. 　\x1c", k=30)) for _ in range(1500)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(want, "<u4").tobytes()


def test_added_tokens_get_their_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())  # with its default settings
    end = "<|endoftext|>"
    texts = [f"{end} x", end, f" {end}", f"a{end}b", f"a  {end}\n {end}{end} the end", "<|endoftext |> x", "plain", None]
    texts += [f"one two {end} " + "word " * 90 + end]
    whole = {}
    for p in packing.pack_documents(frame(spark, texts), tokenizer_path(), max_len=64, keep_ids=True).collect():
        assert zlib.crc32(p.ids) == p.ids_crc32
        whole.setdefault(p.doc_id, {})[p.start] = p.ids
    for doc, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert b"".join(v for _, v in sorted(whole[doc].items())) == np.array(want, "<u4").tobytes()
    rng = random.Random(7)
    encode = packing.text_encoder(tokenizer_path())
    for _ in range(500):
        text = "".join(rng.choices([end, " ", "\n", "a", "sé", "日", "<|", "|>", "1."], k=20))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_archive_damage_is_located(spark):
    held = [("f1", i, f"record {i} " * 3) for i in range(400)] + [("f2", 1, None), (None, 2, ""), ("f1", 7, "again"), ("f2", None, "n")]
    lost = [r for r in held if r[1] != 33]
    lost = [(f, i, "rEcord 5 " * 3) if i == 5 and f == "f1" else (f, i, c) for f, i, c in lost]
    lost = [(f, i, c + "!") if i == 399 else (f, i, c) for f, i, c in lost] + [("f3", 1, "more")]
    schema = "file string, record_id bigint, content string"
    found = warc.audit(spark.createDataFrame(held, schema), spark.createDataFrame(lost, schema))
    got = {(r.file, r.record_id, r.kind) for r in found.collect()}
    assert got == {("f1", 33, "missing"), ("f1", 5, "changed"), ("f1", 399, "resized"), ("f3", 1, "extra")}
    offsets = {r.record_id: r.offset for r in found.where("file = 'f1'").collect()}
    assert offsets[5] == 5 * len("record 1 " * 3)
    same = warc.audit(spark.createDataFrame(held, schema), spark.createDataFrame(held, schema))
    assert same.count() == 0
    none = spark.createDataFrame([], schema)
    assert warc.audit(none, none).count() == 0
    assert {r.kind for r in warc.audit(none, spark.createDataFrame(held, schema)).collect()} == {"extra"}


def test_warc_descends_only_into_what_differs(spark):
    schema = "file string, record_id bigint, content string"
    rows = [(f"f{i % 3}", i if i % 50 else None, f"record {i}") for i in range(6000)] + [("f0", 7, "twice")] * 3
    lost = [("f1", 2503, "other")] + [r for r in rows if r[:2] != ("f1", 2503) and r[2] != "record 50"]
    mine, theirs = (spark.createDataFrame(r, schema) for r in (rows, lost))
    trees = [warc.tree(stage(warc.hashed(t), "records"), 2) for t in (mine, theirs)]
    # Record 50 has no id, so its leaf is one of those spread by digest.
    wrong = sorted((r.file, r.node >= 0) for r in warc.differing(*trees).collect())
    assert wrong == [("f1", True), ("f2", False)]
    found = sorted((r.file, r.record_id or -1, r.kind) for r in warc.audit(mine, theirs).collect())
    assert found == [("f1", 2503, "resized"), ("f2", -1, "missing")]
    at = sum(len(c) for f, i, c in rows if f == "f1" and (i is None or i < 2503))
    assert [r.offset for r in warc.audit(mine, theirs).collect() if r.file == "f1"] == [at]


def test_operators_take_empty_tables(spark, nothing):
    assert suffixes.cut(nothing).count() == 0
    assert substrings.cut(nothing).count() == 0
    assert simhash.near_duplicates(stage(simhash.fingerprints(nothing), "fps")).count() == 0
    none = spark.createDataFrame([], VECTORS)
    assert vectors.near_duplicates(none).count() == 0
    asked = none.select(
        F.col("vec_id").alias("row"), F.col("vec_id").alias("query_id"), topk.quantized(F.col("embedding")).alias("v")
    )
    assert topk.top_k(asked.withColumnRenamed("query_id", "vec_id"), asked).count() == 0
