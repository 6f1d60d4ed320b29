"""Tokenizer alignment against a plain version with the libraries themselves."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ringweave.llm import alignment
from ringweave.llm.queries import op11_alignment, tokenizer_path

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """Per text the seven columns, by whole texts, every pair of tokens compared."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, pre_tokenizers

    a_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    alphabet = dict(
        zip(sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord), visible + sorted(set(range(256)) - set(visible)), strict=True)
    )
    b_library = SentencePieceProcessor(model_file=PATHS[1])

    def b_bytes(i):
        piece = b_library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_library.is_byte(i) else piece.replace("▁", " ").encode()

    links, groups, sizes = [], [], []
    for text in texts:
        ends, ids = [], []
        whole = (" " + (text or "")).encode()
        got = a_library.encode(" " + (text or ""), add_special_tokens=False)
        tokens = [
            (got.ids, [bytes(alphabet[c] for c in t) for t in got.tokens]),
            (b := b_library.encode(text or ""), [b_bytes(i) for i in b]),
        ]
        if not text or any(b"".join(t) != whole for _, t in tokens):
            links.append([]), groups.append([]), sizes.append((0, 0))
            continue
        for numbers, t in tokens:
            ids.append(numbers)
            ends.append(np.cumsum([len(x) for x in t]).tolist())
        found = []
        for i, x in enumerate(ids[0]):
            start = ends[0][i - 1] if i else 0
            for j, y in enumerate(ids[1]):
                if max(start, ends[1][j - 1] if j else 0) < min(ends[0][i], ends[1][j]):
                    found.append((x, y))
        links.append(found)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        out, before = [], 0
        for cut in cuts:
            own = [[str(x) for x, e in zip(ids[k], ends[k], strict=True) if before < e <= cut] for k in (0, 1)]
            out.append("|".join(map(",".join, own)))
            before = cut
        groups.append(out)
        sizes.append((len(ids[0]), len(ids[1])))
    count = Counter(pair for found in links for pair in set(found))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (
            *size,
            len(group),
            len(found),
            sum(count[p] == best[p[0]] for p in found),
            sum(count[p] for p in found),
            hashlib.sha256(";".join(group).encode()).hexdigest() if group else "",
        )
        for size, group, found in zip(sizes, groups, links, strict=True)
    ]


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b \tc", "the the the the", "the the the the",
    "café naïve ☃ 🙂 日本語 text", "x <|endoftext|> y <s> </s> <0x41> <unk>", "a▁b", "▁", "don't I'll we've",
    "12 345 6789", "word " * 700, "é" * 300, "tab\tand nbsp  em", "\x1c sep \x1f", "é ́x", "ﬁ ½ ´x",
]


def test_alignment_matches_plain_version(spark):
    texts = ODD + [f"{a} {b}" for a, b in zip(ODD[4:], ODD[:3:-1], strict=True)]
    rows = [(i if i % 7 else None, t, "x", 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, code string, row double").repartition(3)
    key = docs.select("doc_id", "text").collect()
    out = alignment.alignment(docs, *PATHS).collect()
    want = plain([r.text for r in key])
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in out) == Counter(
        (r.doc_id, *w) for r, w in zip(key, want, strict=True)
    )


def test_alignment_query_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op11_alignment(spark, sf).collect()}
    short = [r for r in docs if len(r.text or "") < 3000]
    # The plain version compares all pairs of tokens: whole corpus for scores, so all short texts only for the rest.
    want = plain([r.text for r in short])
    for r, w in zip(short, want, strict=True):
        assert got[r.doc_id][:4] == w[:4] and got[r.doc_id][6] == w[6]
    assert len(got) == len(docs)


def test_links_and_documents_of_pairs(spark):
    docs = spark.createDataFrame([(1, "go go go"), (2, "go"), (3, None)], "doc_id bigint, text string")
    held = alignment.index(docs.coalesce(1), *PATHS)
    pairs = alignment.pair_scores(held.where("code is not null")).collect()
    assert [(r.documents, r.links, r.best) for r in pairs] == [(2, 4, 2)]


def test_small_fragments_and_containers(spark, monkeypatch):
    chunks = alignment.Chunks(alignment.Tokenizers(*PATHS))
    texts = ["a b a c a", "b b b", "a"]
    whole, cut = alignment.Container(chunks), alignment.Container(chunks)
    for text in texts:
        whole.add(np.array(chunks.of(text), np.int64))
    monkeypatch.setattr(alignment, "FRAGMENT_CHUNKS", 2)
    for text in texts:
        cut.add(np.array(chunks.of(text), np.int64))
    assert whole.postings() == cut.postings()


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, alignment.SPARSE, alignment.SPARSE + 1, 700, alignment.CONTAINER_ROWS):
        numbers = np.sort(rng.choice(alignment.CONTAINER_ROWS, n, replace=False))
        assert alignment.unpacked(alignment.packed(numbers)).tolist() == numbers.tolist()


def test_container_without_tokens(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(6)], "doc_id bigint, text string").coalesce(1)
    rows = alignment.alignment(docs, *PATHS).collect()
    assert sorted(tuple(r) for r in rows) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(6)]


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_many_containers_add_up(spark, n, monkeypatch):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)], "doc_id bigint, text string").repartition(n)
    out = alignment.alignment(docs, *PATHS).agg(F.min("count_sum"), F.max("count_sum"), F.min("n_links")).first()
    assert out[0] == out[1] == 40 * out[2]
