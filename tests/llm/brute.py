"""Plain single-process versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs):
    """docs: [(id, text)] -> {id: (hex, component)}"""
    fps = {d: simhash(t) for d, t in docs}
    union = Union()
    ids = sorted(fps)
    values = np.array([fps[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            union.join(d, ids[j])
    return {d: (f"{fps[d]:016x}", union.find(d)) for d in ids}


def shingle_components(texts, size=5, least=0.8):
    """texts -> component number per text, over all pairs of which the shingle sets are alike."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    holders, union = defaultdict(list), Union()
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for shingle in s for j in holders[shingle] if j < i)
        for j, both in shared.items():
            if both >= least * (len(s) + len(sets[j]) - both):
                union.join(i, j)
    return [union.find(i) for i in range(len(texts))]


def _kept(words_or_bytes, covered):
    return [w for w, c in zip(words_or_bytes, covered, strict=True) if not c]


def word_windows(docs, size=50):
    """docs: [(id, text)] -> {id: (n_words, n_removed, sha256)}"""
    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in words.items():
        covered = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                covered[i : i + size] = [True] * size
        out[d] = (len(w), sum(covered), hashlib.sha256(b" ".join(_kept(w, covered))).hexdigest())
    return out


def byte_windows(docs, size=200):
    """docs: [(id, text)] -> {id: (n_bytes, n_removed, n_spans, sha256)}"""
    texts = {d: (t or "").encode() for d, t in docs}
    count = Counter(t[i : i + size] for t in texts.values() for i in range(len(t) - size + 1))
    out = {}
    for d, t in texts.items():
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                covered[i : i + size] = True
        raw = np.frombuffer(t, np.uint8)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], covered])) & covered)) if len(t) else 0
        out[d] = (len(t), int(covered.sum()), spans, hashlib.sha256(raw[~covered].tobytes()).hexdigest())
    return out


def vector_links(rows, least=0.95):
    """rows: [(id, vector)] -> {id: (links, component)}"""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.all(np.isfinite(v))]
    good = [(i, v / np.linalg.norm(v)) for i, v in good if np.linalg.norm(v) > 0]
    near, union = defaultdict(int), Union()
    if good:
        ids, m = [i for i, _ in good], np.array([v for _, v in good])
        for k, i in enumerate(ids):
            for j in np.flatnonzero(m @ m[k] >= least):
                if j != k:
                    near[i] += 1
                    union.join(i, ids[j])
    return {i: (near[i], union.find(i)) for i, _ in rows}
