"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from offerloom.llm import lexical

DOCS = "doc_id bigint, text string, lang string, rank int, score string, item_id string, n int"
ITEMS = "item_id bigint, text string, doc_id int, terms string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    rows = [(i, Counter(words(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    count, length = len(rows), sum(n for _, _, n in rows)
    holding = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, counts, n in rows:
            m = 100 - 90 + (90 * n * count) // length
            score = 0
            for t in terms & counts.keys():
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * holding[t] + 1)))
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:size])]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, None, 1, "s", "i", 2) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    return sorted(map(tuple, lexical.search(d, q, **how).collect()), key=str)


def test_terms():
    for text in ["", None, "A-b_C9é ÉÀ x", "naïve space １２ Ǆ 🙂ok", "a\x00b\x7fc[d]"]:
        assert [t.decode() for t in lexical.terms_of((text or "").encode())] == words(text)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha BETA"), (None, "alpha beta"), (6, "beta " * 30_000 + "rare"), (7, "gamma É")]
    items = [(1, "alpha, beta!"), (2, None), (3, ""), (None, "rare"), (None, "É"), (9, "nowhere"), (1, "gamma"), (4, "alpha alpha ALPHA")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, size=2) == plain(docs, items, 2)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


@pytest.mark.parametrize("seed", range(3))
def test_against_every_score(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    chance = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, chance, k=rng.randint(0, 60)))) for k in range(400)]
    docs += [(1000 + k, docs[3][1]) for k in range(40)]  # ties of many copies
    items = [(k, " ".join(rng.sample(vocabulary, rng.randint(1, 20)))) for k in range(25)] + [(99, docs[3][1])]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 90)  # several blocks of items
    assert run(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("wave", [1, 3, 256])
def test_segment_search(wave, monkeypatch):
    """One segment after the other, whatever the number of intervals split at a time."""
    monkeypatch.setattr(lexical, "WAVE", wave)
    rng = np.random.default_rng(wave)
    best, everything = [], []
    wanted = np.array([0, 2, 3, 7, 9])
    for part in range(3):
        held = rng.random((200, 10)) < np.linspace(0.02, 0.9, 10)
        places, terms = np.nonzero(held)
        impacts = rng.integers(0, 50, len(terms))
        ids = [part * 200 + k for k in range(200)]
        best = lexical.Segment(terms, places, impacts, 200).search(wanted, ids, best, 10)
        scores = np.zeros(200, np.int64)
        np.add.at(scores, places, np.where(np.isin(terms, wanted), impacts, 0))
        everything += [(int(s), i) for s, i in zip(scores, ids) if s > 0]
        assert best == lexical.ranked(everything)[:10]


def test_range_maxima():
    rng = np.random.default_rng(0)
    terms = np.repeat([0, 1, 2], [1, 37, 100])
    segment = lexical.Segment(terms, np.concatenate([np.arange(k) for k in (1, 37, 100)]), rng.integers(0, 9, 138), 100)
    for _ in range(500):
        a = int(rng.integers(38, 138))
        b = int(rng.integers(a + 1, 139))
        found = segment.maxima(np.array([a]), np.array([b]))[0]
        assert a <= found < b and segment.impacts[found] == segment.impacts[a:b].max()


def test_long_lengths():
    """Lengths whose product with the corpus leaves 64 bits."""
    corpus = lexical.Corpus(10**11, 10**14, np.array([7]))
    n = np.array([10**9, 5])
    got = corpus.impacts(np.zeros(2, np.int64), np.array([3, 1]), n)
    assert got.tolist() == [7 * ((10**9 * tf) // (1000 * tf + 8 * (10 + (90 * k * 10**11) // 10**14))) for tf, k in ((3, 10**9), (1, 5))]
