import random

import numpy as np
import pytest

from foldwise.llm import ngram_join as nj
from foldwise.llm.components import connected_components
from foldwise.llm.common import Scratch
from tests.llm.helpers import MID, awkward, empty, prose, table


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Sorted (id, class, links) by all pairs of different texts."""
    texts = sorted({t for _, t in rows if t and t.split()})
    sets = [grams(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
                continue
            n = len(a & b)
            if n >= 0.8 * (len(a) + len(b) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if t in at and i is not None:
            r = root(at[t])
            least[r] = min(least.get(r, i), i)
    return sorted(((i, least.get(root(at[t])), links[at[t]]) if t in at else (i, i, 0) for i, t in rows), key=str)


def got(docs, **limits):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in nj.similar_texts(docs, **limits).collect()), key=str)


def edits(n, seed):
    draw, words = random.Random(seed), prose(150, seed).split()
    out = []
    for _ in range(n):
        w = words.copy()
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = prose(1, draw.random())
        out.append(" ".join(w))
    return out


def test_given_table(spark):
    docs = table(spark, "documents", MID)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("dense", [1, 4, 1000])
def test_large_groups(spark, monkeypatch, dense):
    """The same links, listed pair by pair or counted block by block."""
    monkeypatch.setattr(nj, "BLOCK_NODES", 16)
    texts = edits(60, 1) + edits(50, 2) + [prose(100, s) for s in range(20)] + ["one two"] * 3
    rows = list(enumerate(texts * 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, dense=dense) == brute(rows)


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)
    assert nj.similar_texts(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = awkward(spark)
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # the class of the twins keeps 6; blank texts stay
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 6, None, 8, 9, 10, 11, 12]))
    twice = spark.createDataFrame([(7, prose(90, 4))] * 5 + [(8, prose(90, 4))], "doc_id long, text string")
    assert [r.doc_id for r in nj.keep_one(twice).collect()] == [7]
    assert nj.keep_one(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "\x1c\x85 "), (2, "\u00a0"), (3, None), (4, prose(90, 4))], "doc_id long, text string")
    assert sorted(r.doc_id for r in nj.keep_one(blank).collect()) == [1, 2, 3, 4]


def test_bands_reach_the_recall():
    n = nj.bands_for(0.8, 8, 0.999)
    assert 1 - (1 - 0.8 ** 8) ** n >= 0.999 > 1 - (1 - 0.8 ** 8) ** (n - 1)
    a, b = nj.hash_family(n * 8)
    draw, missed = np.random.default_rng(0), 0
    for _ in range(300):
        x = draw.integers(0, 1 << 63, 180, np.uint64)
        y = np.concatenate([x[:160], draw.integers(0, 1 << 63, 20, np.uint64)])      # similarity 0.8
        s, t = (nj.band_hashes(nj.signature(v, a, b), 8) for v in (x, y))
        missed += not (s == t).any()
    assert missed <= 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (60, 50), (60, 70), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = dict(tuple(r) for r in connected_components(df, Scratch(spark, "t")).collect())
    assert found == {**{i: 0 for i in range(31)}, **{i: 50 for i in (50, 60, 70, 100)}, 200: 200, 201: 200}
