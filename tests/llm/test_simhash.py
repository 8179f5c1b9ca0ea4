"""Operator 12 against brute force: fingerprints, links, classes."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from foldwise.llm.simhash import GROUP, fields_for, fingerprint, forest, near_lanes, planes_of, simhash_classes
from tests.llm.helpers import MID, awkward, awkward_rows, empty, prose, table


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [words[i:i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=4):
    """Least position reachable, by all pairs."""
    fps = np.array(fps, np.uint64)
    root = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        new = np.where(near, root[None, :], len(fps)).min(axis=1) if len(fps) else root
        if (new == root).all():
            return root
        root = new


def brute(rows, radius=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_fingerprint(t) for _, t in rows]
    root = classes(fps, radius)
    least = defaultdict(lambda: None)
    for (i, _), r in zip(rows, root):
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root)), key=str)


def rows_of(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=str)


def near_family(count, seed):
    """Variants of one long text with a few words changed."""
    draw, words = np.random.default_rng(seed), prose(400, seed).split()
    out = []
    for i in range(count):
        new = list(words)
        for at in draw.integers(0, len(words), draw.integers(0, 8)):
            new[at] = f"w{i}x{at}"
        out.append(" ".join(new))
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "One two", "one  TWO\tthree\x0bfour", "É É é É É", prose(5000, 3), "a" * 9000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def random_family(seed, n=1500):
    draw = np.random.default_rng(seed)
    fps = draw.integers(0, 1 << 64, n // 5, dtype=np.uint64).repeat(5)
    for _ in range(5):
        flip = np.uint64(1) << draw.integers(0, 64, len(fps)).astype(np.uint64)
        fps = np.where(draw.random(len(fps)) < 0.6, fps ^ flip, fps)
    return np.unique(np.append(fps, np.array([0, 1, (1 << 64) - 1], np.uint64)))


@pytest.mark.parametrize("radius", range(5))
def test_bit_sliced_distances(radius):
    for fps in (random_family(radius), random_family(9)[:1], random_family(7, 320)[:64]):
        q, lane = near_lanes(fps, planes_of(fps), radius)
        ok = lane < len(fps)
        want = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
        assert sorted(zip(q[ok], lane[ok])) == sorted(zip(*want))


def joined(fps, edges):
    at = {int(f): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges.tolist():
        a, b = find(at[a]), find(at[b])
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_forest_spans_all_links():
    fps = random_family(3)
    want = classes(fps).tolist()
    edges = forest(fps, None)
    assert len(edges) < len(fps) and joined(fps, edges) == want
    cut = len(fps) // 3
    parts = [forest(fps[:cut], None), forest(fps[cut:], None), forest(fps[:cut], fps[cut:])]
    assert joined(fps, np.concatenate(parts)) == want


def test_linked_pairs_agree_in_the_fields_that_deal_them():
    draw = np.random.default_rng(1)
    for nodes in (10, 10 ** 6, 10 ** 8, 10 ** 10, 10 ** 12):
        fields, agree, bits = fields_for(nodes)
        assert sum(w for _, w in fields) == 64 and len(fields) - 4 == agree
        assert bits <= sum(sorted(w for _, w in fields)[:agree])
        assert nodes / 2 ** bits <= 2 * GROUP or nodes == 10 ** 12
        for _ in range(200):
            diff = {int(b) for b in draw.integers(0, 64, 4)}
            same = [f for f in fields if not any(f[0] <= b < f[0] + f[1] for b in diff)]
            assert len(same) >= agree


@pytest.mark.parametrize("group, block", [(2048, 1 << 14), (8, 20)])
def test_documents_against_brute_force(spark, group, block):
    docs = table(spark, "documents", MID)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(simhash_classes(docs, group=group, block=block)) == want


def test_large_family_over_many_blocks(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(near_family(300, 5))]
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(near_family(1, 8) * 50)]
    want = brute([(r[0], r[1]) for r in rows])
    got = rows_of(simhash_classes(awkward(spark, rows), group=4, block=16))
    assert got == want and len({r[1] for r in got}) > 100


def test_awkward_table(spark):
    rows = awkward_rows()
    assert rows_of(simhash_classes(awkward(spark, rows))) == brute([(r[0], r[1]) for r in rows])


def test_empty_table(spark):
    assert rows_of(simhash_classes(empty(spark))) == []


def test_smaller_radius(spark):
    docs = table(spark, "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    assert rows_of(simhash_classes(docs, radius=2)) == want
