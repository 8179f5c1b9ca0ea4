import random
from bisect import bisect_left, insort
from collections import defaultdict

import pytest

from foldwise.llm import packing as pk
from tests.llm.helpers import SF, awkward, awkward_rows, empty, table


def piecewise(lengths, sizes, opened):
    """Best fit in descending order, one piece after the other; final sizes."""
    opened = sorted(opened, key=lambda s: (pk.linear_cost(s) / s, s))
    rooms, held = [], []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, (x, -1, 0))
        if at < len(rooms):
            room, size, b = rooms.pop(at)
        else:
            size = next((s for s in opened if s >= x), None) or min(s for s in sizes if s >= x)
            room, b = size, len(held)
            held.append([])
        held[b].append(x)
        insort(rooms, (room - x, size, b))
    return sorted(min(s for s in sizes if s >= sum(h)) for h in held), held


@pytest.mark.parametrize("seed", range(25))
def test_bulk_equals_piece_by_piece(seed):
    draw = random.Random(seed)
    sizes = tuple(sorted(draw.sample(range(8, 60), draw.randint(1, 4))))
    lengths = [draw.randint(1, max(sizes)) for _ in range(draw.randint(1, 200))]
    lengths += [draw.randint(1, max(sizes))] * draw.randint(0, 80)
    histogram = defaultdict(int)
    for x in lengths:
        histogram[x] += 1
    groups = pk.pack_histogram(histogram, sizes)
    total = sum(count * pk.linear_cost(size) for count, size, _ in groups)
    costs = []
    for k in range(1, len(sizes) + 1):
        from itertools import combinations
        for opened in combinations(sizes, k):
            bins = pk.Bins(sizes, opened, pk.linear_cost)
            for x in sorted(histogram, reverse=True):
                bins.add(x, histogram[x])
            got = sorted(size for count, size, _ in bins.groups() for _ in range(count))
            want, _ = piecewise(lengths, sizes, opened)
            costs.append(sum(map(pk.linear_cost, want)))
            assert len(got) == len(want)
            if len(sizes) == 1:
                assert got == want
    assert total <= max(costs)
    placed = defaultdict(int)
    for count, size, held in groups:
        used = 0
        while held is not None:
            placed[held[0]] += count * held[1]
            used += held[0] * held[1]
            held = held[2]
        assert used <= size and all(s < used for s in sizes if s < size)
    assert placed == histogram


def check(rows, texts, sizes, gap=1):
    spans, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.length))
        if r.length:
            bins[r.bin_id].append((r.bin_offset, r.length + gap, r.bin_size))
        else:
            assert r.bin_id is None
    want = defaultdict(list)
    for i, t in texts:
        n, most = len((t or "").encode()), max(sizes) - gap
        want[i] += [(s, min(most, n - s)) for s in range(0, n, most)] or [(0, 0)]
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        held.sort()
        assert len({size for *_, size in held}) == 1 and held[0][2] in sizes
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(held, held[1:])) and held[0][0] == 0
        used = held[-1][0] + held[-1][1]
        assert used <= held[0][2] and all(s < used for s in sizes if s < held[0][2])
    return sum(n for held in bins.values() for _, n, _ in held) / sum(held[0][2] for held in bins.values())


def test_given_table(spark):
    docs = table(spark, "documents", SF)
    rows = pk.pack_documents(docs).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()], pk.SIZES) > 0.95


def test_frequent_length_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(pk, "RANK_BUCKET", 10)
    rows = [(i, "x" * 90) for i in range(300)] + [(i, "y" * (i % 97)) for i in range(300, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(pk.pack_documents(docs, sizes=(64, 128, 200)).collect(), rows, (64, 128, 200))


def test_awkward_and_empty(spark):
    rows = pk.pack_documents(awkward(spark)).collect()
    check(rows, [r[:2] for r in awkward_rows()], pk.SIZES)
    assert pk.pack_documents(empty(spark)).count() == 0


def test_smaller_sizes_are_used_where_they_are_cheaper():
    groups = pk.pack_histogram({900: 1}, (1000, 4000))
    assert [(c, s) for c, s, _ in groups] == [(1, 1000)]
    with pytest.raises(ValueError):
        pk.pack_histogram({1: 1}, tuple(range(1, 9)))
