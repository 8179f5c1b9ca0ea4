import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.llm import suffix_dedup as sd
from foldwise.llm.suffix_sort import suffix_arrays
from tests.llm.helpers import SF, awkward, empty, prose, table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=4), min_size=1, max_size=4))
def test_suffix_arrays_against_sorting(strings):
    symbols, base, bars = [], [0], []
    for pieces in strings:
        m, own = len(pieces) + 1, []
        for j, p in enumerate(pieces):
            own += [j, *(x + m for x in p)]
        own.append(m - 1)
        symbols += own
        base.append(len(symbols))
        bars.append(m)
    order = suffix_arrays(np.array(symbols), np.array(base), np.array(bars))
    for a, b in zip(base, base[1:]):
        own = symbols[a:b]
        assert (order[a:b] - a).tolist() == sorted(range(len(own)), key=lambda i: own[i:])


def brute(rows, length=400):
    seen = Counter(b[x:x + length] for _, t in rows for b in [(t or "").encode()] for x in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if seen[b[x:x + length]] > 1:
                hit[x:x + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if hit[j] and (not j or not hit[j - 1]))
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out.append((i, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, **limits):
    return sorted((tuple(r) for r in sd.repeat_report(docs, **limits).collect()), key=str)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_given_table(spark):
    docs = table(spark, "documents", SF)
    assert got(docs) == brute(rows_of(docs))


def test_shared_passages_with_different_neighbours(spark):
    passage = prose(90, 5)[:430]
    texts = [prose(40, i)[:150 + i] + passage[i % 31:] + prose(40, 100 + i)[i:] for i in range(40)]
    texts += [prose(60, 200) + "z" * 900 + prose(60, 201), "ab" * 700, "é" * 300, prose(200, 7) + prose(200, 8) + prose(200, 7)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(docs) == want
    # many blocks for one anchor: nothing is lost
    assert got(docs, limit=3) == want
    assert got(docs, core=200) == want


def test_second_anchors_are_those_of_the_window():
    """A window's second anchor depends on the window's bytes alone, and is the least by hash among all its substrings."""
    around, gram = 40, 10
    rolls = sd.Rolling(2 * around + 1, 21)
    text, core = prose(40, 3)[:200].encode(), 90

    def code(raw):
        sums = rolls.sums(np.frombuffer(raw, np.uint8))
        return sd.mix((sums[-1:] - sums[:1]) * rolls.down[:1])[0]

    for lo, windows in ((50, 41), (60, 7), (86, 5), (89, 2)):
        left, right = text[lo:core], text[core + 5:core + 5 + around - (core - lo) + windows - 1]
        got_at = sd.second_anchors(left, right, windows, around, gram, rolls)
        for x in range(windows):
            own_left, own_right = left[x:], right[:around - len(left) + x]
            places = {i - len(own_left): code(own_left[i:i + gram]) for i in range(len(own_left) - gram + 1)}
            places |= {i: code(own_right[i:i + gram]) for i in range(len(own_right) - gram + 1)}
            assert places[got_at[x]] == min(places.values())


def test_crowded_anchor(spark, monkeypatch):
    """One core with hundreds of different neighbourhoods: dealt by further anchors, at last window by window."""
    core, draw = prose(90, 5)[:280], np.random.default_rng(4)
    sides = [prose(30, 300 + i)[:100] for i in range(6)]
    texts = []
    for i in range(60):
        left, right = sides[draw.integers(6)], sides[draw.integers(6)]
        edit = int(draw.integers(0, 100))
        texts.append(left[:edit] + str(i) + left[edit:] + core + right + str(i) if i % 3 else left + core + right[:edit] + "#" + right[edit:])
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[2] for r in want) > 0
    assert got(docs) == want
    assert got(docs, limit=4) == want
    assert got(docs, limit=1) == want
    monkeypatch.setattr(sd, "ROUNDS", 0)
    assert got(docs, limit=1) == want


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 700)
    rows = [(1, prose(900, 1)), (2, prose(300, 2) + prose(900, 1)[1000:3000] + prose(300, 3)), (3, "q" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    assert got(docs) == brute(rows_of(docs))
    assert sd.repeat_report(empty(spark)).count() == 0
    assert sd.remove_repeats(empty(spark)).count() == 0


def test_remove_repeats_keeps_characters_and_columns(spark):
    shared = "é" * 250
    rows = [(1, "a" + shared + "b"), (2, "ßa" + shared + "c"), (3, None), (4, prose(100, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("k1"), F.lit(2).alias("spans"))
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text == {1: "b", 2: "ßc", 3: None, 4: prose(100, 1)}
    # repeats that begin inside a character leave the whole character
    assert sd.whole_characters("aéb".encode(), [2, 4]) == [3, 4] and sd.whole_characters("aéb".encode(), [0, 2]) == [0, 1]


def test_merge_spans():
    assert sd.merge_spans([5, 0, 20], [10, 6, 30]) == [0, 10, 20, 30]
    assert sd.kept_bytes(b"0123456789", [2, 4, 8, 10]) == b"014567"
    assert sd.kept_bytes(b"", None) == b""
