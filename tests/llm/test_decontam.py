import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.llm import decontam as dc
from tests.llm.helpers import MID, awkward, empty, prose, table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.lists(st.integers(0, 5), max_size=40))
def test_common_subsequence(item, text):
    best = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    assert dc.common_subsequence(item, dc.positions(item), text) == best[-1][-1]


def test_word_hashes_do_not_depend_on_neighbours(monkeypatch):
    words = dc.Words()
    texts = ["One two, three.", None, "", "two TWO éß-x", "a " * 50, "...", "three"]
    got = words.of(texts)
    assert [len(g) for g in got] == [3, 0, 0, 4, 50, 0, 1]
    assert got[0][1] == got[3][0] == got[3][1] and got[0][2] == got[6][0]
    long = prose(800, 1)
    whole = words.of([long])[0]
    monkeypatch.setattr(dc, "SEGMENT", 256)
    assert (dc.Words().of([long])[0] == whole).all() and len(whole) == 800


def planted(spark):
    draw = random.Random(3)
    vocabulary = [f"w{draw.randrange(10 ** 6)}" for _ in range(3000)] + ["the", "of", "and", "to"] * 200
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.randint(15, 60)) + ". " + text(6) + ".") for i in range(40)]
    docs, want = [], set()
    for i in range(400):
        body = [text(draw.randint(20, 200))]
        if i % 4 == 0:
            k = draw.randrange(40)
            words = items[k][1].split()
            if i % 8 == 0:                       # a paraphrase: every sixth word of the question replaced
                words = [w if j % 6 or j > len(words) - 8 else "other" for j, w in enumerate(words)]
            body += [" ".join(words), text(50)]
            want.add((i, k))
        docs.append((i, " ".join(body)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"), want)


def test_planted_leaks(spark):
    docs, items, want = planted(spark)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 1
    clean = {r.doc_id for r in dc.clean_documents(docs, items).collect()}
    assert clean == {i for i in range(400)} - {i for i, _ in got}


def test_items_in_several_passes(spark, monkeypatch):
    docs, items, want = planted(spark)
    monkeypatch.setattr(dc, "ITEMS", 15)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    assert len(want & got) >= 0.99 * len(want)


def test_given_table_has_all_verbatim_items(spark):
    docs, items = table(spark, "documents", MID), table(spark, "benchmark", MID)
    norm = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in t.lower()).split())} "
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    want = {(d, r.item_id) for r in items.collect() if len(norm(r.text).split()) >= dc.LEAST_WORDS
            for d, t in texts if norm(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want)


def test_latent_search_finds_the_nearest_passages(spark):
    """Recall of the candidate search against brute-force TF-IDF cosines."""
    docs, items = table(spark, "documents", MID), table(spark, "benchmark", MID)
    df, n = dc.document_frequencies(docs)
    assert n == docs.count()
    idf = np.log((1 + n) / (1 + df)) + 1
    fit = dc._passages(items, 1.0)
    basis = dc.randomised_svd(fit, idf, dc.RANK)
    index = dc.Index().build(items.select("item_id", "text").toPandas().assign(answer=None), idf, basis)
    hashes = dc.Words().of([r.text for r in docs.orderBy("doc_id").limit(400).collect()])

    def rows(lists):
        m = np.zeros((len(lists), 1 << dc.BITS), np.float32)
        for i, x in enumerate(lists):
            np.add.at(m[i], x, idf[x])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    queries = [dc.buckets(dc.Words().of([t])[0]) for t in items.select("text").toPandas()["text"]]
    queries = [q[s:s + 2 * dc.HALF] for q in queries if len(q) >= dc.LEAST_WORDS for s in dc.passage_starts(len(q))]
    exact = rows(queries)
    found = near = 0
    for h in hashes:
        b, starts = dc.buckets(h), dc.passage_starts(len(h))
        hits = {(p, q) for p, q, _ in index.candidates(index.project(b, starts))}
        close = np.argwhere(rows([b[s:s + 2 * dc.HALF] for s in starts]) @ exact.T >= 0.7)
        near += len(close)
        found += sum((p, q) in hits for p, q in close.tolist())
    assert near > 10 and found >= 0.9 * near


def test_answers():
    words = dc.Words()
    assert dc.answer_words("Who was it? It was old Tom.", None, words) == words.of(["it was old tom"])[0].tolist()
    assert dc.answer_words("Who was it?", "Tom", words) == words.of(["tom"])[0].tolist()
    assert len(dc.answer_words("one two three four five six seven eight nine", None, words)) == 3


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, prose(120, 2)), (1, prose(120, 2)), (2, None), (3, ""), (4, "too short"), (None, prose(60, 9))],
                                  "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()), key=str)
    assert got == sorted([(i, 1) for i in (6, 7, 7, None) for _ in range(2)], key=str)
    clean = dc.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == 11
    assert dc.find_leaks(empty(spark), items).count() == 0
    assert dc.find_leaks(docs, items.filter("false")).count() == 0
    assert dc.clean_documents(docs, items.filter("false")).count() == 15


def test_parts_of_long_items_short_items_and_passing_places(spark):
    draw = random.Random(8)
    vocabulary = [f"v{draw.randrange(10 ** 6)}" for _ in range(4000)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    long, question, answer = text(500), text(50), text(6)
    near = question.split()
    worse = lambda k: " ".join(w if j < k else f"other{j}" for j, w in enumerate(near))
    items = spark.createDataFrame([(1, long, None), (2, "Who wrote it? Tom.", None), (3, question, answer), (4, "Who wrote it? Tom.", None)],
                                  "item_id long, text string, ans string")
    part = " ".join(long.split()[150:350])
    docs = [(1, f"{text(40)} {part} {text(60)}"), (2, text(30) + " who WROTE it, Tom " + text(9)), (3, "who wrote it? Not Tom. " + text(20)),
            (4, f"{worse(34)} {text(400)} {worse(31)} {answer} {text(30)}"), (5, f"{worse(34)} {text(60)}"),
            (6, f"{text(90)} {' '.join(long.split()[200:225])} {text(90)}")]
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, answer="ans").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (2, 4), (4, 3)]
    assert all(r.cosine is None and r.lcs == 1 for r in got if r.doc_id == 2)
    only = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items.filter("item_id in (2, 4)"), answer="ans")
    assert sorted((r.doc_id, r.item_id) for r in only.collect()) == [(2, 2), (2, 4)]


def test_latent_space_is_fitted_on_every_document(spark, monkeypatch):
    """The corpus part of the fit is the sum over all passages of all documents, in any partitioning."""
    texts = [(i, prose(20 + 37 * i, i)) for i in range(12)] + [(None, prose(50, 99)), (12, None), (13, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    idf = np.linspace(1.0, 5.0, 1 << dc.BITS)
    whole = dc.corpus_sketch(docs.repartition(5), idf)
    parts = [dc.corpus_sketch(docs.filter(F.col("doc_id").eqNullSafe(i)), idf) for i, _ in texts]
    assert all(p.any() for p in parts[:13]) and not any(p.any() for p in parts[13:])
    assert np.allclose(sum(parts), whole, atol=1e-5) and (dc.corpus_sketch(docs.coalesce(1), idf) == whole).all()
    one = parts[0][np.abs(parts[0]).max(axis=1) > 0]             # 20 words: one passage, a unit row
    assert len(one) == 1 and abs(np.linalg.norm(one) - 1) < 1e-5

    seen, fit = [], dc.corpus_sketch
    monkeypatch.setattr(dc, "corpus_sketch", lambda rows, w: seen.append(rows.count()) or fit(rows, w))
    many = spark.range(500).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text")
    dc.find_leaks(many, docs.filter("text <> ''").selectExpr("doc_id AS item_id", "text")).collect()
    assert seen == [500]


def test_sketch_rows_enter_the_decomposition(spark):
    """Dense rows count like passages, also on words no item has."""
    passages = spark.createDataFrame([([1, 2], 1.0), ([2, 3], 1.0)], "words array<long>, weight double")
    idf, more = np.ones(1 << dc.BITS), np.zeros((dc.FIT_ROWS, 1 << dc.BITS), np.float32)
    more[0, [3, 7]] = 3.0
    got = dc.randomised_svd(passages, idf, 3, more=more)
    rows = np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 3 * 2 ** .5, 3 * 2 ** .5]]) / 2 ** .5
    want = np.linalg.svd(rows)[2]
    assert np.allclose(np.abs(np.sum(got[[1, 2, 3, 7]].T * want[:3], axis=1)), 1, atol=1e-3)


def test_all_texts_are_projected_at_once_to_the_last_bit():
    draw = np.random.default_rng(2)
    basis = draw.standard_normal((1 << dc.BITS, 20)).astype(np.float32)
    basis[draw.random(len(basis)) < 0.3] = 0               # words without a latent image
    idf = 1 + draw.random(1 << dc.BITS)
    items = [("a", prose(40, 1), None), ("b", prose(20, 2), None)]
    index = dc.Index().build(pd.DataFrame(items, columns=["item_id", "text", "answer"]), idf, basis)
    texts = [draw.integers(0, 1 << dc.BITS, n) for n in (0, 1, 7, 15, 16, 17, 33, 64, 5000)]
    texts += [np.full(40, np.flatnonzero(np.abs(basis).max(axis=1) == 0)[0])]
    starts = [dc.passage_starts(len(t)) for t in texts]
    weighed = basis * idf[:, None].astype(np.float32)
    known = np.abs(basis).max(axis=1) > 1e-7

    def half(words):
        words = words[known[words]]
        return np.add.reduceat(weighed[words], [0], axis=0)[0] if len(words) else np.zeros(20, np.float32)

    want = [half(t[s:s + dc.HALF]) + half(t[s + dc.HALF:s + 2 * dc.HALF]) for t, own in zip(texts, starts) for s in own]
    assert np.array_equal(index.project_all(texts, starts), np.array(want))
