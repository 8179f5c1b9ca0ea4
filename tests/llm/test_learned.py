"""Language and toxicity: held-out quality, edge cases, what may not be an input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from foldwise.llm import langid, toxicity
from foldwise.llm.common import Scratch
from tests.llm.helpers import MID, awkward, empty, table


def test_language_held_out(spark):
    docs = table(spark, "documents", MID)
    rows = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_language_ignores_held_out_labels(spark):
    docs = table(spark, "documents", MID).limit(300)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id"), 5, 0), "xx").otherwise(F.col("lang"))) \
        .withColumn("source", F.lit("s"))
    first = sorted(map(tuple, langid.predict_languages(docs).select("doc_id", "lang_pred").collect()))
    assert first == sorted(map(tuple, langid.predict_languages(other).select("doc_id", "lang_pred").collect()))


def test_language_awkward(spark):
    docs = awkward(spark).unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 100))
    rows = langid.predict_languages(docs).collect()
    assert len(rows) == 30
    for r in rows:
        if r.doc_id in (1, 2, 3, 11, 101, 102, 103, 111):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr", "de", "es", "und")
    assert langid.predict_languages(empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict_languages(unlabelled).collect()} == {"und"}


def test_letters_beyond_the_table():
    letters = langid.letter_table()
    assert langid.ngram_counts("\U0001F600 \U0001F601 12 ##", letters, 12) is None         # no letter
    assert langid.ngram_counts("\U00020000\U0001F600", letters, 12) is not None            # a letter


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    letters, text = langid.letter_table(), "Ein Wort, noch éins\n und 12 mehr " * 50
    whole = langid.ngram_counts(text, letters, 12)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (langid.ngram_counts(text, letters, 12) == whole).all()


def test_temperature():
    draw = np.random.default_rng(0)
    logits = draw.normal(size=(4000, 3))
    y = np.array([draw.choice(3, p=p) for p in langid.softmax(logits)])
    assert 0.85 < langid.best_temperature(logits, y) < 1.15
    assert 4 < langid.best_temperature(logits * 5, y) < 6


def test_ftrl_is_sparse_and_separates():
    draw = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        y = int(draw.integers(2))
        rows.append((np.array([y, 2 + int(draw.integers(200))]), np.array([0.8, 0.6]), y))
    w = langid.ftrl(rows, 2, 400)
    assert (w[300:] == 0).all() and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "documents", MID), table(spark, "labels", MID)
    rows = toxicity.score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    seen = [r for r in rows if r.toxic is not None]
    y = np.array([r.toxic for r in seen])
    assert auc(np.array([r.score for r in seen]), y) > 0.93
    held = [r for r in seen if r.held_out and r.toxic == 0]
    assert np.mean([r.predicted for r in held]) < 0.05


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = table(spark, "documents", MID), table(spark, "labels", MID)
    flipped = labels.withColumn("toxic", F.when(langid.held_out(F.col("doc_id"), 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first = sorted(map(tuple, toxicity.score_toxicity(docs, labels).select("doc_id", "score").collect()))
    again = sorted(map(tuple, toxicity.score_toxicity(docs, flipped).select("doc_id", "score").collect()))
    assert np.allclose([s for _, s in first], [s for _, s in again])


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0), (7, 0, None), (8, 1, 1), (8, 1, 0), (None, 1, 1), (9, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    none = labels.filter("false")
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0


def test_labels_of_one_class_give_the_base_rate(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    for toxic in (0, 1):
        one = labels.filter(F.col("toxic") == toxic)
        scores = {r.score for r in toxicity.score_toxicity(docs, one).collect()}
        assert len(scores) == 1 and (min(scores) < 0.1) == (toxic == 0)


def test_surplus_calibration_rows_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CALIBRATION", 50)
    rows = spark.range(8000).withColumnRenamed("id", "doc_id")
    assert 20 < rows.filter(toxicity.calibration(rows)).count() < 100
    counted = []
    fit = toxicity.fit_ratios
    monkeypatch.setattr(toxicity, "fit_ratios", lambda words, *a, **k: counted.append(
        words.agg(F.sum("n")).first()[0]) or fit(words, *a, **k))
    toxicity.learn(rows.withColumn("text", F.lit("word")).withColumn("toxic", (F.col("doc_id") % 2).cast("int")),
                   Scratch(spark, "test"))
    assert counted[0] == 8000 - rows.filter(toxicity.calibration(rows)).count()


def test_every_ngram_has_its_own_ratio(spark, monkeypatch):
    """A rare toxic word among so many ordinary ones that a table of 2^19 buckets would be full."""
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 500)
    draw = np.random.default_rng(3)
    words = sorted({"".join(w) for w in draw.choice(list("abcdefghijklmnop"), (60_000, 12))})
    rows = [(w, 0, 5) for w in words] + [("zyxwvu", 1, 2)]
    scratch = Scratch(spark, "test")
    ratios = toxicity.fit_ratios(spark.createDataFrame(rows, "word string, toxic int, n long"), scratch)
    pieces = lambda w: [f"^{w}$"[max(0, i - 5):i + 1] for i in range(1, len(w) + 2)]
    grams = {g for w, _, _ in rows for g in pieces(w)}
    want = grams | {"\x01" + g[:-1] for g in grams}
    n = ratios.count()
    assert n > 1 << 19 and n == len(want) and ratios.select("gram").distinct().count() == n
    known = dict(map(tuple, ratios.filter("gram rlike '[q-z]'").collect()))
    assert min(known[g] for g in pieces("zyxwvu")) > 0.5
    score = lambda w: np.mean([known.get(g, known.get("\x01" + g[:-1], 0.0)) for g in pieces(w)])
    texts = [(None, None), (1, "zyxwvu"), (2, ""), (3, "zyxwvu " * 600), (4, "zyxwvu 12 zyxwvq")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.mean, r.most) for r in toxicity.with_features(docs, ratios, n, scratch, "got").collect()}
    assert set(got) == {None, 1, 2, 3, 4} and got[None] == got[2] == (0, 0)
    assert np.allclose(got[1], score("zyxwvu")) and np.allclose(got[3], got[1])
    assert np.allclose(got[4], (score("zyxwvu") + score("zyxwvq")) / 2)
