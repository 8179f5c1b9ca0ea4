"""Operator 8: language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three characters of the lower-case
text, everything but letters read as one blank) in ``2^bits`` buckets, weighted
(1 + log tf) * idf and scaled to unit length.  Document frequencies are counted
over all learning rows.  Weights are learnt by follow-the-regularised-leader
(per-coordinate steps, L1 and L2 penalties) on at most about ``max_train`` rows
(a hash decides which), dealt over ``learners`` tasks whose weights are averaged;
a slice that no learner sees gives the temperature of the softmax.

The model is ``2^bits x languages`` floats, whatever the input size.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties go to
the first language in sorted order; rows without a language are scored, not learnt
from; if nothing can be learnt, every row is ``und``; repeated rows get equal
results; a null id hashes as the empty text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import small_batches

BITS, MAX_TRAIN, LEARNERS, EPOCHS = 15, 20_000, 6, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
CALIBRATION = 10              # one learning row in so many is kept for the temperature
UNKNOWN = "und"
CHUNK = 1 << 16               # characters hashed at a time


def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def ngram_counts(text: str | None, letters: np.ndarray, bits: int) -> np.ndarray | None:
    """Counts by bucket of the text's character n-grams; None without any letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[np.minimum(cp, 0xFFFF)]
    beyond = np.flatnonzero(cp >= 0x10000)               # outside the table: few, looked up one by one
    if len(beyond):
        kinds, which = np.unique(cp[beyond], return_inverse=True)
        is_letter[beyond] = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
    if not is_letter.any():
        return None
    cp = np.where(is_letter, cp, 32)
    keep = np.ones(len(cp), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    cp = np.concatenate([[32], cp[keep], [32]]).astype(np.uint32)
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, len(cp), CHUNK):
        part = cp[at:at + CHUNK + 2]
        h = np.zeros(len(part), np.uint32)
        for n in (1, 2, 3):
            if len(part) < n:
                break
            h = (h[:len(part) - n + 1] + part[n - 1:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            new = h[:min(len(h), CHUNK)]                 # positions of the next chunk are its own
            counts += np.bincount((new * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * idf[at]
    return at, x / np.sqrt(x @ x)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list, classes: int, width: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (width x classes) from rows (buckets, values, class)."""
    z, n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0,
                        (np.sign(zz) * L1 - zz) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1.0
            g = x[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weights(slice(None))


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Least negative log-likelihood over a fine grid of temperatures."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(key: Column, parts: int, part: int) -> Column:
    """crc32 of the key as text, modulo ``parts``, equals ``part``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def learn(rows: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN) -> dict | None:
    """Model from rows (text, lang, draw); ``draw`` is a hash in 0 .. 2^31 - 1."""
    width = 1 << bits

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, seen, langs = letter_table(), np.zeros(width, np.int64), {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                counts = ngram_counts(text, letters, bits)
                if counts is not None:
                    seen += counts > 0
                    langs[lang] = langs.get(lang, 0) + 1
        at = np.flatnonzero(seen)
        if len(at):
            yield pd.DataFrame({"bucket": at, "lang": [None] * len(at), "n": seen[at]})
            yield pd.DataFrame({"bucket": [-1] * len(langs), "lang": list(langs), "n": list(langs.values())})

    # bounded: one row per bucket and language
    table = (rows.select("text", "lang").mapInPandas(frequencies, "bucket long, lang string, n long")
             .groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toPandas())
    by_lang = table[table["bucket"] < 0]
    langs, total = sorted(by_lang["lang"]), int(by_lang["n"].sum())
    if not total:
        return None
    df = np.zeros(width)
    grams = table[table["bucket"] >= 0]
    df[grams["bucket"].to_numpy(np.int64)] = grams["n"].to_numpy(float)
    idf = np.log((1 + total) / (1 + df)) + 1

    def featured(pdf: pd.DataFrame, letters) -> list:
        out = []
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            counts = ngram_counts(text, letters, bits)
            if counts is not None:
                out.append((*tfidf(counts, idf), langs.index(lang)))
        return out

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "lang", "text"])
        w = ftrl(featured(pdf, letter_table()), len(langs), width)
        return pd.DataFrame({"weights": [w.astype(np.float32).tobytes()], "n": [len(pdf)]})

    sample = rows.filter(F.col("draw") < int((1 << 31) * min(1.0, max_train / total)))
    kept = (F.col("draw") % CALIBRATION == 0) if total > CALIBRATION * CALIBRATION else F.lit(False)
    parts = (sample.filter(~kept).withColumn("learner", F.pmod(F.xxhash64("draw"), F.lit(LEARNERS)))
             .groupBy("learner").applyInPandas(train, "weights binary, n long").toPandas())
    if parts.empty:
        return None
    w = sum(np.frombuffer(b, np.float32).reshape(width, -1).astype(float) * n
            for b, n in sorted(zip(parts["weights"], parts["n"], strict=True), key=lambda p: bytes(p[0])))
    w /= parts["n"].sum()
    model = {"langs": langs, "idf": idf.astype(np.float32), "weights": w.astype(np.float32), "bits": bits,
             "temperature": 1.0}

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for pdf in batches:
            got = featured(pdf, letters)
            if got:
                yield pd.DataFrame({"y": [y for *_, y in got], "logits": [list(x @ w[at]) for at, x, _ in got]})

    held = sample.filter(kept).select("text", "lang").mapInPandas(logits, "y int, logits array<double>").toPandas()
    if len(held):
        order = np.lexsort(np.array(held["logits"].tolist()).T)
        model["temperature"] = best_temperature(np.array(held["logits"].tolist())[order], held["y"].to_numpy()[order])
    return model


def identify(text: str | None, model: dict, letters: np.ndarray) -> tuple[str, float]:
    counts = ngram_counts(text, letters, model["bits"])
    if counts is None:
        return UNKNOWN, 0.0
    at, x = tfidf(counts, model["idf"])
    p = softmax(x @ model["weights"][at] / model["temperature"])
    best = int(np.argmax(p))
    return model["langs"][best], float(p[best])


def predict_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                      parts: int = 5, part: int = 0, **limits) -> DataFrame:
    """(key, held_out, lang_pred, score) of every row; learnt from the rows not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang"))
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 31)).alias("draw")
    model = learn(rows.filter(~held_out(F.col("doc_id"), parts, part) & F.col("lang").isNotNull() &
                              F.col("text").isNotNull()).select("text", "lang", draw), **limits)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, known = letter_table(), shared.value
        for pdf in batches:
            got = [identify(t, known, letters) if known else (UNKNOWN, 0.0) for t in pdf.pop("text")]
            pdf["lang_pred"], pdf["score"] = [g[0] for g in got], [g[1] for g in got]
            yield pdf

    kind = docs.schema[key].dataType.simpleString()
    return (rows.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "text")
            .mapInPandas(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
            .withColumnRenamed("doc_id", key))
