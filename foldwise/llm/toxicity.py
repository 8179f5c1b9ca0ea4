"""Operator 5: toxicity by class-conditional Kneser-Ney models.

The models are character models of words (``^word$``, order ``ORDER``): one for the
words of toxic, one for those of ordinary labelled documents.  The highest order is
counted per class; what it discounts goes to a lower order that both classes share,
built from continuation counts (in how many different contexts a character was seen)
over both together.  A word's score is the difference of its two log-likelihoods per
character.  A text is scored by the mean difference over its words and by the largest mean over
a window of ``WINDOW`` words; a logistic fit on labelled rows that were not
counted turns both into a probability.

All labelled learning rows are counted but those of the logistic fit, which are one
document in ``CALIBRATION`` and at most about ``MAX_CALIBRATION``: words first (map-side), then the
character n-grams of distinct words.  The fitted log-ratios are a Spark table with one row
per n-gram, so it grows with the input and n-grams never share an entry.  Texts are scored
in chunks: the n-grams of the corpus's distinct words are joined with the table, and the words of
a chunk with their scores.

Edge cases: a null, empty or wordless text gets the features 0, 0 (about the base rate); several
labels of one id count as toxic if one does; null labels are ignored; with no learnable
label of one class every score is that of the base rate; repeated rows score equally;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foldwise.llm.common import Scratch
from foldwise.llm.langid import held_out
from foldwise.operators.joins import join_stats

ORDER, DISCOUNT = 6, 0.75
WINDOW = 6
CHUNK_DISTINCT = 300_000      # distinct words of texts that are scored together
CHUNK_WORDS = 8_000_000       # and their words at most
BLOCK = 4_096                 # words of a chunk that are stored in one row
CALIBRATION = 8               # one learning document in so many may be kept for the logistic fit
MAX_CALIBRATION = 20_000      # but at most about so many are; the others are counted
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 64                  # characters of a word that are modelled in one piece; longer words are cut into pieces


def words_of(text: str | None) -> list[str]:
    found = WORD.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def fit_ratios(words: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """Log-ratios (gram, r) from (word, toxic, n): of every n-gram seen, and of every context (with a
    control character before it) for characters that never followed it."""
    d = DISCOUNT
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    at = F.explode(F.sequence(F.lit(2), F.length("p")))
    grams = (words.select(padded.alias("p"), "toxic", "n").withColumn("i", at)
             .select(F.expr(f"substring(p, greatest(1, i - {order - 1}), least(i, {order}) - 1)").alias("ctx"),
                     F.expr("substring(p, i, 1)").alias("x"), "toxic", "n"))
    by = lambda v: F.sum(F.when(F.col("toxic") == v, F.col("n")).otherwise(0))
    grams = scratch.put(grams.groupBy("ctx", "x").agg(by(1).alias("t"), by(0).alias("o")), "grams")
    contexts = grams.groupBy("ctx").agg(F.sum("t").alias("tn"), F.sum("o").alias("on"),
                                        F.sum((F.col("t") > 0).cast("int")).alias("tk"),
                                        F.sum((F.col("o") > 0).cast("int")).alias("ok"))
    # shared lower orders: continuation counts over both classes (contexts of two, then of no characters)
    short = F.expr("right(ctx, 2)")
    pairs = grams.groupBy(short.alias("h"), "x").agg(F.count(F.lit(1)).alias("c"))
    heads = pairs.groupBy("h").agg(F.sum("c").alias("hc"), F.count(F.lit(1)).alias("hk"))
    singles = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("xc"))
    every = singles.agg(F.sum("xc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    # characters never seen keep a share, so no probability is zero
    base = (F.col("xc") + F.lit(0.5)) / F.lit(float(every["n"] or 0) + 0.5 * ((every["k"] or 0) + 1))
    shared = (pairs.join(heads, "h").join(singles, "x")
              .select("h", "x", ((F.col("c") - d) / F.col("hc") + F.col("hk") * d / F.col("hc") * base).alias("low")))
    back = lambda k, n: F.when(F.col(n) > 0, F.col(k) * d / F.col(n)).otherwise(1.0)
    own = lambda c, n: F.when(F.col(n) > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(n)).otherwise(0.0)
    seen = (grams.withColumn("h", short).join(shared, ["h", "x"]).join(contexts, "ctx")
            .select(F.concat("ctx", "x").alias("gram"),
                    F.log((own("t", "tn") + back("tk", "tn") * F.col("low"))
                          / (own("o", "on") + back("ok", "on") * F.col("low"))).alias("r")))
    unseen = contexts.select(F.concat(F.lit("\x01"), "ctx").alias("gram"),
                             F.log(back("tk", "tn") / back("ok", "on")).alias("r"))
    return scratch.put(seen.union(unseen).select("gram", "r"), "ratios")


def word_scores(words: DataFrame, ratios: DataFrame, n_ratios: int, scratch: Scratch, name: str, order: int = ORDER) -> DataFrame:
    """(word, score): the difference of its log-likelihoods per character, of distinct words, each named by its hash.

    Distinct n-grams meet the table first, so the many rows of all words are shuffled once for their
    n-grams and once for their sums."""
    p = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    rows = (words.withColumn("p", p).withColumn("i", F.explode(F.sequence(F.lit(2), F.length("p"))))
            .select(F.xxhash64("word").alias("word"), F.expr(f"substring(p, greatest(1, i - {order - 1}), least(i, {order}))").alias("gram")))
    grams = join_stats(rows.select("gram").distinct(), ratios, "gram", "left", n_ratios)
    # the character never followed: both classes back off (keys of grams that were found match nothing)
    context = F.when(F.col("r").isNull(), F.expr("concat('\x01', left(gram, length(gram) - 1))")).otherwise(
        F.concat(F.lit("\x02"), "gram"))
    grams = join_stats(grams.select("gram", "r", context.alias("context")),
                       ratios.select(F.col("gram").alias("context"), F.col("r").alias("back")), "context", "left", n_ratios)
    unit = float(1 << 32)                       # whole numbers, so the order of summation is of no account
    part = F.round(F.coalesce("r", "back", F.lit(0.0)) * unit).cast("long")
    grams = scratch.put(grams.select("gram", part.alias("part")), name)
    rows = join_stats(rows, grams, "gram", "inner", grams.count())
    return rows.groupBy("word").agg((F.sum("part") / F.count(F.lit(1)) / unit).alias("score"))


def packed(numbers: np.ndarray) -> bytes:
    """Word numbers, compressed; bytes of one place stand together, as the upper ones are mostly equal."""
    return zlib.compress(numbers.astype("<i4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def unpacked(cell: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cell), "u1").reshape(4, -1).T.copy().view("<i4").ravel()


def chunked(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (..., text) as word numbers, in chunks of about ``CHUNK_DISTINCT`` distinct words (``kind`` 0), beside rows (1) with
    blocks of the chunk's words: ``words[i]`` has the number ``first + i``."""
    rest = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, *T._parse_datatype_string("chunk long, numbers binary, words array<string>, first int, kind int")])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held = TaskContext.get().partitionId() << 32, 0, 0
        number: dict[str, int] = {}

        def batch(size: int, **columns) -> pa.RecordBatch:
            columns["chunk"] = pa.array([base + n] * size, pa.int64())
            columns["kind"] = pa.array([int("words" in columns)] * size, pa.int32())
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in arrow],
                                              schema=arrow)

        def close():
            words = list(number)
            for first in range(0, len(words), BLOCK):
                yield batch(1, words=pa.array([words[first:first + BLOCK]], pa.list_(pa.string())),
                            first=pa.array([first], pa.int32()))
            number.clear()

        for got in batches:
            found = []
            for text in got.column("text").to_pylist():
                words = words_of(text)
                held += len(words)
                found.append(packed(np.array([number.setdefault(w, len(number)) for w in words], "<i4")))
            yield batch(got.num_rows, numbers=pa.array(found, pa.binary()), **{f.name: got.column(f.name) for f in rest})
            if len(number) >= CHUNK_DISTINCT or held >= CHUNK_WORDS:
                yield from close()
                n, held = n + 1, 0
        if number:
            yield from close()

    return scratch.put(rows.mapInArrow(work, schema), name, by="kind")


def with_features(rows: DataFrame, ratios: DataFrame, n_ratios: int, scratch: Scratch, name: str,
                  done: tuple[str, ...] = ()) -> DataFrame:
    """Rows (..., text) with ``mean`` and ``most`` for the text; tables ``done`` go once the words are scored.  The words of every chunk are joined with
    their scores, so no task holds more of the model than its chunk needs."""
    rest = [f for f in rows.schema.fields if f.name != "text"]
    table = chunked(rows, scratch, f"{name}-chunks")
    words = (table.filter("kind = 1").select("chunk", "first", F.posexplode("words").alias("i", "word"))
             .select("chunk", "word", (F.col("first") + F.col("i")).alias("number")))
    scores = scratch.put(word_scores(words.select("word").distinct(), ratios, n_ratios, scratch, f"{name}-grams"), f"{name}-words")
    scratch.drop(f"{name}-grams", *done)
    words = words.select(F.col("chunk").alias("of"), F.xxhash64("word").alias("word"), "number")
    # number and score in one long, the score to 2^-24; written, so that the join's shuffle and the words can go first
    score = F.least(F.greatest(F.round(F.col("score") * float(1 << 24)), F.lit(-float(1 << 31))), F.lit(float((1 << 31) - 1)))
    pair = F.shiftleft(F.col("number").cast("long"), 32) + score.cast("long") + F.lit(1 << 31)
    known = join_stats(words, scores, "word", "inner", scores.count()).select("of", pair.alias("pair"))
    known = scratch.put(known, f"{name}-known")
    scratch.drop(f"{name}-chunks/kind=1", f"{name}-words")
    schema = T.StructType([*rest, *T._parse_datatype_string("mean double, most double")])
    arrow = to_arrow_schema(schema)

    def work(docs: pa.Table, parts: pa.Table) -> pa.Table:
        values, pairs = np.zeros(parts.num_rows), parts.column("pair").to_numpy()
        values[pairs >> 32] = ((pairs & 0xFFFFFFFF) - (1 << 31)) / (1 << 24)
        got = [text_features(values[unpacked(c)]) for c in docs.column("numbers").to_pylist()]
        columns = [docs.column(f.name) for f in rest] + [pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    docs = table.filter("kind = 0").select(*[f.name for f in rest], "chunk", "numbers")
    out = docs.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(work, schema)
    out = scratch.put(out, name)
    scratch.drop(f"{name}-chunks", f"{name}-known")
    return out


def text_features(v: np.ndarray) -> tuple[float, float]:
    """Mean of the word scores of a text, and the largest mean over ``WINDOW`` words."""
    if not len(v):
        return 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(v)])
    width = min(WINDOW, len(v))
    return float(v.mean()), float((sums[width:] - sums[:-width]).max() / width)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression with an intercept."""
    full = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - y) + ridge * w
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibration(rows: DataFrame) -> Column:
    """Which rows (doc_id) are kept for the logistic fit; all others are counted."""
    kept = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATION)) == 0
    n = rows.filter(kept).count()
    if n > MAX_CALIBRATION:
        part = int((1 << 31) * MAX_CALIBRATION / n)
        kept &= F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 31)) < part
    return kept


def learn(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, np.ndarray]:
    """(log-ratios by n-gram, their number, weights of the logistic fit) from rows (doc_id, text, toxic)."""
    kept = calibration(rows.select("doc_id"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush():
            for toxic, c in held.items():
                if c:
                    yield pd.DataFrame({"word": list(c), "toxic": [toxic] * len(c), "n": list(c.values())})
                    c.clear()

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                held[int(toxic)].update(words_of(text))
                if sum(map(len, held.values())) > 500_000:
                    yield from flush()
        yield from flush()

    words = (rows.filter(~kept).select("text", "toxic").mapInPandas(count, "word string, toxic int, n long")
             .groupBy("word", "toxic").agg(F.sum("n").alias("n")))
    words = scratch.put(words, "words")
    ratios = fit_ratios(words, scratch)
    scratch.drop("words", "grams")
    n_ratios, weights = ratios.count(), np.zeros(3)
    # bounded: about MAX_CALIBRATION rows
    got = with_features(rows.filter(kept).select("text", "toxic"), ratios, n_ratios, scratch, "calibration").toPandas()
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not (counts.get(0) and counts.get(1)):           # one class only: nothing to tell apart
        weights[0] = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    elif len(got):
        got = got.sort_values(["toxic", "mean", "most"])
        weights = logistic_fit(got[["mean", "most"]].to_numpy(), got["toxic"].to_numpy(float))
    return ratios, n_ratios, weights


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "toxic", parts: int = 4, part: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every row; labels are learnt from rows not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = (labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .filter(~held_out(F.col("doc_id"), parts, part)))
    scratch = Scratch(spark, "toxicity", tidy=True)
    marks = scratch.put(marks, "labels")
    learnt = join_stats(rows.filter(F.col("text").isNotNull()), marks, "doc_id", "inner", marks.count())
    ratios, n_ratios, weights = learn(learnt, scratch)
    rows = rows.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "text")
    got = with_features(rows, ratios, n_ratios, scratch, "features", ("ratios",))
    scratch.keep("features")
    base, mean, most = map(float, weights)
    z = F.lit(base) + F.col("mean") * mean + F.col("most") * most
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return (got.select(F.col("doc_id").alias(key), "held_out", score.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
