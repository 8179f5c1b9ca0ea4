"""Operator 3: quality rules with cross-document line frequency.

Base rules look at one text: fewer than ``min_words`` words, or more than half
of the words inside repeated three-word windows, fail it.  The cross-document
rule hashes normalised lines (lower case, blanks collapsed) of every length (of at most
``max_line_words`` words, if that is given), counts the distinct documents of a host that hold each
line, removes lines above the limit, and rejects documents that keep less than
``min_left`` of their words.

A line is above the limit when it is in more than ``min_docs`` distinct
documents and in more than ``max_share`` of its host's distinct documents.
Exact copies are one document, so a copied text is not boilerplate for being
copied.

Edge cases: a null text has no words (it fails the base rules); a null host is a
host of its own; repeated rows get equal results; ties do not arise; an empty
table gives an empty result; other input columns are ignored (operator) or
returned unchanged (``clean_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch, text_key
from foldwise.operators.joins import join_stats

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.01, 0.5

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
LINES = "lines array<struct<line:long,words:int,times:int>>"


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v = len(codes)
    if v == n:
        return 0
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    pair = ids[:-1] * v + ids[1:]
    if v > 2_000_000:                       # keep the three-word key inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * v + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[at + shift] = True
    return int(inside.sum())


def base_stats(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()                     # splits at exactly the six blanks
    n = len(words)
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    repeat = repeated_words(words)
    return (n, len(text or "") - (len(raw) - sum(map(len, words))), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n)


def line_hash(line: str) -> tuple[int, int]:
    """(hash of the normalised line, its words)."""
    words = line.lower().encode("utf-8", "surrogatepass").split()
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63), len(words)


def line_counts(text: str | None, max_line_words: int | None = None) -> list[tuple[int, int, int]]:
    """(hash, words, times) of each different line with words."""
    found: dict[int, list[int]] = {}
    for line in (text or "").split("\n"):
        h, n = line_hash(line)
        if n and (max_line_words is None or n <= max_line_words):
            found.setdefault(h, [n, 0])[1] += 1
    return [(h, n, times) for h, (n, times) in found.items()]


def rule_tables(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
                max_line_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per document: statistics and lines; per (host, text): the lines to remove.

    Both are keyed by (host, k1, k2), as equal texts of a host share their fate."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = docs.select(F.col(key).alias("doc_id"), F.concat(F.lit("="), F.col(host).cast("string")).alias("host"),
                       *text_key(F.col(text)), F.col(text).alias("text"))
    rows = rows.withColumn("host", F.coalesce("host", F.lit("")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf.pop("text")]
            stats = pd.DataFrame([base_stats(t) for t in texts], columns=[x.split()[0] for x in STATS.split(", ")])
            out = pd.concat([pdf.reset_index(drop=True), stats], axis=1)
            out["lines"] = [[{"line": h, "words": n, "times": k} for h, n, k in line_counts(t, max_line_words)]
                            for t in texts]
            yield out

    kind = docs.schema[key].dataType.simpleString()
    table = scratch.put(rows.mapInPandas(
        measure, f"doc_id {kind}, host string, k1 long, k2 long, {STATS}, {LINES}"), "stats")
    # one row per distinct document of a host; a line is in it once
    lines = (table.groupBy("host", "k1", "k2").agg(F.first("lines").alias("lines"))
             .select("host", "k1", "k2", F.inline("lines")))
    sizes = table.select("host", "k1", "k2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = (lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs)
                .join(sizes, "host").filter(F.col("docs") > F.col("host_docs") * max_share)
                .select("host", "line"))
    frequent = scratch.put(frequent, "frequent")
    removed = (join_stats(lines, frequent, ["host", "line"], "inner", frequent.count())
               .groupBy("host", "k1", "k2")
               .agg(F.sum(F.col("words") * F.col("times")).alias("removed_words"), F.collect_set("line").alias("drop")))
    return table.drop("lines"), scratch.put(removed, "removed")


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                     min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """One row per document: base statistics, ``removed_words`` and ``kept``."""
    table, removed = rule_tables(docs, key, text, host, **limits)
    gone = F.coalesce("removed_words", F.lit(0))
    return (table.join(removed.drop("drop"), ["host", "k1", "k2"], "left")
            .select(F.col("doc_id").alias(key), *[x.split()[0] for x in STATS.split(", ")],
                    gone.alias("removed_words"),
                    (~F.col("base_failed") & (F.col("n_words") - gone >= F.col("n_words") * min_left)).alias("kept")))


def without_lines(text: str | None, drop) -> str | None:
    bad = set(map(int, drop))
    return "\n".join(x for x in text.split("\n") if line_hash(x)[0] not in bad)


def clean_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                    min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """The kept documents without their frequent lines, with the input's columns."""
    table, removed = rule_tables(docs, key, text, host, **limits)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"),
                        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"),
                        *text_key(F.col(text)))
    passed = (table.groupBy("host", "k1", "k2").agg(F.first("n_words").alias("n_words"),
                                                    F.first("base_failed").alias("base_failed"))
              .join(removed, ["host", "k1", "k2"], "left")
              .filter(~F.col("base_failed") &
                      (F.col("n_words") - F.coalesce("removed_words", F.lit(0)) >= F.col("n_words") * min_left))
              .select("host", "k1", "k2", "drop"))
    passed = Scratch(docs.sparkSession, "quality").put(passed, "passed")

    @F.pandas_udf("string")
    def stripped(texts: pd.Series, drops: pd.Series) -> pd.Series:
        return pd.Series([t if d is None or not isinstance(t, str) else without_lines(t, d)
                          for t, d in zip(texts, drops, strict=True)])

    kept = keyed.join(passed, ["host", "k1", "k2"])
    return kept.select(*[stripped(F.col("doc")[c], F.col("drop")).alias(c) if c == text else F.col("doc")[c].alias(c)
                         for c in docs.columns])
