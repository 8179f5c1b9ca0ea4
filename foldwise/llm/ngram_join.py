"""Operator 2: n-gram Jaccard self-join by MinHash banding.

Texts are sets of word n-grams (five lower-case words; a shorter text is one
n-gram).  Signatures of ``bands x rows`` minimum hashes are cut into bands; the
number of bands follows from the rows per band, the threshold and the target
recall (0.999 at similarity 0.8: 38 bands of 8 rows).  Texts that share a band
hash are candidates; every reported link is verified on the full n-gram sets.

Texts with equal n-gram sets are one node, so copies never meet pairwise.  Small
buckets list their candidate pairs.  Buckets above ``dense`` nodes hold texts that
are alike in all rows of a band; overlapping ones are merged into dense groups, whose
nodes are cut into blocks, and every pair of blocks is one task that counts the
common n-grams of all its pairs by a matrix product: pairs are counted, never
emitted, and no task holds a whole group.  All links count, none is sampled.

Nodes are keyed by a 64-bit hash of their n-gram set.

Edge cases: a null or blank text has no n-grams and no links, and is its own class
(blank copies too); equal texts share a class without counting as links; repeated
rows are copies; a null id joins a class like any other, and the class id is the
least non-null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch, partitions, text_key
from foldwise.llm.components import connected_components
from foldwise.operators.joins import join_stats

WORDS, THRESHOLD = 5, 0.8
ROWS, RECALL = 8, 0.999
DENSE = 32                    # bucket size from which nodes are compared block by block
BLOCK_NODES, BLOCK_BYTES = 2048, 16 << 20


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Fewest bands with 1 - (1 - threshold^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


class WordHash(dict):
    """Word -> 64-bit hash, remembered for at most ``room`` words."""

    def __init__(self, room: int = 200_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def ngram_set(text: str | None, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    tokens = (text or "").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - width + 1 + j]
    return np.unique(mix(out))


def hash_family(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return (draw.integers(0, 1 << 32, count, np.uint32) | np.uint32(1),
            draw.integers(0, 1 << 32, count, np.uint32))


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of a*x + b (mod 2^32) over the set, for each of the hash functions."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        part = low[None, at:at + 1024] * a[:, None]
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    table = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(table), dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + table[:, j])
    return h.view(np.int64)


def set_node(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs (doc_id, k1, k2, text) -> (doc_id, k1, k2, node, grams, bands)."""
    a, b = hash_family(bands * rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHash()
        for pdf in batches:
            sets = [ngram_set(t if isinstance(t, str) else None, n, words) for t in pdf.pop("text")]
            pdf["node"] = [set_node(s) for s in sets]
            pdf["grams"] = [len(s) for s in sets]
            pdf["bands"] = [band_hashes(signature(s, a, b), rows) if len(s) else [] for s in sets]
            yield pdf

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(work, f"doc_id {kind}, k1 long, k2 long, node long, grams long, bands array<long>")


def _gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs (node, text) -> (node, grams binary: sorted 64-bit hashes)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHash()
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"],
                                "set": [ngram_set(t, n, words).tobytes() for t in pdf["text"]]})

    return docs.mapInPandas(work, "node long, set binary")


def overlap(a: bytes, b: bytes) -> int:
    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def common_counts(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """|x & y| for every x of ``left`` and y of ``right``: products of 0/1 matrices
    over the n-grams that occur on both sides, in column chunks."""
    lrow = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rrow = np.repeat(np.arange(len(right)), [len(x) for x in right])
    lval, rval = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lval, rval)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return total

    def columns(val, row):
        at = np.searchsorted(shared, val)
        at[at == len(shared)] = 0
        ok = shared[at] == val
        at, row = at[ok], row[ok]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    (lat, lrow), (rat, rrow) = columns(lval, lrow), columns(rval, rrow)
    for c in range(0, len(shared), chunk):
        size = min(chunk, len(shared) - c)
        parts = []
        for at, row, count in ((lat, lrow, len(left)), (rat, rrow, len(right))):
            lo, hi = np.searchsorted(at, [c, c + size])
            m = np.zeros((count, size), np.float32)
            m[row[lo:hi], at[lo:hi] - c] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bipartite (or square) link matrix, row by row."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    out = []
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(links.any(axis=1)):
        row = links[i]
        own = int(left[i])
        twin = seen.setdefault(np.packbits(row).tobytes(), own)
        if twin != own:                 # the same links as an earlier row: one edge joins both
            row = np.zeros_like(row)
            row[np.flatnonzero(links[i])[0]] = True
        for j in np.flatnonzero(row):
            other = int(right[j])
            x, y = root(own), root(other)
            if x != y:
                parent[x] = y
                out.append((max(own, other), min(own, other)))
    return out


def _tile(threshold: float):
    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[1], key[2]
        sides = [pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        ids = [s["node"].to_numpy() for s in sides]
        weights = [s["texts"].to_numpy() for s in sides]
        sets = [[np.frombuffer(x, np.uint64) for x in s["set"]] for s in sides]
        sizes = [np.array([len(x) for x in s], np.float64) for s in sets]
        rows = []
        common = common_counts(sets[0], sets[1])
        for at in range(0, len(ids[0]), 512):               # bounds the working copies
            part = common[at:at + 512].astype(np.float64)
            union = sizes[0][at:at + 512, None] + sizes[1][None, :] - part
            links = part >= threshold * union - 1e-9
            links &= ids[0][at:at + 512, None] != ids[1][None, :]
            rows.append(links)
        links = np.concatenate(rows)
        out = [(int(i), 0, int(n)) for i, n in zip(ids[0], links @ weights[1], strict=True) if n]
        if lo != hi:
            out += [(int(i), 0, int(n)) for i, n in zip(ids[1], links.T @ weights[0], strict=True) if n]
        edges = [(a, b, 0) for a, b in spanning(links, ids[0], ids[1])]
        return pd.DataFrame(out + edges, columns=["a", "b", "n"])
    return work


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS,
                  threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL,
                  dense: int = DENSE) -> DataFrame:
    """One row per document: (doc_id, k1, k2, class_id, n_links).  ``n_links`` counts the
    different texts with similarity >= threshold; classes are the components of these links."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("doc_id"), *text_key(F.col(text)), F.col(text).alias("text"))
    signed = scratch.put(_signed(slim, n, bands_for(threshold, rows, recall), rows), "signed")
    filled = signed.filter("grams > 0")
    # nodes: texts by n-gram set; a representative text key and the number of different texts
    texts = filled.groupBy("node", "k1", "k2").agg(F.first("grams").alias("grams"))
    nodes = scratch.put(texts.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("key"), F.first("grams").alias("grams"),
                                                  F.count(F.lit(1)).alias("texts"))
                        .select("node", "key.k1", "key.k2", "grams", "texts"), "nodes")
    hashes = (filled.groupBy("node").agg(F.first("bands").alias("bands"))
              .select("node", F.explode("bands").alias("band")))
    hashes = scratch.put(hashes, "hashes")
    buckets = (hashes.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"))
               .filter("size > 1"))
    members = scratch.put(hashes.join(scratch.put(buckets, "buckets"), "band"), "members")
    scratch.drop("hashes", "buckets")
    # candidate pairs of small buckets; dense groups from the large ones
    small = members.filter(F.col("size") <= dense).select("band", "node")
    pairs = (small.withColumnRenamed("node", "a").join(small.withColumnRenamed("node", "b"), "band")
             .filter("a > b").groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_"))
    large = members.filter((F.col("size") > dense) & (F.col("node") != F.col("hub")))
    groups = scratch.put(connected_components(large.select(F.col("node").alias("a"), F.col("hub").alias("b")),
                                              scratch, "groups"), "groups")
    group = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    pairs = scratch.put(pairs.join(group("a"), "a", "left").join(group("b"), "b", "left")
                        .filter("a_root is null or b_root is null or a_root != b_root").select("a", "b"), "pairs")
    scratch.drop("members")
    # full n-gram sets of the candidates, from one text each
    wanted = (pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(groups.select("node")).distinct()
              .join(nodes, "node").select("node", "k1", "k2"))
    wanted = scratch.put(wanted, "wanted")
    found = join_stats(slim.select("k1", "k2", "text"), wanted, ["k1", "k2"], "inner", wanted.count())
    sets = scratch.put(_gram_sets(found.groupBy("node").agg(F.first("text").alias("text")), n), "sets")

    @F.pandas_udf("long")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([overlap(p, q) for p, q in zip(x, y, strict=True)])

    of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("common", common("set_a", "set_b"))
    size = (F.octet_length("set_a") + F.octet_length("set_b")) / 8 - F.col("common")
    verified = scratch.put(both.filter(F.col("common") >= size * threshold - 1e-9).select("a", "b"), "verified")
    # dense groups: blocks of bounded size, one task per pair of blocks
    inside = groups.join(nodes, "node").select("root", "node", "grams", "texts")
    cuts = inside.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES,
                                                        F.sum("grams") * 8 / BLOCK_BYTES)).alias("blocks"))
    tiles = (inside.join(cuts, "root")
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .select("root", "node", "texts", "block", F.least("block", "other").alias("lo"),
                     F.greatest("block", "other").alias("hi")).join(sets, "node"))
    # little data, much work: as many tasks as asked for
    tiles = tiles.repartition(partitions(spark), "root", "lo", "hi")
    counted = scratch.put(tiles.groupBy("root", "lo", "hi").applyInPandas(_tile(threshold), "a long, b long, n long"),
                          "counted")
    weight = lambda c: nodes.select(F.col("node").alias(c), F.col("texts").alias("n"))
    links = (counted.filter("n > 0").select(F.col("a").alias("node"), "n")
             .union(verified.join(weight("b"), "b").select("a", "n"))
             .union(verified.join(weight("a"), "a").select("b", "n"))
             .groupBy("node").agg(F.sum("n").alias("n")))
    edges = counted.filter("n = 0").select("a", "b").union(verified)
    roots = connected_components(edges, scratch, "classes")
    labels = (nodes.select("node", "texts").join(links, "node", "left").join(roots, "node", "left")
              .select("node", (F.coalesce("n", F.lit(0)) + F.col("texts") - 1).alias("n_links"),
                      F.coalesce("root", "node").alias("root")))
    # written first, so that the joins deal both sides anew and Spark can split copies of one text
    labels = scratch.put(labels, "labels")
    labelled = scratch.put(signed.select("doc_id", "k1", "k2", "node", "grams").join(labels, "node", "left"), "labelled")
    names = scratch.put(labelled.filter("grams > 0").groupBy("root").agg(F.min("doc_id").alias("class_id")), "names")
    scratch.keep("labelled", "names")
    out = labelled.join(names, "root", "left")
    return out.select("doc_id", "k1", "k2",
                      F.coalesce("class_id", F.when(F.col("grams") == 0, F.col("doc_id"))).cast(kind).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.when(F.col("grams") > 0, F.col("root")).alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One document of each class: the least (id, text key); blank texts all stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    found = similar_texts(docs, key, text, **limits)
    best = (found.filter("root is not null").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2")).alias("m"))
            .select("m.doc_id", "m.k1", "m.k2", F.lit(1).alias("rows")))
    best = scratch.put(best, "best")
    bare = scratch.put(found.filter("root is null").select("k1", "k2").distinct(), "bare")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("id"), *text_key(F.col(text)))
    same = (F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")))
    best = best.withColumnRenamed("k1", "b1").withColumnRenamed("k2", "b2")
    kept = scratch.put(keyed.join(best, same, "inner").select("doc", "id", "k1", "k2"), "kept")
    # rows that repeat both id and text: one of them
    again = kept.groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "k1", "k2")
    again = scratch.put(again, "again")
    if again.isEmpty():
        rows = kept
    else:
        on = (F.col("id").eqNullSafe(F.col("i")) & (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")))
        marks = again.select(F.col("id").alias("i"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
        rows = kept.join(marks, on, "left_anti").select("doc", "id", "k1", "k2").union(
            kept.join(marks, on, "left_semi").dropDuplicates(["id", "k1", "k2"]))
    blank = join_stats(keyed, bare, ["k1", "k2"], "left_semi", bare.count())
    return rows.select("doc.*").union(blank.select("doc.*"))
