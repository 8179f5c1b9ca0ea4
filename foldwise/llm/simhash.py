"""Operator 12: SimHash near-duplicate classes by bit-sliced comparison.

A text's fingerprint has bit b set if more than half of the XXH64 hashes of its 4-word shingles
(repeats included) have it.  Fingerprints that differ in at most ``radius`` = 4 bits are linked, and a
document's component is the least id that links reach.

Equal fingerprints are one node.  The 64 bits are cut into m fields; two linked fingerprints agree
in at least m - 4 of them, so a row per choice of m - 4 fields, dealt by the bits of these fields, puts
every linked pair into a common group.  m, and how many of the fields' bits deal the rows, follow
from the counted nodes so that a group has about ``GROUP`` of them; fewer bits only add comparisons.
Groups above ``BLOCK`` nodes (near copies by the thousand) are cut into blocks, and each pair of blocks
is one task, so no task holds more than two blocks.

Inside a task all pairs are compared.  The bits are stored as vertical planes, 64 fingerprints to a
machine word.  For a strip of queries the planes are added, three at a time, to carry-save counters
of 0 to 4 with a sticky bit for more; words in which every lane has passed the radius are abandoned
and only the others go on to the next planes.  A task returns a spanning forest of its links, at
most one row per node: classes need no more, and no list of pairs is ever made.

Edge cases: null and blank texts have fingerprint zero, linked like any other; a text of fewer than
four words is one shingle; repeated rows and copies share a fingerprint; a null id joins a class,
and the component is its least non-null id (null if there is none); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch, partitions
from foldwise.llm.components import connected_components
from foldwise.operators.joins import join_stats

SHINGLE, SEED, RADIUS = 4, 42, 4
GROUP = 2048                     # nodes of a group to aim for
BLOCK = 1 << 14                  # nodes of a block: 1 MB of planes and counters per strip of queries
STRIP = 64                       # queries compared at once
HASHES = 1 << 14                 # shingle hashes whose bits are added at once


def fingerprint(text: str | None) -> int:
    """64 bits; bit b is set if over half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, digest = memoryview(flat), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in
                          zip(starts[:1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())),
                         np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at:at + HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp long)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fp long")


def fields_for(nodes: int, radius: int = RADIUS, group: int = GROUP) -> tuple[list[tuple[int, int]], int, int]:
    """(fields as (low bit, width), fields that must agree, bits that deal the rows)."""
    want = max(0, ceil(log2(max(nodes, 1) / group)))
    for m in range(radius + 1, 2 * radius + 1):
        agree = m - radius
        cuts = [64 * i // m for i in range(m + 1)]
        fields = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        least = sum(sorted(w for _, w in fields)[:agree])
        if want <= least:
            break
    return fields, agree, min(want, least)


def _dealt(nodes: DataFrame, count: int, radius: int, group: int) -> DataFrame:
    """(table, key, fp): every node once per choice of agreeing fields, keyed by their first bits."""
    fields, agree, bits = fields_for(count, radius, group)
    keys = []
    for table, chosen in enumerate(combinations(fields, agree)):
        key, room = F.lit(0).cast("long"), bits
        for low, width in chosen:
            take = min(width, room)
            room -= take
            if take:
                part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << take) - 1))
                key = F.shiftleft(key, take).bitwiseOR(part)
        keys.append(F.struct(F.lit(table).alias("table"), key.alias("key")))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("t")).select("t.table", "t.key", "fp")


# ---- bit-sliced comparison ----------------------------------------------------------------------

def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of all fingerprints, 64 to a word; lanes beyond the end are zero."""
    words = max(1, -(-len(fps) // 64))
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_lanes(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query number, lane) of all pairs within ``radius`` (4 at most; lanes beyond the end may be among them).

    ``one``, ``two``, ``four`` count differing bits of 64 lanes at once, ``over`` stays set once a count
    passes the radius; it is set before a counter of three bits could overflow."""
    words = planes.shape[1]
    query = np.repeat(np.arange(len(queries)), words)
    word = np.tile(np.arange(words), len(queries))
    one = np.zeros(len(query), np.uint64)
    two, four, over = one.copy(), one.copy(), one.copy()
    full = ~np.uint64(0)
    for b in range(0, 64, 3):
        x, y, z = (planes[c][word] ^ (np.uint64(0) - ((queries >> np.uint64(c)) & np.uint64(1)))[query]
                   if c < 64 else np.zeros(len(word), np.uint64) for c in (b, b + 1, b + 2))
        low = x ^ y
        total, carry = low ^ z, (x & y) | (low & z)             # three planes to a sum and a carry
        into_two = one & total
        one ^= total
        low = two ^ carry
        into_four = (two & carry) | (low & into_two)
        two = low ^ into_two
        four ^= into_four
        passed = four & (one | two) if radius == 4 else _above(one, two, four, radius)
        over |= passed
        if b % 12 == 9:
            live = over != full
            if not live.all():
                query, word = query[live], word[live]
                one, two, four, over = one[live], two[live], four[live], over[live]
                if not len(word):
                    break
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(near)
    return query[at], word[at] * 64 + lane


def _above(one, two, four, radius: int):
    """Lanes whose count is above a radius of 0 to 3."""
    return [one | two | four, two | four, four | (one & two), four][radius]


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """(edges, 2): a spanning forest of the links inside ``left``, or between ``left`` and ``right``."""
    lanes = left if right is None else right
    planes = planes_of(lanes)
    names = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    parent = np.arange(len(names))
    edges = []
    for at in range(0, len(left), STRIP):
        skip = 0 if right is not None else at // 64              # lanes before the strip were queries already
        q, lane = near_lanes(left[at:at + STRIP], planes[:, skip:], radius)
        q, lane = q + at, lane + skip * 64
        ok = (lane < len(lanes)) & ((lane > q) if right is None else True)
        q, lane = q[ok], lane[ok] + shift
        roots = parent[q] != parent[lane]                        # most links of a large class are known by now
        for i, j in zip(q[roots].tolist(), lane[roots].tolist()):
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
        if len(q):
            while True:                                          # every node points at its root
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return names[np.array(edges, np.int64).reshape(-1, 2)]


def _links(dealt: DataFrame, scratch: Scratch, radius: int, block: int) -> DataFrame:
    """Spanning links (a, b) of all groups."""
    spark = dealt.sparkSession
    sizes = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = scratch.put(sizes, "sizes")
    rows = join_stats(dealt, sizes, ["table", "key"], "inner", sizes.count())
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1),
                         lambda i: F.struct(F.least(i, mine).alias("lo"), F.greatest(i, mine).alias("hi")))
    rows = rows.select("table", "key", "fp", mine.alias("block"), F.explode(others).alias("p"))
    rows = rows.select("table", "key", "fp", "block", "p.lo", "p.hi")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        fps, of = pdf["fp"].to_numpy().view(np.uint64), pdf["block"].to_numpy()
        pairs = forest(fps[of == lo], None if lo == hi else fps[of == hi], radius)
        return pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)})

    found = (rows.repartition(partitions(spark), "table", "key", "lo", "hi")
             .groupBy("table", "key", "lo", "hi").applyInPandas(work, "a long, b long"))
    return found.distinct()


def simhash_classes(docs: DataFrame, radius: int = RADIUS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint, component_id)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(_fingerprints(docs), "prints")
    nodes = scratch.put(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = scratch.put(_links(_dealt(nodes.select("fp"), nodes.count(), radius, group), scratch, radius, block), "links")
    roots = scratch.put(connected_components(links, scratch), "roots")
    members = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    names = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.put(members.join(names, "root").select("fp", "component_id"), "named")
    everyone = (nodes.join(named, "fp", "left")
                .select("fp", F.coalesce("component_id", "least").alias("component_id")))
    everyone = scratch.put(everyone, "everyone")
    scratch.keep("prints", "everyone")
    out = join_stats(prints, everyone, "fp", "inner", everyone.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
