"""Operator 7: variable-capacity best-fit packing.

Documents are cut into pieces of at most the largest permitted length; pieces are
packed by best fit in descending order into sequences of several permitted
lengths.  When nothing open fits, the size with the least cost per unit that holds
the piece is opened; finished bins are downsized to the smallest permitted length that
holds their contents.  Which sizes may be opened is optimised jointly: every
non-empty subset is tried and the one with the least total cost after downsizing wins.

Best fit only sees lengths, so the driver packs the histogram of piece lengths (at
most one entry per length, whatever the number of documents): equal pieces meet
equal bins in bulk, which gives exactly the bins of piece-by-piece best fit.  The result is a
table of slots (length, rank range -> bins); pieces get a rank among those of
equal length by a two-step numbering and look their slot up, as Spark jobs.

Edge cases: a null or empty text is one piece of length 0 in no bin; repeated rows are
packed each; pieces that tie are ranked by id, text key and piece number; a null id is kept; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch, text_key

SIZES = (2048, 4096, 8192, 16384)      # permitted sequence lengths, in bytes of text
GAP = 1                                # end mark after each piece
OVERHEAD = 64                          # cost of a sequence beside its length
RANK_BUCKET = 50_000                   # pieces numbered in one task
MAX_SIZES = 6


def linear_cost(size: int) -> float:
    return size + OVERHEAD


class Bins:
    """Groups of equal bins: (count, capacity, contents), contents a linked list of
    (length, copies, before)."""

    def __init__(self, sizes: tuple[int, ...], opened: tuple[int, ...], cost: Callable[[int], float]):
        self.sizes = sizes
        self.opened = sorted(opened, key=lambda s: (cost(s) / s, s))
        self.by_room: dict[int, list] = {}
        self.rooms: list[int] = []

    def _put(self, room: int, group: tuple) -> None:
        if room not in self.by_room:
            insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append(group)

    def _take(self, room: int) -> tuple:
        groups = self.by_room[room]
        group = groups.pop()
        if not groups:
            del self.by_room[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return group

    def _size_for(self, length: int) -> int:
        return next((s for s in self.opened if s >= length), None) or next(s for s in self.sizes if s >= length)

    def add(self, length: int, n: int) -> None:
        """Place ``n`` pieces of one length: as best fit would, one after the other."""
        while n:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                count, size, held = self._take(room)
            else:
                size = room = self._size_for(length)
                count, held = -(-n // (room // length)), None
            each = room // length
            full = min(count, n // each)
            if full:
                self._put(room - each * length, (full, size, (length, each, held)))
                n -= full * each
                count -= full
            if count and n and n < each:
                self._put(room - n * length, (1, size, (length, n, held)))
                n, count = 0, count - 1
            if count and held is not None:
                self._put(room, (count, size, held))

    def groups(self) -> list[tuple[int, int, tuple]]:
        """(count, final size, contents), in a fixed order."""
        out = []
        for room in self.rooms:
            for count, size, held in self.by_room[room]:
                out.append((count, next(s for s in self.sizes if s >= size - room), held))
        return out


def pack_histogram(histogram: dict[int, int], sizes: tuple[int, ...],
                   cost: Callable[[int], float] = linear_cost) -> list[tuple[int, int, tuple]]:
    """The cheapest groups of bins over all subsets of sizes that may be opened."""
    sizes = tuple(sorted(set(sizes)))
    if len(sizes) > MAX_SIZES:
        raise ValueError(f"at most {MAX_SIZES} sizes")
    best = None
    for k in range(1, len(sizes) + 1):
        for opened in combinations(sizes, k):
            bins = Bins(sizes, opened, cost)
            for length in sorted(histogram, reverse=True):
                bins.add(length, histogram[length])
            groups = bins.groups()
            total = sum(count * cost(size) for count, size, _ in groups)
            if best is None or total < best[0] - 1e-9:
                best = (total, groups)
    return best[1]


def slot_table(groups: list) -> pd.DataFrame:
    """Slots by (length, first rank): bins from ``bin`` on, ``each`` pieces in a bin."""
    rows, rank, base = [], {}, 0
    for count, size, held in groups:
        chain = []
        while held is not None:
            chain.append(held[:2])
            held = held[2]
        at = 0
        for length, each in reversed(chain):
            first = rank.get(length, 0)
            rows.append((length, first, each, base, at, size))
            rank[length] = first + count * each
            at += length * each
        base += count
    return pd.DataFrame(rows, columns=["length", "first", "each", "bin", "at", "size"]).sort_values(
        ["length", "first"], ignore_index=True)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES,
                   gap: int = GAP, cost: Callable[[int], float] = linear_cost) -> DataFrame:
    """One row per piece: (key, piece, start, length, bin_id, bin_size, bin_offset)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    most = max(sizes) - gap
    n_bytes = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    whole = docs.select(F.col(key).alias("doc_id"), *text_key(F.col(text)), n_bytes.alias("n_bytes"))
    pieces = (whole.withColumn("piece", F.explode(F.sequence(
                  F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.expr(f"(n_bytes - 1) div {most}")))))
              .select("doc_id", "k1", "k2", "piece", (F.col("piece") * most).alias("start"),
                      F.least(F.col("n_bytes") - F.col("piece") * most, F.lit(most)).cast("bigint").alias("length")))
    pieces = scratch.put(pieces, "pieces")
    filled = pieces.filter("length > 0")
    # bounded: one row per length
    counts = filled.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    histogram = {int(x) + gap: int(n) for x, n in zip(counts["length"], counts["n"], strict=True)}
    groups = pack_histogram(histogram, sizes, cost) if histogram else []
    slots = spark.sparkContext.broadcast({c: v.to_numpy(np.int64) for c, v in slot_table(groups).items()})
    # rank among the pieces of a length; a frequent length is numbered in several tasks
    per = {x - gap: -(-n // RANK_BUCKET) for x, n in histogram.items() if n > RANK_BUCKET}
    split = F.lit(1).cast("bigint")
    if per:
        table = F.create_map(*[F.lit(v).cast("bigint") for pair in per.items() for v in pair])
        split = F.coalesce(F.try_element_at(table, F.col("length")), split)
    filled = filled.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k1", "k2", "piece"), split))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (filled.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "k1", "k2", "piece")
    ranked = (filled.join(offsets, ["length", "bucket"])
              .withColumn("rank", F.col("offset") + F.row_number().over(inside) - 1))

    @F.pandas_udf("bin_id long, bin_size long, bin_offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, x, r = slots.value, length.to_numpy() + gap, rank.to_numpy()
        at = np.searchsorted(s["length"] * (1 << 40) + s["first"], x * (1 << 40) + r, side="right") - 1
        nth = r - s["first"][at]
        return pd.DataFrame({"bin_id": s["bin"][at] + nth // s["each"][at], "bin_size": s["size"][at],
                             "bin_offset": s["at"][at] + nth % s["each"][at] * x})

    placed = ranked.withColumn("slot", place("length", "rank"))
    none = F.lit(None).cast("long")
    return placed.select(F.col("doc_id").alias(key), "piece", "start", "length", "slot.*").union(
        pieces.filter("length = 0").select(F.col("doc_id").alias(key), "piece", "start", "length", none, none, none))
