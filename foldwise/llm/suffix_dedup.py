"""Operator 1: exact substring dedup with suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is found,
over all texts, without ever sorting the whole corpus in one place:

1. Every window of ``LENGTH`` bytes names its anchor: the ``CORE``-byte substring with the
   least hash (leftmost on ties).  Equal windows name equal anchors at equal
   distances.  Consecutive windows with one anchor make a piece (their bytes).
2. Anchors that occur once hold no repeated window.  Equal pieces, counted over
   all texts, are repeated throughout.
   Pieces that repeat inside one text (long runs) become one row with a count first.
3. Left are single pieces that share their anchor with different pieces (about
   a twentieth of the text).  The pieces of one anchor are suffix-sorted together
   (``suffix_sort``; the shared core is one symbol), and two windows are equal if and only
   if they are next to each other among equal ones in the suffix array; neighbours are compared in full.
   Anchors with more than ``PIECES`` different pieces get a second anchor: the substring of
   a quarter of the bytes around the core with the least hash.  Windows of a piece that
   name the same one stay together as a smaller piece, so equal windows meet again, and
   the smaller pieces are counted and told apart as in 2 and 3, in ``ROUNDS`` rounds with
   a new hash each.  What is still too much after the last round is counted window by
   window, by a 128-bit hash.

Texts are keyed by 128 bits and pieces by two independent 64-bit hashes; equal
texts are one text with a count.  The longest state of a task is one text or one block.

Edge cases: null and empty texts have 0 bytes and no spans; texts shorter than ``LENGTH``
are never touched; a repeated row of at least that length is removed wholly;
self-overlapping repeats (one character, many times) count; an empty table gives
an empty result; other columns are ignored (``remove_repeats`` returns them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch, partitions, text_key
from foldwise.llm.ngram_join import mix
from foldwise.llm.suffix_sort import suffix_arrays
from foldwise.operators.joins import join_stats

LENGTH, CORE = 400, 256
PIECES = 512                  # different pieces of one anchor that are sorted together
ROUNDS = 3                    # further anchors that a crowded anchor's pieces are dealt by
BLOCK_PIECES = 1500           # pieces a task sorts side by side
CHUNK = 1 << 19               # windows of one text handled at a time (positions fit 20 bits)


class Rolling:
    """Hashes of substrings from prefix sums of byte codes times powers, modulo 2^64."""

    def __init__(self, room: int, seed: int):
        draw = np.random.default_rng(seed)
        self.codes = draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(draw.integers(0, 1 << 61)) * 8 + 5
        self.up, self.down = (np.full(room + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.codes[raw] * self.up[:len(raw)], out=out[1:])
        return out


class Anchors:
    def __init__(self, length: int, core: int):
        self.length, self.core, self.width = length, core, length - core + 1
        self.rolls = None

    def of(self, raw: bytes) -> tuple[np.ndarray, ...]:
        """(anchor hash, piece hash, first window, last window, anchor position) of every piece."""
        parts = [self._chunk(np.frombuffer(raw, np.uint8, min(CHUNK + self.length - 1, len(raw) - at), at), at)
                 for at in range(0, len(raw) - self.length + 1, CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _chunk(self, raw: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n, k, w = len(raw), self.core, self.width
        if self.rolls is None or len(self.rolls[0].up) <= n:
            room = min(max(2 * n, 1 << 17), CHUNK + self.length)
            self.rolls = Rolling(room, 11), Rolling(room, 12)
        first, second = self.rolls
        sums = first.sums(raw)
        cores = mix((sums[k:] - sums[:-k]) * first.down[:n - k + 1])
        low = np.uint64((1 << 20) - 1)
        # sliding minimum: of every block's prefixes and suffixes; the position breaks ties
        keyed = np.full(-(-len(cores) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        keyed[:len(cores)] = (cores & ~low) | np.arange(len(cores), dtype=np.uint64)
        blocks = keyed.reshape(-1, w)
        heads = np.minimum.accumulate(blocks, axis=1).ravel()
        tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - self.length + 1
        least = (np.minimum(tails[:windows], heads[w - 1:w - 1 + windows]) & low).astype(np.int64)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo, hi = np.append(0, cut), np.append(cut, windows) - 1
        anchor = least[lo]
        sums = second.sums(raw)
        pieces = mix(mix((sums[hi + self.length] - sums[lo]) * second.down[lo])
                     + ((hi - lo) << 20 | (anchor - lo)).astype(np.uint64))
        return cores[anchor].view(np.int64), pieces.view(np.int64), lo + at, hi + at, anchor + at


def once(h, p, lo, hi, at, length: int) -> tuple:
    """Each different piece of a text once, with its count; and the spans of those that repeat."""
    order = np.lexsort((lo, p, h))
    new = np.append(True, (h[order[1:]] != h[order[:-1]]) | (p[order[1:]] != p[order[:-1]]))
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    if len(first) == len(order):
        return h, p, lo, hi, at, np.ones(len(h), np.int64), [], []
    twice = order[np.repeat(times > 1, times)]
    keep = order[first]
    own = merge_spans(lo[twice], hi[twice] + length)
    return h[keep], p[keep], lo[keep], hi[keep], at[keep], times, own[::2], np.array(own[1::2]) - length


def _anchor_rows(texts: DataFrame, length: int, core: int) -> DataFrame:
    names = ("h", "p", "lo", "hi", "at", "times", "own_lo", "own_hi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, core)
        for batch in batches:
            found = [once(*anchors.of(x.as_buffer().to_pybytes()), length) for x in batch.column("text")]
            lists = []
            for i in range(len(names)):
                offsets = pa.array(np.cumsum([0, *(len(x[i]) for x in found)]), pa.int32())
                values = np.concatenate([np.asarray(x[i], np.int64) for x in found]) if found else []
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *lists], ["k1", "k2", *names])

    return texts.mapInArrow(work, "k1 long, k2 long, " + ", ".join(f"{c} array<long>" for c in names))


def _cut_pieces(found: DataFrame, length: int, core: int) -> DataFrame:
    """(k1, k2, text, pieces) -> one row per piece with the bytes before and after its core."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(row.k1, row.k2, q["h"], q["p"], q["c"], q["different"], q["lo"], q["hi"],
                    row.text[q["lo"]:q["at"]], row.text[q["at"] + core:q["hi"] + length])
                   for row in pdf.itertuples() for q in row.pieces]
            yield pd.DataFrame(out, columns=["k1", "k2", "h", "p", "c", "different", "lo", "hi", "left", "right"])

    return found.mapInPandas(work, "k1 long, k2 long, h long, p long, c long, different long, lo long, hi long, "
                                   "left binary, right binary")


def equal_windows(groups: list[list[tuple[bytes, bytes, int]]], width: int) -> list[list[np.ndarray]]:
    """Class of every window by group and piece: pieces are (left, right, windows); windows have
    ``width`` symbols and are equal if and only if their classes are (inside a group)."""
    symbols, base, bars, starts = [], [0], [], []
    for pieces in groups:
        m, at = len(pieces) + 1, base[-1]
        for j, (left, right, _) in enumerate(pieces):
            starts.append(at + 1)
            symbols += [np.array([j]), np.frombuffer(left, np.uint8).astype(np.int64) + m, np.array([m + 256]),
                        np.frombuffer(right, np.uint8).astype(np.int64) + m]
            at += 2 + len(left) + len(right)
        symbols.append(np.array([m - 1]))
        base.append(at + 1)
        bars.append(m)
    symbols, base = np.concatenate(symbols), np.array(base)
    order = suffix_arrays(symbols, base, np.array(bars))
    flat = [p for pieces in groups for p in pieces]
    to_core = np.full(len(symbols), -1)                 # of windows: symbols before the core
    for start, (left, _, windows) in zip(starts, flat, strict=True):
        to_core[start:start + windows] = len(left) - np.arange(windows)
    order = order[to_core[order] >= 0]                  # equal windows have only equal windows between them
    a, b = order[:-1], order[1:]
    owner = np.searchsorted(base, order, side="right")
    same = (to_core[a] == to_core[b]) & (owner[:-1] == owner[1:])
    short = symbols.astype(np.int32)
    reach = np.arange(width)
    for at in range(0, len(a), 16384):
        check = np.flatnonzero(same[at:at + 16384]) + at
        same[check] = (short[a[check, None] + reach] == short[b[check, None] + reach]).all(axis=1)
    classes = np.empty(len(symbols), np.int64)
    classes[order] = np.cumsum(np.append(True, ~same)) if len(order) else []
    out, at = [], 0
    for pieces in groups:
        out.append([classes[s:s + w] for s, (_, _, w) in zip(starts[at:at + len(pieces)], pieces, strict=True)])
        at += len(pieces)
    return out


def _match_pieces(length: int, core: int):
    width = length - core + 1

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "p"], ignore_index=True)
        members = [g.index.to_numpy() for _, g in pdf.groupby("h", sort=False)]
        col = {c: pdf[c].tolist() for c in pdf.columns}
        groups = [[(col["left"][i], col["right"][i], col["hi"][i] - col["lo"][i] + 1) for i in m] for m in members]
        out = []
        for m, classes in zip(members, equal_windows(groups, width), strict=True):
            ids, count = np.unique(np.concatenate(classes), return_counts=True)
            for i, own in zip(m, classes, strict=True):
                if col["c"][i] == 1:
                    twice = count[np.searchsorted(ids, own)] > 1
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.view(np.int8), [0]])))
                    out += [(col["k1"][i], col["k2"][i], col["lo"][i] + x, col["lo"][i] + y - 1)
                            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["k1", "k2", "lo", "hi"]).astype("int64")

    return work


PIECE = ["k1", "k2", "h", "p", "c", "lo", "hi", "left", "right"]
PIECE_SCHEMA = "k1 long, k2 long, h long, p long, c long, lo long, hi long, left binary, right binary"


def second_anchors(left: bytes, right: bytes, windows: int, around: int, gram: int, rolls: Rolling) -> np.ndarray:
    """Every window's least-hash substring of ``gram`` bytes among its ``around`` bytes outside the
    core, as its start counted from the core (negative: before it); leftmost on ties."""
    codes = []
    for raw in (left, right):
        raw = np.frombuffer(raw, np.uint8)
        sums, n = rolls.sums(raw), max(0, len(raw) - gram + 1)
        codes.append(mix((sums[gram:] - sums[:-gram]) * rolls.down[:n]) if n else np.zeros(0, np.uint64))
    far = np.iinfo(np.uint64).max
    # of the left side a window has a tail, of the right side a head: running minima from either end
    tail = np.append(codes[0], far)[::-1]
    head = np.append(far, codes[1])
    tail_least, head_least = np.minimum.accumulate(tail), np.minimum.accumulate(head)

    def place(values, least):                                  # where the running minimum was met
        at = np.where(np.append(True, values[1:] < least[:-1]), np.arange(len(values)), 0)
        return np.maximum.accumulate(at)

    x = np.arange(windows)
    before = len(left) - x                                     # bytes of the window before its core
    in_tail = len(tail) - 1 - np.minimum(x, len(tail) - 1)
    in_head = np.clip(around - before - gram + 1, 0, len(head) - 1)
    from_left = len(tail) - 1 - place(tail, tail_least)[in_tail] - len(left)
    from_right = place(head, head_least)[in_head] - 1
    use_left = (tail_least[in_tail] <= head_least[in_head]) & (before >= gram)
    return np.where(use_left, from_left, from_right)


def as_long(raw: bytes) -> int:
    return int.from_bytes(raw, "little", signed=True)


def as_bytes(value: int) -> bytes:
    return int(value).to_bytes(8, "little", signed=True)


def _deal_pieces(length: int, core: int, turn: int):
    """Pieces -> smaller pieces of the windows that share a second anchor; ``turn`` ``ROUNDS``: single windows.

    ``h`` becomes a hash of the old one, the second anchor and its place, ``p`` one of the piece and its core's place."""
    around = length - core
    gram = max(1, around // 4)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolls = Rolling(2 * around + 1, 21 + turn)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                left, right, windows = row.left, row.right, row.hi - row.lo + 1
                if turn < ROUNDS:
                    at = second_anchors(left, right, windows, around, gram, rolls)
                    edge = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [windows]]).tolist()
                else:
                    at, edge = np.zeros(windows, np.int64), list(range(windows + 1))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    own_left, own_right = left[a:], right[:around - len(left) + b - 1]
                    whole = xxhash.xxh3_128_digest(own_left + own_right, seed=len(own_left))
                    if turn < ROUNDS:
                        start = int(at[a])
                        second = left[len(left) + start:][:gram] if start < 0 else right[start:start + gram]
                        key = start.to_bytes(8, "little", signed=True) + second
                    else:
                        key, own_left, own_right = whole[8:], b"", b""
                    out.append((row.k1, row.k2, as_long(xxhash.xxh3_64_digest(as_bytes(row.h) + key)), as_long(whole[:8]), row.c,
                                row.lo + a, row.lo + b - 1, own_left, own_right))
            yield pd.DataFrame(out, columns=PIECE)

    return work


def _deal_crowded(scratch: Scratch, cut: DataFrame, length: int, core: int, limit: int):
    """Pieces of crowded anchors -> (pieces whose anchors are no longer crowded, repeated windows)."""
    ready, repeated = [], []
    for turn in range(ROUNDS + 1):
        dealt = scratch.put(cut.mapInPandas(_deal_pieces(length, core, turn), PIECE_SCHEMA), f"dealt{turn}")
        each = (dealt.groupBy("h", "p").agg(F.sum("c").alias("c"), F.min(F.struct("k1", "k2", "lo", "hi", "left", "right")).alias("one"))
                .select("h", "p", "c", "one.*"))
        each = scratch.put(each, f"kinds{turn}")
        # an own piece that occurs again is repeated throughout
        repeated.append(dealt.filter("c = 1").join(each.filter("c > 1").select("h", "p"), ["h", "p"], "left_semi")
                        .select("k1", "k2", "lo", "hi"))
        if turn == ROUNDS:
            break                                              # single windows: those that stand alone are not repeated
        open_ = (each.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.min("c").alias("least"))
                 .filter("least = 1 AND different > 1").drop("least"))
        each = scratch.put(each.join(scratch.put(open_, f"open{turn}"), "h"), f"each{turn}")
        ready.append(each.filter(F.col("different") <= limit).select(*PIECE))
        cut = each.filter(F.col("different") > limit).select(*PIECE)
        if cut.isEmpty():
            break
    return ready, repeated


def merge_spans(lo, hi) -> list[int]:
    """Sorted, disjoint [start, stop) spans, flat."""
    order = np.argsort(lo, kind="stable")
    lo, hi = np.asarray(lo)[order], np.maximum.accumulate(np.asarray(hi)[order])
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return np.column_stack([lo[new], hi[np.append(new[1:], len(lo)) - 1]]).ravel().tolist()


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, core: int = CORE,
                   limit: int = PIECES) -> DataFrame:
    """(k1, k2, spans): the repeated bytes of every text that has some, as flat start/stop pairs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    body = F.col(text).cast("string")
    rows = docs.filter(F.octet_length(body) >= length).select(*text_key(body), body.cast("binary").alias("text"))
    parts = ["h", "p", "lo", "hi", "at", "times"]
    texts = _anchor_rows(rows, length, core).groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in [*parts, "own_lo", "own_hi"]], F.count(F.lit(1)).alias("copies"))
    texts = scratch.put(texts, "texts")
    own = scratch.put(texts.filter(F.size("own_lo") > 0).select("k1", "k2", F.inline(F.arrays_zip("own_lo", "own_hi"))), "own")
    every = (texts.select("k1", "k2", "copies", F.inline(F.arrays_zip(*parts)))
             .select("k1", "k2", "h", "p", "lo", "hi", "at", (F.col("copies") * F.col("times")).alias("w")))
    shared = (every.groupBy("h").agg(F.sum("w").alias("n"), F.min("p").alias("p0"), F.max("p").alias("p1"))
              .filter("n > 1").select("h", (F.col("p0") != F.col("p1")).alias("mixed")))
    # written first, so that the join deals both sides anew and Spark can split frequent anchors
    shared = scratch.put(every.join(scratch.put(shared, "anchors"), "h"), "shared")
    scratch.drop("texts", "anchors")
    counted = (shared.filter("mixed").groupBy("h", "p")
               .agg(F.sum("w").alias("c"), F.min(F.struct("k1", "k2", "lo", "hi", "at")).alias("one")))
    counted = scratch.put(counted.select("h", "p", "c", "one.*"), "counted")
    single = counted.filter("c = 1").select("h", "p")
    open_ = counted.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.min("c").alias("least")).filter("least = 1")
    pieces = scratch.put(counted.join(scratch.put(open_.drop("least"), "open"), "h"), "pieces")
    n_pieces = pieces.count()
    wanted = pieces.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("h", "p", "c", "different", "lo", "hi", "at")).alias("pieces"))
    cut = _cut_pieces(join_stats(rows, wanted, ["k1", "k2"], "inner", n_pieces, width=80), length, core).dropDuplicates(["h", "p"])
    ready, again = [cut.select(*PIECE)], []
    if pieces.filter(F.col("different") > limit).limit(1).count():
        cut = scratch.put(cut, "cut")
        ready, again = _deal_crowded(scratch, cut.filter(F.col("different") > limit).select(*PIECE), length, core, limit)
        ready.append(cut.filter(F.col("different") <= limit).select(*PIECE))
    blocks = max(1, -(-n_pieces // BLOCK_PIECES))
    found = (reduce(DataFrame.union, ready)
             .withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))
             # little data, much work: as many tasks as asked for, not as few as the bytes suggest
             .repartition(max(partitions(spark), blocks // 4), "block")
             .groupBy("block").applyInPandas(_match_pieces(length, core), "k1 long, k2 long, lo long, hi long"))
    found = scratch.put(found, "found")
    spans = (shared.filter("not mixed").select("k1", "k2", "lo", "hi")
             .union(shared.filter("mixed").join(single, ["h", "p"], "left_anti").select("k1", "k2", "lo", "hi"))
             .union(found).union(own))
    for more in again:
        spans = spans.union(more)

    @F.pandas_udf("array<long>")
    def merged(lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([merge_spans(x, np.asarray(y) + length) for x, y in zip(lo, hi, strict=True)])

    # bounded by the text: its spans are disjoint before they are merged
    listed = (spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
              .select("k1", "k2", merged(F.col("s.lo"), F.col("s.hi")).alias("spans")))
    listed = scratch.put(listed, "spans")
    scratch.keep("spans")
    return listed


def _with_spans(docs: DataFrame, text: str, keep: list, **limits) -> DataFrame:
    spans = repeated_spans(docs, text, **limits)
    size = spans.agg(F.sum(F.size("spans") / 2 + 1)).first()[0] or 0
    body = F.col(text).cast("string")
    return join_stats(docs.select(*keep, *text_key(body), F.coalesce(body, F.lit("")).cast("binary").alias("raw")),
                      spans, ["k1", "k2"], "left", int(size), width=40)


def kept_bytes(raw: bytes, spans) -> bytes:
    edges = [0, *(spans if spans is not None else []), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeat_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: (key, n_bytes, n_removed, n_spans, kept_sha256)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [kept_bytes(r, s) for r, s in zip(pdf["raw"], pdf["spans"], strict=True)]
            n = pdf["raw"].map(len)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": n, "n_removed": n - [len(k) for k in kept],
                                "n_spans": [0 if s is None else len(s) // 2 for s in pdf["spans"]],
                                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})

    kind = docs.schema[key].dataType.simpleString()
    rows = _with_spans(docs, text, [F.col(key).alias("doc_id")], **limits).select("doc_id", "raw", "spans")
    return rows.mapInPandas(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                            ).withColumnRenamed("doc_id", key)


def whole_characters(raw: bytes, spans) -> list[int]:
    """The spans without the bytes of characters they cover only in part."""
    out = []
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out += [a, b]
    return out


def remove_repeats(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents with repeated bytes cut out of their text (whole characters), other columns as they are."""
    @F.pandas_udf("string")
    def cut(raw: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([kept_bytes(r, whole_characters(r, s)).decode("utf-8", "replace")
                          for r, s in zip(raw, spans, strict=True)])

    rows = _with_spans(docs, text, [F.struct(*docs.columns).alias("doc")], **limits)
    some = F.col("spans").isNotNull()
    return rows.filter(some).select(
        *[cut("raw", "spans").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]).union(
        rows.filter(~some).select("doc.*"))
