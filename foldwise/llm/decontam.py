"""Operator 10: benchmark decontamination by latent semantic retrieval.

1. Words are hashed; document frequencies are counted over all documents.
2. Benchmark items are cut into passages (``2 * HALF`` words, every ``HALF`` words).  A
   randomised SVD of their TF-IDF rows, with all corpus passages at low weight, gives a
   latent space of ``RANK`` dimensions.  The corpus enters as a sketch: every passage of
   every document is added, with a random sign, to one of ``FIT_ROWS`` rows, so the rows'
   products are in expectation those of all passages.  Every product with the items'
   passage matrix is a distributed sum over passages; the driver only factorises
   matrices of ``2^BITS`` rows and ``RANK + 16`` columns.
3. All passages of all documents are projected and compared with the items' passages
   as matrix products, block by block: the items are the stated query set.
   Candidates have a cosine of ``COSINE`` and hold ``SHARE`` of the item passage's length
   in its direction.
4. A candidate is checked on words: the longest common subsequence of the item and the
   text around the passage.  ``VERBATIM`` of the item's words in order is a leak;
   a paraphrase needs ``PARAPHRASE`` of them and ``ANSWER`` of the answer's (the last
   sentence of the item, or the column named as answer).  Of an item of more than ``LONG`` words, ``LONG``
   successive words around the passage that was found are held to the same bounds, so a part of a
   long item is a leak; ``lcs`` and ``answer`` are then those of the part.
5. Items of fewer than ``LEAST_WORDS`` words are looked up as whole word sequences in every document; their
   ``cosine`` is null.

Items are handled ``ITEMS`` at a time, so the broadcast model is bounded whatever the
benchmark's size.

Edge cases: null and wordless texts and items match nothing; equal items each get their row; repeated documents
each get theirs; null ids are kept; with an empty benchmark or an empty table the result
is empty; other columns are ignored (``clean_documents`` returns them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch, text_key
from foldwise.llm.ngram_join import mix
from foldwise.llm.suffix_dedup import Rolling
from foldwise.operators.joins import join_stats

BITS, RANK, HALF = 16, 128, 16
COSINE, SHARE = 0.6, 0.5
VERBATIM, PARAPHRASE, ANSWER = 0.7, 0.6, 0.8
LEAST_WORDS = 8               # shorter items have to occur word by word
LONG = 64                     # words of a long item that are checked as one passage
ITEMS = 20_000                # items handled in one pass
FIT_ROWS = 32                 # rows of the corpus sketch
FIT_DOCS, FIT_WEIGHT = 64, 0.1         # all corpus passages weigh as much as those of FIT_DOCS documents of this weight
FIT_UNIT = 2.0 ** 24          # sketch entries are whole multiples of its inverse
SEGMENT = 1 << 20             # bytes hashed at a time

LETTERS = np.array([chr(i).isalnum() or i >= 0x80 for i in range(256)])


class Words:
    """Hashes of the words (letters and digits, lower case) of texts."""

    def __init__(self):
        self.roll = Rolling(SEGMENT + 1, 21)

    def _segment(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = LETTERS[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        sums = self.roll.sums(raw)
        return mix((sums[stop] - sums[start]) * self.roll.down[start] + (stop - start).astype(np.uint64)), start

    def of(self, texts: list) -> list[np.ndarray]:
        """One array of word hashes per text."""
        raws = [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        out: list = [None] * len(raws)
        held, size = [], 0

        def flush():
            raw = np.frombuffer(b" ".join(raws[i] for i in held), np.uint8)
            hashes, start = self._segment(raw)
            ends = np.cumsum([len(raws[i]) + 1 for i in held])
            cuts = np.searchsorted(start, ends)
            for i, a, b in zip(held, np.append(0, cuts), cuts, strict=False):
                out[i] = hashes[a:b]

        for i, raw in enumerate(raws):
            if len(raw) > SEGMENT // 2:
                out[i] = self._long(raw)
                continue
            if size + len(raw) + 1 > SEGMENT:
                flush()
                held, size = [], 0
            held.append(i)
            size += len(raw) + 1
        if held:
            flush()
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(raw):
            stop = min(at + SEGMENT, len(raw))
            if stop < len(raw):                    # cut behind the last word that ends here
                gap = np.flatnonzero(~LETTERS[np.frombuffer(raw, np.uint8, stop - at, at)])
                stop = at + int(gap[-1]) + 1 if len(gap) else stop
            parts.append(self._segment(np.frombuffer(raw, np.uint8, stop - at, at))[0])
            at = stop
        return np.concatenate(parts)


def buckets(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def passage_starts(n: int) -> np.ndarray:
    """First words of the passages of a text of ``n`` words."""
    return np.arange(max(1, -(-n // HALF) - 1)) * HALF


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents by word bucket, documents) over all rows of ``text``."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, n = Words(), np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            found = [buckets(h) for h in words.of(pdf["text"].tolist())]
            n += len(found)
            keys = np.sort(np.concatenate([f + (i << BITS) for i, f in enumerate(found)] or [[]]).astype(np.int64))
            keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
            seen += np.bincount(keys & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], n)})

    # bounded: one row per bucket
    table = docs.select("text").mapInPandas(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS, np.int64)
    grams = table[table["bucket"] >= 0]
    df[grams["bucket"].to_numpy()] = grams["n"].to_numpy()
    return df, int(table["n"][table["bucket"] < 0].sum())


def _passage_sum(passages: DataFrame, column: np.ndarray, idf: np.ndarray, right: np.ndarray,
                 square: bool) -> np.ndarray:
    """A'(A right), or (A right)'(A right) when ``square``, for unit TF-IDF rows A times their weight.
    ``column`` numbers the buckets in use.  Every task sums its passages; blocks of the sums are added up in parallel."""
    shared = passages.sparkSession.sparkContext.broadcast((column, idf.astype(np.float32), right.astype(np.float32)))
    step = 1024

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        col, w, m = shared.value
        total = np.zeros((m.shape[1] if square else len(m), m.shape[1]), np.float32)
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at:at + 256]
                lists, weight = pdf["words"].tolist(), pdf["weight"].to_numpy(np.float32)
                sizes = np.array([len(x) for x in lists])
                words = np.concatenate(lists)
                first = np.cumsum(sizes) - sizes
                value = w[words] * np.repeat(weight / np.sqrt(np.add.reduceat(w[words] ** 2, first)), sizes)
                at_col = col[words]
                left = np.add.reduceat(value[:, None] * m[at_col], first, axis=0)
                if square:
                    total += left.T @ left
                    continue
                order = np.argsort(at_col, kind="stable")
                edge = np.flatnonzero(np.append(True, np.diff(at_col[order]) > 0))
                back = value[order, None] * left[np.repeat(np.arange(len(lists)), sizes)[order]]
                total[at_col[order][edge]] += np.add.reduceat(back, edge, axis=0)
        for at in range(0, len(total), step):
            yield pd.DataFrame({"at": [at], "part": [total[at:at + step].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(bytes(p) for p in pdf["part"])            # a fixed order of summation
        return pd.DataFrame({"at": [pdf["at"][0]], "part": [sum(np.frombuffer(p, np.float32) for p in parts).tobytes()]})

    out = np.zeros((right.shape[1] if square else len(right), right.shape[1]), np.float32)
    sums = passages.mapInPandas(work, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary")
    for at, part in sums.collect():          # at most 2^BITS x (RANK + 16) numbers
        block = np.frombuffer(bytes(part), np.float32).reshape(-1, right.shape[1])
        out[at:at + len(block)] = block
    shared.destroy()
    return out


def corpus_sketch(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """(FIT_ROWS, 2^BITS): the unit TF-IDF rows of all passages of all documents, each added to one row with
    a sign, both drawn by hash of document, text and place.  Sums are of integers, so exact in any order."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, w = Words(), shared.value
        total = np.zeros(FIT_ROWS << BITS, np.int64)
        for whole in batches:
            for at in range(0, len(whole), 200):
                pdf = whole.iloc[at:at + 200]
                found = [buckets(h) for h in words.of(pdf["text"].tolist())]
                place, value = [], []
                for b, own in zip(found, pdf["draw"].to_numpy(np.int64).view(np.uint64), strict=True):
                    if not len(b):
                        continue
                    starts = passage_starts(len(b))
                    sizes = np.minimum(starts + 2 * HALF, len(b)) - starts
                    first = np.cumsum(sizes) - sizes
                    # words of all passages in a row; the passages overlap by half
                    at_word = np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)
                    words_of = b[at_word]
                    draw = mix(own + (starts.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                    size = np.sqrt(np.add.reduceat(w[words_of] ** 2, first))
                    sign = np.where(draw >> np.uint64(63), -1.0, 1.0) / size
                    place.append((np.repeat((draw % np.uint64(FIT_ROWS)).astype(np.int64), sizes) << BITS) + words_of)
                    value.append(np.rint(w[words_of] * np.repeat(sign, sizes) * FIT_UNIT))
                if place:
                    np.add.at(total, np.concatenate(place), np.concatenate(value).astype(np.int64))
        step = 1 << BITS
        for row in range(FIT_ROWS):
            part = total[row * step:(row + 1) * step]
            if part.any():
                yield pd.DataFrame({"row": [row], "part": [part.tobytes()]})

    def add(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in pdfs:
            for row, part in zip(pdf["row"], pdf["part"], strict=True):
                total[row] = total.get(row, 0) + np.frombuffer(bytes(part), np.int64)
        for row, part in total.items():      # all parts of a row are in one task
            yield pd.DataFrame({"row": [row], "part": [(part / FIT_UNIT).astype(np.float32).tobytes()]})

    drawn = rows.select("text", F.xxhash64(F.lit("fit"), "doc_id", "text").alias("draw"))
    sums = drawn.mapInPandas(work, "row int, part binary").repartition(FIT_ROWS, "row").mapInPandas(add, "row int, part binary")
    out = np.zeros((FIT_ROWS, 1 << BITS), np.float32)
    for row, part in sums.collect():         # FIT_ROWS x 2^BITS numbers
        out[row] = np.frombuffer(bytes(part), np.float32)
    shared.destroy()
    return out


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, seed: int = 5, more: np.ndarray | None = None) -> np.ndarray:
    """The ``rank`` leading right singular vectors of the weighted TF-IDF passages (words, weight) and the dense rows ``more``."""
    # bounded: at most 2^BITS buckets
    asked = np.sort(passages.select(F.explode("words").alias("b")).distinct().toPandas()["b"].to_numpy(np.int64))
    column = np.zeros(1 << BITS, np.int64)
    column[asked] = np.arange(len(asked))
    n, rest, across = len(asked), np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
    dense = np.zeros((0, n), np.float32)
    if more is not None:
        # on words of no passage only ``more`` has entries: its few rows span them, so they are turned into as many columns
        rest = np.setdiff1d(np.flatnonzero(np.abs(more).max(axis=0)), asked)
        size, turn = np.linalg.eigh((more[:, rest] @ more[:, rest].T).astype(float))
        some = size > max(size[-1], 1e-30) * 1e-12
        across = (turn[:, some] / np.sqrt(size[some])).astype(np.float32)          # rest columns = more' across
        dense = np.hstack([more[:, asked], (turn[:, some] * np.sqrt(size[some])).astype(np.float32)])
    wide = dense.shape[1]

    def product(q: np.ndarray, square: bool) -> np.ndarray:
        seen = dense @ q
        out = seen.T @ seen if square else dense.T @ seen
        if n:
            out[:len(out) if square else n] += _passage_sum(passages, column, idf, q[:n], square)
        return out

    q = np.random.default_rng(seed).standard_normal((wide, min(rank + 16, wide)), np.float32)
    for _ in range(2):
        q = product(q, False)
        q = np.linalg.qr(q)[0]
    value, vector = np.linalg.eigh(product(q, True).astype(float))
    keep = value > max(value[-1], 1e-12) * 1e-6
    out = np.zeros((1 << BITS, min(rank, int(keep.sum()))), np.float32)
    q = q @ vector[:, keep][:, ::-1][:, :rank].astype(np.float32)
    out[asked] = q[:n]
    if len(rest):
        out[rest] = more[:, rest].T @ (across @ q[n:])
    return out


def _passages(rows: DataFrame, weight: float) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            out = []
            for h in words.of(pdf["text"].tolist()):
                b = buckets(h)
                out += [b[s:s + 2 * HALF].tolist() for s in passage_starts(len(b))] if len(b) else []
            if out:
                yield pd.DataFrame({"words": out, "weight": [weight] * len(out)})

    return rows.select("text").mapInPandas(work, "words array<long>, weight double")


def common_subsequence(item: list[int], where: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence; ``where`` has the item's positions as bits."""
    full = v = (1 << len(item)) - 1
    for w in text:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def positions(item: list[int]) -> dict[int, int]:
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    return where


def sequence_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """One key for every ``n`` successive words."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - n + 1 + i])
    return out


def leaks(lcs: float, answer: float) -> bool:
    return lcs >= VERBATIM or (lcs >= PARAPHRASE and answer >= ANSWER)


SENTENCE = re.compile(r"(?<=[.?!])\s+")


def answer_words(text: str, answer, words: Words) -> list[int]:
    """The answer, or the last sentence of at least three words, or the last third."""
    if isinstance(answer, str) and len(found := words.of([answer])[0]):
        return found.tolist()
    whole = words.of([text])[0].tolist()
    parts = SENTENCE.split(text.strip())
    last = words.of([parts[-1]])[0].tolist()
    return last if len(parts) > 1 and len(last) >= 3 else whole[-max(3, len(whole) // 3):]


class Index:
    """The items' passages in the latent space, and their words for the checks.  ``vars`` of
    an index is plain data, which is what is broadcast."""

    def build(self, items: pd.DataFrame, idf: np.ndarray, basis: np.ndarray) -> Index:
        self.idf, words = idf, Words()
        self.rows = np.flatnonzero(np.abs(basis).max(axis=1) > 1e-7)
        self.place = np.full(len(basis), len(self.rows), np.int32)     # words without a latent image: the last row, of zeros
        self.place[self.rows] = np.arange(len(self.rows))
        self.basis = np.zeros((len(self.rows) + 1, basis.shape[1]), np.float32)
        self.basis[:-1] = basis[self.rows] * idf[self.rows, None].astype(np.float32)
        self.ids, self.words, self.where, self.answers, lists, self.owner, self.at = [], [], [], [], [], [], []
        self.short_ids: list = []
        self.short: dict[int, dict[int, list]] = {}        # number of words -> key -> [(number in short_ids, words, answer)]
        for item, text, answer in zip(items["item_id"], items["text"], items["answer"], strict=True):
            h = words.of([text])[0]
            if len(h) < LEAST_WORDS:
                if len(h):
                    key = int(sequence_keys(h, len(h))[0])
                    self.short.setdefault(len(h), {}).setdefault(key, []).append(
                        (len(self.short_ids), h, answer_words(text, answer, words)))
                    self.short_ids.append(item)
                continue
            own = h.tolist()
            starts = passage_starts(len(h))
            self.owner += [len(self.ids)] * len(starts)
            self.at += starts.tolist()
            lists += [buckets(h)[s:s + 2 * HALF] for s in starts]
            self.ids.append(item)
            self.words.append(own)
            self.where.append(positions(own))
            self.answers.append(answer_words(text, answer, words))
        self.owner = np.array(self.owner, np.int64)
        latent = np.array([self.project(x, np.array([0]))[0] for x in lists], np.float32).reshape(len(lists), self.basis.shape[1])
        self.length = np.linalg.norm(latent, axis=1)
        self.queries = latent / np.maximum(self.length, 1e-9)[:, None]
        return self

    def project(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Latent vectors of the passages of a sequence of buckets."""
        return self.project_all([words], [starts])

    def project_all(self, texts: list[np.ndarray], starts: list[np.ndarray]) -> np.ndarray:
        """Latent vectors of the passages of all texts, one text after the other.  Halves of passages are summed
        place by place, all halves of all texts at once."""
        length = np.array([len(t) for t in texts], np.int64)
        n_halves = np.maximum(1, -(-length // HALF))
        first = np.cumsum(n_halves) - n_halves
        place = np.full(int(n_halves.sum()) * HALF, len(self.rows), np.int32)
        if length.any():
            place[np.arange(int(length.sum())) + np.repeat(first * HALF - (np.cumsum(length) - length), length)] = self.place[np.concatenate(texts)]
        # words with an image to the left of their half
        known = np.flatnonzero(place < len(self.rows))
        part = known // HALF
        count = np.bincount(part, minlength=len(place) // HALF)
        grid = np.full((len(count), HALF), len(self.rows), np.int32)
        grid[part, np.arange(len(known)) - (np.cumsum(count) - count)[part]] = place[known]
        halves = np.zeros((len(grid), self.basis.shape[1]), np.float32)
        for at in range(0, len(grid), 1024):
            many = count[at:at + 1024] > HALF // 2
            for own in (at + np.flatnonzero(many), at + np.flatnonzero(~many)):
                if len(own):
                    halves[own] = self._summed(grid[own], bool(many[own[0] - at]))
        sizes = [len(s) for s in starts]
        half = np.concatenate(starts) // HALF
        row = half + np.repeat(first, sizes)
        out = halves[row]
        more = half + 1 < np.repeat(n_halves, sizes)
        out[more] += halves[row[more] + 1]
        return out

    def _summed(self, grid: np.ndarray, many: bool) -> np.ndarray:
        """Sum of the images of every row of word places, in the order in which ``np.add.reduceat`` adds so many, to
        the last bit."""
        def image(j: int) -> np.ndarray:
            return self.basis.take(grid[:, j], axis=0)

        if many:
            out = (image(1) + image(2)) + (image(3) + image(4))
            out += (image(5) + image(6)) + (image(7) + image(8))
        else:
            out = image(1)
        for j in range(HALF // 2 + 1, HALF) if many else range(2, HALF // 2):
            out += image(j)
        out += image(0)
        return out

    def candidates(self, latent: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item passage, cosine) of all pairs above the bounds, in blocks."""
        size = np.linalg.norm(latent, axis=1)
        for q in range(0, len(self.queries), 1024):
            for at in range(0, len(latent), 2048):
                dot = latent[at:at + 2048] @ self.queries[q:q + 1024].T
                hit = (dot >= COSINE * size[at:at + 2048, None]) & (dot >= SHARE * self.length[q:q + 1024]) & (dot > 0)
                for i, j in zip(*np.nonzero(hit), strict=True):
                    yield at + int(i), q + int(j), float(dot[i, j] / size[at + i])

    def shortest(self, hashes: np.ndarray) -> Iterator[tuple]:
        """(number, share of the answer's words) of the short items that occur in a text."""
        for n, keys in self.short.items():
            if len(hashes) < n:
                continue
            found = sequence_keys(hashes, n)
            for at in np.flatnonzero(np.isin(found, np.fromiter(keys, np.uint64, len(keys)))).tolist():
                for item, own, answer in keys[int(found[at])]:
                    if (hashes[at:at + n] == own).all():
                        region = hashes[max(0, at - 2 * HALF):at + n + 2 * HALF].tolist()
                        yield item, common_subsequence(answer, positions(answer), region) / len(answer)

    def checks(self, text: list[int], start: int, passage: int) -> Iterator[tuple[float, float]]:
        """Shares in order around a passage: of the whole item, and of ``LONG`` words of a longer one."""
        item = int(self.owner[passage])
        yield self.check(text, start, item)
        own, answer = self.words[item], self.answers[item]
        if len(own) > LONG:
            first = min(max(0, self.at[passage] - HALF), len(own) - LONG)
            part = own[first:first + LONG]
            region = text[max(0, start - LONG):start + 2 * HALF + LONG]
            lcs = common_subsequence(part, positions(part), region) / LONG
            yield lcs, common_subsequence(answer, positions(answer), region) / len(answer) if lcs >= PARAPHRASE else 0.0

    def check(self, text: list[int], start: int, item: int) -> tuple[float, float]:
        """Shares of the item's and of the answer's words in order around a passage."""
        own, answer = self.words[item], self.answers[item]
        region = text[max(0, start - len(own)):start + 2 * HALF + len(own)]
        lcs = common_subsequence(own, self.where[item], region) / len(own)
        if lcs < PARAPHRASE:
            return lcs, 0.0
        return lcs, common_subsequence(answer, positions(answer), region) / len(answer)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               answer: str | None = None, rank: int = RANK) -> DataFrame:
    """(doc_id, k1, k2, item_id, cosine, lcs, answer): one row per document and item it leaks."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "decontam")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).alias("item_id"), F.col(text).cast("string").alias("text"),
                         (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")).filter("text is not null")
    asked = scratch.put(asked, "items")
    n_items = asked.count()
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    fit = scratch.put(_passages(asked, 1.0), "fit")
    schema = (f"doc_id {docs.schema[key].dataType.simpleString()}, k1 long, k2 long, "
              f"item_id {items.schema[item].dataType.simpleString()}, cosine double, lcs double, answer double")
    out = spark.createDataFrame([], schema)
    if fit.isEmpty():                        # no item has a word
        return out
    corpus = corpus_sketch(rows, idf) * np.float32(FIT_WEIGHT * np.sqrt(min(1.0, FIT_DOCS / max(1, n))))
    basis = randomised_svd(fit, idf, rank, more=corpus)
    parts = -(-n_items // ITEMS)
    blocks = []
    for part in range(parts):
        # at most about ITEMS rows
        some = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toPandas()
        blocks.append(sc.broadcast(vars(Index().build(some.sort_values(["item_id", "text"]), idf, basis))))
    scratch.keep()
    for shared in blocks:

        def work(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, words = Index(), Words()
            vars(index).update(shared.value)
            for whole in batches:
                for at in range(0, len(whole), 200):
                    pdf = whole.iloc[at:at + 200]
                    hashes = words.of(pdf["text"].tolist())
                    starts = [passage_starts(len(h)) for h in hashes]
                    latent = index.project_all([buckets(h) for h in hashes], starts)
                    owner = np.repeat(np.arange(len(hashes)), [len(s) for s in starts])
                    first = np.concatenate(starts)
                    best: dict[tuple[int, int], tuple] = {}
                    asked, tokens = {}, {}
                    for p, q, cosine in index.candidates(latent):
                        d, i = int(owner[p]), int(index.owner[q])
                        asked.setdefault((d, i), []).append((cosine, int(first[p]), q))
                    for (d, i), places in asked.items():
                        if d not in tokens:
                            tokens[d] = hashes[d].tolist()
                        for cosine, start, q in sorted(set(places), reverse=True):
                            for lcs, ans in index.checks(tokens[d], start, q):
                                # a place that passes comes before any that does not
                                if (leaks(lcs, ans), lcs, ans) > (best[d, i][:3] if (d, i) in best else (False, 0.0, 0.0)):
                                    best[d, i] = (leaks(lcs, ans), lcs, ans, cosine)
                            if (d, i) in best and best[d, i][1] >= VERBATIM:
                                break
                    found = [(d, index.ids[i], c, lcs, ans) for (d, i), (ok, lcs, ans, c) in best.items() if ok]
                    for d, h in enumerate(hashes):
                        short: dict[int, float] = {}
                        for entry, ans in index.shortest(h):
                            if entry not in short or ans > short[entry]:
                                short[entry] = ans
                        found += [(d, index.short_ids[e], None, 1.0, ans) for e, ans in short.items()]
                    out = [(*(pdf[c].iloc[d] for c in ("doc_id", "k1", "k2")), *rest) for d, *rest in found]
                    if out:
                        yield pd.DataFrame(out, columns=["doc_id", "k1", "k2", "item_id", "cosine", "lcs", "answer"]) \
                            .astype({"cosine": "float64"})

        keyed = rows.select("doc_id", *text_key(F.col("text")), "text").filter("text is not null")
        out = out.union(keyed.mapInPandas(work, schema))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents that leak no item, with the input's columns."""
    scratch = Scratch(docs.sparkSession, "decontam")
    bad = scratch.put(find_leaks(docs, items, key, text, **names).select("k1", "k2").distinct(), "leaking")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), *text_key(F.col(text).cast("string")))
    return join_stats(keyed, bad, ["k1", "k2"], "left_anti", bad.count()).select("doc.*")
