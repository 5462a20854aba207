"""Benchmark decontamination by the q-gram lemma.

A text within e edits of a passage of L characters shares at least L + 1 - q - q * e of its q-grams with it, on
diagonals at most 2e apart. Every document is compared whole with all passages: shared q-grams are counted in
overlapping diagonal bands, bands that reach the bound are kept as regions, and each region is verified by alignment
within the band. Both sides are compared in lower case with runs of anything but letters and digits as one space.

Passages of fewer than ``LEAST_CHARS`` characters allow no edit and must stand between word borders; those that are
shorter than a q-gram must be the whole document.

The passages are a stated query set: they go to every task in blocks of at most ``BLOCK_CHARS`` characters, dealt by a
hash, one pass over the documents for each block. Of several blocks only one is broadcast at a time, so what the cluster
holds is bounded however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_buffers

Q = 10
#: Edits allowed in a passage, of its characters.
RATE = 0.08
#: Passages with fewer characters after normalisation are searched without edits, between word borders.
LEAST_CHARS = 40
BLOCK_CHARS = 4_000_000
#: Pairs of equal q-grams held at once.
MOST_HITS = 8_000_000
CHUNK = 1 << 21


def _fold() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    for b in range(256):
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80:
            out[b] = b
        elif 65 <= b <= 90:
            out[b] = b + 32
    return out


FOLD = _fold()


def normalise(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, the rows' offsets in them, and the place of each byte in ``data``."""
    if not len(data):
        return data, np.zeros(len(ends), np.int64), np.zeros(0, np.int64)
    x = FOLD[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)  # Latin-1 capitals
    x[1:][capital] += 0x20
    space = x == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    keep[first] = ~space[first]
    place = np.flatnonzero(keep)
    return x[place], np.searchsorted(place, ends), place


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the q bytes that start at each place (len(x) - q + 1 of them)."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    wide = x.astype(np.uint64)
    for i in range(q):
        code *= np.uint64(0x9E3779B97F4A7C15 | 1)
        code += wide[i : i + n]
    return code


class Passages:
    """The q-grams of a block of passages, sorted, with a bitmap that tells most strange q-grams at once."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.ids, self.texts, self.edits, codes, owner, at = q, [], [], [], [], [], []
        known: dict[bytes, int] = {}  # passages alike share one entry
        self.whole: dict[bytes, list[int]] = {}  # passages without a q-gram
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            x, _, _ = normalise(raw, np.array([0, len(raw)]))
            x = x[: len(x) - (len(x) and x[-1] == 32)]
            if len(x) < q:
                if len(x):
                    self.whole.setdefault(x.tobytes(), []).append(item)
                continue
            if x.tobytes() in known:
                self.ids[known[x.tobytes()]].append(item)
                continue
            known[x.tobytes()] = len(self.ids)
            e = int(rate * len(x)) if len(x) >= LEAST_CHARS else 0
            while e and len(x) + 1 - q - q * e < 1:
                e -= 1
            g = grams(x, q)
            codes.append(g)
            owner.append(np.full(len(g), len(self.ids)))
            at.append(np.arange(len(g)))
            self.ids.append([item])
            self.texts.append(x)
            self.edits.append(e)
        self.edit = np.array(self.edits, np.int64)
        self.length = np.array([len(x) for x in self.texts], np.int64)
        self.need = self.length + 1 - q - q * self.edit
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.owner = np.concatenate(owner)[order] if len(order) else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if len(order) else np.zeros(0, np.int64)
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.slot(self.codes)] = True

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)).astype(np.int64)

    def regions(self, x: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, passage, first and last diagonal) where a band has enough shared q-grams."""
        code = grams(x, self.q)
        hit = np.flatnonzero(self.bits[self.slot(code)])
        if not len(hit):
            return
        found = np.searchsorted(self.codes, code[hit])
        found[found == len(self.codes)] = 0
        same = self.codes[found] == code[hit]
        hit, found = hit[same], found[same]
        row = np.searchsorted(ends, hit, "right") - 1
        inside = hit + self.q <= ends[row + 1]
        hit, found, row = hit[inside], found[inside], row[inside]
        if not len(hit):
            return
        times = self.count[found]
        if times.sum() > MOST_HITS and row[0] < row[-1]:  # passages much alike: fewer rows at a time
            half = (int(row[0]) + int(row[-1]) + 1) // 2
            for i, j in ((0, half), (half, len(ends) - 1)):
                for r, *rest in self.regions(x[ends[i] : ends[j]], ends[i : j + 1] - ends[i]):
                    shift = int(ends[i])
                    yield r + i, rest[0], rest[1] + shift, rest[2] + shift
            return
        over = int(self.length.max() + 2 * self.edit.max()) + self.q
        if times.sum() > MOST_HITS and int(ends[row[0] + 1] - ends[row[0]]) > 4 * over:  # a long row: in parts that share a passage's room
            r = int(row[0])
            start, end = int(ends[r]), int(ends[r + 1])
            middle = (start + end) // 2
            for s, t in ((start, middle + over), (middle, end)):
                for _, p, low, high in self.regions(x[s:t], np.array([0, t - s])):
                    yield r, p, low + s, high + s
            return
        entry = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        hit, row = np.repeat(hit, times), np.repeat(row, times)
        passage, at = self.owner[entry], self.at[entry]
        diagonal = hit - at + int(self.length.max())  # never negative
        width = 2 * self.edit[passage] + 1
        band = diagonal // width
        # every run of `width` diagonals lies within one of the overlapping bands of twice the width
        key = np.concatenate([passage * (len(x) + 2 * int(self.length.max()) + 2) + b for b in (band, np.maximum(band - 1, 0))])
        both_at = np.concatenate([at, at])
        both_row = np.concatenate([row, row])
        both_d = np.concatenate([diagonal, diagonal]) - int(self.length.max())
        order = np.lexsort((both_at, both_row, key))
        key, both_at, both_row, both_d = key[order], both_at[order], both_row[order], both_d[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (both_row[1:] != both_row[:-1])])
        fresh = np.concatenate([[True], both_at[1:] != both_at[:-1]]) | new  # a passage's q-gram counts once in a band
        start = np.flatnonzero(new)
        shared = np.add.reduceat(fresh.astype(np.int64), start)
        p = key[start] // (len(x) + 2 * int(self.length.max()) + 2)
        for i in np.flatnonzero(shared >= self.need[p]):
            s, t = start[i], start[i + 1] if i + 1 < len(start) else len(key)
            yield int(both_row[s]), int(p[i]), int(both_d[s:t].min()), int(both_d[s:t].max())


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end in ``text``) of the best alignment of all of ``pattern`` to a part of ``text``, if within ``most``.

    Only the diagonals ``low`` to ``high`` (place in the text less place in the pattern) are filled.
    """
    width, far = high - low + 1, 1 << 40
    steps = np.arange(width)
    at = np.arange(low, high + 1)  # place in the text of each diagonal, before the row's character
    # distance and start as one number: of equal distances the earliest start
    last = np.where((at >= 0) & (at <= len(text)), np.maximum(at, 0), far << 20)
    padded = np.full(len(pattern) + width + max(0, -low) + len(text) + 2, 256, np.int64)
    padded[max(0, -low) : max(0, -low) + len(text)] = text
    first = low + max(0, -low)
    one = np.int64(1) << 32
    for i, c in enumerate(pattern):
        there = padded[first + i : first + i + width]
        row = last + np.where(there == c, 0, one)
        row[there == 256] = far << 20
        row[:-1] = np.minimum(row[:-1], last[1:] + one)
        last = np.minimum.accumulate(row - steps * one) + steps * one
        end = at + i + 1
        last[(end < 0) | (end > len(text))] = far << 20
        if int(last.min() >> 32) > most:
            return None
    best = int(last.argmin())
    return int(last[best] >> 32), int(last[best] & 0xFFFFFFFF), int(at[best]) + len(pattern)


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end: the best region of each row of ``docs`` for each passage that it holds.

    ``start`` and ``end`` are byte offsets in the row's UTF-8 text; ``distance`` is the number of edits, at most
    ``rate`` of the passage's characters, none below LEAST_CHARS. Null texts hold nothing; passages with null id or text, or
    without letters and digits, are in no document; repeated rows and passages are reported one by one. Empty tables give
    an empty result. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    search = lambda shared: source.mapInArrow(_reporter(shared), "doc_id long, item_id long, distance int, start long, end long")
    return reduce(DataFrame.unionByName, _passes(benchmark, q, rate, item_col, item_text, search))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no passage of ``benchmark``, as ``find_leaks`` tells; null texts stay.

    Scans only, no shuffle.
    """
    kept = [docs]

    def search(shared: Broadcast) -> DataFrame:
        return kept[-1].mapInArrow(_filter(shared, text_col), docs.schema)

    for part in _passes(benchmark, q, rate, item_col, item_text, search):
        kept.append(part)
    return kept[-1]


def _passes(benchmark: DataFrame, q: int, rate: float, item_col: str, item_text: str, search: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """What ``search`` makes of each block of passages, one block at least.

    Blocks have BLOCK_CHARS characters (or one passage) at most. If there are several, each result is written and its
    broadcast is taken back before the next one.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    total, longest = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0)), F.coalesce(F.max(F.length("text") + 1), F.lit(0))).first()
    parts = max(1, -(-total // BLOCK_CHARS))
    block = lambda n: F.pmod(F.xxhash64("text", "item_id"), F.lit(n))
    while parts > 1 and items.groupBy(block(parts).alias("b")).agg(F.sum(F.length("text") + 1).alias("n")).agg(F.max("n")).first()[0] > max(longest, BLOCK_CHARS):
        parts *= 2
    for i in range(parts):
        rows = items.where(block(parts) == i).orderBy("item_id", "text").collect()
        if not rows and parts > 1:
            continue
        shared = spark.sparkContext.broadcast(Passages([(r["item_id"], r["text"]) for r in rows], q, rate))
        if parts == 1:
            yield search(shared)
        else:
            done = materialize(search(shared), "leaks")
            shared.destroy()
            yield done


def leaks(passages: Passages, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, first byte, end) of the best region of each text for each passage it holds."""
    data, ends = text_buffers(texts.fill_null(""))
    if not passages.ids and not passages.whole:
        return
    for i, j in slices(ends, CHUNK):
        x, cut, place = normalise(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        for row in range(j - i) if passages.whole else ():
            own = x[cut[row] : cut[row + 1]]
            if len(own) <= passages.q and (items := passages.whole.get(own.tobytes().rstrip())):
                origin, n = int(ends[i + row] - ends[i]), len(own.tobytes().rstrip())
                for item in items:
                    yield i + row, item, 0, int(place[cut[row]]) - origin, int(place[cut[row] + n - 1]) + 1 - origin
        best: dict[tuple[int, int], tuple] = {}
        for row, p, low, high in passages.regions(x, cut) if passages.ids else ():
            if (row, p) in best and best[row, p][0] == 0:
                continue
            e, pattern = passages.edits[p], passages.texts[p]
            a, b = int(cut[row]), int(cut[row + 1])
            got = None
            if len(pattern) >= LEAST_CHARS:
                s, t = max(a, low - e), min(b, high + len(pattern) + e)
                got = banded(pattern, x[s:t], low - e - s, high + e - s, e)
                if got and got[0] < best.get((row, p), (1 << 30,))[0]:
                    got = got[0], s + got[1], s + got[2]
                else:
                    got = None
            else:
                for s in range(low, high + 1):  # the places of a band without edits
                    t = s + len(pattern)
                    if a <= s and t <= b and (s == a or x[s - 1] == 32) and (t == b or x[t] == 32) and (x[s:t] == pattern).all():
                        got = 0, s, t
                        break
            if got:
                origin = int(ends[i + row] - ends[i])
                best[row, p] = (got[0], int(place[got[1]]) - origin, int(place[got[2] - 1]) + 1 - origin)
        for (row, p), v in sorted(best.items()):
            for item in passages.ids[p]:
                yield i + row, item, *v


def _reporter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], *rest) for i, *rest in leaks(shared.value, batch.column("text"))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def _filter(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[i for i, *_ in leaks(shared.value, batch.column(text_col))]] = False
            yield batch.filter(pa.array(clean))

    return run
