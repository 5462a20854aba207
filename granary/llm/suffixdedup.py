"""Suffix-array deduplication of byte strings by a distributed, common-prefix-aware merge sort.

A string of W bytes that occurs twice has, in both places, its smallest k-gram (by 40 bits of a hash, the leftmost of
equals) at the same offset: the anchor. So only suffixes at anchors are sorted, about 2 in W - k of all, and of these
only the ones whose k-gram occurs elsewhere too. Tasks sort the suffixes of their documents (W bytes at most, with the
bytes to the left as far as a window reaches), front-code the runs and exchange them by a hash of the k-gram; a loser
tree merges the runs of each part and never compares a prefix that is known to be shared. Suffixes that agree in k bytes
or more stand together then, with the lengths of their common prefixes; with the common extensions to the left these
tell for every window of every anchor whether it occurs elsewhere.

Suffixes alike on both sides collapse in their run and again in the merge, so exact copies cost their number, not its
square. k-grams with over ``HOT`` occurrences do not meet in one task: their windows are exchanged by a hash of the
whole window each instead (128 bits of two independent polynomials), which spreads all but windows alike; of these,
each few megabytes of text send one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, keyed, materialize, mix64, powers, slices, text_buffers

GRAM = 128
#: Occurrences of a k-gram that one task merges at most.
HOT = 50_000
#: Distinct suffixes of a group up to which they are held against each other one by one.
FEW = 5
CHUNK = 1 << 21
#: Low bits of a k-gram's hash that give way to its place: the same for every slice, else equal strings in slices of
#: unlike size could get unlike anchors.
PLACE = np.uint64(24)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes that start at each place."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[k:] - sums[:n]) * down[:n])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values on end, by prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    full = -(-len(x) // w) * w
    grid = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, hash, anchor, first and last window) of every anchor, places counted from the row's start.

    ``data`` is cut at 2**24 places at most per call, with the overlap of a window.
    """
    code = gram_hashes(data, k)
    w = window - k + 1
    marked = (code >> PLACE << PLACE) | np.arange(len(code), dtype=np.uint64)
    place = (sliding_least(marked, w) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    if not len(place):
        return (np.zeros(0, np.int64),) * 5
    room = np.maximum(np.diff(ends) - window + 1, 0)
    rows = np.repeat(np.arange(len(room)), room)
    starts = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(ends[:-1], room)
    at = place[starts]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    row = rows[first]
    return row, code[at[first]], at[first] - ends[row], starts[first] - ends[row], starts[last] - ends[row]


def row_anchors(data: np.ndarray, ends: np.ndarray, window: int, k: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(first row, anchors) of slices of rows; very long rows are cut into overlapping pieces whose windows are disjoint.

    An anchor that windows on both sides of a cut share comes once, with all its windows.
    """
    for i, j in slices(ends, CHUNK):
        size = int(ends[j] - ends[i])
        if j > i + 1 or size <= 2 * CHUNK:
            yield i, anchors(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], window, k)
            continue
        held = None
        for s in range(0, size - window + 1, CHUNK):
            t = min(size, s + CHUNK + window - 1)
            row, code, at, lo, hi = anchors(data[ends[i] + s : ends[i] + t], np.array([0, t - s]), window, k)
            at, lo, hi = at + s, lo + s, hi + s
            if held is not None:
                if held[2][-1] == at[0]:
                    lo[0] = held[3][-1]
                    held = tuple(x[:-1] for x in held)
                yield i, held
            held = row, code, at, lo, hi
        yield i, held


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """A front-coded sorted run, decoded as it is read: the suffix, its common prefix with the one before, and the rest."""

    def __init__(self, row: tuple):
        lcp, rest, tails, left_lcp, left_rest, left_tails, counts, ids = row
        self.lcp, self.rest, self.tails = np.frombuffer(lcp, np.int32).tolist(), np.frombuffer(rest, np.int32).tolist(), tails
        self.left_lcp, self.left_rest, self.left_tails = np.frombuffer(left_lcp, np.int32).tolist(), np.frombuffer(left_rest, np.int32).tolist(), left_tails
        self.counts, self.ids = np.frombuffer(counts, np.int32).tolist(), np.frombuffer(ids, np.int64).reshape(-1, 3)
        self.i = self.a = self.b = self.c = 0
        self.text, self.left = b"", b""
        self.step()

    def step(self) -> int:
        """Move on; the common prefix with the suffix before, or -1 at the end (text is None then)."""
        if self.i == len(self.lcp):
            self.text = None
            return -1
        i, n, m = self.i, self.lcp[self.i], self.left_lcp[self.i]
        self.text = self.text[:n] + self.tails[self.a : self.a + self.rest[i]]
        self.left = self.left[:m] + self.left_tails[self.b : self.b + self.left_rest[i]]
        self.owners = self.ids[self.c : self.c + self.counts[i]]
        self.a, self.b, self.c, self.i = self.a + self.rest[i], self.b + self.left_rest[i], self.c + self.counts[i], i + 1
        return n


def front_code(records: list[tuple[bytes, bytes, list]]) -> tuple:
    """The columns of a sorted run of (suffix, reversed left bytes, [(kid, th, anchor)])."""
    lcp, rest, tails, left_lcp, left_rest, left_tails, counts, ids = [], [], [], [], [], [], [], []
    text = left = b""
    for right, back, owners in records:
        n, m = common(text, right, 0), common(left, back, 0)
        lcp.append(n)
        rest.append(len(right) - n)
        tails.append(right[n:])
        left_lcp.append(m)
        left_rest.append(len(back) - m)
        left_tails.append(back[m:])
        counts.append(len(owners))
        ids += owners
        text, left = right, back
    pack32 = lambda x: np.array(x, np.int32).tobytes()
    return pack32(lcp), pack32(rest), b"".join(tails), pack32(left_lcp), pack32(left_rest), b"".join(left_tails), pack32(counts), np.array(ids, np.int64).tobytes()


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    """(common prefix with the one before, suffix, left, owners) in order, by a loser tree over the runs.

    Every entry knows its common prefix with the last winner. Of two entries the one that shares more with it is the
    smaller; only if both share the same are bytes compared, from there on.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    known = [0] * size
    runs = [*runs, *[None] * (size - len(runs))]
    alive = [r is not None and r.text is not None for r in runs]
    losers = [0] * size

    def duel(i: int, j: int) -> tuple[int, int]:
        """(winner, loser)"""
        if not alive[i]:
            return j, i
        if not alive[j]:
            return i, j
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        a, b = runs[i].text, runs[j].text
        n = common(a, b, known[i])
        if n == len(a) or n < len(b) and a[n] < b[n]:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while alive[winner]:
        run = runs[winner]
        yield known[winner], run.text, run.left, run.owners
        n = run.step()
        alive[winner] = n >= 0
        known[winner] = n
        node = (winner + size) // 2
        while node:
            winner, losers[node] = duel(winner, losers[node])
            node //= 2


def resolve(rights: list[bytes], lefts: list[bytes], lcps: list[int], owners: list[list], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(kid, th, first, last): ranges of windows that occur elsewhere too, of suffixes that share a k-gram, in order.

    ``lcps[i]``: common prefix of i and i - 1. A window that reaches a bytes to the left of the anchor occurs at another
    one if the two share a bytes to the left and window - a from the anchor on.
    """
    m = len(rights)
    low = [window - len(r) for r in rights]
    high = [len(x) for x in lefts]
    spans: list[list[tuple[int, int]]] = [[(low[i], high[i])] if len(owners[i]) > 1 else [] for i in range(m)]
    if m <= FEW:
        for i in range(m):
            shared = 1 << 30
            for j in range(i + 1, m):
                shared = min(shared, lcps[j])
                s, t = window - shared, common(lefts[i], lefts[j], 0)
                if s <= t:
                    spans[i].append((s, t))
                    spans[j].append((s, t))
    else:
        right = np.array(lcps)
        right[0] = -1
        order = np.array(sorted(range(m), key=lefts.__getitem__))
        left = np.array([-1] + [common(lefts[i], lefts[j], 0) for i, j in zip(order, order[1:])])
        inside = np.array([len(x) > 1 for x in owners])
        open_ = np.full(m, -1)
        for a in range(min(low), max(high) + 2):
            lc = np.empty(m, np.int64)
            lc[order] = np.cumsum(left < a)
            _, at, count = np.unique(np.cumsum(right < window - a) * (m + 1) + lc, return_inverse=True, return_counts=True)
            dup = (count[at] > 1) & ~inside
            for i in np.flatnonzero(dup & (open_ < 0)):
                open_[i] = a
            for i in np.flatnonzero(~dup & (open_ >= 0)):
                spans[i].append((int(open_[i]), a - 1))
                open_[i] = -1
        for i in np.flatnonzero(open_ >= 0):
            spans[i].append((int(open_[i]), high[i]))
    for i in range(m):
        for s, t in spans[i]:
            s, t = max(s, low[i]), min(t, high[i])
            if s <= t:
                for kid, th, at in owners[i]:
                    yield kid, th, at - t, at - s


RUN = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("lcp", "rest", "tails", "left_lcp", "left_rest", "left_tails", "counts", "ids")]])
RUN_DDL = "part int, lcp binary, rest binary, tails binary, left_lcp binary, left_rest binary, left_tails binary, counts binary, ids binary"
RANGES = pa.schema([("kid", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
RANGES_DDL = "kid long, th long, first long, last long"


def find_anchors(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(kid, th, hash, at, lo, hi) of every anchor of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kid, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kid", "th"))
            data, ends = text_buffers(batch.column("text"))
            for i, (row, code, at, lo, hi) in row_anchors(data, ends, window, k):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kid[i + row], th[i + row], code.view(np.int64), at.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32))], names=["kid", "th", "hash", "at", "lo", "hi"])

    return rows.select("kid", "th", "text").mapInArrow(run, "kid long, th long, hash long, at int, lo int, hi int")


def sorted_runs(rows: DataFrame, window: int, parts: int) -> DataFrame:
    """The front-coded runs of each batch of rows, one for each part; ``rows`` has the anchors as spots (hash, at, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kid, th = batch.column("kid").to_pylist(), batch.column("th").to_pylist()
            data, ends = text_buffers(batch.column("text"))
            text, spots = data.tobytes(), batch.column("spots")
            cuts, fields = spots.offsets.to_numpy() - spots.offsets[0].as_py(), spots.flatten()
            code, at, lo, hi = (fields.field(c).to_numpy(zero_copy_only=False).astype(np.int64).tolist() for c in ("hash", "at", "lo", "hi"))
            held: dict[tuple, list] = {}
            for r in range(batch.num_rows):
                start = int(ends[r])
                seen = set()
                for s in range(cuts[r], cuts[r + 1]):
                    if (x := at[s]) in seen:  # repeated rows gather their anchors twice
                        continue
                    seen.add(x)
                    key = (code[s] % parts, text[start + x : start + hi[s] + window], text[start + lo[s] : start + x][::-1])
                    held.setdefault(key, []).append((kid[r], th[r], x))
            out, part = [], None
            for key in sorted(held):
                if key[0] != part:
                    part = key[0]
                    out.append((part, []))
                out[-1][1].append((key[1], key[2], held[key]))
            coded = [(p, *front_code(records)) for p, records in out]
            if coded:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*coded), RUN)], schema=RUN)

    return rows.mapInArrow(run, RUN_DDL)


def merged(runs: DataFrame, window: int, k: int) -> DataFrame:
    """(kid, th, first, last): ranges of windows that occur elsewhere, from the merged runs of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                held.setdefault(row[0], []).append(row[1:])
        out = []
        for part in list(held):
            rights, lefts, lcps, owners = [], [], [], []
            for n, right, left, own in merge([Run(x) for x in held.pop(part)]):
                if n < k and rights:
                    if len(rights) > 1 or len(owners[0]) > 1:
                        out += resolve(rights, lefts, lcps, owners, window)
                    rights, lefts, lcps, owners = [], [], [], []
                if rights and n == len(right) == len(rights[-1]) and left == lefts[-1]:
                    owners[-1] += own.tolist()
                    continue
                rights.append(right)
                lefts.append(left)
                lcps.append(n)
                owners.append(own.tolist())
            if len(rights) > 1 or owners and len(owners[0]) > 1:
                out += resolve(rights, lefts, lcps, owners, window)
            while len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[:50_000])], schema=RANGES)
                del out[:50_000]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=RANGES)

    return runs.repartition("part").mapInArrow(run, RANGES_DDL)


HOT_ROWS = pa.schema([("part", pa.int32()), ("kid", pa.int64()), ("th", pa.int64()), ("places", pa.binary()), ("hashes", pa.binary())])
HOT_DDL = "part int, kid long, th long, places binary, hashes binary"


#: A random 64-bit number for each byte, so that the second hash of a window is independent of the first one.
SECOND = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hot_windows(rows: DataFrame, window: int, parts: int) -> DataFrame:
    """Hashes (128 bits) and places of the windows of hot anchors, packed by row and part of the hash space.

    Windows that occur twice within a slice of rows are decided there: their places go out without hashes, and of each
    hash one place travels for the other slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kid, th = batch.column("kid").to_pylist(), batch.column("th").to_pylist()
            data, ends = text_buffers(batch.column("text"))
            spots = batch.column("spots")
            cuts, fields = spots.offsets.to_numpy() - spots.offsets[0].as_py(), spots.flatten()
            lo, hi = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            for i, j in slices(ends, CHUNK):
                places, codes, counts = [], [], []
                for r in range(i, j):
                    place = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[cuts[r] : cuts[r + 1]], hi[cuts[r] : cuts[r + 1]])]))
                    raw = data[ends[r] : ends[r + 1]]
                    codes.append(np.stack([gram_hashes(x, window)[place] for x in (raw, SECOND[raw])], axis=1))
                    places.append(place.astype(np.int64))
                    counts.append(len(place))
                place, both, owner = np.concatenate(places), np.concatenate(codes), np.repeat(np.arange(i, j), counts)
                order = np.lexsort((both[:, 1], both[:, 0]))
                same = (both[order[1:]] == both[order[:-1]]).all(axis=1)
                new, twice = np.concatenate([[True], ~same]), np.zeros(len(order), bool)
                twice[order] = ~new | np.concatenate([same, [False]])
                sent = np.sort(order[new])
                out = [(kid[r] % parts, kid[r], th[r], place[(owner == r) & twice].tobytes(), None) for r in np.unique(owner[twice]).tolist()]
                part = (both[sent, 0] % np.uint64(parts)).astype(np.int64)
                group = np.lexsort((part, owner[sent]))
                sent, part = sent[group], part[group]
                first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[sent[1:]] != owner[sent[:-1]])]))
                for s, t in zip(first.tolist(), [*first[1:].tolist(), len(sent)]):
                    r = int(owner[sent[s]])
                    out.append((int(part[s]), kid[r], th[r], place[sent[s:t]].tobytes(), both[sent[s:t]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), HOT_ROWS)], schema=HOT_ROWS)

    return rows.mapInArrow(run, HOT_DDL)


def hot_ranges(packed: DataFrame) -> DataFrame:
    """(kid, th, first, last) of windows that occur twice, from ``hot_windows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[4] is None:
                    place = np.frombuffer(row[3], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(place), row[1]), np.full(len(place), row[2]), place, place)], schema=RANGES)
                else:
                    held.setdefault(row[0], []).append(row[1:])
        for part in list(held):
            rows = held.pop(part)
            place = np.concatenate([np.frombuffer(x[2], np.int64) for x in rows])
            code = np.concatenate([np.frombuffer(x[3], np.uint64).reshape(-1, 2) for x in rows])
            owner = np.repeat(np.arange(len(rows)), [len(x[2]) // 8 for x in rows])
            order = np.lexsort((code[:, 1], code[:, 0]))
            same = (code[order[1:]] == code[order[:-1]]).all(axis=1)
            at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            if len(at):
                kid, th = (np.array([x[i] for x in rows], np.int64)[owner[at]] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kid, th, place[at], place[at])], schema=RANGES)

    return packed.repartition("part").mapInArrow(run, RANGES_DDL)


def remove_repeated_bytes(docs: DataFrame, window: int = 400, gram: int = GRAM, hot: int = HOT, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 for each row of ``docs``.

    A byte of a row's UTF-8 text goes if a string of ``window`` bytes that covers it starts anywhere else too, in this
    row or another; strings are judged on the input. n_spans: maximal removed runs. Null text counts as empty, null ids
    are rows like others, repeated rows repeat each other; an empty table gives an empty result. Other columns are
    ignored. ``parts`` of the k-grams' hashes are merged one by one, eight for each shuffle partition by default.
    """
    parts = parts or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, id_col, text_col).select("kid", "th", "text")
    every = find_anchors(rows, window, gram)
    # written out, so that the join reads two plain exchanges and a hot k-gram's rows can be split
    twice = materialize(every.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1"), "grams")
    found = every.join(twice, "hash")
    spots = F.struct("hash", "at", "lo", "hi")
    by_row = found.groupBy("kid", "th").agg(F.collect_list(F.when(F.col("times") <= hot, spots)).alias("spots"), F.collect_list(F.when(F.col("times") > hot, spots)).alias("hot"))
    both = rows.join(by_row, ["kid", "th"])
    runs = sorted_runs(both.where(F.size("spots") > 0).select("kid", "th", "text", "spots"), window, parts)
    ranges = merged(runs, window, gram)
    ranges = ranges.unionByName(hot_ranges(hot_windows(both.where(F.size("hot") > 0).select("kid", "th", "text", F.col("hot").alias("spots")), window, parts)))
    gone = ranges.groupBy("kid", "th").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    doc_id = F.when(F.col("kid") != NO_ID, F.col("kid")).alias("doc_id")
    last = rows.join(gone, ["kid", "th"], "left").select(doc_id, "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column("text"))
            lists = batch.column("gone")
            cuts, fields = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            first, final = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            out = []
            for r in range(batch.num_rows):
                raw = data[ends[r] : ends[r + 1]]
                spans, keep = 0, raw
                if valid[r] and cuts[r + 1] > cuts[r]:
                    change = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(change, first[cuts[r] : cuts[r + 1]], 1)
                    np.add.at(change, final[cuts[r] : cuts[r + 1]] + window, -1)
                    off = np.cumsum(change[:-1]) > 0
                    spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
                    keep = raw[~off]
                kept = keep.tobytes()
                out.append((len(raw), len(raw) - len(keep), spans, kept, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return last.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
