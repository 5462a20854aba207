"""Substring deduplication with fixed-block anchors over words.

A window of W consecutive words holds a whole block of B = (W + 1) // 2 words at a multiple of B in any document. So
the non-overlapping blocks of the reference documents are indexed, every rolling window of B words of every document
probes the index, and hits are extended on either side: each window of W words around a hit, or around a block that was
hit, is compared as a whole, and the windows that start in a smaller document too merge into maximal repeats.

Probes travel packed: a task sends one blob of hash bytes, places and documents to each part of the hash space. A hash
is aggregated to its smallest block and its largest probe, first within a few megabytes of text and then where it lands:
what is decided on the spot goes out as such, and of a passage that every document holds only the smallest documents of
each of these slices and one larger one meet in its part. Its occurrences are never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, keyed, mix64, slices, text_buffers, word_hashes, word_spans

#: Bytes of text that a task packs at once. Blobs hold CHUNK / 6 / parts entries each: raise it with the parts.
CHUNK = 1 << 22


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that start at each place."""
    count = len(words) - n + 1
    code = np.zeros(max(0, count), np.uint64)
    for i in range(n if count > 0 else 0):
        code *= np.uint64(0xD6E8FEB86659FD93)
        code += words[i : i + count]
    return mix64(code)


def shuffled(x: np.ndarray) -> bytes:
    """Differences of 64-bit integers, all first bytes first, then all second ones, compressed; their number before."""
    step = np.diff(x, prepend=np.int64(0)).astype(np.int64)
    return len(x).to_bytes(4, "little") + pa.compress(step.view(np.uint8).reshape(len(x), 8).T.tobytes(), "zstd", asbytes=True)


def unshuffled(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    step = np.frombuffer(pa.decompress(raw[4:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.cumsum(step.reshape(8, n).T.copy().view(np.int64).ravel())


def part_bits(df: DataFrame) -> int:
    """Bits of a hash that choose its part: about four to eight parts for each shuffle partition, 128 at least."""
    return min(20, max(7, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2))


def pack(bits: int, ids: np.ndarray, counts: np.ndarray, places: np.ndarray, hashes: np.ndarray, more: np.ndarray | None = None) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """(part, documents, entries of each, places, hashes) for each part that has entries; documents in the given order."""
    owner = np.repeat(np.arange(len(ids)), counts)
    part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
    tail = hashes << np.uint64(bits)
    if more is None:  # 32 bits beside the part's: a rare false hit only means more windows to compare
        tail = (tail >> np.uint64(32)).view(np.uint8).reshape(-1, 8)[:, :4]
    else:  # 72 bits beside the part's
        tail = np.hstack([tail.view(np.uint8).reshape(-1, 8), more.view(np.uint8).reshape(-1, 8)[:, :1]])
    for p in range(1 << bits):
        at = order[cuts[p] : cuts[p + 1]]
        if len(at):
            own = owner[at]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            yield p, shuffled(ids[own[new]]), shuffled(np.diff(np.append(new, len(own)))), shuffled(places[at]), tail[at].T.tobytes()


def repeats(code: np.ndarray) -> np.ndarray:
    """The places of the codes that occur more than once."""
    s = np.sort(code)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    marked = np.zeros(1 << 22, bool)
    marked[(twice >> np.uint64(42)).astype(np.int64)] = True
    maybe = np.flatnonzero(marked[(code >> np.uint64(42)).astype(np.int64)])
    at = np.searchsorted(twice, code[maybe])
    at[at == len(twice)] = 0
    return maybe[twice[at] == code[maybe]]


def met_here(docs: np.ndarray, anchored: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hits, entries that need not travel) among a slice's own entries.

    An entry is a hit beside a smaller document's block, a block also beside a larger document. Of each code the
    smallest block and the largest document travel, and all that are not decided.
    """
    hit, stay = np.zeros(len(code), bool), np.zeros(len(code), bool)
    dup = repeats(code)
    if len(dup):
        _, at = np.unique(code[dup], return_inverse=True)
        own, block = docs[dup], anchored[dup]
        least, most = np.full(at.max() + 1, np.iinfo(np.int64).max), np.full(at.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, at[block], own[block])
        np.maximum.at(most, at, own)
        here = (own > least[at]) | block & (own < most[at])
        hit[dup] = here
        stay[dup] = here & ~(block & (own == least[at])) & (own < most[at])
    return hit, stay


def decided(bits: int, ids: np.ndarray, counts: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, None]]:
    """Rows like ``pack``'s without hashes: entries that are decided, dealt by their documents."""
    owner = np.repeat(np.arange(len(ids)), counts)
    part = (mix64(ids.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    for p in np.unique(part[counts > 0]):
        mine = part == p
        yield int(p), shuffled(ids[mine]), shuffled(counts[mine]), shuffled(places[mine[owner]]), None


PACKED = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary())])
PACKED_DDL = "part int, docs binary, counts binary, places binary, hashes binary"


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(documents, places, hashes) of each part of a partition; hashes as ``width`` bytes in one void column or as numbers.

    Decided entries come first, without hashes.
    """
    held: dict[int, list] = {}
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if row[4] is None:
                yield np.repeat(unshuffled(row[1]), unshuffled(row[2])), unshuffled(row[3]), None
            else:
                held.setdefault(row[0], []).append(row[1:])
    for part in list(held):
        rows = held.pop(part)
        docs = np.concatenate([np.repeat(unshuffled(d), unshuffled(c)) for d, c, _, _ in rows])
        places = np.concatenate([unshuffled(x) for _, _, x, _ in rows])
        raw = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1).T for _, _, _, x in rows])
        if width <= 8:
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :width] = raw
            yield docs, places, wide.view(np.uint64).ravel()
        else:
            low = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
            high = np.zeros((len(raw), 8), np.uint8)
            high[:, : width - 8] = raw[:, 8:]
            yield docs, places, np.rec.fromarrays([low, high.view(np.uint64).ravel()], names="a,b")


def by_document(docs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each document's distinct places, as 64-bit numbers."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    for s, t in zip(cuts, [*cuts[1:], len(docs)]):
        yield int(docs[s]), places[s:t].astype(np.int64).tobytes()


def _places(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pydict({"kid": [r[0] for r in rows[i : i + 10_000]], "places": [r[1] for r in rows[i : i + 10_000]]}, schema=pa.schema([("kid", pa.int64()), ("places", pa.binary())]))


def probes(docs: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """Every rolling window of ``block`` words, packed; documents too short for a window have none to match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("kid").to_numpy(zero_copy_only=False)
            data, ends = text_buffers(batch.column("text"))
            for i, j in slices(ends, CHUNK):
                words, cut = word_hashes(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], False)
                code = rolling(words, block)
                n = np.diff(cut)
                n = np.where((n >= window) & (ids[i:j] != NO_ID), n - block + 1, 0)
                at = np.concatenate([np.arange(s, s + k) for s, k in zip(cut[:-1], n)]) if n.sum() else np.zeros(0, np.int64)
                place, owner = at - np.repeat(cut[:-1], n), np.repeat(np.arange(j - i), n)
                hit, stay = met_here(ids[i:j][owner], place % block == 0, code[at])
                rows = list(decided(bits, ids[i:j], np.bincount(owner[hit], minlength=j - i), place[hit]))
                rows += pack(bits, ids[i:j], np.bincount(owner[~stay], minlength=j - i), place[~stay], code[at[~stay]])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)

    return docs.select("kid", "text").mapInArrow(run, PACKED_DDL)


def hits(packed: DataFrame, block: int) -> DataFrame:
    """(kid, places): probes that meet a block of a smaller document, and blocks that a larger document's probe meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for docs, places, code in unpacked(batches, 4):
            if code is None:
                rows += by_document(docs, places)
                continue
            anchored = places % block == 0
            index, at = np.unique(code[anchored], return_inverse=True)
            least = np.full(len(index), np.iinfo(np.int64).max)
            np.minimum.at(least, at, docs[anchored])
            found = np.searchsorted(index, code)
            found[found == len(index)] = 0
            met = index[found] == code if len(index) else np.zeros(len(code), bool)
            docs, places, found, anchored = docs[met], places[met], found[met], anchored[met]
            most = np.full(len(index), np.iinfo(np.int64).min)
            np.maximum.at(most, found, docs)
            keep = (docs > least[found]) | anchored & (docs < most[found])
            rows += by_document(docs[keep], places[keep])
        yield from _places(rows)

    return packed.repartition("part").mapInArrow(run, "kid long, places binary")


def windows(docs: DataFrame, near: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """Every window of ``window`` words that holds a hit, packed with its hash; each once."""
    both = docs.join(near, "kid").select("kid", "th", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("kid").to_numpy(zero_copy_only=False)
            tags = (batch.column("th").to_numpy(zero_copy_only=False) & 0xFFFF) << 32  # tells texts apart that share an id
            near_ = batch.column("places").to_pylist()
            data, ends = text_buffers(batch.column("text"))
            for i, j in slices(ends, CHUNK):
                words, cut = word_hashes(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], False)
                code, more = rolling(words, window), rolling(mix64(words + np.uint64(0x632BE59BD9B4E019)), window)
                starts = []
                for k in range(i, j):
                    last = int(cut[k - i + 1] - cut[k - i]) - window
                    reach = np.zeros(max(0, last + 1) + 1, np.int32)
                    if last >= 0:
                        p = np.concatenate([np.frombuffer(x, np.int64) for x in near_[k]])
                        np.add.at(reach, np.clip(p - (window - block), 0, last + 1), 1)
                        np.add.at(reach, np.clip(p + 1, 0, last + 1), -1)
                    starts.append(np.flatnonzero(np.cumsum(reach[:-1]) > 0))
                n = np.array([len(s) for s in starts])
                place = np.concatenate(starts) if len(starts) else np.zeros(0, np.int64)
                at = place + np.repeat(cut[:-1], n)
                place, owner = place + np.repeat(tags[i:j], n), np.repeat(np.arange(j - i), n)
                later = np.zeros(len(at), bool)  # windows that a smaller document of the slice starts too
                dup = repeats(code[at])
                if len(dup):
                    own, a, b = ids[i:j][owner[dup]], code[at[dup]], more[at[dup]]
                    order = np.lexsort((own, b, a))
                    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
                    later[dup[order]] = own[order] > own[order][np.maximum.accumulate(np.where(new, np.arange(len(dup)), 0))]
                rows = list(decided(bits, ids[i:j], np.bincount(owner[later], minlength=j - i), place[later]))
                rows += pack(bits, ids[i:j], np.bincount(owner[~later], minlength=j - i), place[~later], code[at[~later]], more[at[~later]])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)

    return both.mapInArrow(run, PACKED_DDL)


def repeated(packed: DataFrame) -> DataFrame:
    """(kid, places): windows whose words start in a smaller document too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for docs, places, code in unpacked(batches, 9):
            if code is None:
                rows += by_document(docs, places)
                continue
            order = np.lexsort((docs, code.b, code.a))
            a, b, own = code.a[order], code.b[order], docs[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            least = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
            later = order[own > least]
            rows += by_document(docs[later], places[later])
        yield from _places(rows)

    return packed.repartition("part").mapInArrow(run, "kid long, places binary")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_text, kept_sha256 for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. kept_text:
    the words left, joined by one space. Null and empty texts have no words. Rows with a null id are smaller or larger
    than none: nothing goes from them, nor because of them. Rows that share an id do not take from each other. An empty table gives an empty result; other columns are ignored.
    """
    block = (window + 1) // 2
    # both joins read the same columns, so that the texts are exchanged once
    rows = keyed(docs, id_col, text_col).select("kid", "th", "text")
    gather = lambda df: df.groupBy("kid").agg(F.collect_list("places").alias("places"))
    bits = part_bits(docs)
    near = gather(hits(probes(rows, window, block, bits), block))
    over = gather(repeated(windows(rows, near, window, block, bits)))
    both = rows.join(over, "kid", "left").select("kid", "th", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("kid").to_pylist(), batch.column("places").to_pylist()
            tags = batch.column("th").to_numpy(zero_copy_only=False) & 0xFFFF
            data, ends = text_buffers(batch.column("text"))
            out = []
            for i in range(batch.num_rows):
                raw = data[ends[i] : ends[i + 1]]
                starts, stops, _ = word_spans(raw, np.array([0, len(raw)]))
                gone = np.zeros(len(starts) + 1, np.int32)
                for x in places[i] or ():
                    s = np.frombuffer(x, np.int64)
                    s = s[s >> 32 == tags[i]] & 0xFFFFFFFF
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                text = raw.tobytes()
                kept = b" ".join([text[s:t] for s, t in zip(starts[~gone].tolist(), stops[~gone].tolist())])
                out.append((None if ids[i] == NO_ID else ids[i], len(starts), int(gone.sum()), spans, kept.decode(), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, n_spans long, kept_text string, kept_sha256 string")
