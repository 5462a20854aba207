"""Near-duplicate documents by SetSketch registers (Ertl 2021), locality-sensitive bands, and exact confirmation.

A register is 1 - log_b of the minimum of exponential variates over a document's shingles, rounded down: registers of a
union are the larger ones, and two sets agree in a register with a probability that follows their similarity. Documents
of equal sets are one class from the start. Classes that agree in all registers of a band meet in a bucket; the number
of shared, larger and smaller registers gives the likelihood of the similarity, and pairs for which the threshold is
out of the question go; the others are confirmed on their full sets.

No bucket is expanded into its pairs: first every class is held against the one centre that it meets most often, then
against the other centres of its buckets if their components still differ, and what is apart after that is compared
block by block on full sets. Links that would join what is joined already are not looked for; no other is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, files_for, keyed, materialize, mix64, slices, text_buffers, word_hashes

BASE = 1.001
BANDS, ROWS = 40, 5
#: Members compared with a centre in one group at most.
GROUP = 128
#: Members of a block where what is still apart is compared.
BLOCK = 256
#: Bytes of text that are hashed at once, one text at least.
CHUNK = 1 << 18


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words on end; of the whole sequence where there are fewer words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    code = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        code = code * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return np.unique(mix64(code))


def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2021)
    return rng.integers(0, 1 << 31, k, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.int64).astype(np.uint32)


def registers(codes: np.ndarray, multiply: np.ndarray, add: np.ndarray, base: float = BASE) -> np.ndarray:
    """SetSketch registers of a set of 64-bit codes: truncated logarithms of minima, 0 to 65535."""
    low = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    short = (codes >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 17) // len(multiply))
    for i in range(0, len(short), step):
        h = multiply[:, None] * short[None, i : i + step]
        h += add[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(least) / np.log(base)) + 4000, 0, 65535).astype(np.uint16)


def likelihood(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray, base: float = BASE) -> np.ndarray:
    """Log likelihood of each similarity of ``grid`` (columns) given how the registers of two sets of known sizes compare."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    g = np.minimum(grid[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    more, less = np.maximum(p(u - v * g), 1e-12), np.maximum(p(v - u * g), 1e-12)
    return larger[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal[:, None] * np.log(np.maximum(1 - more - less, 1e-12))


def sketch(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text), n, digest (of the shingle set; null if empty), reg (registers, 16 bits each) of each row."""
    source = keyed(docs, id_col, text_col).select("doc_id", "th", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiply, add = _constants(bands * rows)
        for batch in batches:
            data, ends = text_buffers(batch.column("text"))
            counts, digests, regs = [], [], []
            for i, j in slices(ends, CHUNK):
                words, cut = word_hashes(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], True)
                for k in range(j - i):
                    codes = shingles(words[cut[k] : cut[k + 1]], width)
                    counts.append(len(codes))
                    digests.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None)
                    regs.append(registers(codes, multiply, add).tobytes() if len(codes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "th", "n", "digest", "reg"])

    return source.mapInArrow(run, "doc_id long, th long, n long, digest binary, reg binary")


def band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(cid, band, key) for each class and band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.substring(F.col("reg"), i * (2 * rows) + 1, F.lit(2 * rows)), i))
    return classes.select("cid", F.posexplode(keys).alias("band", "key"))


def plausible(pairs: DataFrame, classes: DataFrame, share: float, doubt: float = 30.0) -> DataFrame:
    """Those of the pairs (a, b) whose registers do not rule out a similarity of ``share``."""
    a = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("reg").alias("ra"))
    b = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("reg").alias("rb"))
    # sizes alone bound the similarity
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * (share - 1e-9)).select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.linspace(0.02, 1, 99)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            counts = [(x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1)]
            every = likelihood(*counts, *sizes, grid)
            at = likelihood(*counts, *sizes, np.array([share]))[:, 0]
            keep = (grid[every.argmax(axis=1)] >= share) | (2 * (every.max(axis=1) - at) <= doubt)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, n, codes): the sorted shingle codes, 64 bits each, of the classes ``wanted`` (cid, rep, th).

    Repeated rows of a class's document give its set once for each task that meets them.
    """
    # the texts stream past a table of a part's classes, so they are never held and sorted
    source = keyed(docs, id_col, text_col).select(F.col("doc_id").alias("rep"), "th", "text").join(wanted.hint("shuffle_hash"), ["rep", "th"]).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, ends = text_buffers(batch.column("text"))
            ids = batch.column("cid").to_pylist()
            for i, j in slices(ends, CHUNK):
                words, cut = word_hashes(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], True)
                out = {"cid": [], "codes": []}
                for k in range(j - i):
                    if ids[i + k] not in seen:
                        seen.add(ids[i + k])
                        out["cid"].append(ids[i + k])
                        out["codes"].append(shingles(words[cut[k] : cut[k + 1]], width).tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("cid", pa.int64()), ("codes", pa.binary())]))

    return source.mapInArrow(run, "cid long, codes binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) with 100 * intersection >= percent * union.

    A centre's set travels once for each group of at most about GROUP of its pairs, a member's once for each pair.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / GROUP).cast("long")
    split = many.select("a", parts.alias("parts"))
    right = pairs.join(split, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    right = right.join(sets, pairs["b"] == sets["cid"]).select("a", "part", "b", "codes")
    left = split.join(sets, split["a"] == sets["cid"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "codes")

    def run(table: pa.Table) -> pa.Table:
        out, centre = [], None
        for b, codes in zip(table.column("b").to_pylist(), table.column("codes").to_pylist()):
            if b is None:
                centre = np.frombuffer(codes, np.uint64)
        for a, b, codes in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), table.column("codes").to_pylist()):
            if b is not None and centre is not None:
                x = np.frombuffer(codes, np.uint64)
                both = len(np.intersect1d(centre, x, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(x) - both):
                    out.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return left.unionByName(right).groupBy("a", "part").applyInArrow(run, "a long, b long")


def across(apart: DataFrame, sets: DataFrame, percent: int, files: int | None = None) -> DataFrame:
    """Links (a, b) between members of one group ``lo`` with different labels, enough to join all that links join.

    ``apart``: lo, cid, label, n. Sets whose sizes differ by more than the threshold allows are not alike, so a group is cut
    into grades of size, and a grade meets itself and the next one. Grades are cut into blocks of about BLOCK members,
    and two blocks are compared as a product of incidence matrices: a member's set travels once for each block of its
    grade and the ones beside it, and no pair is emitted but the links kept.
    """
    step = -math.log(percent / 100)
    apart = apart.withColumn("grade", F.floor(F.log("n") / (step + 1e-9)).cast("long") if step > 0 else F.col("n"))
    sizes = apart.groupBy("lo", "grade").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    above = sizes.select("lo", (F.col("grade") - 1).alias("grade"), F.col("blocks").alias("more"))
    below = sizes.select("lo", (F.col("grade") + 1).alias("grade"), F.col("blocks").alias("fewer"))
    sizes = sizes.join(above, ["lo", "grade"], "left").join(below, ["lo", "grade"], "left").fillna(0, ["more", "fewer"])
    sizes = materialize(sizes, "sizes", files=files)  # so that the planner knows how few they are
    rows = apart.join(sizes, ["lo", "grade"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks"))).join(sets, "cid")
    # a block (grade, number); the smaller of two comes first
    me = F.struct(F.col("grade").alias("g"), F.col("own").alias("b"))
    every = lambda grade, parts: F.when(parts > 0, F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda b: F.struct(grade.alias("g"), b.alias("b")))).otherwise(F.array().cast("array<struct<g:bigint,b:bigint>>"))
    others = F.concat(every(F.col("grade") - 1, F.col("fewer")), every(F.col("grade"), F.col("blocks")), every(F.col("grade") + 1, F.col("more")))
    rows = rows.withColumn("me", me).withColumn("other", F.explode(others))
    rows = rows.select("lo", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), (F.col("me") <= F.col("other")).alias("first"), (F.col("me") >= F.col("other")).alias("second"), F.col("cid").alias("rep"), "label", "codes")

    def run(table: pa.Table) -> pa.Table:
        reps, labels, one, two = (table.column(c).to_numpy() for c in ("rep", "label", "first", "second"))
        if (labels == labels[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]
        left, right = np.flatnonzero(one), np.flatnonzero(two)
        size = np.array([len(x) for x in sets_], np.int64)
        codes = np.concatenate(sets_)
        owner = np.repeat(np.arange(len(sets_)), size)
        _, column, df = np.unique(codes, return_inverse=True, return_counts=True)
        shared = df[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            s, t = np.searchsorted(column, [c, c + 4096])
            part = np.zeros((len(sets_), 4096), np.float32)
            part[owner[s:t], column[s:t] - c] = 1
            both += part[left] @ part[right].T
        linked = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
        linked &= labels[left][:, None] != labels[right][None, :]
        parent = {x: x for x in labels.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked)):
            p, q = root(int(labels[left[x]])), root(int(labels[right[y]]))
            if p != q:
                parent[p] = q
                out.append((int(reps[left[x]]), int(reps[right[y]])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return rows.groupBy("lo", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Sets of ``width``-word shingles (A-Z in lower case); links at 100 * intersection >= percent * union, confirmed on
    full sets; component_id is the smallest id that links reach. Null or wordless texts: no shingles, own component.
    Rows with a null id are linked with nothing: component null, kept. Rows with words that share an id are one node, with
    the links of all their texts, and count their own shingles. Repeated rows and empty tables are allowed; other columns
    are ignored. With the default 40 bands of 5 registers, a pair meets in no bucket with a probability of 1e-7 at a
    similarity of 0.8 and of 7e-11 at 0.85.
    """
    rows_ = materialize(sketch(docs, width, bands, rows, id_col, text_col), "sketch")
    files = files_for(rows_)
    linked = rows_.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("d"), F.first("n").alias("n"), F.first("reg").alias("reg"))
    # written with its number, which tells classes apart whose smallest document is the same
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), F.col("d.doc_id").alias("rep"), F.col("d.th").alias("th"), "digest", "n", "reg"), "classes", files=files)
    keys = band_keys(classes, bands, rows)
    centres = keys.groupBy("band", "key").agg(F.min("cid").alias("centre"), F.count("*").alias("size")).where("size > 1").drop("size")
    met = materialize(keys.join(centres, ["band", "key"]).select("band", "key", "cid", "centre"), "buckets", files=files)
    stars = met.where("cid <> centre").groupBy(F.col("centre").alias("a"), F.col("cid").alias("b")).agg(F.count("*").alias("times"))
    stars = materialize(plausible(stars, classes, percent / 100).join(stars, ["a", "b"]).distinct(), "stars", files=files)
    best = stars.groupBy("b").agg(F.max(F.struct("times", (-F.col("a")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")
    ids = met.select("cid").distinct()
    sets = materialize(full_sets(docs, classes.join(ids, "cid").select("cid", "rep", "th"), width, id_col, text_col), "sets", files=files)
    done = materialize(confirm(best, sets, percent), "links", files=files)
    rest = _apart(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), _hops(done))
    links = materialize(confirm(rest, sets, percent).unionByName(done), "links", files=files)
    labels = materialize(connected_components(links, files=files), "labels", files=files)
    named = classes.select("cid", "rep", "n", "digest").join(labels.toDF("cid", "component"), "cid", "left").withColumn("label", F.coalesce("component", "cid")).drop("component")
    named = materialize(named, "named", files=files)
    here = met.select("band", "key", "cid").join(named.select("cid", "label", "n"), "cid")
    mixed = here.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("hi")
    apart = materialize(here.join(mixed, ["band", "key"]).select("lo", "cid", "label", "n").distinct(), "apart", files=files)
    # what is left to join are labels: by links across them, and by ids that have texts of several
    found, of = across(apart, sets, percent, files), named.select("cid", "label")
    found = found.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    texts = linked.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    several = linked.join(texts, "doc_id").join(named.select("digest", "label"), "digest").select("doc_id", "label").distinct()
    least = several.groupBy("doc_id").agg(F.min("label").alias("a"))
    more = materialize(found.unionByName(several.join(least, "doc_id").select("a", F.col("label").alias("b"))).where("a <> b").distinct(), "more", files=files)
    if not more.isEmpty():
        joined = connected_components(more, files=files).toDF("label", "to")
        named = named.join(joined, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = materialize(named.select("digest", "label").join(least, "label").select("digest", "component_id"), "final", files=files)
    out = rows_.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(final, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def _hops(links: DataFrame) -> DataFrame:
    """(node, component): the centre that a member is linked to, or the one that this one is linked to; a part of the whole."""
    one = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    two = one.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return one.join(two, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs whose ends are not in one component."""
    a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    return out.where(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b")
