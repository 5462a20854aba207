"""What the training-data operators share: table access, shared scratch tables, Arrow text batches, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of the contracts: a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's readers open the path, so it may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir). Only a local session, as in tests, may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "granary-checkpoints")
    return base.rstrip("/")


_scope: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession, what: str) -> Iterator[None]:
    """Scratch tables written inside go when it ends, so what is read from them must be written elsewhere by then."""
    _scope.append(f"{what}-{uuid.uuid4().hex}")
    path = f"{scratch_dir(spark)}/granary/{_scope[-1]}"
    try:
        yield
    finally:
        _scope.pop()
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table or folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Files that a scratch table is worth: one for so many bytes, and for each core so many in any case.
FILE_BYTES, CORE_FILES = 1 << 20, 6


def files_for(table: DataFrame) -> int:
    """The files that tables about as large as the scratch table ``table`` are worth.

    Each file costs a task, folders, and on local disks without Hadoop's native library a process for every permission
    set, a fork of the executor; a shuffle of many near-empty partitions would write one for each.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(CORE_FILES * table.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def materialize(df: DataFrame, what: str, outside: bool = False, files: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back; ``outside`` of any scope, in at most so many ``files``."""
    return _written(df, what, outside, files)[0]


def _written(df: DataFrame, what: str, outside: bool = False, files: int | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = "/".join([scratch_dir(spark), "granary", *([] if outside else _scope[-1:]), f"{what}-{uuid.uuid4().hex}"])
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Stands for a null id in (kid, th) keys.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kid, th, text): text null as empty, kid the id or NO_ID, th a hash of the text.

    Rows alike in (kid, th) have the same text, so that pair serves as the row's key in joins: each copy still counts as
    a row of its own wherever it is scanned, and each gets the result of the key.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return slim.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("kid"), F.xxhash64("text").alias("th"), "text")


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole Arrow string column, and the n + 1 offsets of its rows; no copy for one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes together, one row at least."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def connected_components(edges: DataFrame, rounds: int = 60, files: int | None = None) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b): the smallest node that can be reached; nodes that are it do not appear.

    Alternating large-star and small-star (Kiveris et al. 2014): every round is two shuffles that keep each edge
    once; neighbours of a node are never gathered, only their minimum. Rounds grow with the logarithm of the diameter.
    """
    spark = edges.sparkSession
    edges, path = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", files=files)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = mark(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, old = now, path
        edges, path = _written(small, "cc", files=files)
        discard(spark, old)
        now = mark(edges)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n (kept, in sizes of powers of two)."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[size]


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word, and the rows' offsets in these; words do not cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~SPACE[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = inside[first]
    closes[first[1:] - 1] |= inside[first[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (``lower``: A-Z as a-z), and the rows' offsets in these."""
    starts, stops, cut = word_spans(data, ends)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)), cut
