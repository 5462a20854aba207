"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: every inner node has a random direction and the sample's median along it.
Every row is indexed by its leaf in every tree. A query walks all trees at once through one priority queue that holds
nodes by how far the query lies beyond their splits, and opens leaves until these hold ``probe`` times all rows
(rows that lie in opened leaves of several trees count in each), ``least`` rows at least. The rows of the opened leaves
are ranked exactly.

Inner products of vectors of any length become angles by one more coordinate, sqrt(longest² - length²) for rows and 0
for queries. Queries, a stated set, and rows meet in blocks of bounded size, so no leaf, however full, and no query is
one task's: a row travels once for each block of queries. In a block every leaf is a set of bits over the block's rows,
so that a query's candidates are the union of the bits of its opened leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TREES = 16
#: Rows of the sample that the trees are fitted on, at most, and of it in a leaf, about.
SAMPLE, LEAF = 16384, 64
#: Queries and rows of a block.
QUERY_BLOCK, ROW_BLOCK = 4096, 16384
#: Rows in the leaves that a query opens, counted in each tree: of all rows, and at least.
PROBE, LEAST = 1.0, 4096
#: Queries whose products with a block's rows are held at once.
SLICE = 64


class Forest:
    """planes[tree, node] and cuts[tree, node] of inner nodes 1 .. 2**depth - 1; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        self.longest, self.depth = longest, max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
        self.leaves = 1 << self.depth
        rng = np.random.default_rng(seed)
        x = self.lift(sample)
        self.planes = rng.normal(size=(trees, self.leaves, x.shape[1])).astype(np.float32)
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, self.leaves), np.float32)
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", x, self.planes[t][node])
                for k in np.unique(node):
                    self.cuts[t, k] = np.median(along[node == k])
                node = 2 * node + (along > self.cuts[t][node])

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]]).astype(np.float32) / np.float32(self.longest or 1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row (rows x trees)."""
        x = self.lift(x)
        out = np.empty((len(x), len(self.planes)), np.int16)
        for t in range(len(self.planes)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", x, self.planes[t][node]) > self.cuts[t][node])
            out[:, t] = node - self.leaves
        return out

    def search(self, query: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
        """The leaves (trees x leaves, boolean) that the queue opens until they hold ``budget`` rows."""
        size = np.linalg.norm(query) or 1.0
        margins = self.planes[:, :, :-1] @ (query / size).astype(np.float32) - self.cuts
        margins = margins.tolist()
        opened = np.zeros((len(self.planes), self.leaves), bool)
        queue = [(0.0, t, 1) for t in range(len(self.planes))]
        got = 0
        while queue and got < budget:
            cost, t, node = heapq.heappop(queue)
            if node >= self.leaves:
                opened[t, node - self.leaves] = True
                got += counts[t, node - self.leaves]
                continue
            m = margins[t][node]
            beyond = cost + m * m
            heapq.heappush(queue, (beyond if m > 0 else cost, t, 2 * node))
            heapq.heappush(queue, (cost if m > 0 else beyond, t, 2 * node + 1))
        return opened


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that take part: an id, and finite components that are not all zero."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(finite & F.exists("x", lambda v: v != 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def leaf_bits(leaf: np.ndarray, leaves: int) -> np.ndarray:
    """Packed bits over the rows for each leaf of each tree, from the leaves of each row (rows x trees)."""
    out = np.empty((leaf.shape[1] * leaves, -(-len(leaf) // 8)), np.uint8)
    for t in range(leaf.shape[1]):
        member = np.zeros((leaves, len(leaf)), bool)
        member[leaf[:, t], np.arange(len(leaf))] = True
        out[t * leaves : (t + 1) * leaves] = np.packbits(member, axis=1)
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = TREES, probe: float = PROBE, least: int = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row that meets ``queries``.

    ``queries`` reads the column vec_id. Vectors that are null, empty or all zero, hold null or non-finite components,
    have no id, or a length other than the most common one take no part. Rows with a query's id are its own and are not
    found by it; repeated queries are one. Ties go to the smaller vec_id; scores are in double precision. Fewer than
    ``k`` candidates are all returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64  # as the vectors came: nothing is rounded
    rows = usable(vectors, id_col, vector_col)
    shape = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("longest")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], empty)
    dim, n, longest = shape["d"], shape["n"], shape["longest"]
    rows = rows.where(F.size("x") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    forest = spark.sparkContext.broadcast(Forest(np.array(sample["x"].tolist(), np.float64), longest, trees))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = forest.value.leaf_of(matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in matrix(batch.column("x")).astype(kind)], pa.binary()), pa.array([v.tobytes() for v in leaf], pa.binary())], names=["vec_id", "x", "leaf"])

    index = materialize(rows.mapInArrow(place, "vec_id long, x binary, leaf binary"), "index")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, forest.value.leaves), np.int64)
        for batch in batches:
            leaf = np.frombuffer(b"".join(batch.column("leaf").to_pylist()), np.int16).reshape(-1, trees)
            for t in range(trees):
                total[t] += np.bincount(leaf[:, t], minlength=total.shape[1])
        t, leaf = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(total[t, leaf])], names=["t", "leaf", "n"])

    full = np.zeros((trees, forest.value.leaves), np.int64)  # trees x leaves numbers, whatever the rows
    for r in index.select("leaf").mapInArrow(tally, "t int, leaf int, n long").groupBy("t", "leaf").agg(F.sum("n").alias("n")).collect():
        full[r["t"], r["leaf"]] = r["n"]
    counts = spark.sparkContext.broadcast(full)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").to_pylist()
            opened = [np.packbits(forest.value.search(np.frombuffer(v, kind).astype(np.float64), counts.value, max(least, probe * n))).tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(x, pa.binary()), pa.array(opened, pa.binary())], names=["vec_id", "x", "opened"])

    asked = index.where(queries).dropDuplicates(["vec_id"]).select("vec_id", "x")
    asked = asked.repartition(max(1, min(1 << 14, n // 2048)), F.xxhash64("vec_id"))  # walks are long: more tasks than the bytes call for
    asked = materialize(asked.mapInArrow(walk, "vec_id long, x binary, opened binary"), "asked")
    q_blocks, r_blocks = -(-max(1, asked.count()) // QUERY_BLOCK), -(-n // ROW_BLOCK)
    block = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.withColumn("q", block(1, q_blocks)).withColumn("r", every(r_blocks))
    right = index.withColumn("r", block(2, r_blocks)).withColumn("q", every(q_blocks))

    def rank(asked_: pa.Table, rows_: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if asked_.num_rows and rows_.num_rows:
            ids = rows_.column("vec_id").to_numpy()
            x = np.frombuffer(b"".join(rows_.column("x").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
            asked_ids = asked_.column("vec_id").to_pylist()
            wanted = np.frombuffer(b"".join(asked_.column("x").to_pylist()), kind).reshape(len(asked_ids), -1).astype(np.float64)
            opened = asked_.column("opened").to_pylist()
            leaf = np.frombuffer(b"".join(rows_.column("leaf").to_pylist()), np.int16).reshape(len(ids), -1)
            members = leaf_bits(leaf, forest.value.leaves)
            for i in range(0, len(asked_ids), SLICE):
                products = wanted[i : i + SLICE] @ x.T
                for j, near in enumerate(products, i):
                    leaves = np.flatnonzero(np.unpackbits(np.frombuffer(opened[j], np.uint8), count=len(members)))
                    bits = np.bitwise_or.reduce(members[leaves], axis=0) if len(leaves) else np.zeros(members.shape[1], np.uint8)
                    found = np.flatnonzero(np.unpackbits(bits, count=len(ids)))
                    found = found[ids[found] != asked_ids[j]]
                    if len(found) > k:  # rounding depends on the place in a product: what is close to the last one is ranked anew
                        cut = np.partition(near[found], len(found) - k)[len(found) - k]
                        found = found[near[found] >= cut - 1e-9 * max(1.0, abs(cut))]
                    score = (x[found] * wanted[j]).sum(axis=1)
                    best = np.lexsort((ids[found], -score))[:k]
                    out["query_id"] += [asked_ids[j]] * len(best)
                    out["vec_id"] += ids[found][best].tolist()
                    out["score"] += score[best].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
