"""Train/test contamination: exact phrases, n-gram coverage and vectors, with reports and removal.

An index row is one text with the id of the training row it came from. Queries are rows with one or more text fields.
Nothing is compared with everything: phrases and n-grams meet in equi-joins of hashed shingles. The places that meet are
written, then fetch their text again and are compared there, so every match is exact; no number of hits is capped. The
join's smaller side is broadcast only if the planner finds it small. Vectors of the queries, a stated set, go to the
index in blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, rx
from ..sources.sinks import materialize

STANDARD, SPLITTER = r"[\p{L}\p{N}_]+", r"[^ ,.?!:;()\"\n\\-]+"


def analyse(text, pattern: str = STANDARD) -> Column:
    """Lower-case tokens."""
    return F.regexp_extract_all(F.lower(col(text)), rx(pattern), F.lit(0))


def index_messages(df: DataFrame, key: str, messages: str = "messages", where: tuple[str, str] | None = ("role", "user")) -> DataFrame:
    """(original_id, text) of every message whose field has a value; all messages without a condition."""
    parts = df.select(F.col(key).alias("original_id"), F.explode(messages).alias("m"))
    return (parts.where(F.col("m")[where[0]] == where[1]) if where else parts).select("original_id", F.col("m.content").alias("text"))


def index_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(F.col(key).alias("original_id"), F.col(text).alias("text"))


def _tokens(index: DataFrame, pattern: str) -> DataFrame:
    """(original_id, _dh, _d): the tokens of each text, and a hash that tells texts apart that share an id."""
    return index.select("original_id", F.xxhash64("text").alias("_dh"), analyse("text", pattern).alias("_d"))


def _starts(tokens: str, n: int) -> Column:
    """A hash of the n tokens at each place; nothing of shorter texts."""
    runs = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(F.slice(tokens, i + 1, n)))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def _met(index: DataFrame, wanted: DataFrame, n: int, pattern: str) -> DataFrame:
    """``wanted`` (with _h, a hash of n tokens) with original_id and _d at each place _pos of the index where _h stands."""
    places = _tokens(index, pattern).select("original_id", "_dh", F.posexplode(_starts("_d", n)).alias("_pos", "_h"))
    hits = materialize(places.join(wanted, "_h").drop("_h"), "hits")
    texts = index.select("original_id", "text", F.xxhash64("text").alias("_dh")).dropDuplicates(["original_id", "_dh"])
    return hits.join(_tokens(texts.join(hits.select("original_id", "_dh").distinct(), ["original_id", "_dh"], "left_semi"), pattern), ["original_id", "_dh"])


def exact_match(index: DataFrame, queries: DataFrame, key: str, fields: list[str], pattern: str = STANDARD) -> DataFrame:
    """(key, original_id): training rows whose tokens hold those of every field as a phrase. Null fields match nothing.

    Candidates share the phrase's first tokens (up to 8) with their place; the rest is compared there.
    """
    head = 8
    out = None
    for field in fields:
        phrase = queries.where(F.col(field).isNotNull()).select(key, analyse(field, pattern).alias("_q")).where(F.size("_q") > 0)
        phrase = phrase.withColumn("_n", F.least(F.size("_q"), F.lit(head)))
        anchors = phrase.select(key, "_q", "_n", F.xxhash64(F.slice("_q", 1, F.col("_n"))).alias("_h"))
        hits = None
        for n in [r["_n"] for r in phrase.select("_n").distinct().collect()]:  # at most 8 numbers
            met = _met(index, anchors.where(F.col("_n") == n).drop("_n"), n, pattern)
            part = met.where(F.slice("_d", F.col("_pos") + 1, F.size("_q")) == F.col("_q")).select(key, "original_id")
            hits = part if hits is None else hits.union(part)
        found = (hits if hits is not None else queries.select(key).limit(0).withColumn("original_id", F.lit(None).cast("long"))).distinct()
        out = found if out is None else out.join(found, [key, "original_id"])
    return out


def ngram_scores(index: DataFrame, queries: DataFrame, key: str, fields: list[str], n: int = 8, pattern: str = STANDARD, compat: bool = False) -> DataFrame:
    """(key, original_id, score): share of a query's tokens covered by n-grams that the training row has, mean over fields.

    ``compat``: of an n-gram that a query has twice only the last place counts. Rows that share no n-gram do not appear.
    """
    scores = None
    for field in fields:
        q = queries.select(key, analyse(field, pattern).alias("_q")).where(F.size("_q") >= n)
        runs = F.transform(F.sequence(F.lit(0), F.size("_q") - n), lambda i: F.slice("_q", i + 1, n))
        grams = q.select(key, F.size("_q").alias("_size"), F.posexplode(runs).alias("_at", "_g"))
        if compat:
            grams = grams.groupBy(key, "_size", "_g").agg(F.max("_at").alias("_at"))
        met = _met(index, grams.withColumn("_h", F.xxhash64("_g")), n, pattern).where(F.slice("_d", F.col("_pos") + 1, n) == F.col("_g"))
        spots = met.groupBy(key, "original_id", "_size").agg(F.sort_array(F.collect_set("_at")).alias("_spots"))
        # covered tokens: each place adds what the one before has not covered yet
        before = F.concat(F.array(F.lit(-n)), F.slice("_spots", 1, F.greatest(F.size("_spots") - 1, F.lit(0))))
        covered = F.aggregate(F.zip_with("_spots", before, lambda a, b: F.least(a - b, F.lit(n))), F.lit(0), lambda s, x: s + x)
        part = spots.select(key, "original_id", (covered / F.col("_size") / len(fields)).alias("s"))
        scores = part if scores is None else scores.union(part)
    return scores.groupBy(key, "original_id").agg(F.sum("s").alias("score"))


def vector_scores(index: DataFrame, queries: DataFrame, key: str, k: int = 5, original: str = "original_id", vector: str = "embedding", block: int = 4096, others_only: bool = False) -> DataFrame:
    """(key, original_id, score, rank): the k nearest rows to each query by the inner product of unit vectors.

    Exact: the queries are a stated set and go to all rows in blocks of about ``block`` vectors; every task keeps k
    candidates of each query from each batch of rows. ``others_only``: a query does not find the row of its own id.
    Vectors of zeros have no direction and score 0.
    """
    spark = index.sparkSession
    parts = max(1, -(-queries.count() // block))
    q = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("q"), F.lit(parts)))
    rows = index.select(F.col(original).cast("long").alias("original_id"), F.col(vector).cast("array<double>").alias("v"))
    out = None
    for b in range(parts):
        some = q.where(F.col("b") == b).collect()
        if some:
            shared = spark.sparkContext.broadcast((np.array([r["q"] for r in some]), _units(np.array([r["v"] for r in some]))))
            part = rows.mapInArrow(_nearest(shared, k, others_only), "q long, original_id long, score double")
            out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], "q long, original_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "original_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("q", key)


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _nearest(shared: Broadcast, k: int, others_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("original_id").to_numpy(zero_copy_only=False)
            x = _units(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            scores = vectors @ x.T
            found: tuple[list, list, list] = ([], [], [])
            for i in range(len(ids)):
                near = scores[i]
                at = np.flatnonzero(own != ids[i]) if others_only else np.arange(len(own))
                if len(at) > k:  # rounding depends on the place in a product: what is close to the last one is scored anew
                    last = np.partition(near[at], len(at) - k)[len(at) - k]
                    at = at[near[at] >= last - 1e-9]
                score = (x[at] * vectors[i]).sum(axis=1)
                best = np.lexsort((own[at], -score))[:k]
                found[0].append(np.full(len(best), ids[i]))
                found[1].append(own[at][best])
                found[2].append(score[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["q", "original_id", "score"])

    return run


def worst(scores: DataFrame) -> DataFrame:
    """(original_id, score): the largest score of each training row over all queries."""
    return scores.groupBy("original_id").agg(F.max("score").alias("score"))


def contaminated(scores: DataFrame, threshold: float | None) -> DataFrame:
    """Ids whose score is above the threshold; none without one."""
    return worst(scores).where(F.col("score") > threshold if threshold is not None else F.lit(False)).select("original_id")


def mean_score(queries: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """(queries, mean_score): mean over all queries of their best match; 0 for queries without one."""
    best = scores.groupBy(key).agg(F.max("score").alias("s"))
    return queries.select(key).join(best, key, "left").agg(F.count("*").alias("queries"), F.avg(F.coalesce("s", F.lit(0.0))).alias("mean_score"))


def decontaminate(df: DataFrame, key: str, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is not among the contaminated, summary (total, removed, kept_share))."""
    ids = bad.select(F.col("original_id").alias(key)).distinct()
    kept = df.join(ids, key, "left_anti")
    marked = df.select(key).join(ids.withColumn("_bad", F.lit(1)), key, "left")
    share = F.when(F.count("*") > 0, 1 - F.count("_bad") / F.count("*")).otherwise(1.0)
    return kept, marked.agg(F.count("*").alias("total"), F.count("_bad").alias("removed"), share.alias("kept_share"))
