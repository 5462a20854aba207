"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; the last returns the shard manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, language, mixing, neardup, queries, sharding
from granary.llm.common import materialize, scratch_scope, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without letters and ambiguous ones go. Learned from the labelled rows."""
    return language.accepted(docs, language.train(docs, ~language.held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of rows alike in id and text one.

    Rows with a null id are in no group: of those with equal texts one stays. Null texts count as empty.
    """
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    text = F.coalesce("text", F.lit(""))
    a, b = _free(docs, "a"), _free(docs, "b")
    once = lambda rows: rows.withColumn(a, F.xxhash64(text)).withColumn(b, F.hash(text)).dropDuplicates(["doc_id", a, b]).select(docs.columns)
    # the rows with an id are dealt by it once, for the join and for what is alike among them
    return once(docs.join(kept, "doc_id", "left_semi")).unionByName(once(docs.where("doc_id is null")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null texts hold none."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; rows alike in all columns share their copies.

    Null texts and sources without words take nothing.
    """
    a, b, n = _free(docs, "a"), _free(docs, "b"), _free(docs, "n")
    rows = docs.withColumn(a, F.xxhash64(*docs.columns)).withColumn(b, F.hash(*docs.columns))
    taken = mixing.mix_documents(rows, queries.quality(table(spark, sf_dir, "labels")), keep=(a, b)).groupBy(a, b).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    out = rows.dropDuplicates([a, b]).join(taken, [a, b])
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int")))).select(docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the shards: a row for each document that the mixture holds, copies included."""
    return sharding.shard_documents(docs).withColumn("law", F.lit("rows"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Training a classifier and sketching sets are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark, name):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", outside=True)
    return docs
