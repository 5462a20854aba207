"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, at most ``most_epochs`` times its own words; the excess goes to
the others by weight until no target is above its bound (water filling). A source takes whole epochs of all its
documents first; the rest of the target is a weighted sample without replacement: a document of quality weight w has
the exponential key -ln(u) / w, keys ascend, and the prefix of the words meets the budget. Keys are cut into buckets:
prefix sums run over the (source, bucket) sums and then within each bucket, so no source, however large, is sorted in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """``sizes`` (sk, source, source_size) with weight and target.

    The common level x solves sum(min(cap, weight * x)) = total; in order of cap / weight it lies where the caps before
    it and the weights from it on make up the total. Sources without words get 0.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * most_epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    s = s.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce("before", F.lit(0.0))) / F.col("rest"))
    s = s.withColumn("nth", F.row_number().over(order))  # the first level that its source's bound allows
    s = s.withColumn("x", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(every)["level"])
    return s.select("sk", "source", "source_size", "weight", F.coalesce(F.least("cap", F.col("x") * F.col("weight")), F.col("cap")).alias("target"))


def mix_documents(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 20, rows_per_bucket: int = 250, most_buckets: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_crc32, source, size, source_size, target, copies (times it is taken), taken,
    and the columns named in ``keep``.

    ``quality``: (doc_id, quality) with one positive weight for each of some documents; all others weigh 1. Null text:
    size 0. A null source is a source of its own, ordered last. Rows alike in id and text share a key and are taken one
    after the other. A source without words takes nothing. An empty table gives an empty result. The result depends on
    the rows and the seed alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *keep)
    w = F.lit(1.0)
    if quality is not None:  # joined to the slim rows: no text is shuffled
        known = quality.where("quality > 0").select(F.col("doc_id").alias("known_id"), F.col("quality").cast("double").alias("w"))
        slim, w = slim.join(known, slim["doc_id"] == known["known_id"], "left").drop("known_id"), F.coalesce("w", F.lit(1.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), 11).cast("double") + 0.5) / float(1 << 53)
    slim = slim.withColumn("key", -F.log(u) / w).drop("w")
    slim = materialize(slim.withColumn("sk", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "mix")
    buckets = max(16, min(most_buckets, slim.count() // rows_per_bucket))
    slim = slim.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))
    sums = slim.groupBy("sk", "source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("sk", "source").agg(F.sum("words").alias("source_size")), weights, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most_epochs).cast("long"), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(F.lit(0).cast("long"))
    goal = goal.withColumn("epochs", whole).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    prefix = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sk", "bucket", F.coalesce(F.sum("words").over(prefix), F.lit(0)).alias("before")).join(goal.drop("source", "weight"), "sk")
    run = Window.partitionBy("sk", "bucket").orderBy("key", "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slim.join(offsets, ["sk", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(run))
    # a document is in if more than half of it is within the budget
    more = ((F.col("upto") - F.col("size") / 2) < F.col("budget")).cast("long")
    out = rows.withColumn("copies", F.least(F.lit(most_epochs).cast("long"), F.col("epochs") + more))
    return out.select("doc_id", "text_crc32", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
