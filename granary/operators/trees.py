"""Reply trees: every path from a root to a leaf answer as one conversation, by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quality_of(labels: str = "labels", name: str = "quality"):
    """The value of a named label; 0 without one."""
    at = F.array_position(F.col(f"{labels}.name"), name)
    return F.coalesce(F.when(at > 0, F.try_element_at(F.col(f"{labels}.value"), at.cast("int"))), F.lit(0.0))


def reply_paths(replies: DataFrame, top_k: int | None = None, user: str = "prompter", depth: int = 1000) -> DataFrame:
    """(path, quality): messages of each path that ends at an answer nobody replied to, and the mean quality on it.

    ``replies``: message_id, parent_id, role, text, deleted, quality. Deleted replies end a path, but count as replies:
    an answer whose replies are all deleted gives no path. Of a message's replies the ``top_k`` best are followed.
    """
    spark = replies.sparkSession
    leaf = replies.select(F.col("parent_id").alias("p")).where("p is not null").distinct()
    nodes = replies.join(leaf, replies["message_id"] == leaf["p"], "left").withColumn("is_leaf", F.col("p").isNull()).drop("p").where(~F.coalesce("deleted", F.lit(False)))
    if top_k is not None:
        w = Window.partitionBy("parent_id").orderBy(F.desc("quality"), "message_id")
        nodes = nodes.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= top_k) | F.col("parent_id").isNull()).drop("_r")
    role = F.when(F.col("role") == user, "user").otherwise(F.col("role"))
    nodes = nodes.select("message_id", "parent_id", F.struct(role.alias("role"), F.col("text").alias("content")).alias("m"), F.col("quality").cast("double").alias("quality"), (F.col("is_leaf") & (F.col("role") == "assistant")).alias("ends"))
    return spark.sql(
        f"""
        with recursive walk(message_id, path, total, ends) max recursion level {int(depth)} as (
          select message_id, array(m), quality, ends from {{nodes}} where parent_id is null
          union all
          select n.message_id, concat(w.path, array(n.m)), w.total + n.quality, n.ends from walk w join {{nodes}} n on n.parent_id = w.message_id
        )
        select path, total / size(path) as quality from walk where ends
        """,
        nodes=nodes,
    )
