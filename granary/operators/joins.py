"""Joins that stand for lookups: left with defaults, one to many, overlays, by content hash, semi and anti."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip


def last_per_key(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Of equal keys the last row by order."""
    down = [F.desc(o) if isinstance(o, str) else o for o in order]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*down))).where("_r = 1").drop("_r")


def gold_with_predictions(gold: DataFrame, predictions: DataFrame, key: str = "id", columns: tuple[str, ...] = ("output", "parsed_final_answers")) -> DataFrame:
    """All gold rows with their prediction's columns, null where there is none; keys compare as text."""
    p = predictions.select(F.col(key).cast("string").alias(key), *[c for c in columns if c in predictions.columns])
    return gold.withColumn(key, F.col(key).cast("string")).join(p, key, "left")


def with_all_matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every match of every row, with num_outputs, the number of matches of its key."""
    counted = right.join(right.groupBy(key).agg(F.count("*").alias("num_outputs")), key)
    return left.join(counted, key)


def overlay(results: DataFrame, originals: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Result rows with their original's other columns, the result's columns first; results without an original go."""
    base = last_per_key(originals, key, order)
    return results.join(base.select(key, *[c for c in base.columns if c not in results.columns]), key)


def by_first_message(left: DataFrame, right: DataFrame, messages: str = "messages") -> DataFrame:
    """Rows whose first messages have equal content, joined by its digest."""
    digest = lambda df: df.withColumn("prompt_hash", F.sha2(F.try_element_at(F.col(messages), F.lit(1))["content"], 256))
    return digest(left).join(digest(right).drop(messages), "prompt_hash")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def without_texts(df: DataFrame, others: DataFrame, text: str, other_text: str) -> DataFrame:
    """Rows whose stripped text is not among the others'; null texts stay."""
    known = others.select(strip(other_text).alias("_t")).where("_t is not null").distinct()
    return df.withColumn("_t", strip(text)).join(known, "_t", "left_anti").drop("_t")


def cached(requests: DataFrame, responses: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests with their saved responses, requests that still need one)."""
    return requests.join(responses, key), requests.join(responses.select(key), key, "left_anti")


def prompts_by_index(samples: DataFrame, prompts: DataFrame, index: str = "dataset_index", times: int = 1) -> DataFrame:
    """Prompt attributes looked up by index, every row ``times`` times with its sample number."""
    return samples.join(prompts, index).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def advantages_into_packs(packs: DataFrame, advantages: DataFrame, mask: str = "response_mask") -> DataFrame:
    """Each token's advantage by the 1-based sequence number in its mask; 0 where the mask is 0.

    ``packs``: pack, mask arrays; ``advantages``: seq (1-based), advantage.
    """
    tokens = packs.select("pack", F.posexplode(mask).alias("pos", "seq"))
    found = tokens.join(advantages, "seq", "left").withColumn("advantage", F.when(F.col("seq") == 0, 0.0).otherwise(F.coalesce("advantage", F.lit(0.0))))
    return found.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "advantage"))), lambda x: x["advantage"]).alias("advantages"))
