"""Rewards of rollouts: weighted verifier scores, format tiers, composition, group-normalised advantages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.instructions import CONSTRAINTS, check
from ..functions.verifiers import FORMATS, verify


def weighted_rewards(df: DataFrame, key: str, prediction: str = "prediction", labels: str = "ground_truth", names: str = "dataset", weights: dict[str, float] | None = None, scale: float = 1.0, **options) -> DataFrame:
    """(key, reward, by_verifier): sum over a response's (label, verifier) pairs of scale * score * weight.

    The arrays must be of one length; verifiers that do not exist are skipped. Responses without any get 0.
    """
    checked = df.where(F.when(F.size(labels) == F.size(names), True).otherwise(F.raise_error(F.lit("labels and verifiers differ in number")).cast("boolean")))
    pairs = checked.select(key, F.col(prediction).alias("p"), F.explode_outer(F.arrays_zip(F.col(labels).alias("l"), F.col(names).alias("v"))).alias("x"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv]), F.lower("x.v")), F.lit(1.0))
    scored = pairs.select(key, F.lower("x.v").alias("verifier"), (verify(F.col("x.v"), F.col("p"), F.col("x.l"), **options) * weight * scale).alias("r"))
    each = scored.groupBy(key, "verifier").agg(F.sum("r").alias("r"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("verifier", "r")))))
    return each.groupBy(key).agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("reward"), entries.alias("by_verifier"))


def format_reward(df: DataFrame, batch: str, response: str = "response", scale: float = 1.0, out: str = "format_reward") -> DataFrame:
    """The reward of the best format tier that any response of the batch reaches: its share for those that reach it, else 0."""
    w = Window.partitionBy(batch)
    rows = df.select("*", *[F.coalesce(F.col(response).rlike(p), F.lit(False)).alias(f"_f{i}") for i, (p, _) in enumerate(FORMATS)])
    value = F.lit(0.0)
    for i in reversed(range(len(FORMATS))):
        value = F.when(F.max(f"_f{i}").over(w), F.when(F.col(f"_f{i}"), FORMATS[i][1] * scale).otherwise(0.0)).otherwise(value)
    return rows.withColumn(out, value).drop(*[f"_f{i}" for i in range(len(FORMATS))])


def compose(verified: Column, formatted: Column | None = None, additive: bool = True, good: Column | None = None, finish: Column | None = None, penalty: float | None = None) -> Column:
    """A response's score: verified plus its format's, or only with a full format; only of good outputs if asked; a penalty if it did not stop."""
    base = formatted if formatted is not None else F.lit(0.0)
    full = verified if formatted is None else verified + formatted if additive else F.when(formatted == 1, verified).otherwise(0.0)
    out = full if good is None else F.when(F.coalesce(good, F.lit(False)), full).otherwise(base)
    return out if penalty is None else F.when(F.coalesce(finish != "stop", F.lit(True)), penalty).otherwise(out)


def good_output(output, called, timeout, error) -> Column:
    """A tool was called, printed something, and neither ran out of time nor failed."""
    return (F.length(output) > 0) & F.col(called) & ~F.col(timeout) & (F.length(error) == 0)


def advantages(df: DataFrame, group: str, reward: str, normalise: bool = True, out: str = "advantage") -> DataFrame:
    """A reward less its group's mean, over the group's standard deviation (of all) plus 1e-8."""
    w = Window.partitionBy(group)
    centred = F.col(reward) - F.avg(reward).over(w)
    return df.withColumn(out, centred / (F.stddev_pop(reward).over(w) + 1e-8) if normalise else centred)


def group_kinds(df: DataFrame, group: str, reward: str, most: float) -> DataFrame:
    """(group, n, kind): zero (all 0), solved (all ``most``), flat (all alike) or mixed."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.min(reward).alias("lo"), F.max(reward).alias("hi")).select(
        group, "n", F.when(F.col("lo") != F.col("hi"), "mixed").when(F.col("hi") == 0, "zero").when(F.col("lo") == most, "solved").otherwise("flat").alias("kind")
    )


def varied_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Without the groups whose rewards are all alike."""
    some = df.groupBy(group).agg((F.max(reward) > F.min(reward)).alias("_v")).where("_v").select(group)
    return df.join(some, group, "left_semi")


def pass_rates(rollouts: DataFrame, key: str, correct: str) -> DataFrame:
    """(key, total_rollouts, total_correct, passrate)."""
    ok = F.coalesce(F.col(correct).cast("int"), F.lit(0))
    return rollouts.groupBy(key).agg(F.count("*").alias("total_rollouts"), F.sum(ok).alias("total_correct"), F.avg(ok).alias("passrate"))


def in_band(df: DataFrame, rates: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Rows whose pass rate is within bounds; rows without rollouts have 0."""
    return df.join(rates, key, "left").withColumn("passrate", F.coalesce("passrate", F.lit(0.0))).where(F.col("passrate").between(low, high))


def accepted_tests(df: DataFrame, tests: str, results: str, share: float = 0.8) -> DataFrame:
    """Rows of which that share of tests pass at least, with the passed tests only."""
    n, good = F.size(results), F.size(F.filter(results, lambda r: r == 1))
    passed = F.transform(F.filter(F.arrays_zip(F.col(tests).alias("t"), F.col(results).alias("r")), lambda x: x["r"] == 1), lambda x: x["t"])
    return df.where((n > 0) & (good >= share * n)).withColumn(tests, passed)


def instruction_scores(df: DataFrame, key: str, text: str, label: str, most: int = 500) -> DataFrame:
    """(key, score): share of a row's constraints that its text meets; 0 without any, unknown names count as not met.

    ``label`` is JSON: {"instruction_id": [names], "kwargs": [{...} or null]}, or a list with one such object. Predicates
    are Columns with fixed parameters, so the distinct constraints are planned one by one, in passes of about ``most``.
    """
    kind = "struct<instruction_id:array<string>,kwargs:array<string>>"
    listed = F.trim(F.col(label)).startswith("[")
    parsed = F.when(listed, F.try_element_at(F.from_json(label, f"array<{kind}>"), F.lit(1))).otherwise(F.from_json(label, kind))
    pairs = df.select(key, F.col(text).alias("_t"), parsed.alias("_p")).select(key, "_t", F.explode_outer(F.arrays_zip(F.col("_p.instruction_id").alias("i"), F.col("_p.kwargs").alias("k"))).alias("_x"))
    rows = pairs.select(key, "_t", F.col("_x.i").alias("_i"), F.coalesce("_x.k", F.lit("{}")).alias("_k"))
    specs = rows.where("_i is not null").select("_i", "_k").distinct()
    parts = max(1, -(-specs.count() // most))
    part = F.pmod(F.xxhash64("_i", "_k"), F.lit(parts))
    scored = None
    for b in range(parts):
        here = rows.where(F.coalesce(part, F.lit(0)) == b) if parts > 1 else rows
        met = F.lit(False)
        for s in specs.where(part == b).collect():  # about ``most`` constraints
            if s["_i"] in CONSTRAINTS:
                met = F.when((F.col("_i") == s["_i"]) & (F.col("_k") == s["_k"]), check("_t", s["_i"], json.loads(s["_k"]) or {})).otherwise(met)
        one = here.select(key, F.when(F.col("_i").isNotNull(), met.cast("double")).alias("_m"))
        scored = one if scored is None else scored.unionByName(one)
    return scored.groupBy(key).agg(F.coalesce(F.avg("_m"), F.lit(0.0)).alias("score"))
