"""Corpus statistics: lengths, histograms, shares, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMITS = (512, 768, 1024, 1536, 2048, 4096)


def describe(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by.., name, count, mean, std of a sample, min, quartiles by linear interpolation, max), one row per column."""
    long_ = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.*")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long_.groupBy(*by, "name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max")).select(
        *by, "name", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max"
    )


def conversation_lengths(df: DataFrame, key: str, size, messages: str = "messages") -> DataFrame:
    """(key, n_turns, user, assistant, total): sizes of the turns without system messages; ``size`` measures a content."""
    turns = F.filter(messages, lambda m: m["role"] != "system")
    total = lambda role: F.aggregate(F.filter(turns, lambda m: m["role"] == role) if role else turns, F.lit(0), lambda a, m: a + size(m["content"]))
    return df.select(key, F.size(turns).alias("n_turns"), total("user").alias("user"), total("assistant").alias("assistant"), total(None).alias("total"))


def over_limits(df: DataFrame, column: str, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """(limit, n, share) of rows above each limit."""
    sums = df.agg(F.count(column).alias("all"), *[F.count_if(F.col(column) > x).alias(f"o{x}") for x in limits])
    rows = sums.select("all", F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), F.col(f"o{x}").alias("n")) for x in limits])).alias("r"))
    return rows.select("r.limit", "r.n", F.when(F.col("all") > 0, F.col("r.n") / F.col("all")).otherwise(0.0).alias("share"))


def longest(df: DataFrame, key: str, column: str, n: int = 100) -> DataFrame:
    return df.select(key, column).orderBy(F.desc(column), key).limit(n)


def edges(kind: str, low: float, high: float, bins: int = 25, width: float = 2000) -> list[float]:
    """Bin edges: linear, log, or fixed width."""
    if kind == "log":
        low = max(low, 1.0)
        return [low * (max(high, low + 1) / low) ** (i / bins) for i in range(bins + 1)]
    if kind == "fixed":
        return [width * i for i in range(int(high // width) + 2)]
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Index of the bin from 0; the last edge belongs to the last bin; null outside."""
    n = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= value))
    return F.when((value >= cuts[0]) & (value <= cuts[-1]), F.least(n, F.lit(len(cuts) - 1)) - 1)


def histogram(df: DataFrame, value: str, cuts: list[float] | float, category: Column | None = None, least: int = 0) -> DataFrame:
    """(category, bin, n, category_total): categories with fewer than ``least`` rows are one, Other. One number as cuts: bins of that width from 0 without end."""
    x = F.col(value).cast("double")
    place = bin_of(x, cuts) if isinstance(cuts, list) else F.floor(x / cuts).cast("int")
    cell = df.select((category if category is not None else F.lit("all")).alias("c"), place.alias("bin"))
    counts = cell.groupBy("c", "bin").agg(F.count("*").alias("n"))
    merged = counts.withColumn("t", F.sum("n").over(Window.partitionBy("c"))).withColumn("category", F.when(F.col("t") >= least, F.col("c")).otherwise("Other"))
    out = merged.groupBy("category", "bin").agg(F.sum("n").alias("n"))
    return out.withColumn("category_total", F.sum("n").over(Window.partitionBy("category")))


def source_name(column: str) -> Column:
    """What follows the last slash of a name; Other without one."""
    return F.when(F.col(column).contains("/"), F.element_at(F.split(column, "/"), -1)).otherwise("Other")


def deciles(df: DataFrame, column: str) -> DataFrame:
    """(n, min, mean, median, max, deciles 10 to 90)."""
    return df.agg(F.count(column).alias("n"), F.min(column).alias("min"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"), F.max(column).alias("max"), F.percentile(column, F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("deciles"))


def equal_bins(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """(bin, low, n): bins of equal width from 0, a tenth of the maximum of them at most if that is above 10."""
    top = df.agg(F.max(column).cast("double")).first()[0]
    bins = min(most, int(top // 10)) if top is not None and top > 10 else most
    width = F.nullif(F.lit(top) / bins, F.lit(0.0))
    rows = df.select(F.col(column).alias("v")).where("v is not null")
    counts = rows.groupBy(F.least(F.floor(F.col("v") / width), F.lit(bins - 1).cast("long")).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("bin") * F.coalesce(width, F.lit(0.0))).alias("low"), "n")


def dataset_statistics(df: DataFrame, source: str = "dataset_source", ids: str = "input_ids", labels: str = "labels", masked: int = -100) -> DataFrame:
    """(source, rows, tokens, trainable tokens, mean tokens) with shares of all rows and tokens."""
    trainable = F.size(F.filter(labels, lambda x: x != masked))
    sums = df.groupBy(source).agg(F.count("*").alias("rows"), F.sum(F.size(ids)).alias("tokens"), F.sum(trainable).alias("trainable"), F.avg(F.size(ids)).alias("mean_tokens"))
    return with_shares(sums, ["rows", "tokens"])


def with_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shares of the columns' sums; the table has one row per group."""
    every = Window.partitionBy()
    return df.select("*", *[(F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0))).alias(f"{c}_share") for c in columns])


def transform_statistics(before: DataFrame, after: DataFrame, source: str = "dataset_source") -> DataFrame:
    """(source, initial, final, filtered, upsampling factor)."""
    a, b = before.groupBy(source).agg(F.count("*").alias("initial")), after.groupBy(source).agg(F.count("*").alias("final"))
    out = a.join(b, source, "left").withColumn("final", F.coalesce("final", F.lit(0)))
    return out.withColumn("filtered", F.greatest(F.col("initial") - F.col("final"), F.lit(0))).withColumn("factor", F.col("final") / F.col("initial"))


def statistics_report(stats: DataFrame, name: str = "dataset", n: str = "n", over: list[str] = ()) -> DataFrame:
    """Rows sorted by name, counts over limits as percentages of n."""
    return stats.select(name, n, *[F.round(100.0 * F.col(c) / F.col(n), 2).alias(f"{c}_percent") for c in over], *[c for c in stats.columns if c not in (name, n, *over)]).orderBy(name)
