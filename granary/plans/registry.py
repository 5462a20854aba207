"""Named transforms of DataFrames, pipelines of them, and a cache of their results by configuration.

A transform is ``DataFrame -> DataFrame``; chains are lazy, so Catalyst fuses them into one plan. A cached result is a
Parquet folder named by the digest of the whole configuration, written once and read by later sessions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert, filters, packing
from ..operators.sampling import amount, take
from ..operators.statistics import dataset_statistics, transform_statistics
from ..sources.readers import resolve

Transform = Callable[..., DataFrame]
TRANSFORMS: dict[str, Transform] = {}

#: Columns that every step keeps.
ALWAYS = ("dataset_source", "messages")


def transform(name: str):
    """Register ``f(df, **options)``; other modules add theirs the same way."""

    def add(f: Transform) -> Transform:
        TRANSFORMS[name] = f
        return f

    return add


@transform("to_messages")
def _to_messages(df: DataFrame) -> DataFrame:
    return convert.auto_convert(df)


@transform("sft_tokenize")
def _sft(df: DataFrame, **options) -> DataFrame:
    return packing.tokenize(df, train_on="all", **options)


@transform("sft_tokenize_mask_prompt")
def _sft_masked(df: DataFrame, **options) -> DataFrame:
    return packing.tokenize(df, train_on="last", **options)


@transform("sft_tokenize_truncate")
def _sft_truncate(df: DataFrame, most: int, **options) -> DataFrame:
    return packing.tokenize(df, train_on="assistant", most=most, **options)


@transform("sft_tokenize_truncate_last")
def _sft_last(df: DataFrame, most: int, **options) -> DataFrame:
    return packing.tokenize(df, train_on="last_assistant", most=most, **options)


@transform("sft_filter")
def _sft_filter(df: DataFrame, most_prompt: int | None = None, most: int | None = None, labelled: bool = True) -> DataFrame:
    out = df.where(filters.within_length("input_ids", most))
    if most_prompt is not None and "input_ids_prompt" in df.columns:
        out = out.where(filters.within_length("input_ids_prompt", most_prompt))
    return out.where(filters.has_labels("labels")) if labelled else out


@transform("preference_tokenize")
def _pairs(df: DataFrame, **options) -> DataFrame:
    return packing.tokenize_pairs(df, prompt=True, **options)


@transform("preference_tokenize_truncate")
def _pairs_truncate(df: DataFrame, most: int, **options) -> DataFrame:
    return packing.tokenize_pairs(df, most=most, train_on="assistant", **options)


@transform("preference_filter")
def _pairs_filter(df: DataFrame, most_prompt: int | None = None, most: int | None = None) -> DataFrame:
    keep = filters.within_length("chosen_input_ids", most) & filters.within_length("rejected_input_ids", most) & filters.has_labels("chosen_labels") & filters.has_labels("rejected_labels")
    return df.where(keep if most_prompt is None else keep & filters.within_length("input_ids_prompt", most_prompt))


@transform("verifiable_tokenize")
def _verifiable(df: DataFrame, system: str | None = None, **options) -> DataFrame:
    out = df.withColumn("messages", convert.with_system("messages", system)) if system else df
    kinds = dict(df.dtypes)
    for c in ("ground_truth", "dataset"):
        if c in kinds:
            out = out.withColumn(c, convert.as_list(c, kinds[c].startswith("array")))
    return packing.tokenize_prompt(out, **options)


@transform("verifiable_filter")
def _verifiable_filter(df: DataFrame, most_prompt: int | None = None) -> DataFrame:
    return df.where(filters.within_length("input_ids_prompt", most_prompt))


@dataclass(frozen=True)
class Dataset:
    """A named dataset, how much of it, and the steps that make it: (transform, options)."""

    name: str
    share: str = "1.0"
    split: str = "train"
    steps: tuple[tuple[str, dict], ...] = ()
    key: str = "id"
    seed: int = 42


@dataclass(frozen=True)
class Mixture:
    datasets: tuple[Dataset, ...]
    columns: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def digest(self) -> str:
        """The identity of the result: a hash of the whole configuration."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:16]


def parse_mixture(flat: list[str], **common) -> Mixture:
    """``name amount name amount ...``; an amount with a point is a share, else a number of rows."""
    if len(flat) % 2:
        raise ValueError("names and amounts come in pairs")
    for value in flat[1::2]:
        amount(value)
    return Mixture(tuple(Dataset(n, a, **common) for n, a in zip(flat[::2], flat[1::2])))


def apply(df: DataFrame, steps: tuple[tuple[str, dict], ...], columns: tuple[str, ...] = ()) -> DataFrame:
    """The steps in order, then the wanted columns and those that are always kept."""
    for name, options in steps:
        df = df.transform(TRANSFORMS[name], **options)
    keep = [c for c in (*columns, *ALWAYS) if c in df.columns] if columns else df.columns
    return df.select(*dict.fromkeys(keep))


def build(spark: SparkSession, mixture: Mixture, roots: tuple[str, ...] = (".",)) -> tuple[DataFrame, DataFrame]:
    """(rows of all datasets, statistics of each): read, sample, transform, union. An empty dataset is an error."""
    out, before = None, None
    for d in mixture.datasets:
        raw = take(resolve(spark, d.name, d.split, roots), amount(d.share), d.key, d.seed).withColumn("dataset_source", F.lit(d.name))
        made = apply(raw, d.steps, mixture.columns)
        start = raw.select("dataset_source")
        out, before = (made, start) if out is None else (out.unionByName(made, allowMissingColumns=True), before.unionByName(start))
    stats = transform_statistics(before, out)
    if "input_ids" in out.columns and "labels" in out.columns:
        stats = stats.join(dataset_statistics(out), "dataset_source", "left")
    return out, stats


def build_cached(spark: SparkSession, mixture: Mixture, cache: str, roots: tuple[str, ...] = (".",)) -> DataFrame:
    """The mixture's rows from the cache; computed and written there with their statistics the first time."""
    path = f"{cache.rstrip('/')}/{mixture.digest()}"
    try:
        return spark.read.parquet(f"{path}/rows")
    except Exception as e:  # only a missing path means that nothing is cached
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    rows, stats = build(spark, mixture, roots)
    rows.write.parquet(f"{path}/rows")
    done = spark.read.parquet(f"{path}/rows")
    if done.isEmpty():
        raise ValueError("the transforms left no row")
    stats.write.mode("overwrite").json(f"{path}/statistics")
    return done
