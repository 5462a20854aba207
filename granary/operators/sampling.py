"""Mixing, sampling and splitting. Orders are by key or by a seeded hash of it, so results do not depend on partitions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import ranked, running_sum


@dataclass(frozen=True)
class Share:
    """A part of a dataset, over 1 to repeat it."""

    of: float


@dataclass(frozen=True)
class Count:
    """A number of rows."""

    rows: int


def amount(value: str | int | float, loose: bool = False) -> Share | Count:
    """"0.5" and 0.5 are shares, "50" and 50 counts; ``loose``: the integer 1 is all rows, as in mixes by fraction."""
    if isinstance(value, str):
        value = float(value) if "." in value else int(value)
    if value < 0:
        raise ValueError("amounts are not negative")
    if loose and value == 1 or isinstance(value, float):
        return Share(float(value))
    return Count(int(value))


def draw(key: str | list[str], seed: int) -> Column:
    """A stable pseudo-random order."""
    return F.xxhash64(F.lit(seed), *([key] if isinstance(key, str) else key))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


#: Rows that one task may hold to find the first ones; more are found by distributed ranks.
FEW = 10_000


def _first(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n) if n <= FEW else ranked(df, order).where(F.col("rank") <= n).drop("rank")


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first n rows by key."""
    return _first(df, n, [F.col(key)])


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of the key."""
    return _first(df, n, [draw(key, seed), F.col(key)])


def upsample(df: DataFrame, n: int, key: str, seed: int = 42, size: int | None = None) -> DataFrame:
    """n rows: as many whole copies as fit, the rest sampled without replacement; ``copy`` numbers them from 0."""
    size = df.count() if size is None else size
    if size == 0:
        return df.withColumn("copy", F.lit(0))
    whole, rest = divmod(n, size)
    full = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))) if whole else None
    more = sample_rows(df, rest, key, seed).withColumn("copy", F.lit(whole))
    return more if full is None else full if rest == 0 else full.unionByName(more)


def take(df: DataFrame, what: Share | Count, key: str, seed: int | None = None) -> DataFrame:
    """A share or a number of rows: by key, or by hash if there is a seed; more rows than there are repeat."""
    size = df.count()
    n = int(what.of * size) if isinstance(what, Share) else what.rows
    if n > size:
        return upsample(df, n, key, seed or 42, size).drop("copy")
    return df if n == size else sample_rows(df, n, key, seed) if seed is not None else first_rows(df, n, key)


def conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns and types of ``like``; missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def concatenate(*parts: DataFrame) -> DataFrame:
    """All rows under the first part's schema."""
    return reduce(lambda a, b: a.unionByName(b), [parts[0], *[conform(p, parts[0]) for p in parts[1:]]])


def mix(parts: dict[str, DataFrame], amounts: dict[str, Share | Count], key: str, seed: int | None = 42, keep_all: tuple[str, ...] = ()) -> DataFrame:
    """The parts by their amounts with their names as dataset_source; shares and counts do not go together.

    Parts named in ``keep_all`` (test splits) are never cut.
    """
    kinds = {type(a) for a in amounts.values()}
    if len(kinds) > 1:
        raise ValueError("shares and counts cannot be mixed")
    taken = [(parts[n] if n in keep_all else take(parts[n], a, key, seed)).withColumn("dataset_source", F.lit(n)) for n, a in amounts.items() if (a.of if isinstance(a, Share) else a.rows) > 0]
    return concatenate(*taken)


def repeat(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy") if times > 1 else df.limit(0) if times < 1 else df


def per_group(df: DataFrame, group: str | list[str], n: int | Column, key: str, seed: int | None = None) -> DataFrame:
    """At most n rows of each group, by key or by hash."""
    order = [F.col(key)] if seed is None else [draw(key, seed), F.col(key)]
    by = [group] if isinstance(group, str) else group
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def exactly_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each group that has as many."""
    enough = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(group)
    return per_group(df.join(enough, group, "left_semi"), group, n, key, seed)


def stratified(df: DataFrame, column: str, portions: dict[str, float], total: int, key: str, seed: int = 42) -> DataFrame:
    """``total`` rows with each stratum's portion (summing to 1), rounded down; strata that have fewer give all."""
    if abs(sum(portions.values()) - 1) > 1e-6:
        raise ValueError("portions add up to 1")
    caps = F.create_map(*[F.lit(x) for k, v in portions.items() for x in (k, int(v * total))])
    known = df.where(F.col(column).isin(*portions))
    return per_group(known, column, F.element_at(caps, F.col(column)), key, seed)


def split(df: DataFrame, test_share: float, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): every key falls to one side by its hash, whatever else is in the table."""
    at = F.pmod(draw(key, seed), F.lit(1_000_000)) < int(test_share * 1_000_000)
    return df.where(~at), df.where(at)


def head_split(df: DataFrame, dev_share: float, most_dev: int, key: str, times: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(train, dev): dev is the head by key, at most ``most_dev`` rows; train is the rest, repeated ``times``."""
    n = df.count()
    dev = min(most_dev, int(n * dev_share))
    numbered = ranked(df, [F.col(key)])
    train = numbered.where(F.col("rank") > dev).drop("rank")
    return take(train, Share(times), key), numbered.where(F.col("rank") <= dev).drop("rank")


def page(df: DataFrame, offset: int, size: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def epoch_batches(df: DataFrame, key: str, batch: int, seed: int, epoch: int = 0, rank: int = 0, world: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """(key, batch): the batches of one of ``world`` readers in an epoch's order; the last short batch is dropped."""
    rows = df.select(key) if exclude is None else df.select(key).join(exclude.select(key), key, "left_anti")
    numbered = ranked(rows, [draw(key, seed + epoch), F.col(key)])
    mine = numbered.where((F.col("rank") - 1) % world == rank)
    at = mine.withColumn("batch", F.floor(F.floor((F.col("rank") - 1) / world) / batch).cast("long"))
    full = at.groupBy("batch").agg(F.count("*").alias("_n")).where(F.col("_n") == batch).select("batch")
    return at.join(full, "batch", "left_semi").select(key, "batch")


def length_batches(df: DataFrame, length: str, key: str, batch: int) -> DataFrame:
    """Rows with batch, from 0: the longest together, so that a batch needs little padding; order by key restores the rows."""
    numbered = ranked(df, [F.desc(length), F.col(key)])
    return numbered.withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("long")).drop("rank")


def longest_per_group(df: DataFrame, group: str, length: str, key: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(length), key))).where("_r = 1").drop("_r")


def first_per_key(df: DataFrame, key: str | list[str], order: list[Column | str]) -> DataFrame:
    by = [key] if isinstance(key, str) else key
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that every frame has."""
    marked = reduce(lambda a, b: a.union(b), [f.select(key).distinct().withColumn("_f", F.lit(i)) for i, f in enumerate(frames)])
    return marked.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(frames)).select(key)


def running_cap(df: DataFrame, size: str, most: int, order: list[str]) -> DataFrame:
    """Rows in order until their sizes reach ``most``; ``taken`` is a row's part, the last one's cut."""
    sums = running_sum(df, size, [F.col(o) for o in order], "_upto").withColumn("_b", F.col("_upto") - F.col(size))
    return sums.where(F.col("_b") < most).withColumn("taken", F.least(F.col(size), most - F.col("_b"))).drop("_b", "_upto")
