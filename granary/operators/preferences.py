"""Preference pairs: best against worst by scores, votes, rejection sampling, judge ratings, all combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .convert import turns
from .sampling import draw


def mean_of(aspects: list[str], weights: list[float] | None = None) -> Column:
    """Mean of the aspects, or their weighted sum."""
    terms = [F.col(a).cast("double") * w for a, w in zip(aspects, weights or [1.0] * len(aspects))]
    total = sum(terms[1:], terms[0])
    return total if weights else total / len(aspects)


def binarise(df: DataFrame, prompt: str, response: str, score: Column, order: str, min_score: float | None = None, margin: float | None = None) -> DataFrame:
    """(prompt, chosen, rejected, chosen_score, rejected_score): best against worst response of each prompt.

    Of equal scores the first by ``order`` is chosen and the last rejected. Prompts with one response, a tie, a best
    score below ``min_score`` or a difference below ``margin`` give nothing.
    """
    rows = df.select(F.col(prompt).alias("prompt"), F.col(response).alias("r"), score.alias("s"), F.col(order).alias("o"))
    best = F.max_by(F.struct("r", "s"), F.struct("s", F.struct((-F.col("o").cast("double")).alias("o"))))
    worst = F.min_by(F.struct("r", "s"), F.struct("s", (-F.col("o").cast("double")).alias("o")))
    pairs = rows.groupBy("prompt").agg(F.count("*").alias("n"), best.alias("b"), worst.alias("w")).where("n > 1 and b.s <> w.s")
    if min_score is not None:
        pairs = pairs.where(F.col("b.s") >= min_score)
    if margin is not None:
        pairs = pairs.where(F.col("b.s") - F.col("w.s") >= margin)
    side = lambda x: turns(("user", F.col("prompt")), ("assistant", F.col(f"{x}.r")))
    return pairs.select("prompt", side("b").alias("chosen"), side("w").alias("rejected"), F.bround("b.s", 2).alias("chosen_score"), F.bround("w.s", 2).alias("rejected_score"))


def ranked_pair(df: DataFrame, prompt: str, response: str, rank: str, valid: Column, top: int = 4, seed: int = 1) -> DataFrame:
    """Chosen at random (by hash) among the best min(top, n) valid responses, rejected among the valid rest of lower rank."""
    w = Window.partitionBy(prompt).orderBy(rank)
    rows = df.where(valid).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(prompt))).where("_n >= 2")
    rows = rows.withColumn("_h", draw([prompt, rank], seed)).withColumn("_top", F.least(F.lit(top), F.col("_n") - 1))
    chosen = rows.where("_i <= _top").groupBy(prompt).agg(F.min_by(F.struct("_i", F.col(response).alias("r")), "_h").alias("c"))
    rest = rows.join(chosen, prompt).where("_i > c._i").groupBy(prompt).agg(F.first("c").alias("c"), F.min_by(F.col(response), "_h").alias("rejected"))
    return rest.select(prompt, F.col("c.r").alias("chosen"), "rejected")


def judge_pairs(ratings: DataFrame, key: str, aspect: str, text: str, models: list[str], completions: DataFrame | None = None, among: int = 4, seed: int = 1) -> DataFrame:
    """(key, chosen, rejected, scores): models by their mean rating over aspects.

    A rating text lists one number for each model; what is no number counts -1, lists are padded with nothing. The best
    of the first ``among`` models is chosen (the first of equals), another one at random rejected.
    """
    parsed = F.transform(F.split(F.col(text), r"[,;\s]+"), lambda x: F.coalesce(x.try_cast("double"), F.lit(-1.0)))
    long_ = ratings.select(key, aspect, F.posexplode(parsed).alias("m", "v")).where(F.col("m") < len(models))
    means = long_.groupBy(key, "m").agg(F.avg("v").alias("s"))
    best = means.where(F.col("m") < among).groupBy(key).agg(F.max_by("m", F.struct("s", (-F.col("m")).alias("o"))).alias("c"))
    other = means.join(best, key).where("m <> c").groupBy(key, "c").agg(F.min_by("m", draw([key, "m"], seed)).alias("r"))
    scores = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "s"))), lambda x: x["s"]).alias("scores"))
    name = lambda c: F.element_at(F.array(*[F.lit(m) for m in models]), F.col(c) + 1)
    return other.join(scores, key).select(key, name("c").alias("chosen"), name("r").alias("rejected"), "scores")


def rating_table(ratings: DataFrame, key: str, aspect: str, value: str, aspects: list[str]) -> DataFrame:
    """One row per key, one column per aspect."""
    return ratings.groupBy(key).pivot(aspect, aspects).agg(F.first(value))


def completions_by_prompt(df: DataFrame, prompt: str, completion: str, model: str, n: int = 4, seed: int = 1) -> DataFrame:
    """(prompt, completions, models): n completions of each prompt at random, in model order; prompts with fewer go."""
    w = Window.partitionBy(prompt)
    rows = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= n).withColumn("_r", F.row_number().over(w.orderBy(draw([prompt, model], seed), model))).where(F.col("_r") <= n)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(completion).alias("c"))))
    return rows.groupBy(prompt).agg(pairs.alias("p")).select(prompt, F.transform("p", lambda x: x["c"]).alias("completions"), F.transform("p", lambda x: x["m"]).alias("models"))


def rejection_sample(df: DataFrame, prompt: str, completion: str, score: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(prompt, by.., chosen, rejected, scores): best and worst completion of each prompt for each reward model."""
    best = F.max_by(F.col(completion), F.struct(F.col(score), (-F.col(order)).alias("o")))
    worst = F.min_by(F.col(completion), F.struct(F.col(score), F.col(order).alias("o")))
    return df.groupBy(prompt, *by).agg(best.alias("chosen"), worst.alias("rejected"), F.max(score).alias("chosen_score"), F.min(score).alias("rejected_score"))


def majority(df: DataFrame, key: str, choice: str, seed: int = 1) -> DataFrame:
    """(key, choice, votes): the choice with most votes; of equals one by hash."""
    votes = df.groupBy(key, choice).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), draw([key, choice], seed), choice)
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def all_pairs(df: DataFrame, prompt: str, index: str, completion: str) -> DataFrame:
    """(prompt, i, j, first, second) of every two completions of a prompt."""
    a = df.select(prompt, F.col(index).alias("i"), F.col(completion).alias("first"))
    b = df.select(prompt, F.col(index).alias("j"), F.col(completion).alias("second"))
    return a.join(b, prompt).where("i < j")


def parse_preferred(text: Column | str) -> Column:
    """0 or 1 after ``preferred``; null if there is none."""
    return F.regexp_extract(F.lower(F.col(text) if isinstance(text, str) else text), r"preferred[^01]{0,20}([01])", 1).try_cast("int")


def judged_pairs(pairs: DataFrame, verdict: str) -> DataFrame:
    """chosen and rejected by a judge's verdict: 0 keeps the order, 1 swaps it; without a verdict no pair."""
    v = parse_preferred(verdict)
    return pairs.withColumn("_v", v).where("_v is not null").select("*", F.when(F.col("_v") == 0, F.col("first")).otherwise(F.col("second")).alias("chosen"), F.when(F.col("_v") == 0, F.col("second")).otherwise(F.col("first")).alias("rejected")).drop("_v")


def varied(df: DataFrame, prompt: str, completion: str) -> DataFrame:
    """Prompts whose completions are not all the same."""
    some = df.groupBy(prompt).agg(F.min(completion).alias("_a"), F.max(completion).alias("_b")).where("_a <> _b").select(prompt)
    return df.join(some, prompt, "left_semi")


def pair_metrics(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """(pairs, accuracy, loss, means) of reward scores: loss is -log sigmoid of the margin."""
    m = F.col(chosen) - F.col(rejected)
    loss = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    return df.agg(F.count("*").alias("pairs"), F.avg((m > 0).cast("double")).alias("accuracy"), F.avg(loss).alias("loss"), F.avg(chosen).alias("chosen_mean"), F.avg(rejected).alias("rejected_mean"), F.avg(m).alias("margin_mean"))


def length_duel(a: DataFrame, b: DataFrame, key: str, size: Column) -> DataFrame:
    """(wins, losses, ties) of a's rows against b's with the same key by a size."""
    both = a.select(key, size.alias("x")).join(b.select(key, size.alias("y")), key)
    return both.agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))


def parse_judgement(text: Column | str) -> Column:
    """(explanation, decision) of a judge's reply; null where it has none."""
    t = F.col(text) if isinstance(text, str) else text
    part = lambda p: F.nullif(strip(F.regexp_extract(t, p, 1)), F.lit(""))
    return F.struct(part(r"(?is)explanation:\s*(.*?)(?:\n\s*decision:|$)").alias("explanation"), F.lower(part(r"(?is)decision:\s*([^\n]*)")).alias("decision"))
