"""Evaluation roll-ups: votes, accuracies by scope, human evaluation, traces, comparisons of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, let
from ..sources.sinks import running_sum

Equal = Callable[[Column, Column], Column]


def pass_at(samples, gold, k: int, equal: Equal) -> Column:
    """Whether one of the first k samples equals the gold answer; null samples do not, no samples neither."""
    return F.coalesce(F.exists(F.slice(col(samples), 1, k), lambda s: F.coalesce(s.isNotNull() & equal(s, col(gold)), F.lit(False))), F.lit(False))


def vote(samples, k: int) -> Column:
    """The most frequent of the first k samples, nulls being votes too; of equals the first seen."""

    def winner(some: Column) -> Column:
        count = lambda s: F.size(F.filter(some, lambda x: x.eqNullSafe(s)))
        return F.array_max(F.transform(some, lambda s, i: F.struct(count(s).alias("n"), (-i).alias("first"), s.alias("s"))))["s"]

    return let(F.slice(col(samples), 1, k), winner)


def consensus_at(samples, gold, k: int, equal: Equal) -> Column:
    """Whether the vote equals the gold answer; a null that wins does not."""
    winner = vote(samples, k)
    return F.coalesce(winner.isNotNull() & equal(winner, col(gold)), F.lit(False))


def class_vote(df: DataFrame, key: str, samples: str, forms: str) -> DataFrame:
    """(key, answer, votes): samples grouped by equal normal form (arrays of equal length); of equal groups the first, its last member answers."""
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(samples).alias("s"), F.col(forms).alias("f"))).alias("i", "x"))
    groups = rows.groupBy(key, "x.f").agg(F.count("*").alias("votes"), F.min("i").alias("first"), F.max_by("x.s", "i").alias("answer"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "first")
    return groups.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "answer", "votes")


def raw_vote(df: DataFrame, key: str, order: str, raw: str, form: str) -> DataFrame:
    """(key, answer, votes): the form with most votes without nulls, of equals the first seen; answered by its latest raw text."""
    groups = df.where(F.col(form).isNotNull()).groupBy(key, form).agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.max_by(raw, order).alias("answer"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "first")
    return groups.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "answer", "votes")


def accuracy(df: DataFrame, flags: list[str], scopes: list[str]) -> DataFrame:
    """(scope, value, metric, accuracy, n): the mean of every flag overall and by each scope, in one pass. No rows: 0 overall."""
    cells = F.explode(F.array(F.struct(F.lit("overall").alias("scope"), F.lit("").alias("value")), *[F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("value")) for s in scopes])).alias("c")
    sums = df.groupBy(*scopes).agg(*[F.sum(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in flags], F.count("*").alias("_n"))
    spread = sums.select("_n", *scopes, *flags).select("_n", cells, *flags).select("_n", "c", F.explode(F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).alias("ok")) for f in flags])).alias("m"))
    out = spread.groupBy("c.scope", "c.value", "m.metric").agg((F.sum("m.ok") / F.sum("_n")).alias("accuracy"), F.sum("_n").alias("n"))
    return out


def check_counts(df: DataFrame, flag: str, by: str) -> DataFrame:
    """(by, wrong, right, share_right) for each value."""
    ok = F.coalesce(F.col(flag), F.lit(False))
    return df.groupBy(by).agg(F.count_if(~ok).alias("wrong"), F.count_if(ok).alias("right"), F.avg(ok.cast("double")).alias("share_right"))


def compare_runs(runs: dict[str, DataFrame], metric: str = "metric", value: str = "accuracy") -> DataFrame:
    """One row per run, ordered by the digits in its name, one column per metric; missing ones 0."""
    long_ = None
    for name, df in runs.items():
        digits = int("".join(ch for ch in name if ch.isdigit()) or 0)
        part = df.select(F.lit(name).alias("run"), F.lit(digits).alias("step"), F.col(metric).alias("m"), F.col(value).alias("v"))
        long_ = part if long_ is None else long_.unionByName(part)
    return long_.groupBy("run", "step").pivot("m").agg(F.first("v")).na.fill(0.0).orderBy("step", "run")


def metric_table(results: DataFrame, paths: dict[str, str], column: str = "metrics", digits: int = 4) -> DataFrame:
    """One column per task from JSON results by path; shares become percentages."""
    def value(path: str) -> Column:
        x = F.get_json_object(F.col(column), path).try_cast("double")
        return F.round(F.when(F.abs(x) <= 1, x * 100).otherwise(x), digits)

    return results.select(*[c for c in results.columns if c != column], *[value(p).alias(n) for n, p in paths.items()])


def combine_metrics(df: DataFrame, group: str, order: str, arrays: list[str] = (), numbers: list[str] = (), others: list[str] = ()) -> DataFrame:
    """Metrics of several workers: arrays are joined in order, numbers averaged, of others the last one counts."""
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(a).alias("v")))), lambda x: x["v"])).alias(a) for a in arrays]
    return df.groupBy(group).agg(*joined, *[F.avg(n).alias(n) for n in numbers], *[F.max_by(o, order).alias(o) for o in others])


# human evaluation


def latest(annotations: DataFrame, instance: str = "instance_id", evaluator: str = "evaluator", timestamp: str = "timestamp") -> DataFrame:
    """The last annotation of each evaluator for each instance."""
    w = Window.partitionBy(instance, evaluator).orderBy(F.desc(timestamp))
    return annotations.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_two(annotations: DataFrame, instance: str, timestamp: str, value: str, evaluator: str = "evaluator") -> DataFrame:
    """(instance, first, second): values of the earliest annotation and of the next one."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(timestamp).alias("t"), F.col(evaluator).alias("e"), F.col(value).alias("v"))))
    return annotations.groupBy(instance).agg(ordered.alias("a")).select(instance, F.try_element_at("a", F.lit(1))["v"].alias("first"), F.try_element_at("a", F.lit(2))["v"].alias("second"))


def acceptance(annotations: DataFrame) -> DataFrame:
    """(model, n, acceptance, agreement): share of accepted completions by each instance's first annotation, and of instances whose first two agree."""
    sides = latest(annotations).select("instance_id", "evaluator", "timestamp", F.explode(F.array(*[F.struct(F.col(f"model_{s}").alias("model"), (F.col(f"completion_{s}_is_acceptable") == "yes").alias("ok")) for s in "ab"])).alias("x")).select("instance_id", "evaluator", "timestamp", "x.*")
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "evaluator", "ok")))
    per = sides.groupBy("model", "instance_id").agg(ordered.alias("a"))
    one, two = F.try_element_at("a", F.lit(1))["ok"], F.try_element_at("a", F.lit(2))["ok"]
    return per.groupBy("model").agg(F.count("*").alias("n"), F.avg(one.cast("double")).alias("acceptance"), F.avg(F.when(two.isNotNull(), (one == two).cast("double"))).alias("agreement"))


def pair_of(a: str = "model_a", b: str = "model_b") -> tuple[Column, Column]:
    """The unordered pair of models."""
    return F.least(a, b), F.greatest(a, b)


def win_rates(annotations: DataFrame) -> DataFrame:
    """(model_1, model_2, n, wins_1, wins_2, ties) as shares for each unordered pair; preference is a-is-better.., b-is-better.., or a tie."""
    x, y = pair_of()
    won = F.when(F.col("preference").startswith("a-is"), F.col("model_a")).when(F.col("preference").startswith("b-is"), F.col("model_b"))
    rows = latest(annotations).select(x.alias("model_1"), y.alias("model_2"), won.alias("won"))
    share = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    return rows.groupBy("model_1", "model_2").agg(F.count("*").alias("n"), share(F.col("won") == F.col("model_1")).alias("wins_1"), share(F.col("won") == F.col("model_2")).alias("wins_2"), F.avg(F.col("won").isNull().cast("double")).alias("ties"))


def preference_agreement(annotations: DataFrame) -> DataFrame:
    """(n, strict, relaxed): agreement of the first two annotators on the winner; relaxed counts a tie on one side as half."""
    side = F.when(F.col("preference").startswith("a-is"), "a").when(F.col("preference").startswith("b-is"), "b").otherwise("tie")
    both = first_two(latest(annotations).withColumn("side", side), "instance_id", "timestamp", "side").where("second is not null")
    relaxed = F.when(F.col("first") == F.col("second"), 1.0).when((F.col("first") == "tie") | (F.col("second") == "tie"), 0.5).otherwise(0.0)
    return both.agg(F.count("*").alias("n"), F.avg((F.col("first") == F.col("second")).cast("double")).alias("strict"), F.avg(relaxed).alias("relaxed"))


def progress(annotations: DataFrame, users: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """((evaluator, done) with zeros and a row "all", (evaluator, instance_index) still missing)."""
    done = latest(annotations, "instance_index").groupBy("evaluator").agg(F.count("*").alias("done"))
    each = users.select("evaluator").join(done, "evaluator", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    every = users.select("evaluator", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("instance_index"))
    missing = every.join(annotations.select("evaluator", "instance_index").distinct(), ["evaluator", "instance_index"], "left_anti")
    return each.unionByName(each.agg(F.lit("all").alias("evaluator"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"))), missing


# rollouts


def explode_trace(traces: DataFrame) -> DataFrame:
    """One row per sample of each step, lists padded with nulls to the longest."""
    lists = ["scores", "responses", "queries", "ground_truths", "datasets", "finish_reasons"]
    zipped = F.arrays_zip(*[c for c in lists if c in traces.columns])
    rest = [c for c in traces.columns if c not in lists]
    return traces.select(*rest, F.posexplode_outer(zipped).alias("sample", "x")).select(*rest, "sample", "x.*")


def trace_statistics(samples: DataFrame) -> DataFrame:
    """(training_step, mean_score, solve_rate, n), solved being above 0."""
    return samples.groupBy("training_step").agg(F.avg("scores").alias("mean_score"), F.avg((F.col("scores") > 0).cast("double")).alias("solve_rate"), F.count("scores").alias("n"))


def trace_overall(samples: DataFrame) -> DataFrame:
    """Means over the steps' means."""
    return trace_statistics(samples).agg(F.avg("mean_score").alias("mean_score"), F.avg("solve_rate").alias("solve_rate"), F.sum("n").alias("n"), F.count("*").alias("steps"))


def score_summary(samples: DataFrame, score: str = "scores", perfect: float = 10.0) -> DataFrame:
    """mean, min, max, standard deviation of all, and how many are perfect and zero."""
    return samples.agg(F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"), F.stddev_pop(score).alias("std"), F.count_if(F.col(score) == perfect).alias("perfect"), F.count_if(F.col(score) == 0).alias("zero"), F.count(score).alias("n"))


def filter_traces(traces: DataFrame, step: int | None = None, at_least: float | None = None, at_most: float | None = None, most_samples: int | None = None, order: list[str] = ("training_step",)) -> DataFrame:
    """Traces of a step with some score in bounds, in order until ``most_samples``; the last one's lists are cut."""
    out = traces if step is None else traces.where(F.col("training_step") == step)
    if at_least is not None:
        out = out.where(F.exists("scores", lambda s: s >= at_least))
    if at_most is not None:
        out = out.where(F.exists("scores", lambda s: s <= at_most))
    if most_samples is None:
        return out
    sums = running_sum(out.withColumn("_n", F.size("scores")), "_n", [F.col(o) for o in order], "_upto")
    cut = sums.withColumn("_b", F.col("_upto") - F.col("_n")).where(F.col("_b") < most_samples)
    lists = [f.name for f in traces.schema if f.dataType.typeName() == "array"]
    return cut.select(*[F.slice(c, 1, (most_samples - F.col("_b")).cast("int")).alias(c) if c in lists else c for c in traces.columns])


def view_traces(samples: DataFrame, step: int, correct: bool | None = None, n: int = 10, order: list[str] = ("sample",)) -> DataFrame:
    """The first n samples of a step, only solved or only unsolved ones if asked."""
    out = samples.where(F.col("training_step") == step)
    if correct is not None:
        out = out.where((F.col("scores") > 0) == correct)
    return out.orderBy(*order).limit(n)


def generation_report(df: DataFrame, seconds: str = "seconds", tokens: str = "tokens", reason: str = "finish_reason") -> DataFrame:
    """Sums, means, tokens a second, and the finish reasons with their counts."""
    reasons = df.groupBy(reason).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"), F.sum(tokens).alias("t"))
    return reasons.agg(F.sum("n").alias("batches"), F.sum("s").alias("seconds"), F.sum("t").alias("tokens"), (F.sum("t") / F.sum("s")).alias("tokens_per_second"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(reason, F.lit("none")), "n")))).alias("reasons"))
