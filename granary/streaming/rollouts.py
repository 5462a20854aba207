"""Rollouts as a stream: accumulate groups, drop those without signal, exclude solved prompts, write packed batches.

Sources are folders of files; state lives in checkpoints, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import rewards

SOLVED = "prompt string, attempts long, passes long, rate double, excluded boolean"


def prepare(batch: DataFrame, group: str = "prompt", reward: str = "reward", finish: str | None = "finish_reason", normalise: bool = True) -> DataFrame:
    """One micro-batch of rollouts with advantages: flat groups go, then unfinished responses."""
    out = rewards.advantages(rewards.varied_groups(batch, group, reward), group, reward, normalise)
    return out.where(F.col(finish) == "stop") if finish and finish in batch.columns else out


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Every micro-batch prepared and handed to ``sink`` with its number; numbers repeat only when a batch is redone."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(prepare(df, **options), n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def solved_prompts(stream: DataFrame, prompt: str, correct: str, at_least: int, rate: float) -> DataFrame:
    """(prompt, attempts, passes, rate, excluded) whenever a prompt is tried: a keyed state that never forgets an exclusion."""

    def update(key: tuple, frames, state: GroupState):
        attempts, passes, excluded = state.get if state.exists else (0, 0, False)
        for f in frames:
            attempts += len(f)
            passes += int(f["ok"].sum())
        excluded = bool(excluded or attempts >= at_least and passes / attempts >= rate)
        state.update((attempts, passes, excluded))
        yield pd.DataFrame({"prompt": [key[0]], "attempts": [attempts], "passes": [passes], "rate": [passes / max(1, attempts)], "excluded": [excluded]})

    rows = stream.select(F.col(prompt).cast("string").alias("prompt"), F.coalesce(F.col(correct).cast("int"), F.lit(0)).alias("ok"))
    return rows.groupBy("prompt").applyInPandasWithState(update, SOLVED, "attempts long, passes long, excluded boolean", "update", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, size: str = "5 minutes", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and kind; late rows within the delay are still counted."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w, kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
