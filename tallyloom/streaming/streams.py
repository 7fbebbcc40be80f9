"""Structured Streaming forms of the event work: labels, windows, de-duplication, barriers and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.streaming.consumers import _fs, versions


def route(df: DataFrame, rules: Mapping[str, Column], name: str = "issue") -> DataFrame:
    """A row once for each rule that holds; stateless, so batch and stream are the same."""
    labels = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(label)) for label, rule in rules.items()]))
    return df.withColumn(name, F.explode(labels))


def sliding_rate(df: DataFrame, ts: str, key: str, good: Column, length: str, slide: str, delay: str) -> DataFrame:
    """Rows and percentage of good ones in sliding windows that close once the delay has passed."""
    windows = df.withWatermark(ts, delay).groupBy(F.window(ts, length, slide).alias("w"), key)
    return windows.agg(F.count("*").alias("n"), F.round(100.0 * F.sum(F.when(good, 1).otherwise(0)) / F.count("*"), 2).alias("rate")).select(F.col("w.start").alias("start"), key, "n", "rate")


def tumbling_counts(df: DataFrame, ts: str, key: str, length: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once(df: DataFrame, ts: str, key: str, delay: str) -> DataFrame:
    """The first row of a key within the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def complete_when(df: DataFrame, key: str, wanted: str, ts: str, key_type: str = "long", late: str = "1 day", idle: int = 86_400_000) -> DataFrame:
    """Emits a key once, when as many rows have come as its wanted column says.

    A key's state goes when it has been idle for so many milliseconds of event time.
    """

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, done = state.get if state.exists else (0, False)
        goal = None
        for frame in frames:
            seen += len(frame)
            goal = int(frame[wanted].iloc[-1])
        fire = not done and goal is not None and seen >= goal
        state.update((seen, done or fire))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle)
        if fire:
            yield pd.DataFrame({key: [k[0]], "seen": [seen]})

    return df.withWatermark(ts, late).groupBy(key).applyInPandasWithState(count, f"{key} {key_type}, seen long", "seen long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def latest_by_key(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key in a Parquet table.

    Each batch writes a new version beside the old one; repeating a batch gives the same
    version, so a restart is safe. The version before the last is removed.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        before = [v for v in versions(spark, path) if v < epoch]
        if before:
            old = spark.read.schema(batch.schema).parquet(f"{path}/v{before[-1]}")
            new = old.unionByName(new).groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        new.write.mode("overwrite").parquet(f"{path}/v{epoch}")
        for v in before[:-1]:
            fs, p = _fs(spark, f"{path}/v{v}")
            fs.delete(p, True)

    return merge
