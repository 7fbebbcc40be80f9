"""Set operations, de-duplication, interval coverage, top rows and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first in this order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") == 1).drop("_k")


def top_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered; Spark cuts each task's rows to n before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """The rows of a page, from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def around(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, before: int, after: int) -> DataFrame:
    """Rows within so many places of a row for which hit holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-after, before)
    return df.withColumn("_near", F.max(hit.cast("int")).over(w)).where(F.col("_near") == 1).drop("_near")


def merged_intervals(df: DataFrame, keys: Sequence[str], low: str, high: str, gap_days: int = 1) -> DataFrame:
    """Intervals of days merged where they overlap or lie within gap_days."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.datediff(low, reach) > gap_days, F.lit(True))
    numbered = df.withColumn("_fresh", fresh.cast("int")).withColumn("_no", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_no").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_no")


def interval_gaps(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Stretches of days between merged intervals that none covers."""
    w = Window.partitionBy(*keys).orderBy(low)
    merged = merged_intervals(df, keys, low, high).withColumn("_before", F.lag(high).over(w)).where(F.col("_before").isNotNull())
    return merged.select(*keys, F.date_add("_before", 1).alias("gap_from"), F.date_sub(low, 1).alias("gap_to"))


def covered_months(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Months that at least one interval touches."""
    months = F.explode(F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("INTERVAL 1 MONTH")))
    return df.select(*keys, months.alias("month")).select(*keys, F.date_format("month", "yyyy-MM").alias("month")).distinct()


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, least_tail: int = 0) -> DataFrame:
    """chunk: rows of a key in runs of size; a last run shorter than least_tail joins the one before."""
    whole = Window.partitionBy(*keys)
    n = F.row_number().over(whole.orderBy(*order)) - 1
    total = F.count("*").over(whole)
    tail = total % size
    short = (tail > 0) & (tail < least_tail) & (total > size)
    last = F.floor((total - 1) / size)
    number = F.floor(n / size)
    return df.withColumn("chunk", F.when(short & (number == last), last - 1).otherwise(number).cast("int"))
