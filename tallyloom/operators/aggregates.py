"""Aggregations: monthly features, accumulators that merge, shares that add up, look-back features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def mean_or_zero(c: Column) -> Column:
    """Mean to two places, halves to even, 0 where there is nothing."""
    return F.coalesce(F.bround(F.avg(c), 2), F.lit(0.0))


def deviation_or_zero(c: Column) -> Column:
    """Sample standard deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def share_where(condition: Column, places: int = 2) -> Column:
    """Percentage of rows for which condition holds."""
    return F.round(100.0 * F.sum(F.when(condition, 1).otherwise(0)) / F.count("*"), places)


def accumulate(df: DataFrame, keys: Sequence[str], value: str, date: str) -> DataFrame:
    """Partial states: total, n, low, high and the dates of the extremes (the earliest of equals)."""
    v = F.col(value)
    at = F.struct(v, F.col(date))
    return df.groupBy(*keys).agg(
        F.sum(v).alias("total"), F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.min(at)[date].alias("low_date"), F.min(F.struct(-v, F.col(date)))[date].alias("high_date")
    )


def merge(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of finer keys merged to coarser ones; the mean comes from totals, not from means."""
    return states.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min(F.struct("low", "low_date"))["low_date"].alias("low_date"),
        F.min(F.struct(-F.col("high"), F.col("high_date")))["high_date"].alias("high_date"),
    ).withColumn("mean", F.col("total") / F.col("n"))


def totals_by(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """One column of sums for each kind, 0 where a key has none; the kinds are stated, so no extra pass finds them."""
    return df.groupBy(*keys).pivot(kind, list(kinds)).agg(F.sum(value)).na.fill(0.0)


def look_back(df: DataFrame, key: str, date: str, days: Sequence[int], features: Mapping[str, Column]) -> DataFrame:
    """features over the rows less than so many days before the key's last date, zeros as null."""
    last = df.withColumn("_age", F.datediff(F.max(date).over(Window.partitionBy(key)), F.col(date)))
    out = [F.nullif(f(F.col("_age") < d), F.lit(0.0)).alias(f"{name}_{d}") for d in days for name, f in features.items()]
    return last.groupBy(key).agg(*out)


def largest_remainder(df: DataFrame, keys: Sequence[str], value: str, name: str, out: str = "percent") -> DataFrame:
    """Whole percentages by key that add up to 100: floors, and one more for the largest remainders."""
    whole = Window.partitionBy(*keys)
    exact = 100.0 * F.col(value) / F.sum(value).over(whole)
    parts = df.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    missing = 100 - F.sum("_floor").over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("_rest"), name))
    return parts.withColumn(out, (F.col("_floor") + F.when(rank <= missing, 1).otherwise(0)).cast("int")).drop("_floor", "_rest")


def cumulative_months(monthly: DataFrame, key: str, month_col: str, values: Sequence[str], step: int) -> DataFrame:
    """Sums over the latest step, 2*step, ... months of a key."""
    w = Window.partitionBy(key).orderBy(F.desc(month_col))
    sums = {c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in values}
    return monthly.withColumn("months", F.row_number().over(w)).withColumns(sums).where(F.col("months") % step == 0).drop(month_col)


def weight_of_evidence(df: DataFrame, bin_col: str, target: str, weight: str, smooth: float) -> DataFrame:
    """ln of the smoothed odds against the target in each bin, less that of all rows."""
    def odds(n: Column, bad: Column) -> Column:
        return F.ln(((n - bad) / n + smooth) / (bad / n + smooth))

    bins = df.groupBy(bin_col).agg(F.sum(weight).alias("w"), F.sum(F.col(target) * F.col(weight)).alias("bad"))
    total = Window.partitionBy()
    return bins.select(bin_col, (odds(F.col("w"), F.col("bad")) - odds(F.sum("w").over(total), F.sum("bad").over(total))).alias("woe"))


def upper_median(c: Column) -> Column:
    """The element at the middle, the upper of two; unlike median() it is one of the values."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def occurrences(df: DataFrame, keys: Sequence[str], month: str, day: str, order: Sequence[str]) -> DataFrame:
    """Every occurrence of a key in a month: its number k and its day, with the first and last day of the month's rows."""
    w = Window.partitionBy(*keys, month).orderBy(*order)
    numbered = df.withColumn("k", F.row_number().over(w).cast("long")).select(*keys, month, "k", day)
    measures = df.groupBy(F.col(month).alias("_month")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return numbered.join(F.broadcast(measures), F.col(month).eqNullSafe(F.col("_month"))).drop("_month")


def spend_by_month(df: DataFrame, whole: DataFrame, category: str, month: str, amount: str) -> DataFrame:
    """Long rows of the amount by category and month, 0 where there is none, with totals.

    The months are those of whole. level is grouping_id: 1 for the total of a category, 2 of
    a month, 3 of all; average, where month is null, is the total over the number of months.
    """
    spent = df.groupBy(category, month).agg(F.sum(amount).alias("_amount"))
    months, categories = whole.select(month).distinct(), df.select(category).distinct()
    at = spent.select(F.col(category).alias("_category"), F.col(month).alias("_month"), "_amount")
    grid = categories.crossJoin(months).join(at, F.col(category).eqNullSafe(F.col("_category")) & F.col(month).eqNullSafe(F.col("_month")), "left")
    total = F.sum(F.coalesce("_amount", F.lit(0.0)))
    out = grid.cube(category, month).agg(F.grouping_id().alias("level"), total.alias("_total")).crossJoin(months.agg(F.count("*").alias("_months")))
    return out.select(category, month, "level", F.round("_total", 2).alias(amount), F.when(F.col("level").isin(1, 3), F.round(F.col("_total") / F.col("_months"), 2)).alias("average"))
