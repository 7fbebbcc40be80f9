"""Row filters, column selection and boolean flags over transactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without these columns; absent ones are no error."""
    return df.drop(*names)


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns among names that the frame has, in that order."""
    return df.select(*[n for n in names if n in df.columns])


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(defaults))


def blank(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c == "", F.lit(True))


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def in_session(date: Column, first: Column, last: Column) -> Column:
    """From the first day to the end of the last one."""
    return (date >= F.to_timestamp(first)) & (date < F.to_timestamp(F.date_add(last, 1)))


def valid(amount: Column, balance: Column, date: Column) -> Column:
    """A row that algorithms may use: finite numbers and a date."""
    return finite(amount) & finite(balance) & date.isNotNull()


def salary_candidates(df: DataFrame, least: float, channels: Sequence[str], barred: str) -> DataFrame:
    """Credits above an amount, in these channels, whose note has none of the barred words."""
    note = F.coalesce(F.col("transaction_note"), F.lit(""))
    return df.where((F.col("transaction_type") == "credit") & (F.col("amount") > least) & F.col("transaction_channel").isin(*channels) & ~note.rlike(f"(?i){barred}"))


def pass_or_fail(df: DataFrame, predicate: Column, name: str = "passed") -> DataFrame:
    """A flag column; a predicate that is null has failed."""
    return df.withColumn(name, F.coalesce(predicate, F.lit(False)))


def keyword_flags(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """One boolean column for each pattern, matched anywhere and in any case."""
    return df.withColumns({name: F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)) for name, p in patterns.items()})


def last_months(df: DataFrame, n: int, key: str = "account_id", date: str = "date") -> DataFrame:
    """Rows of the last n distinct months that have rows, by key."""
    month = F.date_format(date, "yyyy-MM")
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(month.desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def until_second(df: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows before the second one for which flag holds."""
    seen = F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_seen", seen).where(F.col("_seen") < 2).drop("_seen")


def drop_repeated_last(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Without the last row of a group if its value is that of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.lead(F.lit(1)).over(w).isNull() & (F.lag(value).over(w) == F.col(value))
    return df.withColumn("_drop", F.coalesce(last, F.lit(False))).where(~F.col("_drop")).drop("_drop")


def cut_block(df: DataFrame, head: Column, foot: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows after the last head line and before the first foot line; without a head, from the start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    place = F.row_number().over(w)
    whole = Window.partitionBy(*keys)
    placed = df.withColumn("_n", place)
    placed = placed.withColumn("_head", F.coalesce(F.max(F.when(head, F.col("_n"))).over(whole), F.lit(0))).withColumn("_foot", F.min(F.when(foot, F.col("_n"))).over(whole))
    kept = placed.where((F.col("_n") > F.col("_head")) & (F.col("_foot").isNull() | (F.col("_n") < F.col("_foot"))))
    return kept.drop("_n", "_head", "_foot")


def all_of(conditions: Mapping[str, object | None]) -> Column:
    """Equality on every given column; a value of None asks for nothing, a list for membership."""
    parts = [F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == v for c, v in conditions.items() if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def local_time(ts: Column, zone: str) -> Column:
    """A UTC timestamp as wall-clock time of a zone."""
    return F.from_utc_timestamp(ts, zone)
