"""Joins that need more than an equality: numbered duplicates, last wins, as-of, intervals, overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.similarity import weighted_score


def pair_duplicates(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str) -> DataFrame:
    """Inner join in which the k-th row of a key on one side meets only the k-th on the other."""
    number = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return left.withColumn("dup_no", number(left_order)).join(right.withColumn("dup_no", number(right_order)), [*keys, "dup_no"])


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") == 1).drop("_k")


def override(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """left with column taken from right where right has a value for the key."""
    patch = right.select(*keys, F.col(column).alias("_new"))
    return left.join(patch, list(keys), "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def groups_with(df: DataFrame, members: DataFrame, group: str, key: str) -> DataFrame:
    """All rows of the groups of which at least one key is in members."""
    hit = df.join(members.select(key).distinct(), key, "left_semi").select(group).distinct()
    return df.join(hit, group, "left_semi")


def mark_members(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """A boolean column: whether the key is in members."""
    found = members.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def until_next(df: DataFrame, keys: Sequence[str], date: str, days: int) -> DataFrame:
    """Each row with until: the date plus days, or the next row's date if that is sooner."""
    following = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    return df.withColumn("until", F.least(F.col(date) + F.make_dt_interval(F.lit(days)), following))


def in_intervals(points: DataFrame, spans: DataFrame, keys: Sequence[str], date: str, low: str, high: str, bucket_days: int) -> DataFrame:
    """Points joined to the spans [low, high) of their key that hold them.

    Spans are dealt to day buckets, so the join is an equality on key and bucket; a point
    meets only the spans that touch its bucket.
    """
    day = lambda c: F.floor(F.unix_timestamp(c) / (86400 * bucket_days))
    placed = spans.withColumn("_bucket", F.explode(F.sequence(day(F.col(low)), day(F.col(high)))))
    met = points.withColumn("_bucket", day(F.col(date))).join(placed, [*keys, "_bucket"])
    return met.where((F.col(date) >= F.col(low)) & (F.col(date) < F.col(high))).drop("_bucket")


def as_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_left: Column, payload: Sequence[str]) -> DataFrame:
    """Rows that are not left ones, each with the payload of the latest left row before it.

    One pass over the union of both sides: no pairs are built, whatever the size of a key.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(is_left, F.struct(*payload)), ignorenulls=True).over(w)
    return rows.withColumn("_found", found).where(~is_left).select(*rows.columns, *[F.col(f"_found.{c}").alias(f"prior_{c}") for c in payload])


def first_later(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_right: Column, payload: str) -> DataFrame:
    """Rows that are not right ones, each with the payload of the first right row after it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(f"next_{payload}", F.first(F.when(is_right, F.col(payload)), ignorenulls=True).over(w)).where(~is_right)


def daily_spine(df: DataFrame, keys: Sequence[str], date: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row for every day of a key from its first to its last, value carried forward."""
    day = F.to_date(date)
    closing = last_of(df.withColumn("day", day), [*keys, "day"], [F.col(c).desc() for c in order]).select(*keys, "day", value)
    days = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    carried = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(closing, [*keys, "day"], "left").withColumn(value, carried)


def monthly_averages(df: DataFrame, keys: Sequence[str], date: str, value: str, order: Sequence[str]) -> DataFrame:
    """keys, month, average: the mean over every day of a key from its first to its last, value carried forward.

    A closing value stands for the days until the next one. Each counts in its own month, the
    first of a month with the days that the one before still had in it; the months between two
    closing values are made last, so that what is grouped grows with the rows, not with the months.
    """
    w = Window.partitionBy(*keys).orderBy("_day", *order)
    rows = df.select(*keys, F.to_date(date).alias("_day"), F.col(value).alias("_value"), *[c for c in order if c not in keys and c not in (date, value)])
    closing = rows.withColumn("_until", F.lead("_day").over(w)).where(F.col("_until").isNull() | (F.col("_until") > F.col("_day")))
    by_day = Window.partitionBy(*keys).orderBy("_day")
    month = F.trunc("_day", "month")
    head = F.when(F.lag("_day").over(by_day) < month, F.date_diff("_day", month))
    closing = closing.where(F.col("_day").isNotNull()).withColumns({"_before": F.lag("_value").over(by_day), "_head": head, "_until": F.coalesce("_until", F.date_add("_day", 1)), "_month": month})
    own = F.date_diff(F.least(F.col("_until"), F.add_months("_month", 1)), "_day")
    parts = (F.sum(F.col("_value") * own), F.sum(F.when(F.col("_head") > 0, F.col("_before") * F.col("_head"))))
    total = F.coalesce(parts[0] + parts[1], *parts)
    by_month = closing.groupBy(*keys, "_month").agg((total / (F.sum(own) + F.coalesce(F.sum("_head"), F.lit(0)))).alias("average"), F.max_by("_value", "_day").alias("_last"), F.max("_until").alias("_until"))
    first, end = F.add_months("_month", 1), F.add_months(F.trunc("_until", "month"), -1)
    days = lambda m: F.date_diff(F.add_months(m, 1), m)
    mean = lambda m, a: F.struct(F.date_format(m, "yyyy-MM").alias("month"), a.alias("average"))
    between = F.transform(F.when(first <= end, F.sequence(first, end, F.expr("interval 1 month"))), lambda m: mean(m, F.col("_last") * days(m) / days(m)))
    here = F.array(mean(F.col("_month"), F.col("average")))
    return by_month.select(*keys, F.explode(F.when(between.isNull(), here).otherwise(F.concat(here, between))).alias("_m")).select(*keys, "_m.month", "_m.average")


def _allowed_days(day: int) -> list[int]:
    """Days of a month near a day: two before to three after, with the wrap at a month's end."""
    near = {1: [29, 30, 31, 1, 2, 3, 4], 2: [30, 31, 1, 2, 3, 4, 5], 3: [31, 1, 2, 3, 4, 5, 6], 29: [26, 27, 28, 29, 30, 31, 1], 30: [27, 28, 29, 30, 31, 1, 2], 31: [28, 29, 30, 31, 1, 2, 3]}
    return near.get(day) or list(range(day - 2, day + 4))


def recurring_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], date: str, note: str, clean: str, id_col: str) -> DataFrame:
    """Pairs of rows of equal keys, the earlier one left, on different dates with like notes.

    The right day of month is one of the left one's allowed days. Clean notes differ by
    less than 10 characters, and either they are similar above 92 or the notes, both
    longer than 10 characters, differ by less than 3. All pairs that meet this come out,
    so their number grows with the square of a group of equal payments.
    """
    side = df.select(*keys, F.struct(*order).alias("at"), F.to_date(date).alias("date"), F.lower(note).alias("note"), F.coalesce(clean, F.lit("")).alias("clean"), F.col(id_col).alias("id"))
    days = F.create_map(*[x for d in range(1, 32) for x in (F.lit(d), F.array(*map(F.lit, _allowed_days(d))))])
    left = side.withColumn("day", F.explode(F.element_at(days, F.dayofmonth("date")))).alias("a")
    right = side.withColumn("day", F.dayofmonth("date")).alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "day")]
    close = (F.col("a.at") < F.col("b.at")) & (F.col("a.date") != F.col("b.date")) & (F.abs(F.length("a.clean") - F.length("b.clean")) < 10)
    for c in met:
        close = c & close
    size = (F.length("a.note"), F.length("b.note"))
    sure = F.coalesce((F.abs(size[0] - size[1]) < 3) & (size[0] > 10) & (size[1] > 10), F.lit(False))
    pairs = left.join(right, close).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), sure.alias("sure"), F.col("a.clean").alias("x"), F.col("b.clean").alias("y"))
    score = weighted_score(F.when(~F.col("sure"), F.col("x")), F.col("y"))
    return pairs.where(F.col("sure") | (score > 92)).select("left_id", "right_id")
