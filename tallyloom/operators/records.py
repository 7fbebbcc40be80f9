"""Account and statement records: split accounts, header phrases, status precedence, allowed metadata, name matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import similarity


def daily_levels(df: DataFrame, keys: Sequence[str], day: str, balance: str) -> DataFrame:
    """keys, month, mean, median and mode of the balance on each day from a month's first row to its last.

    df: one row a key and day. A day without a row has the balance of the last one before;
    each row counts for its days, so no row is made for a day. Of several modes the least.
    """
    keyed = df.withColumn("month", F.date_format(day, "yyyy-MM"))
    w = Window.partitionBy(*keys, "month").orderBy(day)
    days = F.coalesce(F.date_diff(F.lead(day).over(w), F.col(day)), F.lit(1))
    rows = keyed.withColumn("_days", days.cast("long"))
    by_value = rows.groupBy(*keys, "month", balance).agg(F.sum("_days").alias("_days"))
    return by_value.groupBy(*keys, "month").agg(
        (F.sum(F.col(balance) * F.col("_days")) / F.sum("_days")).alias("mean"),
        F.expr(f"percentile({balance}, 0.5, _days)").alias("median"),
        F.max_by(balance, F.struct(F.col("_days"), -F.col(balance))).alias("mode"),
    )


def by_account_number(df: DataFrame, statement: str, order: str, own: Column, known: DataFrame, same: int = 3) -> DataFrame:
    """Rows of a statement with the account they belong to.

    A row without a number has that of the row before, first rows the statement's own. Known
    accounts (statement, account_number) without a row get a placeholder row, kept null, unless
    they end in the same digits as an account with rows, which stands for them.
    """
    w = Window.partitionBy(statement).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn("account_number", F.coalesce(F.last("account_number", ignorenulls=True).over(w), own)).withColumn("placeholder", F.lit(False))
    held = filled.select(statement, F.right("account_number", F.lit(same)).alias("_tail")).distinct()
    empty = known.distinct().withColumn("_tail", F.right("account_number", F.lit(same))).join(held, [statement, "_tail"], "left_anti")
    made = empty.select(*[F.col(c) if c in (statement, "account_number") else F.lit(None).cast(t).alias(c) for c, t in df.dtypes], F.lit(True).alias("placeholder"))
    return filled.unionByName(made)


def child_statements(df: DataFrame, statement: str) -> DataFrame:
    """One row for each account of a statement: its child id (the statement and the account's place), rows and sums."""
    g = df.groupBy(statement, "account_number").agg(F.count_if(~F.col("placeholder")).alias("n"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total"), F.bool_or("placeholder").alias("empty"))
    place = F.row_number().over(Window.partitionBy(statement).orderBy("account_number"))
    return g.withColumn("child_id", F.concat_ws("#", statement, place.cast("string")))


def begins_with(note: Column, phrases: Sequence[str]) -> Column:
    """Whether a trimmed note begins with one of the patterns, in any case."""
    return F.coalesce(F.trim(note).rlike("(?i)^(?:" + "|".join(phrases) + ")"), F.lit(False))


def worst_status(df: DataFrame, key: str, status: str, fraud: Column) -> DataFrame:
    """key, verdict: FRAUD if any row is fraud, else REFER if any refers, else null."""
    any_fraud = F.bool_or(F.coalesce(fraud | (F.col(status) == "FRAUD"), F.lit(False)))
    return df.groupBy(key).agg(F.when(any_fraud, "FRAUD").when(F.bool_or(F.coalesce(F.col(status) == "REFER", F.lit(False))), "REFER").alias("verdict"))


def allowed(df: DataFrame, rules: DataFrame, fields: Sequence[str]) -> DataFrame:
    """df with allowed: whether one rule fits all fields; a null in a rule fits anything.

    Rules are grouped by which fields they state; each group is one join on those fields.
    """
    stated = rules.select(*fields, F.concat(*[F.col(f).isNotNull().cast("int").cast("string") for f in fields]).alias("_shape")).distinct()
    out = df.withColumn("allowed", F.lit(False))
    for (shape,) in stated.select("_shape").distinct().collect():  # at most a shape for each subset of the fields
        keys = [f for f, s in zip(fields, shape) if s == "1"]
        side = stated.where(F.col("_shape") == shape).select(*[F.col(f).alias(f"_r_{f}") for f in keys], F.lit(True).alias("_hit")).distinct()
        on = [F.col(f) == F.col(f"_r_{f}") for f in keys] if keys else F.lit(True)
        if keys:
            out = out.join(F.broadcast(side) if side.count() <= 10_000 else side, on, "left").withColumn("allowed", F.col("allowed") | F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_r_{f}" for f in keys])
        else:
            out = out.withColumn("allowed", F.lit(True))
    return out


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, order and repeats aside; two nulls are the same."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def passes(value: Column, bank: Column, pattern: Column, banks: Column, least: Column, most: Column) -> Column:
    """All rules that are given: the value's pattern, the bank in a list, the length in bounds; an absent rule passes."""
    given = lambda rule, test: F.coalesce(F.when(rule.isNotNull(), F.coalesce(test, F.lit(False))), F.lit(True))
    n = F.length(value)
    return given(pattern, F.regexp_like(value, pattern)) & given(banks, F.array_contains(banks, bank)) & given(least, n >= least) & given(most, n <= most)


def _partial_token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return similarity.partial(" ".join(sorted(x)), " ".join(sorted(y)))


_MATCH = [T.StructField("score", T.DoubleType()), T.StructField("matches", T.BooleanType())]


@F.pandas_udf(T.StructType([*_MATCH, T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), *_MATCH])))]))
def name_match(text: pd.Series, name: pd.Series) -> pd.DataFrame:
    """How a name stands in a text: the score of the whole, whether it is above 90, and both for each of several words."""
    rows = []
    for t, n in zip(text, name):
        whole = _partial_token_set(t or "", n or "")
        words = n.split() if n else []
        each = [(w, _partial_token_set(t or "", w)) for w in words] if len(words) > 1 else []
        rows.append((whole, whole > 90, [{"token": w, "score": s, "matches": s > 90} for w, s in each]))
    return pd.DataFrame(rows, columns=["score", "matches", "tokens"])


def mapped(c: Column, rules: Sequence[tuple[str, Sequence[str], str | None]], otherwise: str) -> Column:
    """The label of the first (kind, words, label) rule: the lower-cased text equals, contains or has a token among words; a null label keeps the text."""
    low, out = F.lower(c), F.when(F.lit(False), F.lit(""))
    tests = {
        "equals": lambda ws: low.isin(*ws),
        "contains": lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)),
        "token": lambda ws: F.arrays_overlap(F.split(low, r"[^a-z0-9]+"), F.array(*[F.lit(w) for w in ws])),
    }
    for kind, words, label in rules:
        out = out.when(tests[kind](words), c if label is None else F.lit(label))
    return out.otherwise(otherwise)


def monthly_report(df: DataFrame, key: str, month: str, metrics: Mapping[str, Column]) -> DataFrame:
    """key, group (the key's place among keys), and an array of (month, metrics) for the key's months in order."""
    g = df.groupBy(key, month).agg(*[c.alias(n) for n, c in metrics.items()])
    rows = F.array_sort(F.collect_list(F.struct(month, *metrics)))
    return g.groupBy(key).agg(rows.alias("months"))
