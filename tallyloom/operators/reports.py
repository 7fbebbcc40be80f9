"""Report rows and small joins: fixed filters, last-wins merges, rejection, months asked for, summed findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of mandated debits (anchored ones match at a note's start), and descriptions that are none.
MANDATES = (
    r".*[^a-z](nach|ecs|ach|achdr)[^a-z]+.*", r"^(ach|nach|ecs|achdr)[^a-z].*", r"^Ins\s*Debit.*(CSG|CA)\s*[0-9]{3,}\s*dt.*", r"^ACHDR(\/)?.*\/[0-9]{4,}\/[0-9]{4,}.*", r"^(Loan)?\s*Reco.*For\s*[0-9]{3,}\s*",
    r"^INTERCITY\s*ECS\s*PAID\s*NACH\s*:\s*Paid\s*to.*", r"^DEBIT-CMP\s*MANDATE\s*DEBIT.*", r"^MAND\s*DR\s*-\s*[a-zA-Z0-9]{4,}-[a-zA-Z0-9]{4,}$", r"^CMS\/[a-zA-Z0-9]{4,}\/[0-9]{4,}$", r".*drawdown\s*from\s*casa.*",
)
NO_MANDATE = ("insurance", "investments", "lender_transaction", "trading/investments", "mutual_funds", "donation")


def mandated_debits(df: DataFrame) -> DataFrame:
    """Debits above 400 of four channels, with a mandate's note and no description that rules one out."""
    fits = F.lit(False)
    for p in MANDATES:
        fits = fits | F.col("transaction_note").rlike(f"(?i){p}")
    channel = F.col("transaction_channel").isin("auto_debit_payment", "net_banking_transfer", "Other", "upi")
    return df.where((F.col("transaction_type") == "debit") & channel & (F.col("amount") > 400) & ~F.coalesce("description", F.lit("")).isin(*NO_MANDATE) & fits)


def report_rows(df: DataFrame, reports: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """A row once for each report whose filter it passes: report and columns."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reports.items()]))
    return df.select(F.explode(names).alias("report"), *columns)


def last_by(df: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Of rows of equal keys the last by place; null keys are equal."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), place).alias("_r")).select(*keys, "_r.*")


def mapped_pairs(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], place: str, our_category: str, their_category: str) -> DataFrame:
    """keys and both categories of rows that agree on keys, the last of each side; rows that they call a transfer go, ours are all called transfer."""
    a, b = last_by(ours, keys, place), last_by(theirs, keys, place).select(*keys, their_category)
    met = a.join(b, list(keys)).where(F.col(our_category).isNotNull() & F.col(their_category).isNotNull() & ~F.contains(F.lower(their_category), F.lit("transfer")))
    ours_ = F.when(F.contains(F.lower(our_category), F.lit("transfer")), "transfer").otherwise(F.col(our_category))
    return met.select(*keys, ours_.alias(our_category), their_category)


def merged_answer(rows: DataFrame, answer: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """rows, the last of each key, with the answer's columns in place of theirs.

    A row without an answer makes the job fail: the message names the key.
    """
    new = [c for c in answer.columns if c not in (*keys, place)]
    side = last_by(answer.select(*keys, place, *new), keys, place).drop(place).withColumn("_met", F.lit(True))
    joined = last_by(rows, keys, place).drop(*new).join(side, list(keys), "left")
    missing = F.raise_error(F.concat(F.concat_ws("/", *keys), F.lit(" is missing from the answer"))).cast("boolean")
    return joined.where(F.when(F.col("_met").isNotNull(), True).otherwise(missing)).drop("_met")


def rejected(df: DataFrame, key: str, broken: DataFrame, share: float = 0.15) -> DataFrame:
    """key, reason: a statement whose balances break, else one with more than a share of blank notes; null for others.

    broken: key and the row of its first break, null where there is none.
    """
    g = df.groupBy(key).agg((F.count_if(F.trim(F.coalesce("transaction_note", F.lit(""))) == "") / F.count("*")).alias("_blank"))
    reason = F.when(F.col("broken").isNotNull(), "inconsistent transactions").when(F.col("_blank") > share, "empty transaction notes")
    return g.join(broken, key, "left").select(key, reason.alias("reason"))


def months_of(low: Column, high: Column) -> Column:
    """The months from one date to another, as yyyy-MM; null where the first is null."""
    return F.transform(F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def missing_months(covered: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """key, asked and missing months: covered has key, months (array), low and high of the request, whose last 7 days do not count."""
    asked = months_of(F.col(low), F.date_sub(high, 7))
    return covered.select(key, asked.alias("asked"), F.array_except(asked, "months").alias("missing"))


def first_seen(df: DataFrame, account: str, month: str, start: str) -> DataFrame:
    """month, start and place: a month's start wherever it differs from that of the account before, in order of accounts and months."""
    w = Window.partitionBy(month).orderBy(account)
    fresh = F.coalesce(F.col(start) != F.lag(start).over(w), F.lit(True))
    return df.where(F.col(month).isNotNull()).withColumn("_new", fresh).where("_new").drop("_new")
