"""Salaries: one row a month, the best recurring group, and what is known of an account's salary.

Everything but the recurring groups is windows and aggregates keyed by account (and group),
so no account is held in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.model import written
from tallyloom.operators.recurring import clean_note, recurring_groups
from tallyloom.operators.windows import recurring

# Words by which a note names a company.
COMPANIES = "PVT|LTD|PRIVATE|LIMITED|TECH|SOLU|SERV|CONSULT|INDUST|ENTERPRISE|EXPOR|TRADER|MANAGEMENT|LOGISTIC|HOTEL|INTERNATIONAL|HOSPITAL"
#: Days of a month before which a credit is the salary of the month before.
LATE_DAY = 20


def salary_month(date: Column) -> Column:
    """yyyy-MM of the month that a credit pays: before the 20th the month before."""
    return F.date_format(F.when(F.dayofmonth(date) < LATE_DAY, F.date_sub(date, F.dayofmonth(date))).otherwise(F.to_date(date)), "yyyy-MM")


def account_months(df: DataFrame, key: str) -> DataFrame:
    """key, month, before: each month with rows, and the one before it among them."""
    months = df.select(key, F.date_format("date", "yyyy-MM").alias("month")).where("month IS NOT NULL").distinct()
    return months.withColumn("before", F.lag("month").over(Window.partitionBy(key).orderBy("month")))  # a row a month


def one_per_month(df: DataFrame, key: str, order: Sequence[str], months: DataFrame, limit: float = 0.4, ignore_deviation: bool = False, median: Column | None = None) -> DataFrame:
    """df with salary_month, at most one row for each of a key's months.

    The amounts' median is that of the last six rows, or given. Rows further from it than
    limit go, unless the deviation is ignored. Of a month with several rows the first is moved to
    the month before it, if that is one of the key's months (account_months) without a row,
    and of the rest the last stays; if the month before has a row, the row nearest to the median stays if
    it is within 0.3, else the largest. A key with fewer than two rows left has none, unless
    the deviation is ignored. Ties go to the earlier row; null dates and amounts are no salary.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = df.where(F.col("date").isNotNull() & F.col("amount").isNotNull()).withColumn("_back", F.row_number().over(last))
    middle = median if median is not None else F.median(F.when(F.col("_back") <= 6, F.col("amount"))).over(Window.partitionBy(key))
    rows = rows.withColumn("_middle", middle).withColumn("_month", salary_month(F.col("date")))
    rows = rows.withColumn("_delta", F.when(F.col("_middle") > 0, F.abs(F.col("_middle") - F.col("amount")) / F.col("_middle")).otherwise(1.0))
    if not ignore_deviation:
        rows = rows.where(F.col("_delta") < limit)
    month = Window.partitionBy(key, "_month")
    rows = rows.withColumn("_n", F.count("*").over(month)).withColumn("_first", F.row_number().over(month.orderBy(*order)))
    near = F.when(F.col("_delta") < 0.3, F.col("_delta"))
    best = month.orderBy(F.asc_nulls_last(near), F.desc("amount"), *order)
    rows = written(rows.withColumn("_best", F.row_number().over(best)), "salaries")
    known = months.select(F.col(key).alias("_k"), F.col("month").alias("_m"), "before")
    full = rows.select(F.col(key).alias("_k2"), F.col("_month").alias("_m2")).distinct().withColumn("_full", F.lit(True))
    placed = rows.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_month") == F.col("_m")), "left")
    placed = placed.join(full, F.col(key).eqNullSafe(F.col("_k2")) & (F.col("before") == F.col("_m2")), "left")
    several = (F.col("_n") > 1) & F.col("_m").isNotNull()
    push = several & F.col("before").isNotNull() & F.col("_full").isNull()
    placed = placed.withColumn("salary_month", F.when(push & (F.col("_first") == 1), F.col("before")).otherwise(F.col("_month")))
    placed = placed.where(~several | push | (F.col("_best") == 1))
    latest = Window.partitionBy(key, "salary_month").orderBy(*[F.desc(c) for c in order])
    out = placed.withColumn("_last", F.row_number().over(latest)).where("_last = 1")
    if not ignore_deviation:
        out = out.withColumn("_left", F.count("*").over(Window.partitionBy(key))).where("_left > 1")
    return out.select(*names, "salary_month")


def _all(c: Column) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))


def group_tests(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys with bank_transfers, company_words, month_end, near_median, same_day: what all rows of a group fulfil."""
    w = Window.partitionBy(*keys)
    note, day = F.upper("transaction_note"), F.dayofmonth("date")
    marked = df.withColumn("_mid", F.median("amount").over(w)).withColumn("_day", F.dayofmonth(F.min("date").over(w)))
    apart = F.abs(F.col("_day") - day)
    return marked.groupBy(*keys).agg(
        _all(note.rlike("NEFT|RTGS")).alias("bank_transfers"),
        _all(note.rlike(COMPANIES)).alias("company_words"),
        _all((day <= 6) | (day >= 24)).alias("month_end"),
        _all((F.col("amount") > 0.8 * F.col("_mid")) & (F.col("amount") < 1.2 * F.col("_mid"))).alias("near_median"),
        _all((apart <= 4) | (apart >= 26)).alias("same_day"),
    )


def possible_groups(df: DataFrame, key: str, group: str, since: Column) -> DataFrame:
    """One row for each group: n, months, latest, latest_amount, total, mean_month, middle, recent (rows from since on)."""
    rows = df.withColumn("_month", salary_month(F.col("date"))).withColumn("_since", since)
    g = rows.groupBy(key, group).agg(
        F.count("*").alias("n"),
        F.count_distinct("_month").alias("months"),
        F.max(F.struct("date", "amount")).alias("_last"),
        F.sum("amount").alias("total"),
        F.median("amount").alias("middle"),
        F.count_if(F.col("date") >= F.col("_since")).alias("recent"),
    )
    return g.select(key, group, "n", "months", F.col("_last.date").alias("latest"), F.col("_last.amount").alias("latest_amount"), "total", (F.col("total") / F.col("months")).alias("mean_month"), "middle", "recent")


def best_groups(groups: DataFrame, key: str, group: str) -> DataFrame:
    """Of each key the group with the greatest mean a month, of equals the latest, then the lesser group."""
    order = Window.partitionBy(key).orderBy(F.desc("mean_month"), F.desc("latest"), group)
    return groups.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def salaries(df: DataFrame, key: str, order: Sequence[str], employer: Column, months_least: int = 3, amount_least: float = 5000.0, keyword_least: float = 3000.0, limit: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """An account's salary credits and what is known of them: (rows with salary_month and method, summary).

    Credits of the employer (method employer_name) and of the channel salary from
    keyword_least up (keyword) are salaries as they are, with confidence 100. Accounts without
    any are searched for recurring credits: groups of like notes above amount_least and not
    by UPI, in enough months and with at most three rows more than months, with at most two
    debits of the same clean note, split by amount and day of month. Groups with three rows
    in the last six months of the account are possible salaries, the best of which counts;
    accounts with none take the best group with two rows there, if these lie a month (26 to 36 days)
    or two (56 to 66, at about the same day) apart, differ by at most 0.3, and are bank transfers
    or of a company. Confidence starts at 50 and gains 10 each for three months and more without
    more than two missing, for days outside 7 to 23, for bank transfers or company words, and
    for amounts and days that stay. summary: key, method, confidence, months, mean_month, latest, latest_amount.
    """
    rows = df.withColumn("_employer", F.coalesce(employer, F.lit(False)))
    credit = (F.col("transaction_type") == "credit") & F.col("date").isNotNull() & F.col("amount").isNotNull()
    months = written(account_months(df, key), "months")
    span = months.groupBy(key).agg(F.count("*").alias("_all"), F.max("month").alias("_end"))
    keyword = F.coalesce(F.col("transaction_channel") == "salary", F.lit(False)) & (F.col("amount") >= keyword_least)
    named = rows.where(credit & (F.col("_employer") | keyword)).withColumn("method", F.when(F.col("_employer"), "employer_name").otherwise("keyword")).drop("_employer")
    named = written(one_per_month(named, key, order, months, ignore_deviation=True), "named")

    # recurring credits of the other accounts
    left = rows.join(named.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti").drop("_employer")
    plain = clean_note(F.col("transaction_note"), F.coalesce("transaction_channel", F.lit("")))
    wanted = left.where(credit & (F.col("amount") > amount_least) & ~F.coalesce(F.upper("transaction_note").contains("UPI"), F.lit(False)))
    grouped = recurring_groups(wanted, [key], order, "transaction_note", "transaction_channel").where("group_no IS NOT NULL").withColumn("_clean", plain)
    month = F.date_format("date", "yyyy-MM")
    since = F.add_months(F.to_date("_end", "yyyy-MM"), -5)
    debits = left.where("transaction_type = 'debit'").groupBy(F.col(key).alias("_dk"), plain.alias("_dc")).agg(F.count("*").alias("_d"))
    grouped = grouped.join(debits, F.col(key).eqNullSafe(F.col("_dk")) & (F.col("_clean") == F.col("_dc")), "left").drop("_dk", "_dc")
    spans = span.withColumnRenamed(key, "_sk")
    grouped = written(grouped.join(spans, F.col(key).eqNullSafe(F.col("_sk"))).drop("_sk"), "grouped")
    ripe = grouped.groupBy(key, "group_no").agg(F.count("*").alias("_n"), F.count_distinct(month).alias("_m"), F.coalesce(F.max("_d"), F.lit(0)).alias("_debits"), F.count_if(F.col("date") >= since).alias("_recent"), F.first("_all").alias("_a"))
    ripe = ripe.where((F.col("_n") > 1) & (F.col("_m") > 1) & ((F.col("_m") >= F.col("_a") - 3) | (F.col("_m") >= months_least)) & (F.col("_n") <= F.col("_m") + 3) & (F.col("_debits") <= 2) & (F.col("_recent") >= 2))
    chosen = grouped.join(ripe.select(F.col(key).alias("_rk"), F.col("group_no").alias("_rg")), F.col(key).eqNullSafe(F.col("_rk")) & (F.col("group_no") == F.col("_rg"))).drop("_rk", "_rg")
    chosen = chosen.withColumn("_group", F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("\u0000")), F.col("group_no").cast("string"))).drop("group_no", "group_size", "_d", "_clean")
    split = recurring(chosen, "_group", order).withColumn("_sub", F.concat_ws("|", "_group", F.col("group_no").cast("string")))
    split = written(split.drop("_group", "group_no"), "subgroups")
    groups = written(possible_groups(split, key, "_sub", since), "possible")
    three = best_groups(groups.where("recent >= 3"), key, "_sub")
    two = groups.where("recent = 2").join(three.select(F.col(key).alias("_tk")), F.col(key).eqNullSafe(F.col("_tk")), "left_anti")
    two = best_groups(two, key, "_sub")

    def members(best: DataFrame) -> DataFrame:
        return split.join(best.select(F.col("_sub").alias("_s"), F.col("middle").alias("_mid")), F.col("_sub") == F.col("_s")).drop("_s")

    first = one_per_month(members(three), key, order, months, ignore_deviation=True, median=F.col("_mid"))
    pair = members(two)
    tests = group_tests(pair, [key]).withColumnRenamed(key, "_pk")
    when = F.array_sort(F.collect_list(F.struct(*order, "amount")))
    facts = pair.groupBy(F.col(key).alias("_fk")).agg(when.alias("_r"))
    a, b = F.col("_r")[0], F.col("_r")[1]
    gap, days = F.abs(F.datediff(b["date"], a["date"])), F.abs(F.dayofmonth(b["date"]) - F.dayofmonth(a["date"]))
    steady = F.when(F.size("_r") == 2, F.abs(b["amount"] / a["amount"] - 1) <= 0.3).otherwise(True)
    trusted = F.col("bank_transfers") | F.col("company_words") | (F.size("_r") != 2)
    apart = gap.between(26, 36) | (gap.between(56, 66) & ((days <= 3) | (days >= 27)))
    good = tests.join(facts, F.col("_pk").eqNullSafe(F.col("_fk"))).where(trusted & steady & apart).select(F.col("_pk").alias("_gk"))
    second = one_per_month(pair.join(good, F.col(key).eqNullSafe(F.col("_gk")), "left_semi"), key, order, months, limit)
    columns = [F.col(f"`{c}`") for c in df.columns]
    found = first.select(*columns, "salary_month").union(second.select(*columns, "salary_month")).withColumn("method", F.lit("recurring"))
    out = written(named.select(*columns, "salary_month", "method").union(found), "salaries")

    stats = out.groupBy(key).agg(F.min("method").alias("method"), F.count_distinct("salary_month").alias("months"), F.sum("amount").alias("_sum"), F.max(F.struct("date", "amount")).alias("_last"))
    stats = stats.join(group_tests(out, [key]).withColumnRenamed(key, "_tk"), F.col(key).eqNullSafe(F.col("_tk")))
    stats = stats.join(spans, F.col(key).eqNullSafe(F.col("_sk")))
    ten = lambda c: F.when(c, 10).otherwise(0)
    score = 50 + ten((F.col("_all") - F.col("months") <= 2) & (F.col("months") > 2)) + ten(F.col("month_end")) + ten(F.col("bank_transfers") | F.col("company_words")) + ten(F.col("near_median") & F.col("same_day"))
    summary = stats.select(
        key, "method", F.when(F.col("method") == "recurring", score).otherwise(100).cast("int").alias("confidence"), "months", (F.col("_sum") / F.col("months")).alias("mean_month"), F.col("_last.date").alias("latest"), F.col("_last.amount").alias("latest_amount")
    )
    return out, summary
