"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.model import CHANNELS, signed, table, transactions
from tallyloom.operators import aggregates as ops
from tallyloom.operators import predictors, rolling
from tallyloom.plans.registry import query, worn



def _amount(kind: str):
    return F.when(F.col("transaction_type") == kind, F.col("amount"))


@query("SELECT bank_name, count(seq) AS cases FROM txn GROUP BY 1 ORDER BY cases DESC, bank_name")
def agg_1_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("bank_name").agg(F.count("seq").alias("cases")).orderBy(F.desc("cases"), "bank_name")


@query("SELECT bank_name, transaction_channel, count(DISTINCT statement_id) AS statements, count(*) AS n FROM txn GROUP BY 1, 2")
def agg_2_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("bank_name", "transaction_channel").agg(F.countDistinct("statement_id").alias("statements"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderstatus, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1, 2", txn=False)
def agg_3_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderpriority").alias("o_orderpriority"))


@query("SELECT DISTINCT bank_name, transaction_channel, transaction_type FROM txn")
def agg_4_5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("bank_name", "transaction_channel", "transaction_type").distinct()


@query("SELECT count(*) AS n FROM txn")
def agg_6_global_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT bank_name, " + ", ".join(f"coalesce(sum(CASE WHEN transaction_channel = '{c}' THEN 1 END), 0) AS {c}" for c in sorted(CHANNELS.values())) + " FROM txn GROUP BY 1")
def agg_7_8_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("bank_name").pivot("transaction_channel", sorted(CHANNELS.values())).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT transaction_channel, count(*) AS total, count(*) FILTER (transaction_type = 'debit') AS matched, count(*) FILTER (transaction_type <> 'debit') AS mismatched, round(100.0 * count(*) FILTER (transaction_type = 'debit') / count(*), 2) AS pct FROM txn GROUP BY 1")
def agg_9_12_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit = F.col("transaction_type") == "debit"
    return transactions(spark, sf_dir).groupBy("transaction_channel").agg(F.count("*").alias("total"), F.count_if(debit).alias("matched"), F.count_if(~debit).alias("mismatched"), ops.share_where(debit).alias("pct"))


@query("SELECT bank_name, transaction_channel, count(*) AS n FROM txn GROUP BY GROUPING SETS ((bank_name), (transaction_channel), ())")
def agg_10_55_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return t.groupingSets([["bank_name"], ["transaction_channel"], []], "bank_name", "transaction_channel").agg(F.count("*").alias("n"))


@query("SELECT bank_name, transaction_type, count(*) AS n, round(sum(amount), 2) AS total FROM txn GROUP BY CUBE (bank_name, transaction_type)")
def agg_55_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).cube("bank_name", "transaction_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("SELECT statement_id, array_to_string(list(seq ORDER BY date, seq), ',') AS seqs FROM txn GROUP BY 1")
def agg_11_lists_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("date", "seq")))
    return transactions(spark, sf_dir).groupBy("statement_id").agg(F.array_join(F.transform(rows, lambda x: x["seq"].cast("string")), ",").alias("seqs"))


@query("SELECT bank_name, 100.0 * count(*) FILTER (transaction_type = 'credit') / 100 AS pct FROM (SELECT *, row_number() OVER (PARTITION BY bank_name ORDER BY date DESC, seq DESC) AS k FROM txn) WHERE k <= 100 GROUP BY 1")
def agg_13_latest_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("bank_name").orderBy(F.desc("date"), F.desc("seq")))
    latest = transactions(spark, sf_dir).withColumn("k", k).where("k <= 100")
    return latest.groupBy("bank_name").agg((100.0 * F.count_if(F.col("transaction_type") == "credit") / 100).cast("double").alias("pct"))


@query(
    """SELECT s.user_id, coalesce(round(r.rate, 2), 100) AS rate FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN (
      SELECT user_id, 100.0 * count(*) FILTER (event_type <> 'error') / count(*) AS rate FROM events, (SELECT max(ts) AS m FROM events)
      WHERE ts >= m - INTERVAL 1700 MINUTES AND ts < m - INTERVAL 20 MINUTES GROUP BY 1) r ON s.user_id = r.user_id""",
    txn=False,
)
def agg_14_recent_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts")).scalar()
    recent = events.where((F.col("ts") >= latest - F.expr("INTERVAL 1700 MINUTES")) & (F.col("ts") < latest - F.expr("INTERVAL 20 MINUTES")))
    rates = recent.groupBy("user_id").agg(ops.share_where(F.col("event_type") != "error").alias("rate"))
    return events.select("user_id").distinct().join(rates, "user_id", "left").select("user_id", F.coalesce(F.col("rate").cast("double"), F.lit(100.0)).alias("rate"))


@query(
    """SELECT account_id, coalesce(round(stddev_samp(balance), 6), 0) AS volatility, max(CASE WHEN transaction_type = 'credit' THEN amount END) AS max_credit, max(balance) AS max_balance, min(balance) AS min_balance,
    arg_max(seq, (amount, -seq)) FILTER (transaction_type = 'debit') AS max_debit_seq FROM txn GROUP BY 1"""
)
def agg_15_18_account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.when(F.col("transaction_type") == "debit", F.struct("amount", (-F.col("seq")).alias("s"))))
    return transactions(spark, sf_dir).groupBy("account_id").agg(
        F.round(ops.deviation_or_zero(F.col("balance")), 6).alias("volatility"), F.max(_amount("credit")).alias("max_credit"), F.max("balance").alias("max_balance"), F.min("balance").alias("min_balance"), (-best["s"]).alias("max_debit_seq")
    )


@query("SELECT account_id, transaction_type, strftime(date, '%Y-%m') AS month, count(*) AS n, round(avg(amount), 6) AS mean FROM txn GROUP BY 1, 2, 3")
def agg_19_monthly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("account_id", "transaction_type", ops.month().alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("amount"), 6).alias("mean"))


@query("SELECT account_id, round(avg(s), 6) AS mean FROM (SELECT account_id, strftime(date, '%Y-%m') AS m, sum(amount) AS s FROM txn WHERE transaction_type = 'credit' GROUP BY 1, 2) GROUP BY 1")
def agg_20_mean_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = transactions(spark, sf_dir).where("transaction_type = 'credit'").groupBy("account_id", ops.month().alias("m")).agg(F.sum("amount").alias("s"))
    return sums.groupBy("account_id").agg(F.round(F.avg("s"), 6).alias("mean"))


@query("SELECT account_id, strftime(date, '%Y-%m') AS month, round(coalesce(sum(amount) FILTER (transaction_type = 'credit'), 0), 2) AS credit, round(coalesce(sum(amount) FILTER (transaction_type = 'debit'), 0), 2) AS debit, count(*) AS n FROM txn GROUP BY 1, 2")
def agg_21_credit_debit_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda kind: F.round(F.coalesce(F.sum(_amount(kind)), F.lit(0.0)), 2).alias(kind)
    return transactions(spark, sf_dir).groupBy("account_id", ops.month().alias("month")).agg(total("credit"), total("debit"), F.count("*").alias("n"))


@query("SELECT account_id, count(*) AS n, min(balance) AS low, max(balance) AS high, array_to_string(list(seq ORDER BY date, seq), '>') AS series FROM txn GROUP BY 1")
def agg_22_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.array_sort(F.collect_list(F.struct("date", "seq")))
    return transactions(spark, sf_dir).groupBy("account_id").agg(F.count("*").alias("n"), F.min("balance").alias("low"), F.max("balance").alias("high"), F.array_join(F.transform(series, lambda x: x["seq"].cast("string")), ">").alias("series"))


@query(
    """WITH eod AS (SELECT account_id, CAST(date AS DATE) AS day, max_by(balance, seq) AS b FROM txn GROUP BY 1, 2)
    SELECT account_id, strftime(day, '%Y-%m') AS month, round(avg(b), 6) AS mean, round(median(b), 6) AS mid, min(b) AS low, max(b) AS high FROM eod GROUP BY 1, 2"""
)
def agg_23_24_end_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    eod = transactions(spark, sf_dir).groupBy("account_id", F.to_date("date").alias("day")).agg(F.max_by("balance", "seq").alias("b"))
    return eod.groupBy("account_id", F.date_format("day", "yyyy-MM").alias("month")).agg(F.round(F.avg("b"), 6).alias("mean"), F.round(F.median("b"), 6).alias("mid"), F.min("b").alias("low"), F.max("b").alias("high"))


@query(
    """SELECT bank_name, transaction_channel, count(*) AS n, round(sum(amount), 2) AS total, min(amount) AS low, max(amount) AS high, round(avg(amount), 6) AS mean,
    arg_min(date, (amount, date)) AS low_date, arg_min(date, (-amount, date)) AS high_date FROM txn GROUP BY 1, 2"""
)
def agg_26_27_merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    states = ops.accumulate(t, ["bank_name", "transaction_channel", "account_id"], "amount", "date")
    merged = ops.merge(states, ["bank_name", "transaction_channel"])
    return merged.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 6))


@query(
    """WITH m AS (SELECT account_id, strftime(date, '%Y-%m') AS month, sum(amount) AS total, CAST(count(*) AS DOUBLE) AS n FROM txn GROUP BY 1, 2),
    w AS (SELECT account_id, row_number() OVER w AS months, sum(total) OVER w AS total, sum(n) OVER w AS n FROM m WINDOW w AS (PARTITION BY account_id ORDER BY month DESC ROWS UNBOUNDED PRECEDING))
    SELECT account_id, months, round(total, 2) AS total, n FROM w WHERE months % 3 = 0"""
)
def agg_28_rolling_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = transactions(spark, sf_dir).groupBy("account_id", ops.month().alias("month")).agg(F.sum("amount").alias("total"), F.count("*").cast("double").alias("n"))
    out = ops.cumulative_months(monthly, "account_id", "month", ["total", "n"], 3)
    return out.select("account_id", F.col("months").cast("long").alias("months"), F.round("total", 2).alias("total"), "n")


@query("SELECT seq, CASE WHEN s < 0 THEN 'debit' ELSE 'credit' END AS label, round(s, 0) AS rounded, strftime(date, '%b-%Y') AS month FROM (SELECT *, CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END AS s FROM txn)")
def agg_29_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signed()
    return transactions(spark, sf_dir).select("seq", F.when(s < 0, "debit").otherwise("credit").alias("label"), F.round(s, 0).alias("rounded"), F.date_format("date", "MMM-yyyy").alias("month"))


_CHANNEL_SQL = ", ".join(f"count(*) FILTER (transaction_channel = '{c}' AND transaction_type = '{k}') AS {k}_{c}_n, round(coalesce(sum(amount) FILTER (transaction_channel = '{c}' AND transaction_type = '{k}'), 0), 2) AS {k}_{c}" for c in CHANNELS.values() for k in ("credit", "debit"))


@query(f"SELECT account_id, strftime(date, '%Y-%m') AS month, arg_min(balance, (date, seq)) AS opening, arg_max(balance, (date, seq)) AS closing, round(median(amount), 6) AS mid, {_CHANNEL_SQL} FROM txn GROUP BY 1, 2")
def agg_30_monthly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("date", "seq")
    per = []
    for c in CHANNELS.values():
        for k in ("credit", "debit"):
            hit = (F.col("transaction_channel") == c) & (F.col("transaction_type") == k)
            per += [F.count_if(hit).alias(f"{k}_{c}_n"), F.round(F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0.0)), 2).alias(f"{k}_{c}")]
    return transactions(spark, sf_dir).groupBy("account_id", ops.month().alias("month")).agg(F.min_by("balance", order).alias("opening"), F.max_by("balance", order).alias("closing"), F.round(F.median("amount"), 6).alias("mid"), *per)


@query("SELECT account_id, round(coalesce(sum(amount) FILTER (transaction_type = 'credit'), 0), 2) AS credit, round(coalesce(sum(-amount) FILTER (transaction_type = 'debit'), 0), 2) AS debit FROM txn GROUP BY 1")
def agg_32_unstacked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("signed", signed())
    out = ops.totals_by(t, ["account_id"], "transaction_type", ["credit", "debit"], "signed")
    return out.select("account_id", F.round("credit", 2).alias("credit"), F.round("debit", 2).alias("debit"))


@query("SELECT account_id, CASE WHEN max(date) = min(date) THEN 'NA' ELSE CAST(CAST(round(100.0 * count(*) / date_diff('day', min(date), max(date)), 0) AS INTEGER) AS VARCHAR) END AS per_100_days FROM txn GROUP BY 1")
def agg_33_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.datediff(F.max("date"), F.min("date"))
    return transactions(spark, sf_dir).groupBy("account_id").agg(F.when(span == 0, "NA").otherwise(F.round(100.0 * F.count("*") / span, 0).cast("int").cast("string")).alias("per_100_days"))


@query(
    """SELECT bank_name, transaction_channel, count(*) AS n, CAST(trunc(round(sum(amount), 2)) AS BIGINT) AS total, min(date) AS first_date, round(avg(balance + CASE WHEN transaction_type = 'debit' THEN amount ELSE -amount END), 6) AS mean_before
    FROM txn GROUP BY 1, 2"""
)
def agg_34_36_group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("bank_name", "transaction_channel").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).cast("long").alias("total"), F.min("date").alias("first_date"), F.round(F.avg(F.col("balance") - signed()), 6).alias("mean_before"))


@query(
    """SELECT bank_name, transaction_channel, k, min(d) AS first_day, max(d) AS last_day, count(*) AS n FROM (
      SELECT bank_name, transaction_channel, day(date) AS d, row_number() OVER (PARTITION BY bank_name, transaction_channel, strftime(date, '%Y-%m') ORDER BY date, seq) AS k FROM txn) GROUP BY 1, 2, 3"""
)
def agg_37_occurrence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("bank_name", "transaction_channel", ops.month()).orderBy("date", "seq")
    rows = transactions(spark, sf_dir).withColumn("k", F.row_number().over(w).cast("long"))
    day = F.dayofmonth("date").cast("long")
    return rows.groupBy("bank_name", "transaction_channel", "k").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


@query(
    """SELECT payee, amount, month, k, day, min(day) OVER (PARTITION BY month) AS first_day, max(day) OVER (PARTITION BY month) AS last_day FROM (
      SELECT *, row_number() OVER (PARTITION BY payee, amount, month ORDER BY date, seq) AS k FROM (
        SELECT split_part(transaction_note, '/', 2) AS payee, amount, strftime(date, '%Y-%m') AS month, day(date) AS day, date, seq FROM txn WHERE transaction_type = 'debit'))"""
)
def agg_37_payment_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    debits = transactions(spark, sf_dir).where("transaction_type = 'debit'")
    payments = debits.select(F.split_part("transaction_note", F.lit("/"), F.lit(2)).alias("payee"), "amount", ops.month().alias("month"), F.dayofmonth("date").cast("long").alias("day"), "date", "seq")
    return ops.occurrences(payments, ["payee", "amount"], "month", "day", ["date", "seq"])


@query("SELECT transaction_channel, " + ", ".join(f"round(coalesce(sum(amount) FILTER (year(date) = {y}), 0), 2) AS y{y}" for y in range(1995, 2002)) + ", round(sum(amount), 2) AS total FROM txn WHERE transaction_type = 'debit' GROUP BY ROLLUP (transaction_channel)")
def spend_by_year_1995_2001(spark: SparkSession, sf_dir: str) -> DataFrame:
    debits = transactions(spark, sf_dir).where("transaction_type = 'debit'").withColumn("y", F.year("date"))
    years = [F.round(F.coalesce(F.sum(F.when(F.col("y") == y, F.col("amount"))), F.lit(0.0)), 2).alias(f"y{y}") for y in range(1995, 2002)]
    return debits.rollup("transaction_channel").agg(*years, F.round(F.sum("amount"), 2).alias("total"))


@query(
    """WITH d AS (SELECT transaction_channel, strftime(date, '%Y-%m') AS month, sum(amount) AS amount FROM txn WHERE transaction_type = 'debit' GROUP BY 1, 2),
    m AS (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM txn), c AS (SELECT DISTINCT transaction_channel FROM d),
    g AS (SELECT c.transaction_channel, m.month, coalesce(d.amount, 0) AS amount FROM c CROSS JOIN m LEFT JOIN d ON d.month = m.month AND d.transaction_channel = c.transaction_channel)
    SELECT transaction_channel, month, CAST(grouping(transaction_channel, month) AS BIGINT) AS level, round(sum(amount), 2) AS amount,
           CASE WHEN grouping(month) = 1 THEN round(sum(amount) / (SELECT count(*) FROM m), 2) END AS average
    FROM g GROUP BY CUBE (transaction_channel, month)"""
)
def agg_38_39_spend_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("month", ops.month())
    return ops.spend_by_month(t.where("transaction_type = 'debit'"), t, "transaction_channel", "month", "amount")


@query(
    """WITH s AS (SELECT bank_name, transaction_channel, count(*) AS n FROM txn WHERE transaction_type = 'debit' GROUP BY 1, 2),
    p AS (SELECT *, floor(100.0 * n / sum(n) OVER w) AS f, round(100.0 * n / sum(n) OVER w - floor(100.0 * n / sum(n) OVER w), 9) AS r FROM s WINDOW w AS (PARTITION BY bank_name)),
    q AS (SELECT *, 100 - sum(f) OVER (PARTITION BY bank_name) AS missing, row_number() OVER (PARTITION BY bank_name ORDER BY r DESC, transaction_channel) AS k FROM p)
    SELECT bank_name, transaction_channel, CAST(f + CASE WHEN k <= missing THEN 1 ELSE 0 END AS INTEGER) AS percent FROM q"""
)
def agg_40_41_whole_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = transactions(spark, sf_dir).where("transaction_type = 'debit'").groupBy("bank_name", "transaction_channel").agg(F.count("*").alias("n"))
    return ops.largest_remainder(n, ["bank_name"], "n", "transaction_channel").select("bank_name", "transaction_channel", "percent")


@query("SELECT statement_id, min(date) AS first_date, max(date) AS last_date, count(DISTINCT page_number) AS pages, count(*) AS n FROM txn GROUP BY 1")
def agg_42_statement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("statement_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("page_number").alias("pages"), F.count("*").alias("n"))


@query("SELECT note, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT lower(split_part(transaction_note, '/', 2)) AS note, amount FROM txn) GROUP BY 1 ORDER BY round(sum(amount), 2) DESC, note LIMIT 10")
def agg_43_57_top_payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.lower(F.split_part("transaction_note", F.lit("/"), F.lit(2)))
    return transactions(spark, sf_dir).groupBy(note.alias("note")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total")).orderBy(F.desc("total"), "note").limit(10)


@query("SELECT account_id, transaction_channel, string_agg(strftime(date, '%Y-%m-%d'), ' ' ORDER BY date) AS dates FROM txn GROUP BY 1, 2")
def agg_44_joined_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd")))
    return transactions(spark, sf_dir).groupBy("account_id", "transaction_channel").agg(F.array_join(dates, " ").alias("dates"))


@query("SELECT account_id, least(min(balance), 0) AS worst, count(*) FILTER (balance < 0) AS negatives, count(*) > 8 AND 2 * count(*) FILTER (balance < 0) >= count(*) AS is_overdraft FROM txn GROUP BY 1")
def agg_46_overdraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    negative = F.count_if(F.col("balance") < 0)
    return transactions(spark, sf_dir).groupBy("account_id").agg(F.least(F.min("balance"), F.lit(0.0)).alias("worst"), negative.alias("negatives"), ((F.count("*") > 8) & (2 * negative >= F.count("*"))).alias("is_overdraft"))


@query("SELECT statement_id, 100.0 * count(*) FILTER (transaction_channel = 'Other') / count(*) > 15 AS rejected FROM txn GROUP BY 1")
def agg_47_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("statement_id").agg((100.0 * F.count_if(F.col("transaction_channel") == "Other") / F.count("*") > 15).alias("rejected"))


@query("SELECT account_id, list_extract(list(amount ORDER BY amount), CAST(count(*) // 2 AS INTEGER) + 1) AS mid, min(date) AS first_date, max(date) AS last_date FROM txn GROUP BY 1")
def agg_48_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("account_id").agg(ops.upper_median(F.col("amount")).alias("mid"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("SELECT account_id, count(DISTINCT strftime(CASE WHEN day(date) > 25 THEN date + INTERVAL 10 DAYS ELSE date END, '%m-%Y')) AS months FROM txn GROUP BY 1")
def agg_49_shifted_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.dayofmonth("date") > 25, F.date_add("date", 10)).otherwise(F.to_date("date"))
    return transactions(spark, sf_dir).groupBy("account_id").agg(F.countDistinct(F.date_format(shifted, "MM-yyyy")).alias("months"))


_LOOK = (90, 365, 1000)


@query(
    "WITH a AS (SELECT *, date_diff('day', date, max(date) OVER (PARTITION BY account_id)) AS age FROM txn) SELECT account_id, "
    + ", ".join(f"nullif(round(coalesce(sum(amount) FILTER (transaction_type = 'credit' AND age < {d}), 0), 2), 0) AS credit_{d}, nullif(CAST(count(*) FILTER (age < {d}) AS DOUBLE), 0) AS n_{d}, max(amount) FILTER (transaction_type = 'debit' AND age < {d}) AS top_{d}" for d in _LOOK)
    + " FROM a GROUP BY 1"
)
def agg_50_51_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = {
        "credit": lambda within: F.round(F.coalesce(F.sum(F.when(within, _amount("credit"))), F.lit(0.0)), 2),
        "n": lambda within: F.count_if(within).cast("double"),
        "top": lambda within: F.max(F.when(within, _amount("debit"))),
    }
    return ops.look_back(transactions(spark, sf_dir), "account_id", "date", _LOOK, features)


@query(
    """WITH b AS (SELECT transaction_channel, sum(1.0) AS w, sum(CASE WHEN transaction_type = 'debit' THEN 1.0 ELSE 0.0 END) AS bad FROM txn GROUP BY 1), a AS (SELECT sum(w) AS w, sum(bad) AS bad FROM b)
    SELECT b.transaction_channel, round(ln(((b.w - b.bad) / b.w + 0.5) / (b.bad / b.w + 0.5)) - ln(((a.w - a.bad) / a.w + 0.5) / (a.bad / a.w + 0.5)), 6) AS woe FROM b, a"""
)
def agg_52_weight_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("transaction_channel", (F.col("transaction_type") == "debit").cast("double").alias("bad_row"), F.lit(1.0).alias("one"))
    return ops.weight_of_evidence(t, "transaction_channel", "bad_row", "one", 0.5).withColumn("woe", F.round("woe", 6))


@query("SELECT account_id, max(n) > 3 AS over_three, count(*) FILTER (n > 1) > 1 AS often_two, count(*) AS months FROM (SELECT account_id, strftime(date, '%Y-%m') AS m, count(*) AS n FROM txn WHERE transaction_type = 'credit' GROUP BY 1, 2) GROUP BY 1")
def agg_58_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = transactions(spark, sf_dir).where("transaction_type = 'credit'").groupBy("account_id", ops.month().alias("m")).agg(F.count("*").alias("n"))
    return sizes.groupBy("account_id").agg((F.max("n") > 3).alias("over_three"), (F.count_if(F.col("n") > 1) > 1).alias("often_two"), F.count("*").alias("months"))


#: Transactions of every channel, description and category that a rolling feature asks for.
_CHANNELS_OF_ROLLING = list(dict.fromkeys([*rolling.CREDIT_CHANNELS, *rolling.DEBIT_CHANNELS, "investments", "salary", "Other"]))
_DESCRIBED = ("chq_bounce_insuff_funds", "credit_card_bill", "min_bal_charge", "minimum_balance_charge", "self_transfer", "ach_bounce_charge", "lender_transaction", "")
_ROLLED = f"""SELECT account_id, seq, date, transaction_type, amount, CASE WHEN account_id % 3 = 0 THEN balance - 300000 ELSE balance END AS balance,
  CASE (seq * 5 + account_id) % {len(_CHANNELS_OF_ROLLING)} {' '.join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CHANNELS_OF_ROLLING))} END AS transaction_channel,
  CASE (seq + 2 * account_id) % {len(_DESCRIBED)} {' '.join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(_DESCRIBED))} END AS description,
  CASE (seq * 3 + account_id) % 8 {' '.join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(rolling.CATEGORIES))} END AS merchant_category, (seq + account_id) % 4 = 1 AS is_lender, (seq + account_id) % 9 = 2 AS is_salary FROM txn"""
_BEFORE = "s - CAST(day(last_day(s - INTERVAL 1 MONTH)) AS INTEGER)"
_ROLLING_SQL = f"""g AS ({_ROLLED}), span AS (SELECT account_id, CAST(min(date) AS DATE) AS low, CAST(max(date) AS DATE) + 1 AS fin FROM g GROUP BY 1),
  cal AS (SELECT account_id, 0 AS k, fin AS s, low FROM span UNION ALL SELECT account_id, k + 1, CAST({_BEFORE} AS DATE), low FROM cal WHERE {_BEFORE} > low),
  mon AS (SELECT account_id, k AS month, coalesce(lead(s) OVER (PARTITION BY account_id ORDER BY k), low) AS a, s - 1 AS z, count(*) OVER (PARTITION BY account_id) AS months FROM cal),
  r AS (SELECT g.*, mon.month FROM g JOIN mon ON g.account_id = mon.account_id AND CAST(date AS DATE) BETWEEN a AND z),
  e AS (SELECT account_id, CAST(date AS DATE) AS day, arg_max(balance, (date, seq)) AS b, bool_or(balance < 0) AS below FROM g GROUP BY 1, 2),
  days AS (SELECT account_id, CAST(unnest(generate_series(low, fin - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
  eod AS (SELECT d.account_id, d.day, last_value(e.b IGNORE NULLS) OVER (PARTITION BY d.account_id ORDER BY d.day ROWS UNBOUNDED PRECEDING) AS b, e.below FROM days d LEFT JOIN e ON e.account_id = d.account_id AND e.day = d.day),
  held AS (SELECT eod.*, mon.month FROM eod JOIN mon ON eod.account_id = mon.account_id AND day BETWEEN a AND z),
  one AS ({" UNION ALL ".join(f"SELECT account_id, month, '{name}' AS feature, amount AS v FROM r WHERE {rule}" for name, rule in rolling.FEATURES.items())}
    UNION ALL SELECT account_id, month, 'opening_balance', arg_min(balance, (date, seq)) FROM r GROUP BY 1, 2 UNION ALL SELECT account_id, month, 'closing_balance', arg_max(balance, (date, seq)) FROM r GROUP BY 1, 2
    UNION ALL SELECT account_id, month, 'avg_bal', b FROM held UNION ALL SELECT account_id, month, 'balance_on_' || day(day), b FROM held WHERE day(day) IN (1, 5, 10, 15, 20, 25, 30)),
  added AS (SELECT account_id, month, feature, round(sum(v), 2) AS sum, count(*) AS count, max(v) AS max, min(v) AS min FROM one GROUP BY 1, 2, 3),
  nets AS (SELECT account_id, month, coalesce(sum(CASE WHEN feature = 'credit' THEN sum END), 0) AS c, coalesce(sum(CASE WHEN feature = 'debit' THEN sum END), 0) AS d, coalesce(sum(CASE WHEN feature = 'loan_credits' THEN sum END), 0) AS l, coalesce(sum(CASE WHEN feature = 'refund_credit' THEN sum END), 0) AS f,
    count(CASE WHEN feature NOT IN ('opening_balance', 'closing_balance', 'avg_bal') AND NOT starts_with(feature, 'balance_on_') THEN 1 END) AS n FROM added GROUP BY 1, 2),
  monthly AS (SELECT * FROM added UNION ALL SELECT account_id, month, 'net_cash_inflow', round(c - d, 2) + 0.0, 1, round(c - d, 2) + 0.0, round(c - d, 2) + 0.0 FROM nets WHERE n > 0 UNION ALL SELECT account_id, month, 'income', round(c - l - f, 2) + 0.0, 1, round(c - l - f, 2) + 0.0, round(c - l - f, 2) + 0.0 FROM nets WHERE n > 0
    UNION ALL SELECT account_id, month, 'negative_balance_days', NULL, count(*), NULL, NULL FROM held WHERE below OR (below IS NULL AND b < 0) GROUP BY 1, 2),
  grouped AS (SELECT m.account_id, t.g, m.feature, round(sum(m.sum), 2) AS sum, sum(m.count) AS count, max(m.max) AS max, min(m.min) AS min FROM monthly m JOIN (SELECT DISTINCT account_id, months FROM mon) n ON n.account_id = m.account_id
    JOIN (SELECT unnest(range(1, 200)) AS g) t ON m.month < 3 * t.g AND 3 * t.g <= n.months WHERE (m.feature <> 'opening_balance' OR m.month = 3 * t.g - 1) AND (m.feature <> 'closing_balance' OR m.month = 0) GROUP BY 1, 2, 3),
  both_ AS (SELECT account_id, 'month_' || month AS period, feature, sum, count, sum / count AS avg, max, min FROM monthly UNION ALL SELECT account_id, (3 * g) || '_months_group', feature, sum, count, sum / count, max, min FROM grouped),
  ratio AS (SELECT account_id, period, (CASE WHEN max(CASE WHEN feature = 'emi_debit' THEN sum END) <> 0 THEN max(CASE WHEN feature = 'avg_bal' THEN sum / count END) / max(CASE WHEN feature = 'emi_debit' THEN sum END) ELSE 9.0 END) AS r FROM both_ GROUP BY 1, 2)"""


_TOLD = ("avg_bal", "opening_balance", "closing_balance", "abb_isto_emi", "net_cash_inflow", "income", "balance_on_15")


@query(
    f"""WITH {_ROLLING_SQL}, every AS (SELECT * FROM both_ UNION ALL SELECT account_id, period, 'abb_isto_emi', r, 1, r, r, r FROM ratio)
    SELECT account_id, period, count(*) AS features, round(sum(sum), 2) AS total, CAST(sum(count) AS BIGINT) AS n, max(max) AS max, min(min) AS min, {", ".join(f"max(CASE WHEN feature = '{f}' THEN avg END) AS {f}" for f in _TOLD)},
      CAST(max(CASE WHEN feature = 'negative_balance_days' THEN count END) AS BIGINT) AS negative_days FROM every GROUP BY 1, 2""",
    recursive=True,
)
def win_28_agg_28_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every rolling month and of the latest 3, 6, 9 ... months, summed up by period, some of them told."""
    found = rolling.rolling_features(worn(spark, sf_dir, _ROLLED), "account_id", ["date", "seq"])
    told = [F.max(F.when(F.col("feature") == f, F.col("avg"))).alias(f) for f in _TOLD]
    days = F.max(F.when(F.col("feature") == "negative_balance_days", F.col("count"))).alias("negative_days")
    return found.groupBy("account_id", "period").agg(F.count("*").alias("features"), F.round(F.sum("sum"), 2).alias("total"), F.sum("count").alias("n"), F.max("max").alias("max"), F.min("min").alias("min"), *told, days)


#: The same with the categories of the predictors, and dates close enough that every window has rows.
_SCORED = f"""SELECT account_id, seq, TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' DAY * CAST((seq * 13 + account_id) % 330 AS INTEGER) AS date, transaction_type, amount, CASE WHEN seq % 6 = 0 THEN 50.0 ELSE balance END AS balance, transaction_channel,
  CASE seq % 9 WHEN 0 THEN 'loans' WHEN 1 THEN 'food' WHEN 2 THEN 'bills' WHEN 3 THEN 'ewallet' WHEN 4 THEN 'fuel' WHEN 5 THEN 'groceries' WHEN 6 THEN 'travel' WHEN 7 THEN NULL ELSE 'x' END AS merchant_category FROM ({_ROLLED}) x"""


def _scored_sql() -> str:
    def within(window: str) -> str:
        return "true" if window == "all" else f"date > fin - INTERVAL {window[1:]} DAY" if window[0] == "c" else f"apart = {window[1:]}"

    def part(how: str, of: str, rule: str, window: str) -> str:
        rows = f"FILTER (({rule}) AND {within(window)})"
        return {"count": f"CAST(count({of}) {rows} AS DOUBLE)", "sum": f"round(coalesce(sum({of}) {rows}, 0), 2)", "mean": f"avg({of}) {rows}"}.get(how, f"{how}({of}) {rows}")

    out = [f"nullif({part(*p)}, 0) AS {name}" if p[0] in ("count", "sum") else f"{part(*p)} AS {name}" for name, p in predictors.PREDICTORS.items()]
    for name, (how, above, below, window, times) in predictors.RATIOS.items():
        ratio = f"CASE WHEN {part(how, 'amount', below, window)} <> 0 THEN {part(how, 'amount', above, window)} / {part(how, 'amount', below, window)} * {times} END"
        out.append(f"{ratio if name == 'ratio_cnt_nonlender_to_lender_debits' else f'nullif({ratio}, 0)'} AS {name}")
    return ", ".join(out)


@query(
    f"""WITH g AS (SELECT * REPLACE (coalesce(merchant_category, '') AS merchant_category), max(date) OVER (PARTITION BY account_id) AS fin FROM ({_SCORED}) x),
    a AS (SELECT *, 12 * (year(fin) - year(date)) + month(fin) - month(date) AS apart FROM g) SELECT account_id, {_scored_sql()} FROM a GROUP BY 1"""
)
def agg_50_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.predictors(worn(spark, sf_dir, _SCORED), "account_id")


def _basic_sql() -> str:
    out = []
    for side, names in (("debit", rolling.DEBIT_CHANNELS), ("credit", rolling.CREDIT_CHANNELS)):
        for c in names:
            rows = f"FILTER (transaction_channel = '{c}' AND transaction_type = '{side}')"
            out += [f"round(coalesce(sum(amount) {rows}, 0), 2) AS amt_{c}_{side}", f"count(*) {rows} AS cnt_{c}_{side}"]
    return ", ".join(out)


@query(
    f"""WITH g AS (SELECT *, strftime(date, '%Y-%m') AS month, CAST(date AS DATE) AS day FROM ({_SCORED}) x),
    e AS (SELECT account_id, month, day, arg_max(balance, (date, seq)) AS b FROM g GROUP BY 1, 2, 3), m AS (SELECT account_id, month, min(day) AS a, max(day) AS z, max(b) AS max_eod_balance, min(b) AS min_eod_balance FROM e GROUP BY 1, 2),
    d AS (SELECT account_id, month, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM m),
    f AS (SELECT d.account_id, d.month, d.day, last_value(b IGNORE NULLS) OVER (PARTITION BY d.account_id, d.month ORDER BY d.day ROWS UNBOUNDED PRECEDING) AS b FROM d LEFT JOIN e ON d.account_id = e.account_id AND d.day = e.day),
    l AS (SELECT account_id, month, round(avg(b), 8) AS avg_bal, median(b) AS median_balance FROM f GROUP BY 1, 2), o AS (SELECT account_id, month, arg_max(b, (n, -b)) AS mode_balance FROM (SELECT account_id, month, b, count(*) AS n FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2),
    w AS (SELECT account_id, month, count(*) AS cnt_transactions, count(*) FILTER (transaction_type = 'debit') AS cnt_debit, count(*) FILTER (transaction_type = 'credit') AS cnt_credit,
      round(arg_min(CASE WHEN transaction_type = 'debit' THEN balance + amount ELSE balance - amount END, (date, seq)), 2) AS opening_balance, round(coalesce(sum(amount) FILTER (transaction_type = 'debit'), 0), 2) AS amt_debit, round(coalesce(sum(amount) FILTER (transaction_type = 'credit'), 0), 2) AS amt_credit,
      arg_max(balance, (date, seq)) AS closing_balance, min(balance) AS lowest, max(balance) AS highest, round(avg(amount) FILTER (transaction_type = 'credit'), 8) AS avg_credit_transaction_size, round(avg(amount) FILTER (transaction_type = 'debit'), 8) AS avg_debit_transaction_size, {_basic_sql()} FROM g GROUP BY 1, 2)
    SELECT w.* EXCLUDE (lowest, highest), least(lowest, opening_balance) AS min_bal, greatest(highest, opening_balance) AS max_bal, round(amt_credit - amt_debit, 2) + 0.0 AS net_cash_inflow, l.avg_bal, l.median_balance, o.mode_balance, m.max_eod_balance, m.min_eod_balance
    FROM w JOIN l ON l.account_id = w.account_id AND l.month = w.month JOIN o ON o.account_id = w.account_id AND o.month = w.month JOIN m ON m.account_id = w.account_id AND m.month = w.month"""
)
def agg_30_basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predictors.basic_features(worn(spark, sf_dir, _SCORED), "account_id", ["date", "seq"])
    return out.withColumns({c: F.round(c, 8) for c in ("avg_bal", "avg_credit_transaction_size", "avg_debit_transaction_size")})
