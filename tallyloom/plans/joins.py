"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.model import table, transactions
from tallyloom.operators import joins as ops
from tallyloom.plans.registry import query


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", txn=False)
def jon_1_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT DISTINCT c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", txn=False)
def jon_2_5_many_way_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_mktsegment", "n_name", "r_name").distinct()


@query("SELECT c_custkey, o_orderkey, r_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')", txn=False)
def jon_3_left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.where(F.col("r_name").isin("ASIA", "EUROPE")).select("c_custkey", "o_orderkey", "r_name")


@query("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey", txn=False)
def jon_4_comma_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT s_name, n_name FROM {s}, {n} WHERE s_nationkey = n_nationkey", s=table(spark, sf_dir, "supplier"), n=table(spark, sf_dir, "nation"))


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY bank_name, statement_month, transaction_channel ORDER BY seq) AS k FROM (SELECT *, strftime(date, '%Y-%m') AS statement_month FROM txn WHERE transaction_type = 'debit')),
    r AS (SELECT *, row_number() OVER (PARTITION BY bank_name, statement_month, transaction_channel ORDER BY seq) AS k FROM (SELECT *, strftime(date, '%Y-%m') AS statement_month FROM txn WHERE transaction_type = 'credit'))
    SELECT l.seq AS left_seq, r.seq AS right_seq FROM l JOIN r ON l.bank_name = r.bank_name AND l.statement_month = r.statement_month AND l.transaction_channel = r.transaction_channel AND l.k = r.k"""
)
def jon_7_numbered_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("statement_month", F.date_format("date", "yyyy-MM")).select("bank_name", "statement_month", "transaction_channel", "transaction_type", "seq")
    side = lambda kind, name: t.where(F.col("transaction_type") == kind).drop("transaction_type").withColumnRenamed("seq", name)
    return ops.pair_duplicates(side("debit", "left_seq"), side("credit", "right_seq"), ["bank_name", "statement_month", "transaction_channel"], "left_seq", "right_seq").select("left_seq", "right_seq")


@query(
    """WITH l AS (SELECT account_id, strftime(date, '%Y-%m') AS m, max(seq) AS credit_seq FROM txn WHERE transaction_type = 'credit' GROUP BY 1, 2),
    r AS (SELECT account_id, strftime(date, '%Y-%m') AS m, max(seq) AS debit_seq FROM txn WHERE transaction_type = 'debit' GROUP BY 1, 2)
    SELECT l.account_id, l.m AS month, credit_seq, debit_seq FROM l JOIN r ON l.account_id = r.account_id AND l.m = r.m"""
)
def jon_8_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("month", F.date_format("date", "yyyy-MM"))
    side = lambda kind: ops.last_of(t.where(F.col("transaction_type") == kind), ["account_id", "month"], [F.col("seq").desc()]).select("account_id", "month", F.col("seq").alias(f"{kind}_seq"))
    return side("credit").join(side("debit"), ["account_id", "month"])


@query("SELECT t.seq, CASE WHEN t.amount > 300000 THEN 'patched' ELSE t.transaction_channel END AS transaction_channel FROM txn t")
def jon_9_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("seq", "transaction_channel", "amount")
    patch = t.where("amount > 300000").select("seq", F.lit("patched").alias("transaction_channel"))
    return ops.override(t.drop("amount"), patch, ["seq"], "transaction_channel")


@query("SELECT account_id, seq FROM txn WHERE account_id IN (SELECT account_id FROM txn WHERE amount > 495000)")
def jon_10_groups_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return ops.groups_with(t, t.where("amount > 495000"), "account_id", "seq").select("account_id", "seq")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) AS is_large FROM customer", txn=False)
def jon_11_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return ops.mark_members(table(spark, sf_dir, "customer").select("c_custkey"), large, "c_custkey", "is_large")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20)", txn=False)
def jon_12_semi_of_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    return table(spark, sf_dir, "orders").join(top, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query(
    """WITH m AS (SELECT account_id, median(amount) AS mid FROM txn GROUP BY account_id)
    SELECT t.account_id, t.seq FROM txn t JOIN m ON t.account_id = m.account_id WHERE t.amount BETWEEN mid * 0.8 AND mid * 1.2"""
)
def jon_13_around_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    mid = t.groupBy("account_id").agg(F.median("amount").alias("mid"))
    return t.join(mid, "account_id").where(F.col("amount").between(F.col("mid") * 0.8, F.col("mid") * 1.2)).select("account_id", "seq")


@query(
    """WITH a AS (SELECT account_id, strftime(date, '%Y-%m') AS month, count(*) AS n FROM txn GROUP BY 1, 2),
    b AS (SELECT account_id, strftime(date, '%Y-%m') AS month, sum(amount) AS s FROM txn WHERE transaction_channel = 'upi' GROUP BY 1, 2)
    SELECT a.account_id, a.month, a.n, CAST(trunc(coalesce(round(b.s, 2), 0)) AS BIGINT) AS upi_sum FROM a LEFT JOIN b ON a.account_id = b.account_id AND a.month = b.month"""
)
def jon_14_month_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("month", F.date_format("date", "yyyy-MM"))
    upi = t.where("transaction_channel = 'upi'").groupBy("account_id", "month").agg(F.sum("amount").alias("s"))
    return t.groupBy("account_id", "month").agg(F.count("*").alias("n")).join(upi, ["account_id", "month"], "left").select("account_id", "month", "n", F.coalesce(F.round("s", 2), F.lit(0)).cast("long").alias("upi_sum"))


@query(
    """WITH c AS (SELECT account_id, date, seq, least(date + INTERVAL 30 DAYS, lead(date) OVER (PARTITION BY account_id ORDER BY date)) AS hi FROM (SELECT account_id, date, min(seq) AS seq FROM txn WHERE transaction_type = 'credit' GROUP BY 1, 2)),
    x AS (SELECT account_id, date, seq, coalesce(hi, date + INTERVAL 30 DAYS) AS hi FROM c)
    SELECT x.seq AS credit_seq, d.transaction_channel, count(*) AS n, round(sum(d.amount), 2) AS spent FROM x JOIN txn d ON d.account_id = x.account_id AND d.transaction_type = 'debit' AND d.date >= x.date AND d.date < x.hi GROUP BY 1, 2"""
)
def jon_15_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    credits = t.where("transaction_type = 'credit'").groupBy("account_id", "date").agg(F.min("seq").alias("credit_seq"))
    spans = ops.until_next(credits, ["account_id"], "date", 30).withColumnRenamed("date", "low")
    debits = t.where("transaction_type = 'debit'").select("account_id", "date", "transaction_channel", "amount")
    met = ops.in_intervals(debits, spans, ["account_id"], "date", "low", "until", 30)
    return met.groupBy("credit_seq", "transaction_channel").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("spent"))


@query(
    """SELECT seq, prior_seq FROM (
      SELECT seq, transaction_type, last_value(CASE WHEN transaction_type = 'credit' THEN seq END IGNORE NULLS) OVER (PARTITION BY account_id, transaction_channel ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_seq FROM txn
    ) WHERE transaction_type = 'debit'"""
)
def jon_16_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return ops.as_of(t, ["account_id", "transaction_channel"], ["date", "seq"], F.col("transaction_type") == "credit", ["seq"]).select("seq", "prior_seq")


@query(
    """SELECT seq, next_seq FROM (
      SELECT seq, transaction_type, first_value(CASE WHEN transaction_type = 'credit' THEN seq END IGNORE NULLS) OVER (PARTITION BY bank_name, date ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_seq FROM txn
    ) WHERE transaction_type <> 'credit'"""
)
def jon_17_first_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_later(transactions(spark, sf_dir), ["bank_name", "date"], ["seq"], F.col("transaction_type") == "credit", "seq").select("seq", "next_seq")


@query("SELECT seq FROM txn d WHERE transaction_type = 'debit' AND NOT EXISTS (SELECT 1 FROM txn c WHERE c.transaction_type = 'credit' AND c.bank_name = d.bank_name AND c.date = d.date)")
def jon_18_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return t.where("transaction_type = 'debit'").join(t.where("transaction_type = 'credit'"), ["bank_name", "date"], "left_anti").select("seq")


@query(
    """SELECT a.seq AS left_seq, b.seq AS right_seq FROM txn a JOIN txn b ON a.account_id = b.account_id AND a.transaction_channel = b.transaction_channel AND a.seq < b.seq
    WHERE a.date <> b.date AND abs(day(a.date) - day(b.date)) <= 2 AND abs(length(a.transaction_note) - length(b.transaction_note)) <= 3"""
)
def jon_19_near_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("account_id", "transaction_channel", "seq", F.to_date("date").alias("day"), F.length("transaction_note").alias("size"))
    a, b = t.alias("a"), t.alias("b")
    on = (F.col("a.account_id") == F.col("b.account_id")) & (F.col("a.transaction_channel") == F.col("b.transaction_channel")) & (F.col("a.seq") < F.col("b.seq"))
    close = (F.col("a.day") != F.col("b.day")) & (F.abs(F.dayofmonth("a.day") - F.dayofmonth("b.day")) <= 2) & (F.abs(F.col("a.size") - F.col("b.size")) <= 3)
    return a.join(b, on & close).select(F.col("a.seq").alias("left_seq"), F.col("b.seq").alias("right_seq"))


@query()
def jon_19_recurring_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("clean", F.array_join(text.note_tokens(F.col("transaction_note"), []), " "))
    out = ops.recurring_pairs(t, ["account_id", "transaction_channel", "amount"], ["date", "seq"], "date", "transaction_note", "clean", "seq")
    return out.withColumnsRenamed({"left_id": "left_seq", "right_id": "right_seq"})


@query(
    """SELECT account_id, CAST(NULL AS BIGINT) AS seq, 'metadata' AS fraud_type FROM txn GROUP BY account_id HAVING count(DISTINCT bank_name) > 1 OR count(*) > 14
    UNION ALL SELECT account_id, seq, 'negative_balance' FROM txn WHERE balance < -300000 AND bank_name <> 'BUILDING'"""
)
def jon_21_union_of_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    many = t.groupBy("account_id").agg(F.countDistinct("bank_name").alias("b"), F.count("*").alias("n")).where("b > 1 OR n > 14").select("account_id", F.lit(None).cast("long").alias("seq"), F.lit("metadata").alias("fraud_type"))
    return many.unionByName(t.where("balance < -300000 AND bank_name <> 'BUILDING'").select("account_id", "seq", F.lit("negative_balance").alias("fraud_type")))


@query(
    """WITH top AS (SELECT account_id, amount FROM (SELECT account_id, amount, row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, seq) AS k FROM txn) WHERE k <= 2)
    SELECT account_id, min(t.seq) AS seq, t.amount FROM txn t JOIN top USING (account_id, amount) GROUP BY account_id, t.amount"""
)
def jon_22_rejoin_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("amount"), "seq"))
    top = t.withColumn("k", k).where("k <= 2").select("account_id", "amount")
    return t.join(top.distinct(), ["account_id", "amount"]).groupBy("account_id", "amount").agg(F.min("seq").alias("seq"))


@query("SELECT o_orderkey, CASE WHEN l.n IS NULL THEN 'Failed' ELSE 'Success' END AS status, coalesce('lines ' || l.n, 'no lines') AS reason FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey", txn=False)
def jon_24_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return joined.select("o_orderkey", F.when(F.col("n").isNull(), "Failed").otherwise("Success").alias("status"), F.when(F.col("n").isNull(), "no lines").otherwise(F.concat(F.lit("lines "), F.col("n").cast("string"))).alias("reason"))


@query("SELECT a.seq AS left_seq, b.seq AS right_seq FROM txn a JOIN txn b ON a.bank_name = b.bank_name AND a.date = b.date AND a.transaction_channel = b.transaction_channel WHERE a.transaction_type = 'debit' AND b.transaction_type = 'credit'")
def jon_25_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("bank_name", "date", "transaction_channel", "transaction_type", "seq")
    side = lambda kind, name: t.where(F.col("transaction_type") == kind).drop("transaction_type").withColumnRenamed("seq", name)
    return side("debit", "left_seq").join(side("credit", "right_seq"), ["bank_name", "date", "transaction_channel"]).select("left_seq", "right_seq")


@query("SELECT seq FROM txn WHERE account_id IN (SELECT account_id FROM txn GROUP BY account_id HAVING count(*) <= 5)")
def jon_26_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return t.join(t.groupBy("account_id").count().where("count <= 5"), "account_id", "left_semi").select("seq")


@query(
    """WITH eod AS (SELECT account_id, CAST(date AS DATE) AS day, max_by(balance, seq) AS balance FROM txn GROUP BY 1, 2),
    span AS (SELECT account_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM eod GROUP BY 1),
    s AS (SELECT account_id, CAST(d AS DATE) AS day FROM span)
    SELECT s.account_id, strftime(s.day, '%Y-%m') AS month, round(avg(b), 6) AS average FROM (
      SELECT s.account_id, s.day, last_value(e.balance IGNORE NULLS) OVER (PARTITION BY s.account_id ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS b FROM s LEFT JOIN eod e ON s.account_id = e.account_id AND s.day = e.day
    ) s GROUP BY 1, 2"""
)
def jon_27_daily_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ops.monthly_averages(transactions(spark, sf_dir), ["account_id"], "date", "balance", ["seq"])
    return means.withColumn("average", F.round("average", 6))
