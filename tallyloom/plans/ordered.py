"""Queries of the ordered analytics, top rows, sets and interval coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.model import by_account, table, transactions
from tallyloom.operators import coverage, sets, statements, windows
from tallyloom.plans.registry import query, worn

_W = "WINDOW w AS (PARTITION BY account_id ORDER BY date, seq)"
_SIGNED = "CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END"


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1", txn=False)
def win_1_latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_shipdate"), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))]
    return sets.first_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT DISTINCT account_id, statement_id FROM (SELECT *, dense_rank() OVER (PARTITION BY account_id ORDER BY year(date) DESC) AS k FROM txn) WHERE k = 1")
def win_2_latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.dense_rank().over(Window.partitionBy("account_id").orderBy(F.desc(F.year("date"))))
    return transactions(spark, sf_dir).withColumn("k", k).where("k = 1").select("account_id", "statement_id").distinct()


@query("SELECT seq, (SELECT count(*) FROM txn) AS total FROM txn ORDER BY date, seq LIMIT 25 OFFSET 50")
def win_3_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return sets.page(t, [F.col("date"), F.col("seq")], 25, 3).select("seq", t.agg(F.count("*")).scalar().alias("total"))


_TAMPERED = """tampered AS (SELECT account_id, seq, date, transaction_type, amount, bank_name, CASE WHEN seq % 97 = 0 THEN balance + 50 ELSE balance END AS balance FROM txn)"""


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).withColumn("balance", F.when(F.col("seq") % 97 == 0, F.col("balance") + 50).otherwise(F.col("balance")))


@query(f"WITH {_TAMPERED}, b AS (SELECT *, coalesce(abs(round(lag(balance) OVER w + {_SIGNED}, 2) - round(balance, 2)) > CASE WHEN lower(bank_name) = 'machinery' THEN 100.0 ELSE 0.1 END, false) AS bad FROM tampered {_W}) SELECT account_id, arg_min(seq, (date, seq)) AS first_bad, count(*) AS n FROM b WHERE bad GROUP BY 1")
def win_4_5_6_balance_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = windows.tolerance(F.col("bank_name"), ["MACHINERY"], wide=100.0)
    bad = _tampered(spark, sf_dir).withColumn("bad", windows.breaks(by_account(), limit)).where("bad")
    return bad.groupBy("account_id").agg(F.min_by("seq", F.struct("date", "seq")).alias("first_bad"), F.count("*").alias("n"))


@query()
def type_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("account_id", "seq", "date", "amount", "balance", F.when(F.col("seq") % 50 == 0, F.when(F.col("transaction_type") == "debit", "credit").otherwise("debit")).otherwise(F.col("transaction_type")).alias("transaction_type"))
    schema = "account_id long, seq long, date timestamp, amount double, balance double, transaction_type string"
    return windows.per_group(t, "account_id", ["date", "seq"], windows.repaired_types, schema).select("account_id", "seq", "transaction_type")


@query(f"SELECT statement_id, bool_or(up) AS has_up, bool_or(down) AS has_down, bool_or(up) AND bool_or(down) AS jumbled, arg_max(date, seq) < arg_min(date, seq) AS reversed FROM (SELECT *, coalesce(date > lag(date) OVER (PARTITION BY statement_id ORDER BY seq), false) AS up, coalesce(date < lag(date) OVER (PARTITION BY statement_id ORDER BY seq), false) AS down FROM txn) GROUP BY 1")
def win_9_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("date").over(Window.partitionBy("statement_id").orderBy("seq"))
    flagged = transactions(spark, sf_dir).withColumn("up", F.coalesce(F.col("date") > before, F.lit(False))).withColumn("down", F.coalesce(F.col("date") < before, F.lit(False)))
    return flagged.groupBy("statement_id").agg(F.bool_or("up").alias("has_up"), F.bool_or("down").alias("has_down"), (F.bool_or("up") & F.bool_or("down")).alias("jumbled"), (F.max_by("date", "seq") < F.min_by("date", "seq")).alias("reversed"))


@query("SELECT seq FROM txn")
def win_11_repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("statement_id", "seq", "date")
    doubled = t.withColumn("copy", F.lit(0)).union(t.withColumn("copy", F.lit(1)))  # each statement's rows, then again
    return statements.without_repeats(doubled, ["statement_id"], ["copy", "date", "seq"], ["seq", "date"]).select("seq")


@query(f"WITH i AS (SELECT *, sum(CASE WHEN transaction_channel = 'chq' THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS island FROM txn) SELECT account_id, CAST(island AS BIGINT) AS island, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM i GROUP BY 1, 2")
def win_12_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = windows.islands(transactions(spark, sf_dir), F.col("transaction_channel") == "chq", ["account_id"], ["date", "seq"])
    return t.groupBy("account_id", "island").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT bank_name, CAST(date AS DATE) AS a, CAST(date AS DATE) + CAST(page_number // 3 AS INTEGER) AS b FROM txn WHERE transaction_channel = 'chq'),
    f AS (SELECT *, CASE WHEN date_diff('day', max(b) OVER (PARTITION BY bank_name ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) <= 1 THEN 0 ELSE 1 END AS fresh FROM r),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY bank_name ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT bank_name, strftime(min(a), '%Y-%m-%d') AS a, strftime(max(b), '%Y-%m-%d') AS b FROM n GROUP BY bank_name, k"""
)
def win_13_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("date")
    spans = transactions(spark, sf_dir).where("transaction_channel = 'chq'").select("bank_name", day.alias("a"), F.date_add(day, F.floor(F.col("page_number") / 3).cast("int")).alias("b"))
    return sets.merged_intervals(spans, ["bank_name"], "a", "b").select("bank_name", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


@query()
def win_15_clamped_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("statement_id", "seq", "date")
    return windows.clamped_dates(t, "statement_id", ["seq"])


@query(f"SELECT seq, lag(seq) OVER w AS before_seq, lag(date) OVER w AS before_date FROM txn {_W}")
def win_16_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag(F.struct("seq", "date")).over(by_account())
    return transactions(spark, sf_dir).select("seq", before.alias("x")).select("seq", F.col("x.seq").alias("before_seq"), F.col("x.date").alias("before_date"))


@query(
    """SELECT seq, md5(regexp_replace(seq || transaction_channel || transaction_note || coalesce(CAST(lag(seq, 1) OVER w AS VARCHAR), 'None') || coalesce(lag(transaction_channel, 1) OVER w, 'None') || coalesce(lag(transaction_note, 1) OVER w, 'None')
    || coalesce(CAST(lag(seq, 2) OVER w AS VARCHAR), 'None') || coalesce(lag(transaction_channel, 2) OVER w, 'None') || coalesce(lag(transaction_note, 2) OVER w, 'None'), '[^0-9A-Za-z]', '', 'g')) AS hash FROM txn """
    + _W
)
def win_17_row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", windows.row_hash(["seq", "transaction_channel", "transaction_note"], by_account()).alias("hash"))


@query("SELECT seq, balance FROM txn")
def win_20_fill_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = transactions(spark, sf_dir).withColumn("_n", F.row_number().over(by_account())).withColumn("balance", F.when((F.col("_n") % 3 == 2) | (F.col("_n") == 1) & (F.count("*").over(Window.partitionBy("account_id")) > 2), None).otherwise(F.col("balance")))
    lone = holed.withColumn("balance", F.when(F.count("balance").over(Window.partitionBy("account_id")) > 0, F.col("balance")))
    return windows.fill_balances(lone, ["account_id"], ["date", "seq"]).select("seq", "balance")


@query(f"SELECT seq, last_value(CASE WHEN transaction_channel = 'upi' THEN date END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS carried FROM txn")
def win_21_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", windows.carry(F.when(F.col("transaction_channel") == "upi", F.col("date")), by_account()).alias("carried"))


@query(f"SELECT seq, CAST(sum(fell) OVER (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS years FROM (SELECT *, CASE WHEN month(date) * 100 + day(date) < lag(month(date) * 100 + day(date)) OVER w THEN 1 ELSE 0 END AS fell FROM txn {_W})")
def year_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", windows.rolls_over(F.col("date"), by_account()).alias("years"))


@query(f"SELECT seq FROM (SELECT *, lag(transaction_type) OVER w AS t0, lag(balance) OVER w AS b0, lead(transaction_type) OVER w AS t1 FROM txn {_W}) WHERE b0 > 0 AND transaction_type = 'debit' AND balance < 0 AND t1 = 'credit'")
def win_24_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_account()
    hit = (F.lag("balance").over(w) > 0) & (F.col("transaction_type") == "debit") & (F.col("balance") < 0) & (F.lead("transaction_type").over(w) == "credit")
    return transactions(spark, sf_dir).withColumn("hit", F.coalesce(hit, F.lit(False))).where("hit").select("seq")


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY account_id, transaction_channel ORDER BY date, seq) - 1 AS k FROM txn) SELECT a.seq AS debit_seq, b.seq AS credit_seq FROM p a JOIN p b ON a.account_id = b.account_id AND a.transaction_channel = b.transaction_channel AND a.k % 2 = 0 AND b.k = a.k + 1 WHERE a.transaction_type = 'debit' AND b.transaction_type = 'credit'")
def pairs_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["account_id", "transaction_channel"]
    t = windows.pairs_in_group(transactions(spark, sf_dir), keys, ["date", "seq"])
    both = t.groupBy(*keys, "pair").agg(F.max(F.when(F.col("place") == 0, F.struct("transaction_type", "seq"))).alias("a"), F.max(F.when(F.col("place") == 1, F.struct("transaction_type", "seq"))).alias("b"))
    return both.where("a.transaction_type = 'debit' AND b.transaction_type = 'credit'").select(F.col("a.seq").alias("debit_seq"), F.col("b.seq").alias("credit_seq"))


@query(f"SELECT account_id, count(*) FILTER (f < 0) AS negative FROM (SELECT account_id, last_value(CASE WHEN seq % 4 = 0 THEN NULL ELSE balance END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS f FROM txn) GROUP BY 1")
def win_26_27_negative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = F.when(F.col("seq") % 4 != 0, F.col("balance"))
    return transactions(spark, sf_dir).select("account_id", windows.carry(holed, by_account()).alias("f")).groupBy("account_id").agg(F.count_if(F.col("f") < 0).alias("negative"))


@query("SELECT account_id, CAST(date_diff('day', date, last) // 30 AS BIGINT) AS months_back, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT *, max(date) OVER (PARTITION BY account_id) AS last FROM txn) GROUP BY 1, 2")
def win_28_months_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("date").over(Window.partitionBy("account_id"))
    t = transactions(spark, sf_dir).withColumn("months_back", F.floor(F.datediff(last, "date") / 30))
    return t.groupBy("account_id", "months_back").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query()
def win_29_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("account_id", "seq", "date", "amount")
    return windows.recurring(t, "account_id", ["date", "seq"]).select("account_id", "seq", "group_no")


@query(f"SELECT account_id, count(*) FILTER (gap BETWEEN 25 AND 35) AS regular, count(*) AS n FROM (SELECT account_id, date_diff('day', lag(date) OVER w, date) AS gap FROM txn {_W}) GROUP BY 1")
def gaps_between_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.datediff("date", F.lag("date").over(by_account()))
    return transactions(spark, sf_dir).select("account_id", gap.alias("gap")).groupBy("account_id").agg(F.count_if(F.col("gap").between(25, 35)).alias("regular"), F.count("*").alias("n"))


@query("SELECT account_id, month, seq FROM (SELECT account_id, strftime(CASE WHEN day(date) < 20 THEN date - INTERVAL 1 MONTH ELSE date END, '%Y-%m') AS month, seq, row_number() OVER (PARTITION BY account_id, strftime(CASE WHEN day(date) < 20 THEN date - INTERVAL 1 MONTH ELSE date END, '%Y-%m') ORDER BY amount DESC, seq) AS k FROM txn WHERE transaction_type = 'credit') WHERE k = 1")
def win_31_one_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.dayofmonth("date") < 20, F.add_months("date", -1)).otherwise(F.to_date("date"))
    t = transactions(spark, sf_dir).where("transaction_type = 'credit'").withColumn("month", F.date_format(shifted, "yyyy-MM"))
    return sets.first_of(t, ["account_id", "month"], [F.desc("amount"), F.col("seq")]).select("account_id", "month", "seq")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 30", txn=False)
def srt_1_3_14_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_totalprice")


@query("SELECT seq FROM txn ORDER BY bank_name, page_number, seq LIMIT 40 OFFSET 80")
def srt_2_4_5_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.page(transactions(spark, sf_dir), [F.col("bank_name"), F.col("page_number"), F.col("seq")], 40, 3).select("seq")


@query("SELECT DISTINCT b.seq FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k FROM txn) a JOIN (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k FROM txn) b ON a.account_id = b.account_id AND b.k BETWEEN a.k - 2 AND a.k + 1 WHERE a.amount > 495000")
def srt_6_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.around(transactions(spark, sf_dir), ["account_id"], ["date", "seq"], F.col("amount") > 495000, 2, 1).select("seq")


@query("SELECT bank_name, month, rank, seq FROM (SELECT bank_name, strftime(date, '%Y-%m') AS month, CAST(row_number() OVER (PARTITION BY bank_name, strftime(date, '%Y-%m') ORDER BY amount DESC, seq) AS INTEGER) AS rank, seq FROM txn WHERE transaction_type = 'credit' AND NOT regexp_matches(transaction_note, '^CHQ')) WHERE rank <= 3")
def srt_7_10_11_top_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).where((F.col("transaction_type") == "credit") & ~F.col("transaction_note").rlike("^CHQ")).withColumn("month", F.date_format("date", "yyyy-MM"))
    return sets.top_of(t, ["bank_name", "month"], [F.desc("amount"), F.col("seq")], 3).select("bank_name", "month", "rank", "seq")


@query(
    """WITH m AS (SELECT account_id, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM txn GROUP BY 1),
    r AS (SELECT account_id, strftime(date, '%Y-%m') AS month, seq, row_number() OVER (PARTITION BY account_id, strftime(date, '%Y-%m') ORDER BY amount DESC, seq) AS k FROM txn WHERE transaction_type = 'debit')
    SELECT m.account_id, strftime(m.m, '%Y-%m') AS month, r.seq FROM m LEFT JOIN r ON r.account_id = m.account_id AND r.month = strftime(m.m, '%Y-%m') AND r.k <= 2"""
)
def srt_8_9_top_with_empty_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    spine = sets.covered_months(t.groupBy("account_id").agg(F.min("date").alias("a"), F.max("date").alias("b")), ["account_id"], "a", "b")
    debits = t.where("transaction_type = 'debit'").withColumn("month", F.date_format("date", "yyyy-MM"))
    return spine.join(sets.top_of(debits, ["account_id", "month"], [F.desc("amount"), F.col("seq")], 2), ["account_id", "month"], "left").select("account_id", "month", "seq")


@query("SELECT account_id, transaction_channel FROM (SELECT account_id, transaction_channel, row_number() OVER (PARTITION BY account_id ORDER BY round(avg(amount), 6) DESC, max(date) DESC, transaction_channel) AS k FROM txn GROUP BY 1, 2) WHERE k = 1")
def srt_12_best_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transactions(spark, sf_dir).groupBy("account_id", "transaction_channel").agg(F.round(F.avg("amount"), 6).alias("mean"), F.max("date").alias("latest"))
    return sets.first_of(g, ["account_id"], [F.desc("mean"), F.desc("latest"), F.col("transaction_channel")]).select("account_id", "transaction_channel")


@query("SELECT bank_name, transaction_type, seq FROM (SELECT bank_name, transaction_type, seq, row_number() OVER (PARTITION BY bank_name, transaction_type ORDER BY amount DESC, seq) AS a, row_number() OVER (PARTITION BY bank_name, transaction_type ORDER BY amount, seq) AS b FROM txn) WHERE a <= 5 OR b <= 5")
def srt_13_top_and_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, keys = transactions(spark, sf_dir), ["bank_name", "transaction_type"]
    ends = [sets.top_of(t, keys, [o, F.col("seq")], 5).select(*keys, "seq") for o in (F.desc("amount"), F.col("amount"))]
    return ends[0].union(ends[1]).distinct()


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier", txn=False)
def set_1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").where("c_acctbal > 9000"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).union(s.select("s_nationkey")).distinct()


@query("SELECT seq AS id, 'txn' AS kind, date FROM txn UNION ALL SELECT event_id, 'event', ts FROM events")
def set_2_4_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select(F.col("seq").alias("id"), F.lit("txn").alias("kind"), "date")
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("date"), F.col("event_id").alias("id"), F.lit("event").alias("kind"))
    return t.unionByName(e)


@query("SELECT account_id, date, amount, min(seq) AS seq FROM txn GROUP BY 1, 2, 3")
def set_3_merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    overlapping = t.where("page_number <= 7").union(t.where("page_number >= 5"))
    return sets.first_of(overlapping, ["account_id", "date", "amount"], [F.col("seq")]).select("account_id", "date", "amount", "seq")


@query("SELECT account_id, max(seq) AS seq FROM txn GROUP BY account_id, strftime(date, '%Y-%m')")
def set_5_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("month", F.date_format("date", "yyyy-MM"))
    return sets.first_of(t, ["account_id", "month"], [F.desc("seq")]).select("account_id", "seq")


@query(
    """WITH d AS (SELECT DISTINCT bank_name, CAST(date AS DATE) AS day FROM txn WHERE amount > 450000), s AS (SELECT bank_name, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
    SELECT bank_name, strftime(day, '%Y-%m') AS month, array_to_string(list(CAST(day(day) AS VARCHAR) ORDER BY day), ',') AS days FROM (SELECT * FROM s EXCEPT SELECT * FROM d) GROUP BY 1, 2"""
)
def set_6_7_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = transactions(spark, sf_dir).where("amount > 450000").select("bank_name", F.to_date("date").alias("day")).distinct()
    spine = days.groupBy("bank_name").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("bank_name", F.explode(F.sequence("a", "b")).alias("day"))
    gone = spine.exceptAll(days)
    return gone.groupBy("bank_name", F.date_format("day", "yyyy-MM").alias("month")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.dayofmonth("day"))), lambda d: d.cast("string")), ",").alias("days"))


@query("SELECT DISTINCT account_id, strftime(m, '%Y-%m') AS month FROM (SELECT account_id, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM txn GROUP BY account_id, statement_id)")
def set_8_13_14_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = transactions(spark, sf_dir).groupBy("account_id", "statement_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return sets.covered_months(spans, ["account_id"], "a", "b")


@query(
    """WITH s AS (SELECT account_id, statement_id, CAST(min(date) AS DATE) AS a, CAST(max(date) AS DATE) AS b FROM txn GROUP BY 1, 2), g AS (SELECT account_id, a, lag(b) OVER (PARTITION BY account_id ORDER BY a) AS before FROM s)
    SELECT account_id, strftime(before + 1, '%Y-%m-%d') AS gap_from, strftime(a - 1, '%Y-%m-%d') AS gap_to FROM g WHERE date_diff('day', before, a) > 1"""
)
def set_9_10_11_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = transactions(spark, sf_dir).groupBy("account_id", "statement_id").agg(F.to_date(F.min("date")).alias("a"), F.to_date(F.max("date")).alias("b"))
    gaps = sets.interval_gaps(spans, ["account_id"], "a", "b")
    return gaps.select("account_id", F.col("gap_from").cast("string").alias("gap_from"), F.col("gap_to").cast("string").alias("gap_to"))


#: Statements of a year; those of some accounts share a row with the one before, some do not carry the balance.
_YEARS = """SELECT account_id, seq, date, statement_id, transaction_type, amount, CASE WHEN account_id % 3 = 1 AND year(date) % 2 = 0 THEN balance + 50 ELSE balance END AS balance FROM txn
  UNION ALL SELECT account_id, seq, date, account_id || '-' || (year(date) + 1), transaction_type, amount, CASE WHEN account_id % 3 = 1 AND year(date) % 2 = 0 THEN balance + 50 ELSE balance END FROM txn WHERE account_id % 4 = 1 AND seq % 5 = 0"""
_ASKED = """SELECT account_id, CAST('1995-02-10' AS DATE) AS asked_from, CASE WHEN account_id % 2 = 0 THEN CAST('2000-12-31' AS DATE) ELSE CAST('2001-03-20' AS DATE) END AS asked_to, CASE WHEN account_id % 5 = 0 THEN CAST('1996-07-01' AS DATE) END AS opening FROM (SELECT DISTINCT account_id FROM txn WHERE account_id % 11 <> 0) d"""


@query(
    f"""WITH g AS ({_YEARS}), asked AS ({_ASKED}), z AS (SELECT *, CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END AS step, row_number() OVER (PARTITION BY account_id, statement_id ORDER BY date, seq) AS f, row_number() OVER (PARTITION BY account_id, statement_id ORDER BY date DESC, seq DESC) AS l FROM g),
    s AS (SELECT account_id, statement_id, CAST(min(date) AS DATE) AS low, CAST(max(date) AS DATE) AS high, max(CASE WHEN f = 1 THEN step END) AS step, max(CASE WHEN f = 1 THEN balance END) AS opens, max(CASE WHEN l = 1 THEN balance END) AS closes FROM z GROUP BY 1, 2),
    n AS (SELECT *, lag(statement_id) OVER w AS before, lag(high) OVER w AS ended, lag(closes) OVER w AS carried FROM s WINDOW w AS (PARTITION BY account_id ORDER BY low, high, statement_id)),
    between_ AS (SELECT account_id, ended AS a, low AS b FROM n WHERE before IS NOT NULL AND low >= ended AND NOT abs(round(carried + step, 2) - opens) <= 0.1
      AND NOT EXISTS (SELECT 1 FROM g p JOIN g q ON p.account_id = q.account_id AND p.seq = q.seq AND p.date = q.date AND p.balance = q.balance WHERE p.account_id = n.account_id AND p.statement_id = n.statement_id AND q.statement_id = n.before)),
    e AS (SELECT s.account_id, min(low) AS low, max_by(high, (low, high)) AS high FROM s GROUP BY 1), x AS (SELECT e.*, asked_from, asked_to, opening FROM e JOIN asked USING (account_id)),
    begun AS (SELECT DISTINCT x.account_id FROM x JOIN s ON s.account_id = x.account_id AND s.low <= date_trunc('month', asked_to) AND date_trunc('month', asked_to) <= s.high),
    edges AS (SELECT account_id, asked_from AS a, low AS b FROM x WHERE date_diff('day', asked_from, low) > 30
      UNION ALL SELECT account_id, high, asked_to FROM x WHERE date_diff('day', high, asked_to) > 4 AND NOT (date_diff('day', high, asked_to) <= 40 AND asked_to <> last_day(asked_to) AND account_id IN (SELECT account_id FROM begun))),
    every AS (SELECT u.*, asked.opening FROM (SELECT * FROM between_ UNION ALL SELECT * FROM edges) u LEFT JOIN asked ON asked.account_id = u.account_id),
    cut AS (SELECT account_id, CASE WHEN a <= opening THEN opening ELSE a END AS a, b FROM every WHERE (opening IS NULL OR b >= opening) AND NOT (opening IS NOT NULL AND a <= opening AND b = opening)),
    r AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY account_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM cut),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY account_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT account_id, strftime(min(a), '%Y-%m-%d') AS gap_from, strftime(max(b), '%Y-%m-%d') AS gap_to FROM k GROUP BY account_id, run"""
)
def set_9_missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worn(spark, sf_dir, _YEARS)
    out = coverage.missing_ranges(rows, "account_id", "statement_id", ["date", "seq"], ["seq", "date", "balance"], worn(spark, sf_dir, _ASKED), grace=4, ignore_first=30, ignore_last=40)
    return out.select("account_id", F.col("gap_from").cast("string").alias("gap_from"), F.col("gap_to").cast("string").alias("gap_to"))


@query("SELECT account_id, CASE WHEN count(*) < 5 THEN 'too_few_rows' WHEN count(DISTINCT statement_id) < 4 THEN 'too_few_statements' WHEN min(balance) < -500000 THEN 'overdrawn' ELSE 'completed' END AS status FROM txn GROUP BY 1")
def set_12_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.when(F.count("*") < 5, "too_few_rows").when(F.countDistinct("statement_id") < 4, "too_few_statements").when(F.min("balance") < -500000, "overdrawn")
    return transactions(spark, sf_dir).groupBy("account_id").agg(rules.otherwise("completed").alias("status"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", txn=False)
def set_15_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query(
    """WITH n AS (SELECT account_id, seq, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) - 1 AS k, count(*) OVER (PARTITION BY account_id) AS total FROM txn)
    SELECT account_id, seq, CAST(CASE WHEN total % 4 > 0 AND total % 4 < 2 AND total > 4 AND k // 4 = (total - 1) // 4 THEN (total - 1) // 4 - 1 ELSE k // 4 END AS INTEGER) AS chunk FROM n"""
)
def set_16_17_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.chunks(transactions(spark, sf_dir), ["account_id"], ["date", "seq"], 4, 2).select("account_id", "seq", "chunk")
