"""Queries of the filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.model import table, transactions
from tallyloom.operators import filters as ops
from tallyloom.operators import nested
from tallyloom.plans.registry import query


@query("SELECT account_id, seq, amount FROM txn")
def prj_1_2_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.keep_columns(transactions(spark, sf_dir), ["account_id", "seq", "amount", "no_such_column", "balance"])
    return ops.drop_columns(kept, ["balance", "hash"])


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0) AS value, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, 'none') AS event_type FROM events", txn=False)
def prj_3_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    holes = table(spark, sf_dir, "events").select("event_id", F.when(~error, F.col("value")).alias("value"), F.when(~error, F.col("event_type")).alias("event_type"))
    return ops.fill_defaults(holes, {"value": 0.0, "event_type": "none"})


@query("SELECT seq, amount > 0 AND balance IS NOT NULL AND NOT isnan(amount) AND NOT isinf(amount) AND date IS NOT NULL AS valid, date >= DATE '1996-03-01' AND date < DATE '1997-07-01' AS in_session FROM txn")
def prj_4_6_valid_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return t.select("seq", ops.valid(F.col("amount"), F.col("balance"), F.col("date")).alias("valid"), ops.in_session(F.col("date"), F.lit("1996-03-01").cast("date"), F.lit("1997-06-30").cast("date")).alias("in_session"))


@query("SELECT event_id, event_type = '' OR event_type IS NULL AS is_blank, typeof(value) IN ('DOUBLE', 'FLOAT') AS is_number FROM events", txn=False)
def prj_5_blank_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ops.blank(F.col("event_type")).alias("is_blank"), F.typeof("value").isin("double", "float").alias("is_number"))


@query("SELECT account_id, seq, amount FROM txn WHERE transaction_type = 'credit' AND amount > 100000 AND transaction_channel IN ('upi', 'net_banking_transfer', 'chq', 'Other') AND NOT regexp_matches(transaction_note, '(?i)loan|00000000[13]/')")
def prj_7_8_salary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return ops.salary_candidates(t, 100000, ["upi", "net_banking_transfer", "chq", "Other"], "loan|00000000[13]/").select("account_id", "seq", "amount")


@query("SELECT seq, coalesce(nullif(transaction_channel, 'chq') = 'upi', false) AS passed FROM txn")
def prj_9_pass_or_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.nullif(F.col("transaction_channel"), F.lit("chq"))
    return ops.pass_or_fail(transactions(spark, sf_dir), channel == "upi").select("seq", "passed")


@query("SELECT seq FROM txn WHERE transaction_type = 'debit' AND transaction_channel NOT IN ('cash_withdrawl', 'chq') AND NOT regexp_matches(transaction_note, 'OTHER/') AND amount > 400")
def prj_10_13_14_debit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return t.where((F.col("transaction_type") == "debit") & ~F.col("transaction_channel").isin("cash_withdrawl", "chq") & ~F.col("transaction_note").rlike("OTHER/") & (F.col("amount") > 400)).select("seq")


@query("SELECT seq, regexp_matches(transaction_note, '(?i)upi') AS has_upi, regexp_matches(transaction_note, '(?i)transfer') AS has_transfer, regexp_matches(transaction_note, '(?i)customer#0+1') AS has_one, regexp_matches(transaction_note, '(?i)salary') AS has_salary FROM txn")
def prj_12_keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"has_upi": "upi", "has_transfer": "transfer", "has_one": "customer#0+1", "has_salary": "salary"}
    return ops.keyword_flags(transactions(spark, sf_dir), "transaction_note", flags).select("seq", *flags)


@query(
    """SELECT 'high_credit' AS report, seq FROM txn WHERE transaction_type = 'credit' AND amount > 400000
    UNION ALL SELECT 'cash', seq FROM txn WHERE transaction_channel = 'cash_withdrawl'
    UNION ALL SELECT 'charge', seq FROM txn WHERE transaction_type = 'debit' AND transaction_channel IN ('chq', 'Other')"""
)
def prj_15_16_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    kind, channel = F.col("transaction_type"), F.col("transaction_channel")
    rules = {"high_credit": (kind == "credit") & (F.col("amount") > 400000), "cash": channel == "cash_withdrawl", "charge": (kind == "debit") & channel.isin("chq", "Other")}
    labels = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in rules.items()]))
    return t.select(F.explode(labels).alias("report"), "seq")


@query("SELECT seq, strftime(date, '%d/%m/%Y') AS date, coalesce(nullif(transaction_channel, 'Other'), '') AS transaction_channel FROM txn")
def prj_17_dates_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", F.date_format("date", "dd/MM/yyyy").alias("date"), F.coalesce(F.nullif(F.col("transaction_channel"), F.lit("Other")), F.lit("")).alias("transaction_channel"))


@query(
    """SELECT seq, CASE WHEN seq % 4 = 0 THEN '' ELSE strftime(date, '%d/%m/%Y') END AS start, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN 'odd' ELSE strftime(date, '%d/%m/%Y') END AS first_day, transaction_channel AS inner_name,
    strftime(date, '%d/%m/%Y') AS mapped, CASE WHEN seq % 5 = 0 THEN '' ELSE transaction_type END AS mapped_type, strftime(date, '%Y-%m-%d') AS plain, seq % 6 = 0 AS no_detail FROM txn"""
)
def prj_17_nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records three levels deep: a struct, an array of structs that hold structs, and a map."""
    t, text = transactions(spark, sf_dir), lambda p: F.date_format("date", p)
    daily = F.array(F.struct(F.when(F.col("seq") % 3 == 0, "None").when(F.col("seq") % 3 == 1, "odd").otherwise(text("yyyy-MM-dd")).alias("date"), F.struct("transaction_channel").alias("inner"), F.lit(None).cast("string").alias("empty")))
    detail = F.when(F.col("seq") % 6 != 0, F.struct(text("dd-MMM-yyyy").alias("startDate"), F.array(text("yyyy-MM-dd")).alias("plain")))
    about = F.create_map(F.lit("xnsEndDate"), text("yyyy-MM-dd HH:mm:ss"), F.lit("kind"), F.when(F.col("seq") % 5 == 0, None).otherwise(F.col("transaction_type")))
    head = F.struct(F.when(F.col("seq") % 4 != 0, text("yyyy-MM-dd HH:mm:ss")).alias("xnsStartDate"), daily.alias("EODBalances"), detail.alias("MonthlyDetail"), about.alias("about"), F.array(text("yyyy-MM-dd")).alias("date"))
    out = nested.reshaped(t.select("seq", head.alias("head")), out="dd/MM/yyyy")
    day = F.col("head.EODBalances")[0]
    return out.select(
        "seq", F.col("head.xnsStartDate").alias("start"), day["date"].alias("first_day"), day["inner"]["transaction_channel"].alias("inner_name"), F.col("head.about")["xnsEndDate"].alias("mapped"),
        F.col("head.about")["kind"].alias("mapped_type"), F.col("head.date")[0].alias("plain"), F.col("head.MonthlyDetail").isNull().alias("no_detail"),
    )


@query("SELECT account_id, seq FROM (SELECT *, dense_rank() OVER (PARTITION BY account_id ORDER BY strftime(date, '%Y-%m') DESC) AS k FROM txn) WHERE k <= 3")
def prj_18_last_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_months(transactions(spark, sf_dir), 3).select("account_id", "seq")


@query("SELECT account_id, seq FROM (SELECT *, sum(CASE WHEN transaction_channel = 'chq' THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS s FROM txn) WHERE s < 2")
def prj_19_until_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.until_second(transactions(spark, sf_dir), F.col("transaction_channel") == "chq", ["account_id"], ["date", "seq"]).select("account_id", "seq")


@query(
    """SELECT account_id, seq FROM (SELECT *, lead(1) OVER w AS nxt, lag(transaction_channel) OVER w AS prv FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY date, seq))
    WHERE NOT coalesce(nxt IS NULL AND prv = transaction_channel, false)"""
)
def prj_20_repeated_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_repeated_last(transactions(spark, sf_dir), "transaction_channel", ["account_id"], ["date", "seq"]).select("account_id", "seq")


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k FROM txn),
    e AS (SELECT account_id, max(CASE WHEN transaction_channel = 'upi' AND amount > 400000 THEN k END) AS h, min(CASE WHEN transaction_channel = 'Other' THEN k END) AS f FROM n GROUP BY account_id)
    SELECT n.account_id, n.seq FROM n JOIN e ON n.account_id = e.account_id WHERE n.k > coalesce(e.h, 0) AND (e.f IS NULL OR n.k < e.f)"""
)
def prj_21_head_and_foot(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = (F.col("transaction_channel") == "upi") & (F.col("amount") > 400000)
    return ops.cut_block(transactions(spark, sf_dir), head, F.col("transaction_channel") == "Other", ["account_id"], ["date", "seq"]).select("account_id", "seq")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", txn=False)
def prj_22_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    return orders.join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'click' THEN false END AS f FROM events) WHERE f <> true", txn=False)
def prj_23_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "click", False)
    return table(spark, sf_dir, "events").where(flag != F.lit(True)).select("event_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS", txn=False)
def prj_24_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts")).scalar()
    return events.where(F.col("ts") > latest - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 330 MINUTES BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 23:59:59'", txn=False)
def prj_25_zone_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(ops.local_time(F.col("ts"), "Asia/Kolkata").between(F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-12 23:59:59").cast("timestamp"))).select("event_id")


@query("SELECT seq, CASE WHEN transaction_type = 'debit' THEN 'Matched' ELSE 'Mismatched' END AS state, coalesce(nullif(transaction_channel, 'Other'), 'Blank') AS channel FROM txn")
def prj_26_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", F.when(F.col("transaction_type") == "debit", "Matched").otherwise("Mismatched").alias("state"), F.coalesce(F.nullif(F.col("transaction_channel"), F.lit("Other")), F.lit("Blank")).alias("channel"))


@query("SELECT seq FROM txn WHERE regexp_matches(transaction_note, '^UPI/.*7/') AND transaction_channel NOT ILIKE '%cash%'")
def prj_27_28_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).where(F.col("transaction_note").rlike("^UPI/.*7/") & ~F.col("transaction_channel").ilike("%cash%")).select("seq")


@query("SELECT statement_id FROM txn GROUP BY statement_id HAVING count(*) // count(DISTINCT page_number) < 2")
def prj_29_integer_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transactions(spark, sf_dir).groupBy("statement_id").agg(F.count("*").alias("n"), F.countDistinct("page_number").alias("pages"))
    return g.where(F.expr("n div pages") < 2).select("statement_id")


@query("SELECT seq FROM txn WHERE bank_name = 'MACHINERY' AND transaction_channel IN ('upi', 'chq')")
def prj_30_optional_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).where(ops.all_of({"bank_name": "MACHINERY", "transaction_channel": ["upi", "chq"], "transaction_type": None})).select("seq")
