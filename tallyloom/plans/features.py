"""Queries of the account features, repairs, lookups and read verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.model import by_account, signed, table, transactions
from tallyloom.operators import features, feeds, recurring, rules, salary, sets, statements, windows
from tallyloom.plans.registry import query, worn

_W = "WINDOW w AS (PARTITION BY account_id ORDER BY date, seq)"
_COLUMNS = ["account_id", "seq", "date", "transaction_type", "amount", "balance"]


@query("SELECT p_partkey, e.name FROM part, (VALUES ('small copper'), ('Large Brushed')) e(name) WHERE list_has_all(str_split_regex(lower(p_type), '[ /:,;.#&_-]'), str_split(lower(e.name), ' '))", txn=False)
def prj_11_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("small copper",), ("Large Brushed",)], "name string")
    return features.name_matches(table(spark, sf_dir, "part"), "p_partkey", "p_type", names, "name", ["ltd"], 1.0)


@query("SELECT seq, r.pattern FROM txn JOIN (VALUES ('upi', '7/[0-9]+$'), ('chq', '1/[0-9]+$')) r(transaction_channel, pattern) ON txn.transaction_channel = r.transaction_channel WHERE regexp_matches(transaction_note, r.pattern)")
def jon_6_cluster_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("upi", "7/[0-9]+$"), ("chq", "1/[0-9]+$")], "transaction_channel string, pattern string")
    return transactions(spark, sf_dir).join(patterns, "transaction_channel").where(F.expr("rlike(transaction_note, pattern)")).select("seq", "pattern")


@query("SELECT account_id, seq FROM txn")
def jon_20_set_3_overlapping_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select(*_COLUMNS)
    n, total = F.row_number().over(by_account()), F.count("*").over(Window.partitionBy("account_id"))
    placed = t.withColumn("n", n).withColumn("total", total)
    # the first two thirds and the last two thirds of each account overlap by a third
    first = placed.where(F.col("n") <= F.ceil(2 * F.col("total") / 3)).withColumn("part", F.lit(0))
    last = placed.where(F.col("n") > F.floor(F.col("total") / 3)).withColumn("part", F.lit(1))
    fold = lambda rows: features.joined_lists(rows, least=1)
    return windows.rearranged(first.union(last).drop("n", "total"), "account_id", ["part", "date", "seq"], ["part", "seq", "date", "amount", "balance"], fold).select("account_id", "seq")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7", txn=False)
def jon_23_bnk_30_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_nationkey = 7").select("n_nationkey", "n_name")


@query("SELECT c_custkey, o_orderkey, r_name FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000 CROSS JOIN (SELECT r_name FROM region WHERE r_regionkey = 2)", txn=False)
def jon_28_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    name = table(spark, sf_dir, "region").where("r_regionkey = 2").select("r_name").scalar()
    joined = c.join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 480000), "full_outer")
    return joined.select("c_custkey", "o_orderkey", name.alias("r_name"))


@query(
    """WITH eod AS (SELECT bank_name, account_id, CAST(date AS DATE) AS day, max_by(balance, seq) AS b FROM txn GROUP BY 1, 2, 3),
    s AS (SELECT bank_name, day, sum(b - coalesce(p, 0)) AS step FROM (SELECT *, lag(b) OVER (PARTITION BY bank_name, account_id ORDER BY day) AS p FROM eod) GROUP BY 1, 2)
    SELECT bank_name, strftime(day, '%Y-%m-%d') AS day, round(sum(step) OVER (PARTITION BY bank_name ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS b FROM s"""
)
def agg_25_summed_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    eod = transactions(spark, sf_dir).groupBy("bank_name", "account_id", F.to_date("date").alias("day")).agg(F.max_by("balance", "seq").alias("b"))
    return features.summed_daily(eod, "bank_name", "account_id", "day", "b").withColumn("day", F.col("day").cast("string"))


@query("SELECT bank_name, transaction_channel AS grp, count(*) AS n, round(sum(amount), 2) AS total, max(amount) AS top, round(avg(balance), 6) AS mean_balance FROM txn GROUP BY 1, 2 HAVING count(*) >= 2 AND round(sum(amount), 2) >= 100000")
def agg_35_group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transactions(spark, sf_dir).groupBy("bank_name", F.col("transaction_channel").alias("grp"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.max("amount").alias("top"), F.round(F.avg("balance"), 6).alias("mean_balance")).where("n >= 2 AND total >= 100000")


@query("SELECT month, min(account_id) AS first_account FROM (SELECT strftime(date, '%Y-%m') AS month, account_id FROM txn) GROUP BY 1")
def agg_45_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select(F.date_format("date", "yyyy-MM").alias("month"), F.col("account_id").alias("first_account"))
    return sets.first_of(t, ["month"], [F.col("first_account")])


@query("WITH f AS (SELECT seq FROM txn WHERE balance < -300000) SELECT transaction_type, count(*) AS n, round(sum(amount), 2) AS total FROM txn JOIN f USING (seq) GROUP BY 1")
def agg_56_findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    found = rules.findings(t, {"negative": F.col("balance") < -300000}, "seq")
    return t.join(found, "seq").groupBy("transaction_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("SELECT account_id, seq, transaction_type FROM txn")
def win_14_33_repaired_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select(*_COLUMNS)
    n = F.row_number().over(by_account())
    worn = t.withColumn("n", n).withColumn("transaction_type", F.when(F.col("n") == 3, F.when(F.col("transaction_type") == "debit", "credit").otherwise("debit")).otherwise(F.col("transaction_type"))).drop("n")
    fixed = windows.rearranged(worn, "account_id", ["date", "seq"], ["transaction_type", "amount", "balance", "date"], features.repaired_statement, "transaction_type string")
    return fixed.select("account_id", "seq", "transaction_type")


@query("SELECT account_id, seq, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS place FROM txn")
def win_32_srt_16_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select(*_COLUMNS)
    return windows.rearranged(t, "account_id", ["date", "seq"], ["transaction_type", "amount", "balance", "date"], features.swapped_neighbours, "place long").select("account_id", "seq", "place")


@query("SELECT seq, CASE WHEN d IS NOT NULL THEN 'debit' ELSE 'credit' END AS transaction_type, coalesce(d, c) AS amount FROM (SELECT seq, CASE WHEN transaction_type = 'debit' THEN amount END AS d, CASE WHEN transaction_type = 'credit' THEN amount END AS c FROM txn)")
def sca_9_columns_to_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("transaction_type")
    two = transactions(spark, sf_dir).select("seq", F.when(kind == "debit", F.col("amount")).alias("d"), F.when(kind == "credit", F.col("amount")).alias("c"))
    return two.select("seq", F.when(F.col("d").isNotNull(), "debit").otherwise("credit").alias("transaction_type"), F.coalesce("d", "c").alias("amount"))


@query("SELECT seq, CASE WHEN transaction_channel = 'cash_withdrawl' THEN false WHEN transaction_type = 'debit' AND regexp_matches(transaction_note, '(?i)transfer.*[05]/[0-9]+$') THEN true ELSE false END AS is_lender, CASE WHEN transaction_type = 'debit' THEN 'loan' ELSE 'disbursal' END || '_' || transaction_channel AS kind FROM txn")
def lender_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit = F.col("transaction_type") == "debit"
    lender = (F.col("transaction_channel") != "cash_withdrawl") & debit & F.col("transaction_note").rlike("(?i)transfer.*[05]/[0-9]+$")
    return transactions(spark, sf_dir).select("seq", lender.alias("is_lender"), F.concat(F.when(debit, "loan").otherwise("disbursal"), F.lit("_"), "transaction_channel").alias("kind"))


@query("SELECT c_custkey, regexp_matches(c_name, '(?i)ltd|customer#0+5') AS is_company, trim(coalesce(c_name, '')) = '' AS continues FROM customer", txn=False)
def sca_46_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").rlike("(?i)ltd|customer#0+5").alias("is_company"), (F.trim(F.coalesce("c_name", F.lit(""))) == "").alias("continues"))


@query("SELECT seq, CASE WHEN k = 1 OR k = n THEN NULL ELSE balance END AS inner_balance, coalesce(nullif(regexp_extract(transaction_note, '#0*([1-9][0-9]*)/', 1), ''), transaction_note) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k, count(*) OVER (PARTITION BY account_id) AS n FROM txn)")
def bnk_7_8_edges_and_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.row_number().over(by_account()), F.count("*").over(Window.partitionBy("account_id"))
    t = transactions(spark, sf_dir).withColumn("k", k).withColumn("n", n)
    cell = F.coalesce(F.nullif(F.regexp_extract("transaction_note", "#0*([1-9][0-9]*)/", 1), F.lit("")), "transaction_note")
    return t.select("seq", F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("balance")).alias("inner_balance"), cell.alias("cell"))


@query(f"SELECT seq, first_value(CASE WHEN transaction_channel = 'upi' THEN date END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY date, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_date FROM txn")
def dates_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.first(F.when(F.col("transaction_channel") == "upi", F.col("date")), ignorenulls=True).over(by_account().rowsBetween(0, Window.unboundedFollowing))
    return transactions(spark, sf_dir).select("seq", ahead.alias("next_date"))


@query("WITH n AS (SELECT account_id, seq, transaction_note, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k FROM txn) SELECT a.seq, b.transaction_note AS note FROM n a JOIN n b ON a.account_id = b.account_id AND b.k = a.k + 1")
def bnk_12_shifted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = transactions(spark, sf_dir).withColumn("k", F.row_number().over(by_account())).select("account_id", "seq", "transaction_note", "k")
    notes = n.select("account_id", (F.col("k") - 1).alias("k"), F.col("transaction_note").alias("note"))
    return n.join(notes, ["account_id", "k"]).select("seq", "note")


@query("SELECT account_id, bool_or(coalesce(abs(round(p + s, 2) - round(balance, 2)) > 0.1, false)) AS inconsistent FROM (SELECT account_id, balance, lag(balance) OVER w AS p, CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END AS s FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY date, seq)) GROUP BY 1")
def bnk_16_23_feed_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).withColumn("bad", windows.breaks(by_account(), 0.1)).groupBy("account_id").agg(F.bool_or("bad").alias("inconsistent"))


@query("SELECT seq, CASE WHEN lower(bank_name) = 'building' THEN 'Housing' WHEN contains(lower(bank_name), 'mach') THEN 'Industry' ELSE bank_name END AS mapped, dense_rank() OVER (ORDER BY bank_name) AS group_no FROM txn")
def mapped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("bank_name")
    t = transactions(spark, sf_dir)
    numbers = t.select("bank_name").distinct().withColumn("group_no", F.dense_rank().over(Window.orderBy("bank_name")).cast("long"))
    return t.join(numbers, "bank_name").select("seq", F.when(low == "building", "Housing").when(low.contains("mach"), "Industry").otherwise(F.col("bank_name")).alias("mapped"), "group_no")


@query("WITH f AS (SELECT bank_name, amount, transaction_type, min(seq) AS seq FROM txn GROUP BY 1, 2, 3) SELECT t.seq, f.seq AS first_equal FROM txn t JOIN f ON t.bank_name = f.bank_name AND t.amount = f.amount AND t.transaction_type = f.transaction_type")
def bnk_19_first_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, keys = transactions(spark, sf_dir), ["bank_name", "amount", "transaction_type"]
    return t.join(t.groupBy(*keys).agg(F.min("seq").alias("first_equal")), keys).select("seq", "first_equal")


@query("SELECT c_custkey, concat(c_mktsegment, '-', c_name) AS label FROM customer WHERE c_acctbal > 0 AND c_mktsegment IS NOT NULL AND c_nationkey BETWEEN 3 AND 9", txn=False)
def bnk_29_case_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where((F.col("c_acctbal") > 0) & F.col("c_mktsegment").isNotNull() & F.col("c_nationkey").between(3, 9))
    return c.select("c_custkey", F.concat_ws("-", "c_mktsegment", "c_name").alias("label"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT 3, 'renamed' UNION ALL SELECT -9, 'added'", txn=False)
def bnk_31_32_34_udf_17_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    changed = rules.upsert(rows, spark.createDataFrame([(3, "renamed"), (-9, "added")], rows.schema), "s_suppkey")
    return changed


@query()
def clu_2_3_4_fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("account_id", "seq", "date", "transaction_note")
    group = lambda rows: features.fuzzy_groups(rows, 85.0)
    return windows.rearranged(t, "account_id", ["date", "seq"], ["transaction_note"], group, "group_no int").select("account_id", "seq", "group_no")


#: Each account's rows by four statements: most rows, a later stretch that overlaps, one inside the first, and (some) one after a gap.
LISTS = """SELECT account_id, p.part, seq, date, transaction_type, amount, balance, CASE WHEN p.part = 1 AND seq % 3 = 0 THEN lower(transaction_note) ELSE transaction_note END AS transaction_note
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k, count(*) OVER (PARTITION BY account_id) AS n FROM txn) t
  JOIN (SELECT 0 AS part, 0.0 AS a, 0.6 AS b UNION ALL SELECT 1, 0.35, 0.8 UNION ALL SELECT 2, 0.2, 0.5 UNION ALL SELECT 3, 0.85, 1.0) p ON k > floor(n * p.a) AND k <= floor(n * p.b)"""

#: Statements of one to many rows, a seventh of them each: as they are, with flipped types, halves exchanged, reversed, with a gap, with wrong balances, with a block repeated.
JUMBLED = """SELECT CAST(account_id AS STRING) AS statement_id, seq, date, CASE WHEN account_id % 7 = 1 AND k % 4 = 2 THEN CASE WHEN transaction_type = 'debit' THEN 'credit' ELSE 'debit' END ELSE transaction_type END AS transaction_type, amount,
  CASE WHEN account_id % 7 = 5 AND k % 3 = 1 THEN balance + 17 ELSE balance END AS balance, transaction_note, CASE WHEN seq % 5 = 0 THEN 'c7' END AS chq_num, page_number,
  CASE WHEN account_id % 7 = 2 THEN (k + n - floor(n / 2)) % n WHEN account_id % 7 = 3 THEN n - k ELSE k END * 1000 + copy AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k, count(*) OVER (PARTITION BY account_id) AS n FROM txn) t
  JOIN (SELECT 0 AS copy UNION ALL SELECT 2500 AS copy) c ON copy = 0 OR (account_id % 7 = 6 AND (k = 3 OR k = 4))
  WHERE NOT (account_id % 7 = 4 AND k > floor(n / 3) AND k <= floor(n / 2))"""

#: Notes of many lengths, some alike, for small accounts and a few that many share.
NOTED = """SELECT CASE WHEN account_id % 2 = 0 THEN account_id ELSE -1 - account_id % 7 END AS account_id, seq, date, transaction_type, CASE WHEN seq % 10 = 9 THEN 'salary' ELSE transaction_channel END AS transaction_channel,
  CASE WHEN seq % 4 = 1 THEN lower(bank_name) || ' stores of the ' || chr(CAST(97 + seq % 11 AS INTEGER)) || ' ward' END AS merchant,
  CASE seq % 7 WHEN 0 THEN 'NEFT/' || bank_name || ' traders and sons/' || seq
    WHEN 1 THEN 'IMPS-rent of flat ' || chr(CAST(97 + seq % 17 AS INTEGER)) || chr(CAST(97 + seq % 5 AS INTEGER)) || 'lane paid-' || seq
    WHEN 2 THEN 'instalment of the yearly household insurance premium number ' || seq || ' for policy of class ' || bank_name || ' holder ' || chr(CAST(97 + seq % 19 AS INTEGER)) || 'yz'
    WHEN 3 THEN 'a/c xxxxx' || (seq % 9) || '12 ' || chr(CAST(97 + seq % 3 AS INTEGER)) || 'q'
    WHEN 4 THEN 'shop' || chr(CAST(97 + seq % 23 AS INTEGER)) || 'mart'
    WHEN 5 THEN lower(bank_name) || (seq % 6) || '@ybl/9876543210/ref' || seq
    ELSE transaction_note END AS transaction_note
  FROM txn"""


@query()
def clu_2_4_6_recurring_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers for accounts up to 40 rows of a type (a low bound, so that both ways are taken at any scale), runs of three beyond."""
    rows = worn(spark, sf_dir, NOTED)
    found = recurring.recurring_groups(rows, ["account_id", "transaction_type"], ["date", "seq"], "transaction_note", "transaction_channel", F.col("merchant"), limit=40)
    return found.select("account_id", "seq", "group_no", "group_size")


@query()
def clu_3_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group at one threshold of each account and type, whatever their number of rows."""
    rows = worn(spark, sf_dir, NOTED)
    found = recurring.recurring_groups(rows, ["account_id", "transaction_type"], ["date", "seq"], "transaction_note", "transaction_channel", rule=recurring.alike(90.0), limit=None)
    return recurring.top_group(found).select("account_id", "seq", "group_size")


@query("SELECT account_id, CASE WHEN count(*) < 3 THEN 'OTHER' ELSE transaction_channel END AS grp, count(*) AS n FROM txn GROUP BY account_id, transaction_channel")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transactions(spark, sf_dir).groupBy("account_id", "transaction_channel").agg(F.count("*").alias("n"))
    return g.select("account_id", F.when(F.col("n") < 3, "OTHER").otherwise(F.col("transaction_channel")).alias("grp"), "n")


@query(
    """WITH s AS (SELECT *, regexp_replace(upper(transaction_note), '[0-9]+', '', 'g') AS stem FROM txn WHERE transaction_type = 'credit'),
    m AS (SELECT account_id, stem, count(DISTINCT strftime(date, '%Y-%m')) AS months FROM s GROUP BY 1, 2)
    SELECT s.seq, CASE WHEN s.account_id % 10 = 1 THEN 'employer' WHEN regexp_matches(s.transaction_note, '(?i)chq') THEN 'keyword' ELSE 'recurring' END AS method FROM s JOIN m ON s.account_id = m.account_id AND s.stem = m.stem
    WHERE s.account_id % 10 = 1 OR regexp_matches(s.transaction_note, '(?i)chq') OR m.months >= 3"""
)
def clu_7_salary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = transactions(spark, sf_dir).where("transaction_type = 'credit'")
    return features.salary_stream(credits, "chq", F.col("account_id") % 10 == 1, 3).select("seq", "method")


#: Many credits in few months: one account a nation-sized group, dates within 500 days.
PAID = """SELECT account_id % 25 AS account_id, seq, TIMESTAMP '2020-01-05 00:00:00' + INTERVAL '1' DAY * CAST((seq * 37) % 500 AS INTEGER) AS date, transaction_type, CASE WHEN seq % 3 = 0 THEN 20000.0 + amount / 100 ELSE 20000.0 + amount / 10 END AS amount,
  CASE WHEN account_id % 25 = 3 AND seq % 7 = 0 THEN 'salary' WHEN seq % 5 = 1 THEN 'upi' ELSE 'neft' END AS transaction_channel,
  CASE seq % 4 WHEN 0 THEN 'NEFT/ACME INDUSTRIES PVT LTD/' || seq WHEN 1 THEN 'orange lane ' || chr(CAST(97 + seq % 9 AS INTEGER)) || 'bc' WHEN 2 THEN 'RTGS river clinic salary ' || seq ELSE transaction_note END AS transaction_note
  FROM txn"""
_PAY_MONTH = "strftime(CASE WHEN day(date) < 20 THEN date - INTERVAL 1 DAY * day(date) ELSE date END, '%Y-%m')"


@query(
    f"""WITH g AS ({PAID}), l AS (SELECT *, lag(month) OVER (PARTITION BY account_id ORDER BY month) AS before FROM (SELECT DISTINCT account_id, strftime(date, '%Y-%m') AS month FROM g)),
    c AS (SELECT *, {_PAY_MONTH} AS sm, row_number() OVER (PARTITION BY account_id ORDER BY date DESC, seq DESC) AS b FROM g WHERE transaction_type = 'credit'),
    d AS (SELECT *, abs(mid - amount) / mid AS delta FROM (SELECT *, median(CASE WHEN b <= 6 THEN amount END) OVER (PARTITION BY account_id) AS mid FROM c)),
    e AS (SELECT *, count(*) OVER (PARTITION BY account_id, sm) AS n, row_number() OVER (PARTITION BY account_id, sm ORDER BY date, seq) AS k,
      row_number() OVER (PARTITION BY account_id, sm ORDER BY CASE WHEN delta < 0.3 THEN delta END NULLS LAST, amount DESC, date, seq) AS best FROM d WHERE delta < 0.4),
    f AS (SELECT e.*, l.month IS NOT NULL AND e.n > 1 AS several, l.before, x.sm AS held FROM e LEFT JOIN l ON l.account_id = e.account_id AND l.month = e.sm LEFT JOIN (SELECT DISTINCT account_id, sm FROM e) x ON x.account_id = e.account_id AND x.sm = l.before),
    p AS (SELECT *, several AND before IS NOT NULL AND held IS NULL AS push FROM f),
    q AS (SELECT account_id, seq, date, CASE WHEN push AND k = 1 THEN before ELSE sm END AS salary_month FROM p WHERE NOT several OR push OR best = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY account_id, salary_month ORDER BY date DESC, seq DESC) AS z FROM q)
    SELECT account_id, salary_month, seq FROM (SELECT *, count(*) OVER (PARTITION BY account_id) AS n FROM r WHERE z = 1) WHERE n > 1"""
)
def win_31_salary_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worn(spark, sf_dir, PAID)
    out = salary.one_per_month(rows.where("transaction_type = 'credit'"), "account_id", ["date", "seq"], salary.account_months(rows, "account_id"))
    return out.select("account_id", "salary_month", "seq")


@query(
    f"""WITH g AS ({PAID}), c AS (SELECT *, {_PAY_MONTH} AS sm FROM g WHERE transaction_type = 'credit'),
    s AS (SELECT account_id, transaction_channel, count(*) AS n, count(DISTINCT sm) AS months, round(median(amount), 6) AS middle, sum(amount) / count(DISTINCT sm) AS mean, max(date) AS latest, count(*) FILTER (date >= TIMESTAMP '2021-01-01') AS recent FROM c GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY mean DESC, latest DESC, transaction_channel) AS r FROM s WHERE recent >= 1),
    t AS (SELECT c.account_id, c.transaction_channel, bool_and(regexp_matches(upper(transaction_note), 'NEFT|RTGS')) AS bank_transfers, bool_and(day(date) <= 6 OR day(date) >= 24) AS month_end FROM c GROUP BY 1, 2)
    SELECT b.account_id, b.transaction_channel, b.n, b.months, b.middle, round(b.mean, 6) AS mean_month, b.recent, t.bank_transfers, t.month_end FROM b JOIN t ON b.account_id = t.account_id AND b.transaction_channel = t.transaction_channel WHERE r = 1"""
)
def srt_12_best_salary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = worn(spark, sf_dir, PAID).where("transaction_type = 'credit'")
    groups = salary.possible_groups(credits, "account_id", "transaction_channel", F.lit("2021-01-01").cast("timestamp"))
    best = salary.best_groups(groups.where("recent >= 1"), "account_id", "transaction_channel")
    tests = salary.group_tests(credits, ["account_id", "transaction_channel"]).select("account_id", "transaction_channel", "bank_transfers", "month_end")
    return best.join(tests, ["account_id", "transaction_channel"]).select("account_id", "transaction_channel", "n", "months", F.round("middle", 6).alias("middle"), F.round("mean_month", 6).alias("mean_month"), "recent", "bank_transfers", "month_end")


@query()
def clu_7_salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each account's salary, over notes and amounts of which some recur."""
    rows = worn(spark, sf_dir, PAID)
    _, summary = salary.salaries(rows, "account_id", ["date", "seq"], (F.col("account_id") == 7) & F.col("transaction_note").contains("ACME"))
    return summary


@query()
def set_3_src_5_folded_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts folded from statements that overlap, stand in one another and leave gaps."""
    out = statements.folded_lists(worn(spark, sf_dir, LISTS), ["account_id"], "part", ["date", "seq"])
    return out.select("account_id", "part", "seq")


@query()
def win_14_33_merged_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of statements that were jumbled in several ways, after their repair, with their places."""
    rows, _ = statements.merged_statements(worn(spark, sf_dir, JUMBLED), "statement_id", "place")
    place = F.row_number().over(Window.partitionBy("statement_id").orderBy("_order")).cast("long")
    return rows.select("statement_id", "seq", "transaction_type", F.round("amount", 2).alias("amount"), F.round("balance", 2).alias("balance"), place.alias("place"))


@query()
def win_14_statement_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdicts = statements.merged_statements(worn(spark, sf_dir, JUMBLED), "statement_id", "place")
    return verdicts.select("statement_id", "is_inconsistent", "breaks", F.size("ranges").alias("chunks"), "is_missing_data", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


#: Feeds of which some accounts have neighbours exchanged, a row that came too early or too late, or split balances.
FED = """SELECT account_id, seq, CASE WHEN account_id % 5 = 1 THEN TIMESTAMP '2020-01-01 00:00:00' ELSE date END AS date, transaction_type, amount, CASE WHEN account_id % 5 = 4 AND k = 4 THEN next_balance ELSE balance END AS balance,
  CASE WHEN account_id % 5 = 1 AND k = 3 THEN 45 WHEN account_id % 5 = 2 AND k = 7 THEN 25 WHEN account_id % 5 = 3 AND k = 2 THEN 75 ELSE 10 * k END AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS k, lead(balance) OVER (PARTITION BY account_id ORDER BY date, seq) AS next_balance FROM txn) t"""


@query()
def win_32_srt_16_feed_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each feed in their repaired order, with new balances and what was done."""
    rows = worn(spark, sf_dir, FED).withColumnRenamed("place", "given")
    return feeds.repaired_feed(rows, "account_id", ["given"]).select("account_id", "seq", "place", "new_balance", F.array_join("tags", ",").alias("tags"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 20 MINUTES", txn=False)
def str_10_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "click", "processing").otherwise("done"))
    return features.stuck(events, "ts", events.agg(F.max("ts")).scalar(), 20).select("event_id")


@query("SELECT account_id, abs(max(page_number) - min(page_number)) >= 2 AS far FROM txn GROUP BY 1")
def str_17_page_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("account_id").agg((F.abs(F.max("page_number") - F.min("page_number")) >= 2).alias("far"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS \"Day\", event_type AS \"Event Type\", count(*) AS \"Count\" FROM events GROUP BY 1, 2", txn=False)
def str_18_daily_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd"), "event_type").agg(F.count("*"))
    return g.toDF("Day", "Event Type", "Count")


@query("SELECT account_id, c_name, c_mktsegment AS bank, strftime(min(date), '%Y-%m') AS first_month, strftime(max(date), '%Y-%m') AS last_month, count(DISTINCT statement_id) AS statements FROM txn JOIN customer ON account_id = c_custkey GROUP BY ALL")
def udf_6_8_account_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), "c_name", F.col("c_mktsegment").alias("bank"))
    months = lambda f: F.date_format(f("date"), "yyyy-MM")
    g = transactions(spark, sf_dir).groupBy("account_id").agg(months(F.min).alias("first_month"), months(F.max).alias("last_month"), F.countDistinct("statement_id").alias("statements"))
    return g.join(c, "account_id")


@query("SELECT account_id, seq, transaction_type, amount, balance FROM txn WHERE transaction_type = 'debit' AND regexp_matches(transaction_note, '(?i)transfer.*[05]/[0-9]+$')")
def udf_10_lender_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).where((F.col("transaction_type") == "debit") & F.col("transaction_note").rlike("(?i)transfer.*[05]/[0-9]+$"))
    return t.select("account_id", "seq", "transaction_type", "amount", "balance")


@query("SELECT account_id, transaction_channel, array_to_string(list(CAST(seq AS VARCHAR) ORDER BY date, seq), ',') AS seqs FROM txn GROUP BY 1, 2 HAVING count(*) >= 3")
def udf_2_11_nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("date", "seq")))
    g = transactions(spark, sf_dir).groupBy("account_id", "transaction_channel").agg(F.transform(rows, lambda r: r["seq"].cast("string")).alias("seqs")).where(F.size("seqs") >= 3)
    return g.withColumn("seqs", F.array_join("seqs", ","))


@query("SELECT seq, CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END * 2 AS doubled FROM txn")
def udf_1_row_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", (signed() * 2).alias("doubled"))
