"""Queries of report filters, last-wins merges, rejections, months asked for and table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.model import shared, table, transactions
from tallyloom.operators import repairs, reports
from tallyloom.plans.registry import query, worn

_MANDATED = """SELECT seq, transaction_type, CASE WHEN seq % 9 = 0 THEN 300.0 ELSE amount END AS amount, CASE WHEN seq % 5 = 0 THEN 'chq' ELSE 'Other' END AS transaction_channel, CASE WHEN seq % 7 = 0 THEN 'insurance' END AS description,
  CASE seq % 8 WHEN 0 THEN 'Paid by NACH/77' WHEN 1 THEN 'ach-9' WHEN 2 THEN 'DEBIT-CMP MANDATE DEBIT x' WHEN 3 THEN 'CMS/AB12/1234' WHEN 4 THEN 'x DRAWDOWN from CASA' WHEN 5 THEN 'teach me' WHEN 6 THEN NULL ELSE 'MAND DR - ab12-cd34 no' END AS transaction_note FROM txn"""


@query(f"WITH g AS ({_MANDATED}) SELECT seq FROM g WHERE transaction_type = 'debit' AND amount > 400 AND transaction_channel = 'Other' AND description IS NULL AND seq % 8 IN (0, 1, 2, 3, 4)")
def prj_13_mandated_debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mandated_debits(worn(spark, sf_dir, _MANDATED)).select("seq")


_LABELLED = "SELECT seq, amount, transaction_type, transaction_channel, CASE seq % 6 WHEN 0 THEN 'Loan' WHEN 1 THEN 'Penal' WHEN 2 THEN 'Cash' WHEN 3 THEN 'Bank Charge' WHEN 4 THEN 'Bounce' END AS category, seq % 10 = 0 AS is_lender FROM txn"


@query(
    f"""WITH g AS ({_LABELLED}) SELECT 'high_credit' AS report, seq, amount FROM g WHERE transaction_type = 'credit' AND amount > 50000 UNION ALL SELECT 'bounced_emi', seq, amount FROM g WHERE is_lender AND transaction_channel = 'chq' UNION ALL SELECT 'penal_charges', seq, amount FROM g WHERE category = 'Penal'
    UNION ALL SELECT 'bank_charges', seq, amount FROM g WHERE category = 'Bank Charge' UNION ALL SELECT 'cash', seq, amount FROM g WHERE category = 'Cash' UNION ALL SELECT 'loans', seq, amount FROM g WHERE category IN ('Loan', 'Bounce') UNION ALL SELECT 'lender_debits', seq, amount FROM g WHERE is_lender AND transaction_type = 'debit'"""
)
def prj_15_report_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lender = F.col("category"), F.col("is_lender")
    filters = {
        "high_credit": (F.col("transaction_type") == "credit") & (F.col("amount") > 50_000), "bounced_emi": lender & (F.col("transaction_channel") == "chq"), "penal_charges": c == "Penal", "bank_charges": c == "Bank Charge",
        "cash": c == "Cash", "loans": c.isin("Loan", "Bounce"), "lender_debits": lender & (F.col("transaction_type") == "debit"),
    }
    return reports.report_rows(worn(spark, sf_dir, _LABELLED), filters, ["seq", "amount"])


_OURS = "SELECT seq, account_id % 7 AS k1, seq % 9 AS k2, CASE seq % 4 WHEN 0 THEN 'Transfer to X' WHEN 1 THEN 'Food' WHEN 2 THEN 'Fuel' END AS category FROM txn"
_THEIRS = "SELECT seq, account_id % 7 AS k1, seq % 9 AS k2, CASE seq % 5 WHEN 0 THEN 'Transfer in' WHEN 1 THEN 'Eating' WHEN 2 THEN 'Car' ELSE 'Other' END AS their_category FROM txn WHERE seq % 3 > 0"


@query(
    f"""WITH o AS ({_OURS}), t AS ({_THEIRS}), a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY seq DESC) = 1), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY seq DESC) = 1)
    SELECT k1, k2, CASE WHEN contains(lower(category), 'transfer') THEN 'transfer' ELSE category END AS category, their_category FROM a JOIN b USING (k1, k2) WHERE category IS NOT NULL AND NOT contains(lower(their_category), 'transfer')"""
)
def jon_8_mapped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mapped_pairs(worn(spark, sf_dir, _OURS), worn(spark, sf_dir, _THEIRS), ["k1", "k2"], "seq", "category", "their_category")


@query(f"WITH o AS ({_OURS}), l AS (SELECT k1, k2, max(seq) AS seq FROM o GROUP BY 1, 2) SELECT k1, k2, seq, 'cat' || seq % 4 AS category FROM l")
def jon_9_merged_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worn(spark, sf_dir, _OURS)
    answer = rows.select("k1", "k2", "seq", F.concat(F.lit("cat"), (F.col("seq") % 4).cast("string")).alias("category"))
    return reports.merged_answer(rows, answer, ["k1", "k2"], "seq").select("k1", "k2", "seq", "category")


_NOTED = """SELECT account_id, seq, CAST(row_number() OVER (PARTITION BY account_id ORDER BY date, seq) AS BIGINT) AS place, date, transaction_type, amount, CASE WHEN account_id % 5 = 0 AND seq % 4 = 1 THEN balance + 9 ELSE balance END AS balance, CASE WHEN seq % 6 = 0 THEN ' ' WHEN seq % 13 = 0 THEN NULL ELSE 'x' END AS transaction_note FROM txn"""


@query(
    f"""WITH g AS ({_NOTED}), b AS (SELECT *, coalesce(abs(round(lag(balance) OVER w + CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END, 2) - round(balance, 2)) > 0.1, false) AS bad FROM g WINDOW w AS (PARTITION BY account_id ORDER BY place))
    SELECT account_id, CASE WHEN bool_or(bad) THEN 'inconsistent transactions' WHEN count(*) FILTER (trim(coalesce(transaction_note, '')) = '') / count(*) > 0.15 THEN 'empty transaction notes' END AS reason FROM b GROUP BY 1"""
)
def agg_47_rejected_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = worn(spark, sf_dir, _NOTED)
    return reports.rejected(g, "account_id", repairs.first_break(g, "account_id", "place", "seq"))


_PERIODS = "SELECT account_id, CAST(min(date) AS DATE) AS low, CAST(max(date) AS DATE) AS high FROM txn GROUP BY account_id, year(date)"


@query(
    f"""WITH p AS ({_PERIODS}), m AS (SELECT DISTINCT account_id, strftime(unnest(generate_series(date_trunc('month', low), high, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM p),
    a AS (SELECT DISTINCT account_id FROM p), q AS (SELECT account_id, strftime(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-28', INTERVAL 1 MONTH)), '%Y-%m') AS month FROM a),
    c AS (SELECT account_id, array_to_string(list_sort(list(month)), ',') AS months FROM m GROUP BY 1)
    SELECT account_id, months, count(*) AS asked, coalesce(array_to_string(list_sort(list(q.month) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE m.account_id = q.account_id AND m.month = q.month))), ','), '') AS missing FROM q JOIN c USING (account_id) GROUP BY 1, 2"""
)
def set_8_missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = worn(spark, sf_dir, _PERIODS)
    months = F.array_sort(F.array_distinct(F.flatten(F.collect_list(reports.months_of(F.col("low"), F.col("high"))))))
    covered = p.groupBy("account_id").agg(months.alias("months")).withColumns({"from": F.lit("1996-01-20").cast("date"), "to": F.lit("1998-01-04").cast("date")})
    out = reports.missing_months(covered, "account_id", "from", "to").join(covered.select("account_id", "months"), "account_id")
    return out.select("account_id", F.array_join("months", ",").alias("months"), F.size("asked").cast("long").alias("asked"), F.array_join("missing", ",").alias("missing"))


@query("WITH f AS (SELECT seq, 'h' || seq AS hash FROM txn WHERE balance < -300000) SELECT transaction_type, count(*) AS n, round(sum(amount), 2) AS total, string_agg(hash, ',' ORDER BY seq) AS hashes FROM txn JOIN f USING (seq) GROUP BY 1")
def agg_56_fraud_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings met with their rows by hash, summed by type, with the hashes in order."""
    t = transactions(spark, sf_dir).withColumn("hash", F.concat(F.lit("h"), F.col("seq").cast("string")))
    found = t.where("balance < -300000").select("hash")
    rows = F.array_sort(F.collect_list(F.struct("seq", "hash")))
    return t.join(found, "hash").groupBy("transaction_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.array_join(F.transform(rows, lambda r: r["hash"]), ",").alias("hashes"))


@query("SELECT c_custkey, coalesce(round(avg(round(amount * 100)) FILTER (transaction_type = 'credit')) / 100, 0.0) AS credit, coalesce(round(avg(round(amount * 100)) FILTER (transaction_type = 'debit')) / 100, 0.0) AS debit, coalesce(round(avg(round(balance * 100))) / 100, 0.0) AS balance FROM customer LEFT JOIN txn ON account_id = c_custkey GROUP BY 1")
def agg_15_rounded_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means to two decimals, taken in cents, 0 where there is nothing to average; every customer has a row."""
    mean = lambda c: F.coalesce(F.round(F.avg(F.round(c * 100))) / 100, F.lit(0.0))
    of = lambda kind: mean(F.when(F.col("transaction_type") == kind, F.col("amount")))
    g = table(spark, sf_dir, "customer").join(transactions(spark, sf_dir), F.col("c_custkey") == F.col("account_id"), "left").groupBy("c_custkey")
    return g.agg(of("credit").alias("credit"), of("debit").alias("debit"), mean(F.col("balance")).alias("balance"))


@query("SELECT month, start, account_id FROM (SELECT *, lag(start) OVER (PARTITION BY month ORDER BY account_id) AS before FROM (SELECT account_id, strftime(date, '%Y-%m') AS month, min(day(date)) // 11 AS start FROM txn GROUP BY 1, 2)) WHERE before IS NULL OR before <> start")
def agg_45_month_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transactions(spark, sf_dir).groupBy("account_id", F.date_format("date", "yyyy-MM").alias("month")).agg(F.floor(F.min(F.dayofmonth("date")) / 11).cast("long").alias("start"))
    return reports.first_seen(g, "account_id", "month", "start").select("month", "start", "account_id")


@query("SELECT event_id, value, event_id % 2 AS part FROM events", txn=False)
def snk_4_appended_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one columnar table, read back."""
    out, events = shared(spark, "columns"), table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") % 2).alias("part"))
    for k in (0, 1):
        events.where(F.col("part") == k).write.mode("append").parquet(out)
    return spark.read.parquet(out)


class PageRows:
    """The rows of a page's text: lines of a date, a note and an amount; other lines are skipped."""

    def eval(self, page: str) -> Iterator[tuple[int, str, float]]:
        for place, line in enumerate((page or "").split("\n")):
            cells = line.split("|")
            if len(cells) == 3 and cells[2].replace(".", "", 1).isdigit():
                yield place, cells[1], float(cells[2])


@query("SELECT statement_id, page_number, CAST(row_number() OVER (PARTITION BY statement_id, page_number ORDER BY seq) AS INTEGER) AS place, transaction_note AS note, amount FROM txn")
def udf_3_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of text turned into rows by a table function, a page at a time."""
    expand = F.udtf(PageRows, returnType="place int, note string, amount double")
    rows = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("|", F.lit("d"), "transaction_note", F.format_string("%.2f", "amount")).alias("line"))))
    t = transactions(spark, sf_dir).groupBy("statement_id", "page_number").agg(F.concat(F.lit("Statement of account\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\ntotal")).alias("page"))
    return t.lateralJoin(expand(F.col("page").outer())).select("statement_id", "page_number", "place", "note", "amount")
