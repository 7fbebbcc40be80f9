"""Queries of account and statement records: split accounts, phrases, precedence, metadata rules, mappings, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.model import table, transactions
from tallyloom.operators import aggregates, records, scorecards
from tallyloom.plans.registry import query, worn

_EOD = "eod AS (SELECT account_id, CAST(date AS DATE) AS day, arg_max(balance, seq) AS b FROM txn GROUP BY 1, 2)"


def _eod(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("day", F.to_date("date"))
    return t.groupBy("account_id", "day").agg(F.max_by("balance", "seq").alias("b"))


@query(
    f"""WITH {_EOD}, m AS (SELECT account_id, strftime(day, '%Y-%m') AS month, min(day) AS a, max(day) AS z FROM eod GROUP BY 1, 2),
    d AS (SELECT account_id, month, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM m),
    f AS (SELECT d.account_id, month, d.day, last_value(b IGNORE NULLS) OVER (PARTITION BY d.account_id, month ORDER BY d.day ROWS UNBOUNDED PRECEDING) AS b FROM d LEFT JOIN eod ON d.account_id = eod.account_id AND d.day = eod.day),
    n AS (SELECT account_id, month, b, count(*) AS n FROM f GROUP BY ALL)
    SELECT account_id, month, round(mean, 4) AS mean, median, mode FROM (SELECT account_id, month, avg(b) AS mean, median(b) AS median FROM f GROUP BY 1, 2) JOIN (SELECT account_id, month, arg_max(b, (n, -b)) AS mode FROM n GROUP BY 1, 2) USING (account_id, month)"""
)
def agg_31_daily_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.daily_levels(_eod(spark, sf_dir), ["account_id"], "day", "b").withColumn("mean", F.round("mean", 4))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    return t.select("seq", F.when(F.col("seq") % 11 != 0, F.col("amount")).alias("x"), ((F.col("amount") > 150_000) == (F.col("seq") % 5 != 0)).cast("int").alias("y"), F.when(F.col("seq") % 13 != 0, F.concat_ws("-", "bank_name", "transaction_channel")).alias("kind"), F.lit(1.0).alias("one"))


@query()
def agg_53_tree_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of the amount by a tree, null apart, with their weight of evidence."""
    t = _marked(spark, sf_dir)
    points = scorecards.split_points(t, "x", "y", 4, 50)
    binned = t.withColumn("bin", F.coalesce(scorecards.bin_of(F.col("x"), points), F.lit(-1)))
    edges = F.array(*[F.lit(float(p)) for p in points]) if points else F.array().cast("array<double>")
    return aggregates.weight_of_evidence(binned, "bin", "y", "one", 0.0001).withColumn("points", edges)


@query(
    """WITH g AS (SELECT CASE WHEN seq % 13 <> 0 THEN bank_name || '-' || transaction_channel END AS kind, CAST((amount > 150000) = (seq % 5 <> 0) AS INTEGER) AS y FROM txn),
    s AS (SELECT kind, count(*) AS n, sum(y) AS b FROM g GROUP BY 1), p AS (SELECT sum(b) / sum(n) AS r FROM s WHERE n < (SELECT count(*) / 40 FROM g)),
    r AS (SELECT kind, CASE WHEN n < (SELECT count(*) / 40 FROM g) THEN (SELECT r FROM p) ELSE b / n END AS rate FROM s),
    q AS (SELECT CAST(rate > 0.4 AS INTEGER) + CAST(rate > 0.5 AS INTEGER) AS grp, y FROM g JOIN r ON g.kind IS NOT DISTINCT FROM r.kind), a AS (SELECT count(*) AS w, sum(y) AS bad FROM q), k AS (SELECT grp, count(*) AS w, sum(y) AS bad FROM q GROUP BY 1)
    SELECT k.grp, round(ln(((k.w - k.bad) / k.w + 0.5) / (k.bad / k.w + 0.5)) - ln(((a.w - a.bad) / a.w + 0.5) / (a.bad / a.w + 0.5)), 6) AS woe FROM k, a"""
)
def agg_54_category_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _marked(spark, sf_dir)
    grouped, _ = scorecards.category_groups(t, "kind", "y", t.count() / 40, points=[0.4, 0.5])
    return aggregates.weight_of_evidence(grouped, "grp", "y", "one", 0.5).select("grp", F.round("woe", 6).alias("woe"))


@query("SELECT seq, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN amount > 200000 THEN 0.5 WHEN amount > 100000 THEN -0.25 ELSE 0.1 END WHEN 2 THEN 0.75 ELSE -1.0 END AS woe FROM txn")
def sca_59_bin_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = transactions(spark, sf_dir), F.col("seq") % 4
    by_bin = F.element_at(F.create_map(*[F.lit(x) for kv in {0: 0.1, 1: -0.25, 2: 0.5}.items() for x in kv]), scorecards.bin_of(F.col("amount"), [100_000.0, 200_000.0]))
    values = F.create_map(F.lit("known"), F.lit(0.75))
    name = F.when(k == 2, "known").otherwise("never seen")
    return t.select("seq", F.when(k == 0, None).when(k == 1, by_bin).otherwise(F.coalesce(F.try_element_at(values, name), F.lit(-1.0))).alias("woe"))


_NUMBERED = "SELECT statement_id, seq, amount, CASE WHEN seq % 4 = 0 THEN concat('AC', account_id, '10', seq % 3) END AS account_number FROM txn"
_KNOWN = "SELECT DISTINCT statement_id, concat('ZZ', CASE WHEN account_id % 2 = 0 THEN '101' ELSE '777' END) AS account_number FROM txn"


@query(
    f"""WITH g AS ({_NUMBERED}), f AS (SELECT statement_id, seq, amount, coalesce(last_value(account_number IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'own-' || statement_id) AS account_number, false AS placeholder FROM g),
    k AS ({_KNOWN}), u AS (SELECT * FROM f UNION ALL SELECT statement_id, NULL, NULL, account_number, true FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.statement_id = k.statement_id AND right(f.account_number, 3) = right(k.account_number, 3))),
    c AS (SELECT statement_id, account_number, count(*) FILTER (NOT placeholder) AS n, round(coalesce(sum(amount), 0.0), 2) AS total, bool_or(placeholder) AS empty FROM u GROUP BY 1, 2)
    SELECT *, statement_id || '#' || row_number() OVER (PARTITION BY statement_id ORDER BY account_number) AS child_id FROM c"""
)
def bnk_14_15_child_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = worn(spark, sf_dir, _KNOWN)
    rows = records.by_account_number(worn(spark, sf_dir, _NUMBERED), "statement_id", "seq", F.concat(F.lit("own-"), "statement_id"), known)
    return records.child_statements(rows, "statement_id")


@query(
    "SELECT seq, n IN (0, 2) AS opening, n IN (1, 3) AS closing FROM (SELECT seq, seq % 6 AS n FROM txn)"
)
def bnk_17_header_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [" Opening  Balance 5", "CLOSING BALANCE as of", "b/f", "closing bal", "the opening balance", None]
    note = F.element_at(F.array(*[F.lit(w) for w in words]), (1 + F.col("seq") % 6).cast("int"))
    return transactions(spark, sf_dir).select("seq", records.begins_with(note, [r"opening\s+bal", r"b/f$"]).alias("opening"), records.begins_with(note, [r"closing\s+bal"]).alias("closing"))


_LABELS = ["EMI Payment", "Bounced I/W Cheque Charges", "Transfer to Bob", "Credit Card Payment", "Investment Income", "Home Loan", "Fuel", "Food", "Travel", "nothing"]


@query(
    f"""WITH g AS (SELECT seq, [{', '.join(f"'{w}'" for w in _LABELS)}][1 + seq % 10] AS category FROM txn)
    SELECT seq, CASE WHEN contains(lower(category), 'loan') OR contains(lower(category), 'emi payment') THEN 'lender_transaction' WHEN lower(category) = 'bounced i/w cheque charges' THEN 'chq_bounce_charge' WHEN contains(lower(category), 'transfer to') THEN category WHEN lower(category) = 'credit card payment' THEN 'credit_card_bill' WHEN lower(category) = 'investment income' THEN 'trading/investments' ELSE '' END AS description,
      CASE WHEN contains(lower(category), 'loan') OR contains(lower(category), 'emi payment') THEN 'loans' WHEN lower(category) = 'credit card payment' THEN 'bills' WHEN lower(category) IN ('fuel', 'food', 'travel') THEN lower(category) WHEN lower(category) = 'investment income' THEN 'trading/investments' ELSE '' END AS merchant_category,
      CASE WHEN category IN ('EMI Payment', 'Credit Card Payment') THEN 'paid' ELSE 'other' END AS token FROM g"""
)
def bnk_18_vendor_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.element_at(F.array(*[F.lit(w) for w in _LABELS]), (1 + F.col("seq") % 10).cast("int"))
    texts = [("contains", ["loan", "emi payment"], "lender_transaction"), ("equals", ["bounced i/w cheque charges"], "chq_bounce_charge"), ("contains", ["transfer to", "transfer from"], None), ("equals", ["credit card payment"], "credit_card_bill"), ("equals", ["investment expense", "investment income"], "trading/investments")]
    kinds = [("contains", ["loan", "emi payment"], "loans"), ("equals", ["credit card payment"], "bills"), ("equals", ["fuel"], "fuel"), ("equals", ["travel"], "travel"), ("equals", ["investment expense", "investment income"], "trading/investments"), ("equals", ["food"], "food")]
    t = transactions(spark, sf_dir).select("seq", c.alias("c"))
    return t.select("seq", records.mapped(F.col("c"), texts, "").alias("description"), records.mapped(F.col("c"), kinds, "").alias("merchant_category"), records.mapped(F.col("c"), [("token", ["payment"], "paid")], "other").alias("token"))


@query(
    "SELECT account_id, CASE WHEN bool_or(status = 'FRAUD' OR amount > 400000) THEN 'FRAUD' WHEN bool_or(status = 'REFER') THEN 'REFER' END AS verdict FROM (SELECT account_id, amount, CASE WHEN seq % 31 = 0 THEN 'FRAUD' WHEN seq % 7 = 0 THEN 'REFER' WHEN seq % 3 = 0 THEN 'OK' END AS status FROM txn) GROUP BY 1"
)
def bnk_20_worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("status", F.when(F.col("seq") % 31 == 0, "FRAUD").when(F.col("seq") % 7 == 0, "REFER").when(F.col("seq") % 3 == 0, "OK"))
    return records.worst_status(t, "account_id", "status", F.col("amount") > 400_000)


@query(
    """WITH m AS (SELECT bank_name, strftime(date, '%Y-%m') AS month, count(*) AS n, max(amount) AS top FROM txn GROUP BY 1, 2)
    SELECT bank_name, 'group' || dense_rank() OVER (ORDER BY bank_name) AS group_name, string_agg(month || ':' || n || ':' || CAST(top AS DECIMAL(18, 2)), ',' ORDER BY month) AS months FROM m GROUP BY bank_name"""
)
def bnk_21_22_monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).withColumn("month", F.date_format("date", "yyyy-MM"))
    r = records.monthly_report(t, "bank_name", "month", {"n": F.count("*"), "top": F.max("amount")})
    number = F.dense_rank().over(Window.orderBy("bank_name")).cast("string")  # one row for each bank
    text = F.transform("months", lambda m: F.concat_ws(":", m["month"], m["n"].cast("string"), m["top"].cast("decimal(18,2)").cast("string")))
    return r.select("bank_name", F.concat(F.lit("group"), number).alias("group_name"), F.array_join(text, ",").alias("months"))


@query(
    "SELECT p_partkey, (p_brand = 'Brand#11' AND p_size = 7) OR (p_brand = 'Brand#12') OR (p_size = 9 AND p_type = (SELECT min(p_type) FROM part)) OR p_size = 3 AS allowed FROM part",
    txn=False,
)
def bnk_24_allowed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    first = part.agg(F.min("p_type")).first()[0]
    rules = spark.createDataFrame([("Brand#11", 7, None), ("Brand#12", None, None), (None, 9, first), (None, 3, None)], "p_brand string, p_size int, p_type string")
    return records.allowed(part, rules, ["p_brand", "p_size", "p_type"]).select("p_partkey", "allowed")


@query(
    """SELECT c_custkey, len(t) = 2 AS two, 100.0 AS score, array_to_string(list_transform(t, lambda w: w || '=' || CASE WHEN w = 'XQZ' THEN 'false' ELSE 'true' END), ',') AS tokens FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ['ANN', 'LEE'] ELSE ['ANN', 'XQZ'] END AS t FROM customer)""",
    txn=False,
)
def bnk_26_name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace(F.upper(F.when(F.col("c_custkey") % 2 == 0, "Ann. Lee").otherwise("ann xqz 9")), "[^A-Z ]+", "")
    m = table(spark, sf_dir, "customer").select("c_custkey", records.name_match(F.lit("MISS LEE ANN BOBSON"), F.trim(name)).alias("m"))
    tokens = F.transform("m.tokens", lambda t: F.concat(t["token"], F.lit("="), t["matches"].cast("string")))
    return m.select("c_custkey", (F.size("m.tokens") == 2).alias("two"), F.col("m.score").alias("score"), F.array_join(tokens, ",").alias("tokens"))


@query(
    """SELECT o_orderkey, o_orderkey % 3 <> 2 AS same, (o_orderkey % 2 = 1 OR starts_with(o_orderpriority, '1')) AND (o_orderkey % 5 <> 0 OR o_orderstatus IN ('F', 'O')) AND (o_orderkey % 7 <> 0 OR length(o_orderpriority) >= 7) AND (o_orderkey % 11 <> 0 OR length(o_orderpriority) <= 8) AS passed FROM orders""",
    txn=False,
)
def bnk_27_28_optional_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")
    b = F.when(k % 3 == 2, F.array("o_orderstatus")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    given = lambda every, rule: F.when(k % every == 0, rule)
    ok = records.passes(F.col("o_orderpriority"), F.col("o_orderstatus"), given(2, F.lit("^1")), given(5, F.array(F.lit("F"), F.lit("O"))), given(7, F.lit(7)), given(11, F.lit(8)))
    return o.select("o_orderkey", records.same_members(a, b).alias("same"), ok.alias("passed"))


@query(
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 40",
    txn=False,
)
def bnk_33_inconsistency_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where((F.col("event_type") != "error") & (F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-20"))
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), "event_type").where("k > 40")


@query(
    "SELECT statement_id, bool_or(seq % 5 = 0) AS any_date, bool_and(seq % 7 <> 0) AS all_noted, count(*) FILTER (seq % 2 = 0) * 2 > count(*) AS mostly_split FROM txn GROUP BY 1"
)
def bnk_13_table_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("statement_id", F.when(F.col("seq") % 5 == 0, "paid 05/06/2021 10:22:01").otherwise("paid 7").alias("cell"), F.when(F.col("seq") % 7 == 0, " ").otherwise("x").alias("note"), F.when(F.col("seq") % 2 == 0, "12.00 40.00").otherwise("12.00").alias("amount"))
    timed = F.col("cell").rlike(r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}")
    return t.groupBy("statement_id").agg(F.bool_or(timed).alias("any_date"), F.bool_and(F.trim("note") != "").alias("all_noted"), (2 * F.count_if(F.col("amount").rlike(r"^[\d.]+ [\d.]+$")) > F.count("*")).alias("mostly_split"))


@query("SELECT seq, CAST(seq % 1000 + 0.5 AS DOUBLE) AS amount, CASE WHEN seq % 3 <> 2 THEN CAST(seq % 77 + 0.25 AS DOUBLE) END AS balance FROM txn")
def bnk_2_merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of amount and balance split by pattern, or by its tokens' places; a lone number is the amount."""
    k = F.col("seq") % 3
    a, b = F.format_string("%d.50", F.col("seq") % 1000), F.format_string("%d.25", F.col("seq") % 77)
    cell = F.when(k == 0, F.concat(a, F.lit("Dr"), b, F.lit("Cr"))).when(k == 1, F.concat(F.lit("INR "), a, F.lit(" / "), b)).otherwise(a)
    t = transactions(spark, sf_dir).select("seq", cell.alias("cell"))
    numbers = F.regexp_extract_all("cell", F.lit(r"([0-9,]+\.[0-9]{2})"))
    number = lambda i: F.replace(F.get(numbers, i), F.lit(","), F.lit("")).cast("double")
    return t.select("seq", number(0).alias("amount"), number(1).alias("balance"))
