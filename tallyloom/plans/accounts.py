"""Queries of the account reads, stores, salary tests, account rules and missing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.model import shared, table, transactions, written
from tallyloom.operators import accounts, rules
from tallyloom.plans.registry import query, worn
from tallyloom.sources import files, sinks
from tallyloom.streaming.stores import KeyedStore

_PAID = """SELECT account_id, seq, CAST(substr(CAST(date AS STRING), 1, 10) AS DATE) AS date, transaction_type, CASE WHEN account_id % 4 = 0 THEN 5000.0 + seq % 3 ELSE amount END AS amount, CASE WHEN account_id % 11 = 0 THEN 'loans' ELSE transaction_channel END AS transaction_channel,
  CASE account_id % 5 WHEN 0 THEN 'NEFT acme ltd' WHEN 1 THEN CASE WHEN seq % 2 = 0 THEN 'RTGS' ELSE 'neft' END WHEN 2 THEN 'tech imps 7' ELSE transaction_note END AS transaction_note FROM txn"""


@query(
    f"""WITH g AS ({_PAID}), r AS (SELECT *, upper(transaction_note) AS n, day(date) AS d, row_number() OVER (PARTITION BY account_id ORDER BY date DESC, seq DESC) AS k FROM g),
    b AS (SELECT account_id, median(amount) AS med, avg(amount) FILTER (k <= 2) AS last2, min(date) AS first FROM r GROUP BY 1),
    t AS (SELECT r.account_id, count(*) AS n, bool_and(regexp_matches(n, 'NEFT|RTGS')) AS bank_transfers, bool_and(regexp_matches(n, 'LTD|TECH')) AS company_words, bool_and(d <= 6 OR d >= 24) AS month_end, bool_and(amount > 0.8 * med AND amount < 1.2 * med) AS near_median,
      bool_and(abs(day(first) - d) <= 4 OR abs(day(first) - d) >= 26) AS same_day, bool_or(contains(n, 'IMPS')) AS imps, bool_and(contains(transaction_channel, 'loan')) AS to_remove, bool_and(abs(amount - last2) / last2 <= 0.05) AS within_5, bool_and(abs(amount - last2) / last2 <= 0.2 AND date_diff('day', first, date) <= 5) AS within_20, bool_or(transaction_type = 'debit' AND r.account_id % 2 = 0) AS debit_to_employer
      FROM r JOIN b ON r.account_id = b.account_id GROUP BY 1)
    SELECT * EXCLUDE (n, s), CASE WHEN imps THEN 50 WHEN to_remove THEN least(s, 80) ELSE s END AS confidence FROM (SELECT *, CAST(50 + 10 * (CAST(n >= 3 AS INT) + CAST(month_end AS INT) + CAST(company_words AS INT) + CAST(within_20 AS INT) + CAST(within_5 AS INT) - CAST(debit_to_employer AS INT)) AS INT) AS s FROM t)"""
)
def sca_39_40_salary_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit = (F.col("transaction_type") == "debit") & (F.col("account_id") % 2 == 0)
    return accounts.salary_tests(worn(spark, sf_dir, _PAID), "account_id", "LTD|TECH", debit)


_RULED = "SELECT account_id, seq, date, transaction_type, amount, CASE WHEN account_id % 6 = 0 THEN 'cash_deposit' ELSE transaction_channel END AS transaction_channel, CASE WHEN account_id % 7 = 0 AND transaction_type = 'debit' THEN -abs(balance) ELSE balance END AS balance, CASE WHEN seq % 3 = 0 THEN 'IMPS/x' WHEN seq % 7 = 1 THEN 'rtgs y' ELSE transaction_note END AS transaction_note, CASE WHEN account_id % 2 = 0 THEN 'CURRENT' ELSE 'individual' END AS category FROM txn"
_FOUND_SQL = f"""g AS ({_RULED}), m AS (SELECT *, upper(transaction_note) AS n, lead(date) OVER (PARTITION BY account_id ORDER BY date, seq) AS next FROM g),
  s AS (SELECT *, contains(n, 'RTGS') AND amount < 200000 AS small, transaction_channel = 'upi' AND transaction_type = 'debit' AS u, transaction_channel = 'net_banking_transfer' AND transaction_type = 'debit' AND contains(n, 'IMPS') AS i FROM m),
  found AS (SELECT account_id, 'min_rtgs_amount' AS finding, seq FROM s WHERE small UNION ALL SELECT account_id, 'negative_balance', seq FROM s WHERE NOT small AND balance < 0 AND category <> 'CURRENT' AND next <> date
    UNION ALL SELECT account_id, 'max_upi_limit_per_transaction', seq FROM s WHERE u AND amount > 100000 UNION ALL SELECT account_id, 'max_imps_limit_per_transaction', seq FROM s WHERE i AND amount > 100000
    UNION ALL SELECT DISTINCT account_id, f, CAST(NULL AS BIGINT) FROM (SELECT account_id, CAST(date AS DATE) AS day, CASE WHEN u THEN 'max_upi_limit_per_day' ELSE 'max_imps_limit_per_day' END AS f, sum(amount) AS t FROM s WHERE u OR i GROUP BY ALL) WHERE t > 200000
    UNION ALL SELECT account_id, 'mostly_cash_transactions', NULL FROM s GROUP BY 1 HAVING 2 * count(*) FILTER (transaction_channel IN ('cash_withdrawl', 'cash_deposit')) >= count(*)
    UNION ALL SELECT account_id, 'equal_credit_debit', NULL FROM s GROUP BY 1 HAVING round(coalesce(sum(amount) FILTER (transaction_type <> 'debit'), 0.0) - coalesce(sum(amount) FILTER (transaction_type = 'debit'), 0.0), 2) = 0)"""


@query(f"WITH {_FOUND_SQL} SELECT * FROM found")
def sca_43_account_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.account_findings(worn(spark, sf_dir, _RULED), "account_id", ["date", "seq"], F.col("category"), 100_000, 200_000)


@query(
    f"""WITH {_FOUND_SQL} SELECT account_id, statement_id, CASE WHEN account_id % 3 = 0 THEN 'author_fraud' ELSE 'page_fraud' END AS fraud_type, CAST(NULL AS BIGINT) AS seq, 'metadata' AS fraud_category FROM (SELECT DISTINCT account_id, statement_id FROM txn) WHERE account_id % 4 = 1
    UNION ALL SELECT account_id, NULL, finding, seq, 'transaction' FROM found WHERE NOT (finding = 'negative_balance' AND account_id % 5 = 0)"""
)
def udf_9_fraud_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = accounts.account_findings(worn(spark, sf_dir, _RULED), "account_id", ["date", "seq"], F.col("category"), 100_000, 200_000)
    k = F.col("account_id")
    who = transactions(spark, sf_dir).select("account_id", "statement_id").distinct()
    identities = who.withColumns({"is_fraud": k % 4 == 1, "fraud_type": F.when(k % 3 == 0, "font_fraud").otherwise("page_fraud")})
    return accounts.fraud_list(identities, found, ["font_fraud", "creator_fraud"], F.when(k % 5 == 0, "corporate").otherwise("individual"), "account_id")


#: The columns that a caller sees of a transaction.
_PUBLIC = ["transaction_type", "transaction_note", "amount", "balance", "date", "seq"]


@query("SELECT transaction_type, transaction_note, amount, balance, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, seq, transaction_channel || '|' || bank_name AS metadata FROM txn WHERE account_id = 7")
def udf_6_13_account_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).where("account_id = 7")
    return t.select(*[c for c in _PUBLIC if c != "date"], F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.concat_ws("|", "transaction_channel", "bank_name").alias("metadata"))


@query(
    "SELECT seq, amount, CASE WHEN account_id % 10 = 1 THEN 'ACME' END AS employer_name, strftime(CASE WHEN day(date) < 20 THEN date - INTERVAL 1 MONTH ELSE date END, '%b-%Y') AS salary_month FROM txn WHERE transaction_type = 'credit' AND (account_id % 10 = 1 OR regexp_matches(transaction_note, '(?i)chq'))"
)
def udf_12_salary_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    employer = F.col("account_id") % 10 == 1
    t = transactions(spark, sf_dir).where((F.col("transaction_type") == "credit") & (employer | F.col("transaction_note").rlike("(?i)chq")))
    month = F.date_format(F.when(F.dayofmonth("date") < 20, F.add_months("date", -1)).otherwise(F.col("date")), "MMM-yyyy")
    return t.select("seq", "amount", F.when(employer, "ACME").alias("employer_name"), month.alias("salary_month"))


@query(
    """SELECT statement_id, 'done' AS transactions_status, CASE WHEN page % 2 = 0 THEN 'failed' ELSE 'processing' END AS identity_status, CASE WHEN page % 3 = 0 THEN NULL WHEN page % 3 = 1 THEN 'bad page' ELSE 'old' END AS message, page % 5 = 0 AS to_reject_statement
    FROM (SELECT statement_id, max(page_number) AS page FROM txn GROUP BY 1)"""
)
def snk_17_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = transactions(spark, sf_dir).groupBy("statement_id").agg(F.max("page_number").alias("page"))
    page, no = F.col("page"), F.lit(None).cast("string")
    update = lambda at, kind, status, message=no, reject=F.lit(None).cast("boolean"), where=F.lit(True): s.where(where).select("statement_id", F.lit(at).alias("at"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), message.alias("message"), reject.alias("reject"))
    updates = update(1, "transactions_status", "processing", F.lit("bad page"), where=page % 3 == 1).union(update(2, "transactions_status", "done")).union(update(3, "identity_status", "failed", where=page % 2 == 0))
    updates = updates.union(update(4, "transactions_status", "done", F.lit(""), where=page % 3 == 0)).union(update(5, "transactions_status", "done", no, F.lit(True), page % 5 == 0)).union(update(6, "transactions_status", "done", no, F.lit(False)))
    stored = s.select("statement_id", F.lit("processing").alias("transactions_status"), F.lit("processing").alias("identity_status"), F.lit("old").alias("message"), F.lit(False).alias("to_reject_statement"))
    out = accounts.progress(stored, updates, "statement_id", ["transactions_status", "identity_status"])
    return out.select("statement_id", "transactions_status", "identity_status", "message", "to_reject_statement")


@query("SELECT account_id, string_agg(transaction_note, '|' ORDER BY seq) AS item_data, length(string_agg(transaction_note, '|' ORDER BY seq)) > 300 AS spilled FROM txn GROUP BY 1")
def snk_7_spilled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seq", "transaction_note")))
    g = transactions(spark, sf_dir).groupBy("account_id").agg(F.array_join(F.transform(rows, lambda r: r["transaction_note"]), "|").alias("data"))
    objects, store = shared(spark, "objects"), shared(spark, "features")
    accounts.spilled(g, "account_id", "data", 300, objects).write.parquet(store)
    kept = spark.read.parquet(store)
    back = accounts.unspilled(kept, spark.read.schema("object_key string, body string").parquet(objects), "account_id")
    return back.join(kept.select("account_id", F.col("object_key").isNotNull().alias("spilled")), "account_id")


@query("SELECT statement_id, page_number, seq, CASE WHEN seq % 50 = 0 THEN 'patched' ELSE transaction_note END AS transaction_note, bool_or(seq % 50 = 0) OVER (PARTITION BY statement_id, page_number) AS dirty FROM txn")
def snk_6_dirty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the pages (of a statement) with a changed row are written again, as a later layer of a keyed store."""
    page = F.concat_ws("/", "statement_id", F.col("page_number").cast("string")).alias("page")
    t = transactions(spark, sf_dir).select(page, "statement_id", "page_number", "seq", "transaction_note")
    pages = t.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "statement_id", "page_number", "transaction_note"))).alias("rows"))  # a page's rows
    store = KeyedStore(spark, shared(spark, "pages"), "page", pages.schema, buckets=16)
    store.write(pages, 0)
    patches = t.where("seq % 50 = 0").select("page", "seq").groupBy("page").agg(F.collect_set("seq").alias("patched"))
    note = lambda r, patched: F.when(F.array_contains(patched, r["seq"]), "patched").otherwise(r["transaction_note"]).alias("transaction_note")
    changed = store.read(before=1).join(patches, "page").select("page", F.transform("rows", lambda r: F.struct(r["seq"].alias("seq"), r["statement_id"].alias("statement_id"), r["page_number"].alias("page_number"), note(r, F.col("patched")))).alias("rows"))
    store.write(changed, 1)
    written_again = spark.read.schema(store.stored).parquet(f"{store.root}/deltas/epoch=1").select("page", F.lit(True).alias("dirty"))
    back = store.read().join(written_again, "page", "left").select(F.explode("rows").alias("r"), F.coalesce("dirty", F.lit(False)).alias("dirty"))
    return back.select("r.statement_id", "r.page_number", "r.seq", "r.transaction_note", "dirty")


@query("SELECT p_partkey, p_brand, p_size FROM part", txn=False)
def snk_16_csv_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared(spark, "groups")
    sinks.csv_by_group(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), out, "p_brand")
    return spark.read.option("header", True).schema("p_partkey long, p_size int, p_brand string").csv(out)


@query("SELECT n_regionkey, r_name, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", txn=False)
def snk_14_src_20_nested_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report as XML text in a file, and the record read back from it."""
    out = shared(spark, "report")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    g = n.groupBy("n_regionkey", "r_name").agg(rows.alias("nation"))
    record = F.struct("n_regionkey", F.struct("r_name", F.struct("nation").alias("nations")).alias("identity"))
    g.select(F.to_xml(record, {"rowTag": "report", "indent": ""}).alias("value")).write.text(out)
    schema = "n_regionkey int, identity struct<r_name:string,nations:struct<nation:array<struct<key:int,name:string>>>>"
    parsed = spark.read.text(out, lineSep="</report>").where("trim(value) <> ''").select(F.from_xml(F.concat("value", F.lit("</report>")), schema, {"rowTag": "report"}).alias("r")).where("r.n_regionkey IS NOT NULL")
    names = F.transform("r.identity.nations.nation", lambda x: x["name"])
    return parsed.select("r.n_regionkey", "r.identity.r_name", F.size(names).cast("long").alias("n"), F.array_join(names, ",").alias("names"))


_SENT = "SELECT statement_id, page_number, seq, date, transaction_type, amount, balance, transaction_note, concat('h', seq % 40) AS hash FROM txn"


@query(
    f"""WITH g AS ({_SENT}), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY statement_id, page_number ORDER BY seq) - 1 AS INTEGER) AS sequence_number FROM g WHERE page_number <= 9), v AS (SELECT * FROM p WHERE amount > 3000)
    SELECT v.statement_id, v.page_number, v.sequence_number, 'template-' || v.page_number % 3 AS template_id, row_number() OVER (PARTITION BY v.statement_id ORDER BY v.date, v.page_number, v.sequence_number) AS place, h.pages FROM v JOIN (SELECT hash, array_to_string(list_sort(list_distinct(list(statement_id || ':' || page_number))), ',') AS pages FROM p GROUP BY 1) h ON v.hash = h.hash"""
)
def src_2_4_5_statement_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written one JSON object each, scanned up to the last page: rows with their page, place and
    template, in order of date, without invalid ones, and the pages on which each hash stands."""
    out, t = shared(spark, "pages"), worn(spark, sf_dir, _SENT)
    row = F.struct("seq", "transaction_type", "transaction_note", "amount", "balance", F.col("date").cast("string").alias("date"), "hash")
    pages = t.groupBy("statement_id", "page_number").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("item_data"))
    pages.withColumn("template_id", F.concat(F.lit("template-"), (F.col("page_number") % 3).cast("string"))).write.json(out)
    stored = spark.read.schema("statement_id string, page_number int, item_data string, template_id string").json(out).where("page_number <= 9")
    kind = "array<struct<transaction_type:string,amount:double,balance:double,date:string,hash:string>>"
    rows = stored.select("statement_id", "page_number", "template_id", F.posexplode(F.from_json("item_data", kind)).alias("sequence_number", "r")).select("statement_id", "page_number", "template_id", "sequence_number", "r.*")
    rows = written(rows, "rows")  # parsed once
    by_hash = rows.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "statement_id", F.col("page_number").cast("string")))), ",").alias("pages"))
    place = F.row_number().over(Window.partitionBy("statement_id").orderBy("date", "page_number", "sequence_number")).cast("long")
    valid = rows.where(F.col("date").isNotNull() & F.col("transaction_type").isNotNull() & (F.col("amount") > 3000)).withColumn("place", place)
    columns = ["statement_id", "page_number", "sequence_number", "template_id", "place"]
    return accounts.beside(valid.select(*columns, "hash"), by_hash, "hash", "pages").select(*columns, "pages")


@query("SELECT r_name AS bank, n_name AS channel, CAST(dense_rank() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INTEGER) AS priority, pattern FROM (SELECT r_name, n_name, unnest(['^' || n_name, upper(substr(n_name, 1, 2)) || '$']) AS pattern FROM nation JOIN region ON n_regionkey = r_regionkey)", txn=False)
def src_28_rule_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule tables read from JSON files, one a bank (here a region, whose channels are its nations); priorities by place."""
    out = shared(spark, "rules")
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    patterns = F.array(F.concat(F.lit("^"), "n_name"), F.concat(F.upper(F.substring("n_name", 1, 2)), F.lit("$")))
    held = named.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", patterns.alias("p")))).alias("c"))  # a region's nations
    order, lists = F.transform("c", lambda x: x["n_name"]), F.map_from_entries(F.transform("c", lambda x: F.struct(x["n_name"], x["p"])))
    held.select(F.to_json(F.struct(F.col("r_name").alias("bank"), order.alias("order"), lists.alias("patterns")))).write.text(out)
    raw = spark.read.text(out).select(F.from_json("value", "bank string, `order` array<string>, patterns map<string, array<string>>").alias("r"))
    placed = raw.select("r.bank", F.posexplode("r.order").alias("priority", "channel"), F.col("r.patterns").alias("p"))
    return placed.select("bank", "channel", "priority", F.explode(F.element_at("p", F.col("channel"))).alias("pattern"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS kind, s_name AS uuid, '^' || s_name AS regex, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 4 END AS INTEGER) AS corners FROM supplier UNION ALL SELECT 'memory', r_name, r_name || '$', 2 FROM region", txn=False)
def src_29_30_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates from files of one JSON object each (here the suppliers of a nation), and from a list in memory."""
    out = shared(spark, "templates")
    box = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(*[F.lit(float(k)) for k in range(4)]))
    one = F.struct(F.col("s_name").alias("uuid"), F.concat(F.lit("^"), "s_name").alias("regex"), box.alias("bbox"))
    by_kind = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("kind")).agg(F.collect_list(one).alias("t"))  # a nation's file
    by_kind.select(F.to_json(F.create_map("kind", "t"))).write.text(out)
    listed = [("memory", r["r_name"], f"{r['r_name']}$", [0.0, 1.0]) for r in table(spark, sf_dir, "region").select("r_name").collect()]  # five rows, the list
    held = files.rows(spark, listed, "kind string, uuid string, regex string, bbox array<double>")
    return files.templates(spark, out).select("kind", "uuid", "regex", "bbox").union(held).select("kind", "uuid", "regex", F.size("bbox").alias("corners"))


_SPANS = "SELECT account_id, min(CAST(date AS DATE)) AS low, max(CAST(date AS DATE)) AS high FROM txn GROUP BY account_id, year(date), month(date)"


@query(
    f"""WITH c AS ({_SPANS}), a AS (SELECT account_id, DATE '1996-01-10' AS low, DATE '1996-03-20' AS high FROM c GROUP BY 1), d AS (SELECT account_id, CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS day FROM a),
    m AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.account_id = d.account_id AND d.day BETWEEN c.low AND c.high))
    SELECT account_id, strftime(day, '%b %Y') AS month, array_to_string(list_sort(list(day(day))), ',') AS days FROM m WHERE account_id IN (SELECT account_id FROM m GROUP BY 1 HAVING count(*) > 60) GROUP BY 1, 2"""
)
def set_7_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = worn(spark, sf_dir, _SPANS)
    asked = covered.select("account_id").distinct().select("account_id", F.lit("1996-01-10").cast("date").alias("low"), F.lit("1996-03-20").cast("date").alias("high"))
    out = accounts.missing_days(asked, covered, "account_id", 60)
    return out.select("account_id", "month", F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days"))


@query(
    """SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY account_id, strftime(date, '%Y-%m') ORDER BY amount DESC, seq) AS k FROM txn WHERE transaction_type = 'credit' AND NOT regexp_matches(transaction_note, '(?i)upi|imps|paytm') AND date >= date_trunc('month', (SELECT max(o_orderdate) FROM orders)) - INTERVAL 6 MONTH) WHERE k <= 2"""
)
def srt_7_largest_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    today = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    return accounts.largest_credits(t, "account_id", today, 2, "upi|imps|paytm").select("seq")


@query(
    """WITH m AS (SELECT strftime(date, '%Y-%m') AS month, bank_name || '/' || transaction_channel AS category, round(sum(amount), 2) AS total FROM txn GROUP BY 1, 2), a AS (SELECT bank_name || '/' || transaction_channel AS category, round(sum(amount), 2) AS total FROM txn GROUP BY 1)
    SELECT * FROM (SELECT month, category, total, CAST(row_number() OVER (PARTITION BY month ORDER BY total DESC, category) AS INTEGER) AS place FROM m) WHERE place <= 5 UNION ALL SELECT * FROM (SELECT 'all', category, total, CAST(row_number() OVER (ORDER BY total DESC, category) AS INTEGER) AS place FROM a) WHERE place <= 10"""
)
def srt_10_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest categories of each month, and the ten of all months."""
    t = transactions(spark, sf_dir).select(F.date_format("date", "yyyy-MM").alias("month"), F.concat_ws("/", "bank_name", "transaction_channel").alias("category"), "amount")
    total = F.round(F.sum("amount"), 2).alias("total")
    monthly = t.groupBy("month", "category").agg(total).withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("total"), "category"))).where("place <= 5")
    best = t.groupBy("category").agg(total).orderBy(F.desc("total"), "category").limit(10)
    ranked = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "category")))  # ten rows
    return monthly.union(ranked.select(F.lit("all").alias("month"), "category", "total", "place"))


@query(f"WITH c AS ({_SPANS}) SELECT account_id, low, high, row_number() OVER (PARTITION BY account_id ORDER BY low, high) AS place FROM c")
def srt_15_sorted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a key in order of their ends, each with its place; sorted within partitions of the key."""
    c = worn(spark, sf_dir, _SPANS)
    place = F.row_number().over(Window.partitionBy("account_id").orderBy("low", "high")).cast("long")
    return c.withColumn("place", place)


@query("SELECT seq, row_number() OVER (PARTITION BY account_id ORDER BY date, page_number % 2, seq) AS place FROM txn")
def set_2_merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists of an account, here its odd and even pages, merged by date; of equal dates the first list comes first."""
    t = transactions(spark, sf_dir)
    lists = [t.where(F.col("page_number") % 2 == k).select("account_id", "seq", "date", F.lit(k).alias("list")) for k in (0, 1)]
    place = F.row_number().over(Window.partitionBy("account_id").orderBy("date", "list", "seq")).cast("long")
    return lists[0].union(lists[1]).select("seq", place.alias("place"))
