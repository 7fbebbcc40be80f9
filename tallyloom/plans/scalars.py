"""Queries of the text, amount, date and rule functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text, values
from tallyloom.model import by_account, table, transactions
from tallyloom.operators import rules, similarity
from tallyloom.plans.registry import query


@query("SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')) AS cleaned, md5(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS bare FROM documents", txn=False)
def sca_1_2_54_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_only(t)).alias("cleaned"), F.md5(text.bare(t)).alias("bare"))


@query("SELECT seq, CASE WHEN regexp_matches(transaction_note, '^(?:UPI/Customer#0*([0-9]+)/)') THEN regexp_extract(transaction_note, '^(?:UPI/Customer#0*([0-9]+)/)', 1) END AS customer FROM txn")
def sca_3_29_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", text.capture(F.col("transaction_note"), "UPI/Customer#0*([0-9]+)/", 1).alias("customer"))


@query("SELECT doc_id, contains(lower(text), 'idiot') OR contains(lower(text), 'license') AS has_any, regexp_matches(text, '\\bthe\\b') AS has_the FROM documents", txn=False)
def sca_5_25_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_any(F.col("text"), ["idiot", "License"]).alias("has_any"), text.has_word(F.col("text"), "the").alias("has_the"))


_AMOUNT_SQL = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Rs. ' || CAST(o_totalprice AS VARCHAR) || ' Cr' WHEN 1 THEN '-' || CAST(o_totalprice AS VARCHAR) || ' dr' WHEN 2 THEN '- 17' ELSE 'n/a' END AS t, o_orderkey % 4 AS k FROM orders"


@query(f"SELECT o_orderkey, k <> 3 AS is_amount, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN -1 END AS sign, CASE WHEN k < 2 THEN try_cast(regexp_replace(regexp_replace(t, '[Rr]s\\.', ''), '[^0-9.]', '', 'g') AS DOUBLE) WHEN k = 2 THEN 17.0 END AS amount FROM ({_AMOUNT_SQL})", txn=False)
def sca_6_7_8_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 4, F.format_string("%.2f", "o_totalprice")
    t = F.when(k == 0, F.concat(F.lit("Rs. "), price, F.lit(" Cr"))).when(k == 1, F.concat(F.lit("-"), price, F.lit(" dr"))).when(k == 2, "- 17").otherwise("n/a")
    marked = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    bare = F.regexp_replace("t", r"[Rr]s\.", "")
    return marked.select("o_orderkey", values.is_amount(F.col("t")).alias("is_amount"), values.sign(F.col("t")).alias("sign"), values.amount(bare).alias("amount"))


@query("SELECT seq, md5(regexp_replace(coalesce(lag(CAST(seq AS VARCHAR)) OVER w, '') || seq || coalesce(lead(CAST(seq AS VARCHAR)) OVER w, '') || transaction_note, '[^0-9A-Za-z]', '', 'g')) AS hash FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY date, seq)")
def sca_10_11_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, seq = by_account(), F.col("seq").cast("string")
    parts = F.concat(F.coalesce(F.lag(seq).over(w), F.lit("")), seq, F.coalesce(F.lead(seq).over(w), F.lit("")), "transaction_note")
    return transactions(spark, sf_dir).select("seq", F.md5(text.bare(parts)).alias("hash"))


@query("SELECT seq, CASE WHEN seq % 5 = 4 THEN NULL ELSE strftime(date, '%Y-%m-%d') END AS parsed, strftime(CASE WHEN day(date) < 20 THEN date - INTERVAL 1 MONTH ELSE date END, '%b-%Y') AS salary_month FROM txn")
def sca_12_to_19_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy", "yyyyMMdd"]
    k, d = F.col("seq") % 5, F.col("date")
    written = F.when(k == 4, F.lit("nothing"))
    for i, f in enumerate(formats):
        written = written.when(k == i, F.date_format(d, f))
    return transactions(spark, sf_dir).select("seq", F.date_format(values.parsed(written, formats), "yyyy-MM-dd").alias("parsed"), values.salary_month(d).alias("salary_month"))


@query("SELECT seq, array_to_string(list_filter(str_split_regex(lower(transaction_note), '[ /:,;.#-]'), lambda w: length(w) >= 3 AND w NOT IN ('chq', 'other') AND 2 * length(regexp_replace(w, '[^0-9]', '', 'g')) <= length(w)), ' ') AS tokens FROM txn")
def note_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("seq", F.array_join(text.note_tokens(F.col("transaction_note"), ["chq", "other"]), " ").alias("tokens"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)))), '|') AS shingles FROM part", txn=False)
def sca_22_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.shingles(F.col("p_name")), "|").alias("shingles"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) > 0.75", txn=False)
def sca_23_24_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, block = table(spark, sf_dir, "part"), ["p_brand", "p_type"]
    near = similarity.different_texts(p, "p_name", block).where(text.alike(F.col("x"), F.col("y")))
    return similarity.pairs_of_rows(near.union(similarity.equal_texts(p, "p_name", block)), p, "p_partkey", "p_name", block)


@query()
def sca_23_fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, block = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.lower("p_name").alias("name")), ["p_brand", "p_type"]
    met = similarity.different_texts(p, "name", block)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = met.select("x", "y").distinct().repartition(spread, "x", "y").withColumn("score", similarity.fuzzy_score("x", "y")).where("score > 75")  # alike both ways round
    same = similarity.equal_texts(p, "name", block).withColumn("score", F.lit(100.0))
    found = met.join(scored, ["x", "y"]).select(*block, "x", "y", "score").union(same)
    return similarity.pairs_of_rows(found, p, "p_partkey", "name", block)


_CATEGORY_REGEXES = [("cash", "^cash_"), ("account_seven", "customer#0*7/")]
_CATEGORY_WORDS = [("transfers", ["net_banking_transfr", "wiretransfer"]), ("cheques", ["chq/customer"]), ("upi", ["upi/custmer#"])]


@query()
def sca_30_keyword_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.keyword_categories(transactions(spark, sf_dir), _CATEGORY_REGEXES, _CATEGORY_WORDS, "transaction_note", "category", {"transfers": "debit", "upi": "credit"}, ["salary", "refund"], {"cheques": ["customer#000000001"]}, {"Other": "others", "bill_payment": "bills"})
    return out.select("seq", "category")


_RULES = [("upi_seven", "^upi/.*7/"), ("transfer", "transfer"), ("cheque", "^chq"), ("cash", "cash")]


@query("SELECT seq, CASE WHEN regexp_matches(transaction_note, '(?i)^upi/.*7/') THEN 'upi_seven' WHEN regexp_matches(transaction_note, '(?i)transfer') THEN 'transfer' WHEN regexp_matches(transaction_note, '(?i)^chq') THEN 'cheque' WHEN regexp_matches(transaction_note, '(?i)cash') THEN 'cash' ELSE 'Other' END AS label FROM txn")
def first_rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(transactions(spark, sf_dir), _RULES, "transaction_note", "label").select("seq", "label")


@query(
    """SELECT seq, CASE WHEN transaction_channel = 'upi' AND transaction_type = 'debit' THEN 'Payment' WHEN transaction_channel = 'upi' THEN 'UPI' WHEN transaction_channel = 'chq' THEN 'Cheque' WHEN bank_name = 'MACHINERY' THEN 'Machines' ELSE 'Others' END AS category FROM txn"""
)
def lookup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "upi", "debit", None, "Payment"), (1, "upi", None, None, "UPI"), (1, "chq", None, None, "Cheque"), (2, None, None, "MACHINERY", "Machines")]
    mapping = spark.createDataFrame(rows, "level int, transaction_channel string, transaction_type string, bank_name string, category string")
    levels = [["transaction_channel", "transaction_type"], ["transaction_channel"], ["bank_name"]]
    return rules.lookup_levels(transactions(spark, sf_dir), mapping, levels, "category", "found", "Others").select("seq", F.col("found").alias("category"))


@query("SELECT account_id, arg_max(transaction_channel, (date, seq)) FILTER (transaction_channel IN ('upi', 'chq')) AS category FROM txn GROUP BY 1")
def sca_37_38_latest_decisive(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisive = F.col("transaction_channel").isin("upi", "chq")
    return transactions(spark, sf_dir).groupBy("account_id").agg(F.max(F.when(decisive, F.struct("date", "seq", "transaction_channel")))["transaction_channel"].alias("category"))


@query("SELECT account_id, bool_and(amount > 10000) AS all_large, bool_or(transaction_channel = 'cash_withdrawl') AS any_cash, least(80, 50 + 10 * CAST(count(*) FILTER (transaction_channel = 'upi') AS INTEGER) - CASE WHEN bool_or(transaction_type = 'debit') THEN 10 ELSE 0 END) AS confidence FROM txn GROUP BY 1")
def sca_39_40_group_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.lit(50) + 10 * F.count_if(F.col("transaction_channel") == "upi").cast("int") - F.when(F.bool_or(F.col("transaction_type") == "debit"), 10).otherwise(0)
    return transactions(spark, sf_dir).groupBy("account_id").agg(F.bool_and(F.col("amount") > 10000).alias("all_large"), F.bool_or(F.col("transaction_channel") == "cash_withdrawl").alias("any_cash"), F.least(F.lit(80), score).alias("confidence"))


@query("SELECT 'small_transfer' AS finding, seq FROM txn WHERE transaction_channel = 'net_banking_transfer' AND amount < 20000 UNION ALL SELECT 'sunday_cash', seq FROM txn WHERE transaction_channel IN ('cash_withdrawl', 'chq') AND dayofweek(date) = 0 UNION ALL SELECT 'round_charge', seq FROM txn WHERE CAST(floor(amount) AS BIGINT) % 100 = 0")
def sca_42_row_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.col("transaction_channel")
    found = {"small_transfer": (channel == "net_banking_transfer") & (F.col("amount") < 20000), "sunday_cash": channel.isin("cash_withdrawl", "chq") & (F.dayofweek("date") == 1), "round_charge": F.floor("amount") % 100 == 0}
    return rules.findings(transactions(spark, sf_dir), found, "seq")


@query("SELECT bank_name, strftime(date, '%Y-%m-%d') AS day, 'daily_upi' AS finding FROM txn WHERE transaction_channel = 'upi' GROUP BY bank_name, strftime(date, '%Y-%m-%d') HAVING round(sum(amount), 2) > 500000")
def sca_43_daily_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    upi = transactions(spark, sf_dir).where("transaction_channel = 'upi'")
    return rules.daily_over(upi, ["bank_name"], "date", F.col("amount"), 500000, "daily_upi").withColumn("day", F.col("day").cast("string"))


@query(
    """WITH r AS (SELECT *, sum(CASE WHEN transaction_channel <> 'chq' THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS k FROM txn)
    SELECT account_id, arg_min(seq, (date, seq)) AS seq, string_agg(transaction_note, ' ' ORDER BY date, seq) AS note FROM r WHERE k > 0 GROUP BY account_id, k"""
)
def sca_44_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.join_continuations(transactions(spark, sf_dir), F.col("transaction_channel") != "chq", "transaction_note", ["account_id"], ["date", "seq"])
    return out.select("account_id", "seq", F.col("transaction_note").alias("note"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, right(replace(CAST(user_id AS VARCHAR), '-', ''), 1) = right(CAST(event_id AS VARCHAR), 1) AS same_end FROM events", txn=False)
def sca_47_48_json_and_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), text.masked_equal(F.col("user_id").cast("string"), F.col("event_id").cast("string"), 1).alias("same_end"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(l_quantity, 30) - greatest(l_quantity / 2, 10)) AS overlap, bit_count(xor(l_partkey, l_suppkey)) AS bits FROM lineitem", txn=False)
def overlap_and_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.overlap(q / 2, q, F.lit(10), F.lit(30)).alias("overlap"), values.hamming(F.col("l_partkey"), F.col("l_suppkey")).alias("bits"))


@query("SELECT statement_id, sha256(string_agg(seq || ':' || transaction_note, '|' ORDER BY seq)) AS hash FROM txn GROUP BY 1")
def sca_53_table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seq", "transaction_note")))
    joined = F.array_join(F.transform(rows, lambda r: F.concat(r["seq"].cast("string"), F.lit(":"), r["transaction_note"])), "|")
    return transactions(spark, sf_dir).groupBy("statement_id").agg(F.sha2(joined, 256).alias("hash"))


@query("SELECT account_id, 'Source' || dense_rank() OVER (PARTITION BY account_id ORDER BY transaction_channel) AS source, count(*) AS n FROM txn GROUP BY account_id, transaction_channel")
def sca_55_56_tagged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transactions(spark, sf_dir).groupBy("account_id", "transaction_channel").agg(F.count("*").alias("n"))
    rank = F.dense_rank().over(Window.partitionBy("account_id").orderBy("transaction_channel"))
    return g.select("account_id", F.concat(F.lit("Source"), rank.cast("string")).alias("source"), "n")


@query("SELECT event_id, round(CASE WHEN value <= 10 THEN 900.0 WHEN value <= 50 THEN 900 + (value - 10) * (-200.0) / 40 WHEN value <= 200 THEN 700 + (value - 50) * (-400.0) / 150 ELSE 300.0 END, 4) AS score FROM events", txn=False)
def sca_57_58_59_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(values.piecewise(F.col("value"), [(10, 900), (50, 700), (200, 300)]), 4).alias("score"))


@query("SELECT account_id, list_extract(list(amount ORDER BY date, seq), -2) AS second_last FROM txn GROUP BY 1")
def sca_60_nth_from_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("date", "seq", "amount")))
    as_map = F.map_from_entries(F.transform(rows, lambda r: F.struct(r["seq"], r["amount"])))
    return transactions(spark, sf_dir).groupBy("account_id").agg(values.nth_from_last(as_map, 2).alias("second_last"))


@query("SELECT seq, str_split(transaction_note, '/')[1] AS first_token, str_split(transaction_note, '/')[-1] AS last_token, CAST(CAST(floor(amount) AS BIGINT) AS DOUBLE) + 0.1 AS amount FROM txn")
def bnk_1_2_6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("transaction_note", "/")
    local = F.concat(F.floor("amount").cast("string"), F.lit(",10"))
    return transactions(spark, sf_dir).select("seq", F.element_at(parts, 1).alias("first_token"), F.element_at(parts, -1).alias("last_token"), values.locale_number(local).alias("amount"))


@query("SELECT seq, transaction_note || coalesce(CASE WHEN lead(transaction_channel) OVER w = 'chq' THEN lead(transaction_note) OVER w END, '') AS note FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY date, seq)")
def next_row_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_account()
    tail = F.when(F.lead("transaction_channel").over(w) == "chq", F.lead("transaction_note").over(w))
    return transactions(spark, sf_dir).select("seq", F.concat("transaction_note", F.coalesce(tail, F.lit(""))).alias("note"))


@query("SELECT statement_id, bool_or(amount > 400000) AS any_large, bool_and(amount > 5000) AS all_some, count(*) FILTER (transaction_type = 'debit') > count(*) FILTER (transaction_type = 'credit') AS mostly_debit FROM txn GROUP BY 1")
def bnk_13_20_table_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("transaction_type")
    return transactions(spark, sf_dir).groupBy("statement_id").agg(F.bool_or(F.col("amount") > 400000).alias("any_large"), F.bool_and(F.col("amount") > 5000).alias("all_some"), (F.count_if(kind == "debit") > F.count_if(kind == "credit")).alias("mostly_debit"))


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(first_type, 'none') AS first_type FROM customer LEFT JOIN (SELECT account_id, count(*) AS n, arg_min(transaction_type, (date, seq)) AS first_type FROM txn GROUP BY 1) ON account_id = c_custkey")
def bnk_14_15_16_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = transactions(spark, sf_dir).groupBy(F.col("account_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.min_by("transaction_type", F.struct("date", "seq")).alias("first_type"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_type", F.lit("none")).alias("first_type"))


@query("SELECT account_id, bool_or(amount > 450000) AS flag, count(*) AS n, min(amount) AS low, max(amount) AS high, array_to_string(list(CAST(page_number AS VARCHAR) ORDER BY CAST(page_number AS VARCHAR)), ',') AS tags FROM txn GROUP BY 1")
def bnk_25_merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = transactions(spark, sf_dir).groupBy("account_id", "page_number").agg(F.bool_or(F.col("amount") > 450000).alias("flag"), F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.collect_list(F.col("page_number").cast("string")).alias("tags"))
    return rules.merge_pages(pages, "account_id").withColumn("tags", F.array_join("tags", ","))


@query("SELECT n_nationkey, n_regionkey IN (1, 3) AS wanted FROM nation", txn=False)
def allowed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.lit(1), F.lit(3))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_contains(allowed, F.col("n_regionkey")).alias("wanted"))


@query("SELECT seq, CASE WHEN seq % 6 = 0 THEN 'second' WHEN seq % 3 = 0 THEN 'first' ELSE transaction_channel END AS transaction_channel, CASE WHEN seq % 3 = 0 THEN 1.5 ELSE amount END AS amount FROM txn")
def snk_5_6_8_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("seq", "transaction_channel", "amount")
    patch = lambda every, at, column, value: t.where(F.col("seq") % every == 0).select("seq", F.lit(at).alias("at"), F.lit(column).alias("column"), F.lit(value).alias("value"))
    patches = patch(3, 1, "transaction_channel", "first").union(patch(6, 2, "transaction_channel", "second")).union(patch(3, 1, "amount", "1.5"))
    return rules.apply_patches(t, patches, "seq", ["transaction_channel", "amount"], "at")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1, 5.0", txn=False)
def snk_9_10_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = spark.createDataFrame([(-1, 5.0)], stored.schema)
    return rules.upsert(stored, stored.where("o_totalprice > 400000").withColumn("o_totalprice", F.lit(0.0)).union(new), "o_orderkey")
