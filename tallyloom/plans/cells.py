"""Queries of note, date, cell and JSON expressions on inputs that take every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import cells, text
from tallyloom.model import table
from tallyloom.plans.registry import query, worn

_STOP, _HOSTS = ["upi", "chq", "the", "pay"], ["okaxis", "ybl"]
_NOTED = """SELECT seq, CASE WHEN seq % 2 = 0 THEN 'upi' ELSE 'chq' END AS transaction_channel, CASE seq % 11 WHEN 0 THEN 'UPI/ann.lee@okaxis/the' WHEN 1 THEN 'CHQ xxxx1152 pay BOB77' WHEN 2 THEN 'pay/9876543210/ab' WHEN 3 THEN 'to a1b2 x9' WHEN 4 THEN 'UPI-bo7b-z12z34' WHEN 5 THEN NULL
  WHEN 6 THEN 'ann@other:mob 12345' WHEN 7 THEN '' ELSE transaction_note END AS transaction_note, CASE seq % 4 WHEN 0 THEN 'ann 9876543210/x-1234567890' WHEN 1 THEN '' WHEN 2 THEN 'bob 77' END AS merchant FROM txn"""
_SPLIT = "str_split_regex(lower(transaction_note), '[/:\\-,;.# ]')"
_STOP_SQL = "('upi', 'chq', 'the', 'pay')"
_KEPT = "CASE WHEN length(y) < 3 OR y IN ('upi', 'chq', 'the', 'pay') THEN '' ELSE y END"
_PLAIN = f"list_transform(list_transform({_SPLIT}, lambda w: CASE WHEN w IN {_STOP_SQL} THEN '' WHEN regexp_matches(w, '^x+[0-9]+$') THEN replace(w, 'x', '') ELSE regexp_replace(w, '[0-9]', '', 'g') END), lambda y: {_KEPT})"
_PAID = f"""list_transform(list_transform({_SPLIT}, lambda w: CASE WHEN w IN {_STOP_SQL} THEN '' WHEN split_part(w, '@', 2) IN ('okaxis', 'ybl') THEN split_part(w, '@', 1) WHEN regexp_extract(w, '[0-9]+') = '' OR length(regexp_extract(w, '[0-9]+')) = 10 THEN w
  WHEN length(regexp_replace(replace(w, regexp_extract(w, '[0-9]+'), ''), '[^0-9]', '', 'g')) >= 2 THEN '' ELSE replace(w, regexp_extract(w, '[0-9]+'), '') END), lambda y: {_KEPT})"""


@query(
    f"""WITH g AS ({_NOTED}), c AS (SELECT *, coalesce(array_to_string(list_filter(CASE WHEN transaction_channel = 'upi' THEN {_PAID} ELSE {_PLAIN} END, lambda w: w <> ''), ' '), '') AS note FROM g)
    SELECT seq, note, CASE WHEN coalesce(merchant, '') = '' THEN note ELSE array_to_string(list_filter(str_split_regex(merchant, '[/:\\-,;.# ]'), lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) = 10), ' ') END AS merchant FROM c"""
)
def sca_20_21_clean_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = worn(spark, sf_dir, _NOTED)
    note = cells.clean_note(F.col("transaction_note"), F.col("transaction_channel"), _STOP, _HOSTS)
    return g.withColumn("note", note).select("seq", "note", cells.clean_merchant(F.col("merchant"), F.col("note"), _STOP).alias("merchant"))


_GIVEN = ["re.compile('(?i)^upi/.*7/')", "TRANSFER", "re.compile('.*(CASH).*')", "(broken", "re.compile('[a-')"]


@query("SELECT seq, regexp_matches(transaction_note, '(?i)^upi/.*7/') AS p0, regexp_matches(transaction_note, 'TRANSFER') AS p1, regexp_matches(transaction_note, '.*(CASH).*') AS p2, 2 AS refused FROM txn")
def sca_4_pattern_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = cells.patterns(_GIVEN)
    return worn(spark, sf_dir, "SELECT seq, transaction_note FROM txn").select("seq", *[F.col("transaction_note").rlike(p).alias(f"p{k}") for k, p in enumerate(good)], F.lit(len(bad)).alias("refused"))


_WRITTEN = """SELECT o_orderkey, o_orderdate, CASE o_orderkey % 12 WHEN 10 THEN 'no date' WHEN 11 THEN '' ELSE NULL END AS none, o_orderkey % 12 AS k FROM orders"""
_SHAPES = ["yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "MMM d, yyyy", "ddMMMyyyy", "d.M.yyyy", "yyyyMMdd", "EEE MMM d yyyy", "yyyy-MM-dd HH:mm:ss", "dd-MMM-yy"]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 12 < 10 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 12 = 2 AND false AS semi FROM orders", txn=False)
def sca_12_49_any_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 12
    written = F.when(k == 10, "no date").when(k == 11, "")
    for i, shape in enumerate(_SHAPES):
        written = written.when(k == i, F.date_format("o_orderdate", shape))
    return o.select("o_orderkey", cells.any_date(text.ascii_only(written)).cast("string").alias("day"), cells.semi_date(written).alias("semi"))


@query("SELECT n_nationkey, ['2024-05-07', '2024-10-01', '2023-12-31', NULL][1 + n_nationkey % 4] AS day, n_nationkey % 4 = 3 AS semi FROM nation", txn=False)
def sca_12_month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.element_at(F.array(*[F.lit(x) for x in ("7 mei 2024", "01-OKT-2024", "31  Dez  2023", "29 Feb")]), (1 + F.col("n_nationkey") % 4).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", cells.any_date(written).cast("string").alias("day"), cells.semi_date(written).alias("semi"))


_WORDS = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_linenumber * 10 + l_partkey % 3 AS DOUBLE) AS y0, CAST(l_quantity + 8 AS DOUBLE) AS x1, CAST(l_linenumber * 10 + 8 AS DOUBLE) AS y1, l_returnflag AS text FROM lineitem"


@query(
    f"""WITH w AS ({_WORDS}), i AS (SELECT *, greatest(0, least(x1, 30.0) - greatest(x0, 5.0)) * greatest(0, least(y1, 45.0) - greatest(y0, 12.0)) AS s FROM w)
    SELECT l_orderkey, coalesce(string_agg(text, ' ' ORDER BY round(y0), x0, text) FILTER (2 * s >= (x1 - x0) * (y1 - y0)), '') AS text FROM i GROUP BY 1""",
    txn=False,
)
def sca_50_text_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.sql(_WORDS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    pages = w.groupBy("l_orderkey").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text")).alias("words"))
    return pages.select("l_orderkey", cells.text_in_box(F.col("words"), (5, 12, 30, 45)).alias("text"))


@query(
    """SELECT vec_id, printf('%x', CAST(list_sum(list_transform(range(0, 56), lambda i: CASE WHEN embedding[1 + (i // 7) * 8 + i % 7] < embedding[2 + (i // 7) * 8 + i % 7] THEN 1 ELSE 0 END * (CAST(1 AS UBIGINT) << (55 - i)))) AS UBIGINT)) AS hash
    FROM embeddings WHERE len(embedding) >= 64""",
    txn=False,
)
def sca_52_difference_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64)
    return e.select("vec_id", cells.difference_hash(F.slice("embedding", 1, 64), 8).alias("hash"))


@query("SELECT statement_id, page_number, md5(regexp_replace(string_agg(transaction_note, '' ORDER BY seq), '[^0-9A-Za-z]', '', 'g')) AS hash FROM txn GROUP BY 1, 2")
def sca_54_page_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = worn(spark, sf_dir, "SELECT statement_id, page_number, seq, transaction_note FROM txn")
    rows = F.array_sort(F.collect_list(F.struct("seq", "transaction_note")))
    return t.groupBy("statement_id", "page_number").agg(F.md5(text.bare(F.array_join(F.transform(rows, lambda r: r["transaction_note"]), ""))).alias("hash"))


_ROWS = "SELECT seq, CASE seq % 4 WHEN 0 THEN 'Opening balance' WHEN 1 THEN 'Statement TOTAL' WHEN 2 THEN '' ELSE 'paid' END AS note, CASE seq % 3 WHEN 0 THEN '01/02/2021' WHEN 1 THEN '' ELSE 'x' END AS date_cell, CASE seq % 8 WHEN 0 THEN '(1,200.50)' WHEN 1 THEN 'D 75.25' WHEN 2 THEN '99.50 -' WHEN 3 THEN '-7' WHEN 4 THEN '8,000' WHEN 5 THEN '' WHEN 6 THEN 'n/a' END AS balance_cell FROM txn"


@query(
    f"""WITH g AS ({_ROWS}), a AS (SELECT *, seq % 8 IN (0, 3, 4) AS amount FROM g)
    SELECT seq, date_cell = '' AND NOT amount AND note <> '' AS continuation, date_cell LIKE '0%' AS has_date, amount AS has_balance, note = 'Opening balance' AS begins, note = 'Statement TOTAL' AS ends,
      CASE seq % 8 WHEN 0 THEN -1200.5 WHEN 1 THEN -75.25 WHEN 2 THEN -99.5 WHEN 3 THEN -7.0 WHEN 4 THEN 8000.0 END AS balance FROM a"""
)
def sca_61_bnk_7_row_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = cells.row_shape(F.col("note"), F.col("date_cell"), F.col("balance_cell"), ["opening"], ["total"])
    return worn(spark, sf_dir, _ROWS).select("seq", *[c.alias(n) for n, c in shapes.items()], cells.signed_balance(F.col("balance_cell")).alias("balance"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k":"' || (event_id % 100) || '"}' WHEN 1 THEN '{"k":"x","v":"7"}' END AS clean, CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0.4 END AS deviation, CASE WHEN event_id % 2 = 0 THEN 5.0 ELSE 3.0 END AS least, 5000.0 AS amount FROM events""",
    txn=False,
)
def sca_41_48_json_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    given = F.when(k % 3 == 0, F.concat(F.lit('{"k": " '), (k % 100).cast("string"), F.lit('", "v": "", "other": [1]}'))).when(k % 3 == 1, F.lit('{"v": 7, "k": "x  "}')).otherwise("not json")
    setting = F.when(k % 2 == 0, '{"standard_deviation_limit": 0.25, "min_salary_cnt_allowed": 5}').otherwise("null")
    got = cells.configured(setting, {"standard_deviation_limit": 0.4, "min_salary_cnt_allowed": 3, "min_salary_amount": 5000})
    return e.select("event_id", cells.without_empty(given, "k string, v string", ["k", "v"]).alias("clean"), got["standard_deviation_limit"].alias("deviation"), got["min_salary_cnt_allowed"].alias("least"), got["min_salary_amount"].alias("amount"))


_SHORT = "SELECT account_id, seq, date FROM txn"


@query("SELECT seq, strftime(date, '%Y-%m-%d') AS day FROM txn WHERE account_id % 2 = 0 OR true")
def sca_17_yearless_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a year take the year of the row before, one more where the day of the year falls back."""
    g = worn(spark, sf_dir, _SHORT)
    w = Window.partitionBy("account_id").orderBy("date", "seq")
    # every year's first row of an account has its year, the others only day and month
    first = F.coalesce(F.year("date") != F.lag(F.year("date")).over(w), F.lit(True))
    g = g.withColumn("first", first).withColumn("written", F.when(F.col("first"), F.date_format("date", "EEE MMM d yyyy")).otherwise(F.date_format("date", "EEE MMM d")))
    full = F.try_to_timestamp(F.substring("written", 5, 30), F.lit("MMM d yyyy"))
    leap = F.try_to_timestamp(F.concat(F.substring("written", 5, 30), F.lit(" 2020")), F.lit("MMM d yyyy"))
    g = g.withColumn("known", full).withColumn("part", F.coalesce("known", leap))
    g = g.withColumn("place", F.month("part") * 100 + F.dayofmonth("part"))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("base", F.last(F.year("known"), ignorenulls=True).over(up)).withColumn("anchor", F.count("known").over(up))
    inside = Window.partitionBy("account_id", "anchor").orderBy("date", "seq")
    g = g.withColumn("turn", F.coalesce((F.col("place") < F.lag("place").over(inside)).cast("int"), F.lit(0)))
    year = F.col("base") + F.sum("turn").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    day = F.concat_ws("-", year.cast("string"), F.date_format("part", "MM-dd"))
    return g.select("seq", day.alias("day"))
