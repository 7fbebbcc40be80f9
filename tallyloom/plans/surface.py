"""Queries of the sources, sinks, streams, similarity and of the table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.model import shared, table, transactions
from tallyloom.operators import similarity
from tallyloom.plans.registry import QUERIES, query
from tallyloom.sources import files, sinks
from tallyloom.streaming import streams


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7", txn=False)
def src_1_3_6_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.by_key(spark, f"{sf_dir}/orders.parquet", {"o_custkey": 7}).select("o_orderkey", "o_orderstatus")


@query("SELECT statement_id, page_number, CAST(row_number() OVER (PARTITION BY statement_id, page_number ORDER BY seq) - 1 AS INTEGER) AS sequence_number, transaction_type, amount FROM txn")
def src_2_4_5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("seq", "transaction_type", "transaction_note", "amount", "balance", F.col("date").cast("string").alias("date"))
    pages = transactions(spark, sf_dir).groupBy("statement_id", "page_number").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("item_data"))
    return files.page_rows(pages).select("statement_id", "page_number", "sequence_number", "transaction_type", "amount")


@query("SELECT n_nationkey, n_name FROM nation", txn=False)
def src_7_snk_1_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared(spark, "json")
    sinks.append_json(table(spark, sf_dir, "nation"), out, 10)
    return spark.read.schema("n_nationkey int, n_name string").json(out)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part", txn=False)
def src_8_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared(spark, "csv")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("Part No"), F.col("p_brand").alias("Brand"), F.col("p_size").cast("string").alias("Size (mm)"))
    part.write.option("header", True).csv(out)
    return files.statement_csv(spark, out, {"id": ["part no", "id"], "brand": ["brand"], "size": ["size", "size (mm)"]})


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS transaction_type, o_totalprice AS amount FROM orders", txn=False)
def src_17_18_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared(spark, "feed")
    kind = F.when(F.col("o_orderstatus") == "F", "DEBIT").otherwise("Credit")
    table(spark, sf_dir, "orders").select(kind.alias("type"), F.col("o_totalprice").cast("string").alias("amount"), F.col("o_orderkey").cast("string").alias("narration"), F.lit("1.0").alias("balance")).write.json(out)
    return files.feed(spark, out).select(F.col("transaction_note").cast("long").alias("id"), "transaction_type", "amount")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier", txn=False)
def src_19_20_snk_14_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared(spark, "xml")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format("xml").option("rowTag", "supplier").option("rootTag", "suppliers").save(out)
    return files.xml_rows(spark, out, "supplier", "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT CAST(n_regionkey AS BIGINT) AS page, CAST(n_nationkey AS BIGINT) AS row, n_name AS name, CAST(n_nationkey * 2 AS VARCHAR) AS double FROM nation", txn=False)
def src_21_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("page"), F.col("n_nationkey").cast("long").alias("row"), "n_name", "n_nationkey")
    cells = n.select("page", "row", F.lit("name").alias("column"), F.col("n_name").alias("text")).union(n.select("page", "row", F.lit("double"), (F.col("n_nationkey") * 2).cast("string")))
    return files.cells_to_rows(cells, ["name", "double"])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 490000 AND o_orderpriority = '1-URGENT'", txn=False)
def src_23_24_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parameterised(spark, "SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderpriority = :priority", {"orders": table(spark, sf_dir, "orders")}, least=490000, priority="1-URGENT")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region", txn=False)
def snk_2_3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.messages(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")


@query("SELECT event_id, value, 'nightly' AS job FROM events WHERE value > 0", txn=False)
def snk_4_11_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.warehouse(table(spark, sf_dir, "events").where("value > 0").select("event_id", "value"), {"job": "nightly"}, {"event_id": -1})


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, and reads what it wrote."""
    spark, out = df.sparkSession, shared(df.sparkSession, "stream")
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", shared(spark, "checkpoint")).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("SELECT event_id, 'high' AS issue FROM events WHERE value > 60 UNION ALL SELECT event_id, 'error' FROM events WHERE event_type = 'error'", txn=False)
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rules = {"high": F.col("value") > 60, "error": F.col("event_type") == "error"}
    return streams.route(events, rules).select("event_id", "issue")


@query("SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", txn=False)
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling_counts(table(spark, sf_dir, "events"), "ts", "event_type", "15 minutes", "60 minutes")


@query("SELECT s AS start, event_type, count(*) AS n, round(100.0 * count(*) FILTER (value > 20) / count(*), 2) AS rate FROM (SELECT *, unnest([time_bucket(INTERVAL 5 MINUTES, ts), time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 5 MINUTES, time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 10 MINUTES]) AS s FROM events) GROUP BY 1, 2", txn=False)
def sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding_rate(table(spark, sf_dir, "events"), "ts", "event_type", F.col("value") > 20, "15 minutes", "5 minutes", "2 minutes").withColumn("rate", F.col("rate").cast("double"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", count(*) AS n FROM s GROUP BY user_id, k", txn=False)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours", "20 minutes")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1", txn=False)
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = shared(spark, "latest")
    merge = streams.latest_by_key(out, "user_id", "ts")
    merge(events.where("ts < '2024-01-16'"), 0)
    merge(events.where("ts >= '2024-01-16'"), 1)
    return spark.read.parquet(f"{out}/v1")


@query("SELECT user_id, 50 AS seen FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) WHERE n >= 50", txn=False)
def page_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _stream(spark, sf_dir).select("user_id", "ts", F.lit(50).alias("wanted"))
    return _finished(streams.complete_when(wanted, "user_id", "wanted", "ts")).select("user_id", F.least("seen", F.lit(50)).cast("int").alias("seen"))


@query("SELECT event_id FROM events", txn=False)
def str_14_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(streams.once(_stream(spark, sf_dir), "ts", "event_id", "1 hour").select("event_id"))


@query(
    """WITH s AS (SELECT p_partkey, p_brand, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS s FROM part)
    SELECT x.p_partkey AS a, y.p_partkey AS b, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) AS similarity FROM s x JOIN s y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey
    WHERE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.6""",
    txn=False,
)
def clu_1_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.similar_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", 0.6, "p_brand")
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def clu_1_minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.minhash_pairs(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 0.6)


@query()
def clu_8_text_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(spark, sf_dir).select("seq", "bank_name", "transaction_type", "transaction_note")
    return similarity.text_clusters(rows, "transaction_note", 10, ["bank_name", "transaction_type"]).select("seq", "cluster")


@query("SELECT event_id, CAST(CASE WHEN value < 10 THEN 0 WHEN value < 30 THEN 1 ELSE 2 END AS DOUBLE) AS bin FROM events", txn=False)
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.binned(table(spark, sf_dir, "events").select("event_id", "value"), "value", [10.0, 30.0]).select("event_id", "bin")


@query("SELECT seq, regexp_extract(transaction_note, '^([A-Z_]+)/Customer#0*([0-9]+)/', 1) AS channel, regexp_extract(transaction_note, '^([A-Z_]+)/Customer#0*([0-9]+)/', 2) AS customer FROM txn")
def udf_5_capture_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"channel": 1, "customer": 2}
    return transactions(spark, sf_dir).select("seq", *[F.regexp_extract("transaction_note", "^([A-Z_]+)/Customer#0*([0-9]+)/", g).alias(c) for c, g in groups.items()])


@query("SELECT n_nationkey, i AS place, substr(n_name, i, 1) AS letter FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)", txn=False)
def udf_3_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.filter(F.split("n_name", ""), lambda c: c != "")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(letters).alias("p", "letter")).select("n_nationkey", (F.col("p") + 1).cast("long").alias("place"), "letter")


def access(spark: SparkSession, sf_dir: str, verb: str) -> DataFrame:
    """A read by its verb: the registered query of that name; an unknown verb is an error."""
    if verb not in QUERIES:
        raise KeyError(f"no query named {verb}")
    return QUERIES[verb](spark, sf_dir)
