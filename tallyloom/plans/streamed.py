"""Queries that run Structured Streaming over arriving files and read what the streams wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.model import shared, table
from tallyloom.plans.registry import ORACLE_SQL, query
from tallyloom.sources import files
from tallyloom.streaming import consumers, streams
from tallyloom.streaming.stores import KeyedStore

_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def arrivals(spark: SparkSession, sf_dir: str, cuts: tuple[str, ...] = ("2024-01-16",)) -> str:
    """The events as JSON files that arrived one after the other, cut at these times."""
    out, low = shared(spark, "arrivals"), None
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("text"), "user_id", "event_type", "value")
    for cut in (*cuts, None):
        part = events.where((F.col("ts") >= low) if low else F.lit(True)).where((F.col("ts") < cut) if cut else F.lit(True))
        part.withColumn("ts", F.col("text")).drop("text").coalesce(1).write.mode("append").json(out)
        low = cut
    return out


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, and reads what it wrote."""
    spark, out = df.sparkSession, shared(df.sparkSession, "stream")
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", shared(spark, "checkpoint")).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _queue(spark: SparkSession, sf_dir: str, per_trigger: int = 1000, keep: bool = True) -> DataFrame:
    return files.queue(spark, arrivals(spark, sf_dir), _EVENT, per_trigger, keep)


@query("SELECT event_id, 'high' AS issue FROM events WHERE value > 60 UNION ALL SELECT event_id, 'error' FROM events WHERE event_type = 'error'", txn=False)
def str_5_6_routed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"high": F.col("value") > 60, "error": F.col("event_type") == "error"}
    return finished(streams.route(_queue(spark, sf_dir), rules).select("event_id", "issue"))


_CLOSED = "(SELECT max(ts) FROM events)"


@query(f"SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES <= {_CLOSED} - INTERVAL 60 MINUTES", txn=False)
def str_8_9_delayed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of 15 minutes, each written once 60 minutes have passed it."""
    return finished(streams.tumbling_counts(_queue(spark, sf_dir), "ts", "event_type", "15 minutes", "60 minutes"))


@query(
    f"""SELECT s AS start, event_type, count(*) AS n, CAST(round(100.0 * count(*) FILTER (value > 20) / count(*), 2) AS DOUBLE) AS rate FROM (SELECT *, unnest([time_bucket(INTERVAL 5 MINUTES, ts), time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 5 MINUTES, time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 10 MINUTES]) AS s FROM events)
    GROUP BY 1, 2 HAVING s + INTERVAL 15 MINUTES <= {_CLOSED} - INTERVAL 2 MINUTES""",
    txn=False,
)
def str_7_22_settled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 15 minutes, each written once 2 minutes have passed it."""
    found = streams.sliding_rate(_queue(spark, sf_dir), "ts", "event_type", F.col("value") > 20, "15 minutes", "5 minutes", "2 minutes")
    return finished(found).withColumn("rate", F.col("rate").cast("double"))


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOURS <= {_CLOSED} - INTERVAL 20 MINUTES""",
    txn=False,
)
def str_21_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(streams.sessions(_queue(spark, sf_dir), "ts", "user_id", "6 hours", "20 minutes"))


_INFO = [
    "user_id AS statement_id", "ts", "event_id", "CASE WHEN event_id % 4 = 0 THEN concat('h', event_id) END AS inconsistent_hash",
    "CASE WHEN user_id % 5 <> 0 THEN concat('p', CAST(floor(user_id / 2) AS BIGINT)) END AS pdf_hash", "CASE WHEN event_type = 'error' THEN 'aa' ELSE 'pdf' END AS attempt_type",
]


def _batch_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT statement_id, arg_max(inconsistent_hash, (ts, event_id)) FILTER (inconsistent_hash IS NOT NULL) AS h, arg_max_null(pdf_hash, (ts, event_id)) AS p, min((ts, event_id)) AS first_at FROM (SELECT {', '.join(_INFO)} FROM events) WHERE attempt_type <> 'aa' AND {where} GROUP BY 1)"


@query(
    f"""WITH {_batch_sql('a', "ts < '2024-01-16'")}, {_batch_sql('b', "ts >= '2024-01-16'")},
    a1 AS (SELECT statement_id, h, p FROM a QUALIFY p IS NULL OR row_number() OVER (PARTITION BY p ORDER BY first_at, statement_id) = 1),
    n AS (SELECT * FROM b WHERE statement_id NOT IN (SELECT statement_id FROM a1) AND (p IS NULL OR p NOT IN (SELECT p FROM a1 WHERE p IS NOT NULL))),
    n1 AS (SELECT statement_id, h, p FROM n QUALIFY p IS NULL OR row_number() OVER (PARTITION BY p ORDER BY first_at, statement_id) = 1)
    SELECT a1.statement_id, CASE WHEN b.statement_id IS NULL THEN a1.h ELSE b.h END AS inconsistent_hash, a1.p AS pdf_hash FROM a1 LEFT JOIN b USING (statement_id) UNION ALL SELECT * FROM n1""",
    txn=False,
)
def str_4_15_16_snk_10_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared(spark, "statements")
    rows = _queue(spark, sf_dir, per_trigger=1).selectExpr(*_INFO)
    write = rows.writeStream.foreachBatch(consumers.ingest(store, "statement_id", ["ts", "event_id"])).option("checkpointLocation", shared(spark, "checkpoint")).trigger(availableNow=True)
    write.start().awaitTermination()
    return spark.read.parquet(f"{store}/v{consumers.versions(spark, store)[-1]}")


@query(ORACLE_SQL["str_4_15_16_snk_10_ingest"], txn=False)
def str_4_15_16_keyed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over keyed stores, where a batch reads and writes the buckets of its own statements."""
    rows = _queue(spark, sf_dir, per_trigger=1).selectExpr(*_INFO)
    statements = KeyedStore(spark, shared(spark, "statements"), "statement_id", rows.select("statement_id", "inconsistent_hash", "pdf_hash").schema, buckets=16)
    documents = KeyedStore(spark, shared(spark, "documents"), "pdf_hash", rows.select("pdf_hash", "statement_id").schema, buckets=16)
    write = rows.writeStream.foreachBatch(consumers.ingest_keyed(statements, documents, ["ts", "event_id"])).option("checkpointLocation", shared(spark, "checkpoint")).trigger(availableNow=True)
    write.start().awaitTermination()
    return statements.read()


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1", txn=False)
def snk_9_13_latest_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, batch by batch; then the whole stream again under a new checkpoint, which changes nothing."""
    path = arrivals(spark, sf_dir)
    schema = files.queue(spark, path, _EVENT, 1).select("user_id", "event_id", "event_type").schema
    store, last = KeyedStore(spark, shared(spark, "latest"), "user_id", schema, buckets=8, merge_from=2), 0
    for first, per_trigger in ((0, 1), (1000, 1000)):
        rows = files.queue(spark, path, _EVENT, per_trigger).select("user_id", "event_id", "event_type")
        keep = consumers.latest_each(store, "event_id")
        later = lambda batch, epoch, first=first, keep=keep: keep(batch, first + epoch)
        rows.writeStream.foreachBatch(later).option("checkpointLocation", shared(spark, f"checkpoint{last}")).trigger(availableNow=True).start().awaitTermination()
        last += 1
    return store.read()


@query("SELECT user_id, count(*) AS seen FROM events GROUP BY 1 HAVING count(*) >= 8", txn=False)
def str_11_page_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _queue(spark, sf_dir).select("user_id", "ts", F.lit(8).alias("wanted"))
    return finished(streams.complete_when(wanted, "user_id", "wanted", "ts"))


@query(
    "WITH u AS (SELECT user_id % 20 AS entity, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT entity, count(*) AS statements, sum(n) AS seen FROM u GROUP BY 1 HAVING min(n) >= 1 + entity % 3", txn=False
)
def str_12_entity_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities all of whose statements have their pages; entity: users of one remainder."""
    members = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("entity")).agg(F.countDistinct("user_id").alias("members"))
    rows = _queue(spark, sf_dir).select((F.col("user_id") % 20).alias("entity"), "user_id", "ts", (1 + F.col("user_id") % 20 % 3).alias("pages"))
    return finished(consumers.all_complete(rows.join(F.broadcast(members), "entity"), "entity", "user_id", "pages", "members", "ts"))


@query("SELECT 'record' AS mode, event_id AS id, length(event_type) AS n FROM events UNION ALL SELECT 'batch ' || event_type, CAST(ts >= '2024-01-16' AS BIGINT), count(*) FROM events GROUP BY ALL", txn=False)
def str_1_2_udf_4_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream consumed message by message and another in batches, by handlers that names find."""
    records, batches = shared(spark, "records"), shared(spark, "batches")
    consumers.consume(_queue(spark, sf_dir), "tallyloom.streaming.consumers:with_size", records, shared(spark, "checkpoint"), batches=False)
    consumers.consume(_queue(spark, sf_dir, per_trigger=1), "tallyloom.streaming.consumers:by_type", batches, shared(spark, "checkpoint"), batches=True)
    one = spark.read.schema("event_id long, n int").parquet(records).select(F.lit("record").alias("mode"), F.col("event_id").alias("id"), F.col("n").cast("long").alias("n"))
    many = spark.read.schema("event_type string, n long, batch long").parquet(batches).select(F.concat(F.lit("batch "), "event_type").alias("mode"), F.col("batch").alias("id"), "n")
    return one.union(many)


@query("SELECT event_id, count(*) AS n FROM events GROUP BY 1", txn=False)
def str_13_guarded_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream is replayed from its start under a new checkpoint; each event is there once."""
    path, out = arrivals(spark, sf_dir), shared(spark, "guarded")
    for per_trigger in (1, 1000):
        rows = files.queue(spark, path, _EVENT, per_trigger).select("event_id")
        rows.writeStream.foreachBatch(consumers.guarded(out, "event_id")).option("checkpointLocation", shared(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, batch long").parquet(out).groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events", txn=False)
def src_25_27_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of JSON files read to its end; files that are done with are deleted."""
    return finished(_queue(spark, sf_dir, per_trigger=1, keep=False).select("event_id", "event_type"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-11' GROUP BY 1, 2", txn=False)
def str_18_daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's slice as a CSV with titled columns in their order, and the same rows appended to a table."""
    events = table(spark, sf_dir, "events").where((F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-11"))
    g = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    report, lake = shared(spark, "report"), shared(spark, "lake")
    g.select(F.col("day").alias("Report Day"), F.col("kind").alias("Event Kind"), F.col("n").alias("Row Count")).orderBy("Report Day", "Event Kind").coalesce(1).write.option("header", True).csv(report)
    g.write.mode("append").parquet(lake)
    back = spark.read.option("header", True).csv(report)
    return back.select(F.col("Report Day").alias("day"), F.col("Event Kind").alias("kind"), F.col("Row Count").cast("long").alias("n")).join(spark.read.parquet(lake), ["day", "kind", "n"])


@query(
    """WITH r AS (SELECT c_custkey, 'job' || c_nationkey % 3 AS job_id, CASE WHEN c_custkey % 7 = 0 THEN 'Internal Server Error' WHEN c_custkey % 5 = 0 THEN 'Matching customer_id does not exist' WHEN c_custkey % 3 = 0 THEN 'refused' END AS failure_reason FROM customer)
    SELECT c_custkey, failure_reason, failed, total FROM r JOIN (SELECT job_id, count(failure_reason) AS failed, count(*) AS total FROM r GROUP BY 1) USING (job_id)""",
    txn=False,
)
def str_19_bulk_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = shared(spark, "requests")
    given = c.select(F.concat(F.lit("job"), (F.col("c_nationkey") % 3).cast("string")).alias("job_id"), k.cast("string").alias("customer_id"), F.lit("c1").alias("consent_id"), F.when(k % 7 == 0, "soon").otherwise("2024-01-01").alias("start_date"), F.lit("2024-02-01").alias("end_date"))
    given.write.option("header", True).csv(path)
    sessions = c.where(k % 5 != 0).select(k.cast("string").alias("customer_id"), F.lit("c1").alias("consent_id"), F.when(k % 3 == 0, "refused").alias("error"))
    rows, jobs = consumers.bulk_pull(spark.read.option("header", True).csv(path), sessions)
    return rows.join(jobs, "job_id").select(F.col("customer_id").cast("long").alias("c_custkey"), "failure_reason", "failed", "total")
