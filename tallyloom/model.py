"""The transaction model: one declared schema, and a view of it over the star-schema tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical columns of a transaction; order within an account is (date, seq).
TRANSACTION = T.StructType(
    [
        T.StructField("account_id", T.LongType()),
        T.StructField("statement_id", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("balance", T.DoubleType()),
        T.StructField("transaction_note", T.StringType()),
        T.StructField("transaction_channel", T.StringType()),
        T.StructField("bank_name", T.StringType()),
    ]
)

#: Channel of each order priority in the view.
CHANNELS = {"1-URGENT": "upi", "2-HIGH": "net_banking_transfer", "3-MEDIUM": "cash_withdrawl", "4-NOT SPECIFIED": "chq", "5-LOW": "Other"}


_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, label: str) -> str:
    """A new path in the folder that executors share (spark.checkpoint.dir).

    Where none is set a local master has a folder of its own; on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    folder = f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return f"{folder}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: the plan behind it ends there, and a lost executor costs only its running tasks."""
    path = shared(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    """Shared folders go when the driver ends."""
    for spark, folder in _made:
        with contextlib.suppress(Exception):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_account() -> Window:
    """Rows of an account in their order."""
    return Window.partitionBy("account_id").orderBy("date", "seq")


def signed() -> F.Column:
    """The amount, negative for debits."""
    return F.when(F.col("transaction_type") == "debit", -F.col("amount")).otherwise(F.col("amount"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as account transactions: final orders are debits, balances run from the customer's."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    channel = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])[F.col("o_orderpriority")]
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("account_id"),
        F.concat_ws("-", F.col("o_custkey"), F.year("o_orderdate")).alias("statement_id"),
        F.month("o_orderdate").alias("page_number"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "debit").otherwise("credit").alias("transaction_type"),
        F.col("o_totalprice").alias("amount"),
        F.concat_ws("/", F.upper(channel), F.col("c_name"), F.col("o_orderkey")).alias("transaction_note"),
        channel.alias("transaction_channel"),
        F.col("c_mktsegment").alias("bank_name"),
        "c_acctbal",
    )
    running = F.sum(signed()).over(by_account().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("balance", F.round(F.col("c_acctbal") + running, 2)).select(*TRANSACTION.fieldNames())


#: The same view in SQL, as the first table of a WITH list.
TXN_SQL = """txn AS (
  SELECT account_id, statement_id, page_number, seq, date, transaction_type, amount,
         round(c_acctbal + sum(CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END) OVER (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING), 2) AS balance,
         transaction_note, transaction_channel, bank_name
  FROM (
    SELECT o_custkey AS account_id, o_custkey || '-' || year(o_orderdate) AS statement_id, CAST(month(o_orderdate) AS INTEGER) AS page_number, o_orderkey AS seq, o_orderdate AS date,
           CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS transaction_type, o_totalprice AS amount,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'upi' WHEN '2-HIGH' THEN 'net_banking_transfer' WHEN '3-MEDIUM' THEN 'cash_withdrawl' WHEN '4-NOT SPECIFIED' THEN 'chq' ELSE 'Other' END AS transaction_channel,
           upper(CASE o_orderpriority WHEN '1-URGENT' THEN 'upi' WHEN '2-HIGH' THEN 'net_banking_transfer' WHEN '3-MEDIUM' THEN 'cash_withdrawl' WHEN '4-NOT SPECIFIED' THEN 'chq' ELSE 'Other' END) || '/' || c_name || '/' || o_orderkey AS transaction_note,
           c_mktsegment AS bank_name, c_acctbal
    FROM orders JOIN customer ON o_custkey = c_custkey
  )
)"""
