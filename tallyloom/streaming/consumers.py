"""Consumers of message streams: handlers by name, batch and record modes, ingest with known hashes, barriers, guards."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.streaming.stores import KeyedStore

Batch = Callable[[DataFrame, int], None]


def handler(name: str) -> Callable:
    """The function that module:function names; anything else is an error."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function, None)
    if not callable(found):
        raise ValueError(f"{name} is no function")
    return found


def by_type(rows: DataFrame) -> DataFrame:
    """A handler of batches: how many messages of each type."""
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def with_size(rows: DataFrame) -> DataFrame:
    """A handler of records: each message with the length of its type."""
    return rows.select("event_id", F.length("event_type").alias("n"))


def consume(stream: DataFrame, name: str, out: str, checkpoint: str, batches: bool) -> None:
    """Runs a stream over what there is through the handler of this name.

    batches: the handler sees each micro-batch as a frame of its own, and its rows go to out
    under the batch's number; else it is a transformation of single records.
    """
    if not batches:
        writer = handler(name)(stream).writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        call = handler(name)
        writer = stream.writeStream.foreachBatch(lambda rows, epoch: call(rows).write.mode("overwrite").parquet(f"{out}/batch={epoch}"))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def guarded(out: str, key: str) -> Batch:
    """A foreachBatch function that appends each key once, whatever is replayed: keys already in out are left out.

    A batch repeated under its number replaces what it wrote before.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates([key])
        if _exists(spark, out):
            seen = spark.read.schema(rows.schema.add("batch", "long")).parquet(out).where(F.col("batch") != epoch)
            new = new.join(seen.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return write


def once_each(store: KeyedStore) -> Batch:
    """A foreachBatch function that keeps the first row of each key; a batch reads the buckets of its own keys only.

    A batch repeated under its number sees the store as it was before it.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        new = rows.dropDuplicates([store.key]).select(*store.schema.names).persist()
        mine = store.buckets_of(new)
        store.write(new.join(store.read(mine, before=epoch).select(store.key), store.key, "left_anti"), epoch)
        store.merge(epoch, mine)
        new.unpersist()

    return write


def latest_each(store: KeyedStore, order: str) -> Batch:
    """A foreachBatch function that keeps the row of each key with the greatest order, reading the buckets of the batch's keys only."""

    def write(rows: DataFrame, epoch: int) -> None:
        new = rows.groupBy(store.key).agg(F.max_by(F.struct(*store.schema.names), order).alias("r")).select("r.*").persist()
        mine = store.buckets_of(new)
        held = store.read(mine, before=epoch).select(F.col(store.key).alias("_k"), F.col(order).alias("_o"))
        later = new.join(held, F.col(store.key).eqNullSafe(F.col("_k")), "left").where(F.col("_o").isNull() | (F.col(order) > F.col("_o")))
        store.write(later.select(*store.schema.names), epoch)
        store.merge(epoch, mine)
        new.unpersist()

    return write


def ingest_keyed(statements: KeyedStore, documents: KeyedStore, order: list[str]) -> Batch:
    """As ingest, over two keyed stores: statements by their key, and the statement that each pdf_hash belongs to.

    A batch reads the buckets of its statements and of its documents, and writes what changed.
    """
    key = statements.key

    def write(rows: DataFrame, epoch: int) -> None:
        place = F.struct(*order)
        last_hash = F.max_by("inconsistent_hash", F.when(F.col("inconsistent_hash").isNotNull(), place))
        new = rows.where(F.coalesce(F.col("attempt_type") != "aa", F.lit(True))).groupBy(key).agg(last_hash.alias("inconsistent_hash"), F.max_by("pdf_hash", place).alias("pdf_hash"), F.min(place).alias("_at")).persist()
        mine = statements.buckets_of(new)
        papers = documents.buckets_of(new.where("pdf_hash IS NOT NULL"))
        known = statements.read(mine, before=epoch).select(F.col(key).alias("_k"), F.col("pdf_hash").alias("_p"))
        taken = documents.read(papers, before=epoch).select(F.col("pdf_hash").alias("_d"))
        met = new.join(known, F.col(key) == F.col("_k"), "left")
        old = met.where(F.col("_k").isNotNull()).select(key, "inconsistent_hash", F.col("_p").alias("pdf_hash"))
        fresh = met.where(F.col("_k").isNull()).join(taken, F.col("pdf_hash") == F.col("_d"), "left_anti")
        first = F.row_number().over(Window.partitionBy("pdf_hash").orderBy("_at", key))
        fresh = fresh.withColumn("_n", first).where(F.col("pdf_hash").isNull() | (F.col("_n") == 1)).select(key, "inconsistent_hash", "pdf_hash").persist()
        # the documents first: a batch that ends between the two writes starts over with both
        documents.write(fresh.where("pdf_hash IS NOT NULL").select("pdf_hash", key), epoch)
        statements.write(old.unionByName(fresh), epoch)
        statements.merge(epoch, mine)
        documents.merge(epoch, papers)
        new.unpersist()
        fresh.unpersist()

    return write


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, store: str) -> list[int]:
    """The finished versions of a store, in order."""
    fs, p = _fs(spark, store)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and _exists(spark, f"{store}/{n}/_SUCCESS"))


def ingest(store: str, key: str, order: list[str], keep: int = 2) -> Batch:
    """A foreachBatch function that keeps one row of each statement in versions of a Parquet table.

    Batches have key, order columns, inconsistent_hash, pdf_hash and attempt_type. Rows of
    attempt type aa are skipped. Of a batch a statement has its last row's pdf_hash and its last
    hash that is not null. A known statement takes the hash alone; a new one is
    rejected if its pdf_hash is known or an earlier one of the batch has it. A repeated batch
    writes the same version; all but the last versions are removed.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        spark, cols = rows.sparkSession, [key, "inconsistent_hash", "pdf_hash"]
        place = F.struct(*order)
        last_hash = F.max_by("inconsistent_hash", F.when(F.col("inconsistent_hash").isNotNull(), place))
        new = rows.where(F.coalesce(F.col("attempt_type") != "aa", F.lit(True))).groupBy(key).agg(last_hash.alias("inconsistent_hash"), F.max_by("pdf_hash", place).alias("pdf_hash"), F.min(place).alias("_at"))
        before = [v for v in versions(spark, store) if v < epoch]
        kept = spark.read.parquet(f"{store}/v{before[-1]}") if before else rows.select(*cols).limit(0)
        old = kept.join(new.select(key, F.col("inconsistent_hash").alias("_h"), F.lit(True).alias("_met")), key, "left")
        old = old.select(key, F.when(F.coalesce("_met", F.lit(False)), F.col("_h")).otherwise(F.col("inconsistent_hash")).alias("inconsistent_hash"), "pdf_hash")
        fresh = new.join(kept.select(key), key, "left_anti").join(kept.select("pdf_hash").where("pdf_hash IS NOT NULL").distinct(), "pdf_hash", "left_anti")
        first = F.row_number().over(Window.partitionBy("pdf_hash").orderBy("_at", key))
        fresh = fresh.withColumn("_n", first).where(F.col("pdf_hash").isNull() | (F.col("_n") == 1)).select(*cols)
        old.unionByName(fresh).write.mode("overwrite").parquet(f"{store}/v{epoch}")
        for v in versions(spark, store)[:-keep]:
            fs, p = _fs(spark, f"{store}/v{v}")
            fs.delete(p, True)

    return write


def all_complete(df: DataFrame, entity: str, member: str, pages: str, members: str, ts: str, late: str = "1 day", idle: int = 86_400_000) -> DataFrame:
    """entity, statements, seen: once, when each of an entity's members has as many rows as it says.

    pages: how many rows a member has; members: how many members the entity has. The state
    is a count for each member; it goes when the entity is complete or idle so many milliseconds of event time.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        if held is None:  # fired before
            return
        goal = 0
        for frame in frames:
            goal = int(frame[members].iloc[-1])
            for name, rows in frame.groupby(member):
                seen = held.get(str(name), [0, 0])
                held[str(name)] = [seen[0] + len(rows), int(rows[pages].iloc[-1])]
        done = len(held) >= goal > 0 and all(n >= wanted for n, wanted in held.values())
        state.update((json.dumps(None if done else held),))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle)
        if done:
            yield pd.DataFrame({entity: [key[0]], "statements": [len(held)], "seen": [sum(n for n, _ in held.values())]})

    kind = dict(df.dtypes)[entity]
    return df.withWatermark(ts, late).groupBy(entity).applyInPandasWithState(count, f"{entity} {kind}, statements long, seen long", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def bulk_pull(requests: DataFrame, sessions: DataFrame, jobs: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Rows of a request file with their outcome, and for each job how many are done of how many.

    A request whose dates cannot be read, whose customer has no session, or whose session is
    refused fails, with the reason; the others are started.
    """
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    met = requests.join(sessions.select("customer_id", "consent_id", F.col("error").alias("_error"), F.lit(True).alias("_known")).dropDuplicates(["customer_id", "consent_id"]), ["customer_id", "consent_id"], "left")
    reason = F.when(day("start_date").isNull() | day("end_date").isNull(), "Internal Server Error").when(F.col("_known").isNull(), "Matching customer_id does not exist").otherwise(F.col("_error"))
    out = met.withColumn("failure_reason", reason).drop("_error", "_known")
    return out, out.groupBy(jobs).agg(F.count_if(F.col("failure_reason").isNotNull()).alias("failed"), F.count("*").alias("total"))
