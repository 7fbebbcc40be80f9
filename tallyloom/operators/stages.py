"""Enrichment stages as a graph: results are kept by key and input, and only what is stale is computed again.

A stage names its inputs, sources or other stages. For each key a stage's input hash is made
of the hashes of its inputs' rows of that key, whatever their order. Keys whose hash differs
from the one that their result was made from are stale; the stage runs on their rows alone. A
descendant sees the hash of the result, so a result that came out the same stops there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.model import written
from tallyloom.streaming.stores import KeyedStore

_STATE = T.StructType([T.StructField(n, t) for n, t in (("key", T.StringType()), ("input_hash", T.StringType()), ("output_hash", T.StringType()), ("made", T.LongType()))])


@dataclass(frozen=True)
class Stage:
    """run takes its inputs by name, all with the key's column, and gives rows with that column. version: part of every input hash."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[[Mapping[str, DataFrame]], DataFrame]
    version: str = "1"


def order_of(stages: Sequence[Stage], sources: Sequence[str]) -> list[Stage]:
    """The stages so that each comes after its inputs; an unknown input or a cycle is an error."""
    by_name = {s.name: s for s in stages}
    if len(by_name) < len(stages) or by_name.keys() & set(sources):
        raise ValueError("names of stages and sources must differ")
    missing = {i for s in stages for i in s.inputs} - by_name.keys() - set(sources)
    if missing:
        raise ValueError(f"no stage or source named {sorted(missing)}")
    graph = TopologicalSorter({s.name: [i for i in s.inputs if i in by_name] for s in stages})
    return [by_name[n] for n in graph.static_order()]


def _key(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\u0000")).alias("_key")


def row_hashes(df: DataFrame, key: str) -> DataFrame:
    """_key and hash: one hash for all rows of a key, the same in any order; added up before rows are shuffled.

    The upper and lower halves of the rows' hashes are added up apart, so that long sums hold them.
    """
    values = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(_key(key), F.xxhash64(*values, *[v.isNull() for v in values]).alias("_row"))
    sums = [F.sum(F.shiftright("_row", 32)), F.sum(F.col("_row").bitwiseAND(F.lit(0xFFFFFFFF))), F.count("*")]
    return rows.groupBy("_key").agg(F.concat_ws("/", *[s.cast("string") for s in sums]).alias("hash"))


class Enrichments:
    """root: a folder that driver and executors share. One account, entity, ... a key; its rows are never gathered in one place."""

    def __init__(self, spark: SparkSession, root: str, key: str, stages: Sequence[Stage], sources: Sequence[str], buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.order, self.sources = order_of(stages, sources), tuple(sources)

    def _states(self, stage: Stage) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.root}/{stage.name}/state", "key", _STATE, self.buckets)

    def _rows(self, stage: Stage, made: list[int], schema: T.StructType) -> DataFrame:
        """The stage's rows of all keys, each as it was last made."""
        stored = T.StructType([*schema.fields, T.StructField("_made", T.LongType())])
        rows = self.spark.read.schema(stored).parquet(*[f"{self.root}/{stage.name}/rows/made={m}" for m in made])
        if len(made) == 1:  # nothing was made again
            return rows.drop("_made")
        last = self._states(stage).read().select(F.col("key").alias("_last_key"), F.col("made").alias("_last"))
        return rows.withColumn("_key", _key(self.key)).join(last, (F.col("_key") == F.col("_last_key")) & (F.col("_made") == F.col("_last")), "left_semi").drop("_key", "_made")

    def refresh(self, sources: Mapping[str, DataFrame], run: int) -> tuple[dict[str, DataFrame], DataFrame]:
        """Bring all stages up to date with the sources: (results by stage, stage and key of what ran).

        run numbers ascend; a run that ended half-way is repeated under its number. Keys that
        left the sources lose their results.
        """
        held, hashes, ran = dict(sources), {n: written(row_hashes(df, self.key), "hashes") for n, df in sources.items()}, None
        results = {}
        for stage in self.order:
            given = None
            for name in stage.inputs:
                one = hashes[name].select("_key", F.col("hash").alias(f"_{name}"))
                given = one if given is None else given.join(one, "_key", "full")
            parts = [F.coalesce(F.col(f"_{n}"), F.lit("")) for n in stage.inputs]
            given = given.select("_key", F.md5(F.concat_ws("|", F.lit(stage.version), *parts)).alias("input_hash"))
            store = self._states(stage)
            known = store.read(before=run).select(F.col("key").alias("_known"), F.col("input_hash").alias("_was"))
            both = given.join(known, F.col("_key") == F.col("_known"), "full")
            stale = written(both.where(~F.coalesce(F.col("input_hash") == F.col("_was"), F.lit(False))).select(F.coalesce("_key", "_known").alias("_key"), "input_hash"), "stale")
            every = store.empty(before=run)  # the first time all keys are stale, so no row is left out
            mine = {n: held[n] if every else held[n].withColumn("_key", _key(self.key)).join(stale.select("_key"), "_key", "left_semi").drop("_key") for n in stage.inputs}
            made = stage.run(mine)
            made.withColumn("_made", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{self.root}/{stage.name}/rows/made={run}")
            fresh = row_hashes(self.spark.read.schema(made.schema).parquet(f"{self.root}/{stage.name}/rows/made={run}"), self.key)
            state = stale.join(fresh, "_key", "left").select(F.col("_key").alias("key"), F.coalesce("input_hash", F.lit("gone")).alias("input_hash"), F.coalesce("hash", F.lit("")).alias("output_hash"), F.lit(run).cast("long").alias("made"))
            store.write(state, run)
            numbers = store._numbers(f"{self.root}/{stage.name}/rows", "made=")
            held[stage.name] = results[stage.name] = self._rows(stage, [m for m in numbers if m <= run], made.schema)
            hashes[stage.name] = written(store.read().where("output_hash <> ''").select(F.col("key").alias("_key"), F.col("output_hash").alias("hash")), "hashes")
            here = stale.where("input_hash IS NOT NULL").select(F.lit(stage.name).alias("stage"), F.col("_key").alias("key"))
            ran = here if ran is None else ran.union(here)
        return results, ran
