"""A table of immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small shards. Compaction sorts the shards below the target size
into tiers of similar size, takes runs of neighbours whose sizes add up to the target, and
rewrites each run as one file. Nothing is changed in place: a manifest lists the shards of
a version, and a version is committed by renaming its finished manifest to a name that
must not exist yet. Readers keep the version they opened.

A shard has a place (seq) from its commit, its writing task and its file's number, so no
pass over all of the manifest is needed to number arrivals. The driver names live files, up
to LISTED of them, and beyond that folders, one for each commit: rows meet the manifest by
their file's path. expire() forgets old versions and removes the files that only they hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.runtime import cut, free, hadoop_path

#: Manifest entries (about 200 bytes each) up to which they are broadcast to the rows; beyond it the rows are shuffled to them.
BROADCAST_ENTRIES = 50_000
_ENTRY = "path string, bytes long, n_rows long, seq long"
#: A shard's place: its commit's number, then its writing task's, then its file's of that task.
_COMMIT, _TASK = 1 << 46, 1 << 24
#: The name that Spark gives a task's file: task, job's UUID (which may hold anything that looks like a counter), counter.
_NAME = r"/part-(\d+)-[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}-c(\d+)\.[^/]*$"
#: Live files up to which a read names each; beyond it folders are named, and rows of other files are dropped.
LISTED = 10_000


def place(path: str) -> Column:
    """The place of an appended file within its commit: its task's number, then its number among that task's files."""
    return F.regexp_extract(path, _NAME, 1).cast("long") * _TASK + F.regexp_extract(path, _NAME, 2).cast("long")


class CommitConflict(RuntimeError):
    """Another writer has committed this version first; nothing was published."""


class ShardedTable:
    """root: a folder that driver and executors share.

    tier_base: shards of tier t have sizes from unit * base^t. fan_in: a tier is merged
    once it has so many shards.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int, tier_base: int = 4, fan_in: int = 4, unit_bytes: int = 1 << 16):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self.base, self.fan_in, self.unit = tier_base, fan_in, unit_bytes

    def _versions(self) -> list[int]:
        fs, path = hadoop_path(self.spark, f"{self.root}/manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def version(self) -> int:
        """The latest committed version, 0 before the first."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, n_rows and seq (order of arrival) of each shard of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(f"{self.root}/manifest/v{version}")

    def _commit(self, entries: DataFrame, version: int) -> int:
        """Publish entries as a version; the rename fails if that version exists."""
        staged = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        entries.select("path", "bytes", "n_rows", "seq").repartitionByRange("seq").write.parquet(staged)
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        _, source = hadoop_path(self.spark, staged)
        _, target = hadoop_path(self.spark, f"{self.root}/manifest/v{version}")
        context = hadoop.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)
        except Exception as e:
            context.delete(source, True)
            if "exist" in str(e).lower():
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _written(self, folder: str) -> DataFrame:
        """path, bytes and n_rows of the files in a folder; counts come from the files' footers."""
        rows = self.spark.read.option("recursiveFileLookup", True).parquet(folder)
        meta = rows.metadataColumn("_metadata")
        files = rows.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes"))
        return files.groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n_rows"))

    def append(self, rows: DataFrame, rows_per_shard: int) -> int:
        """Write rows as new shards of at most rows_per_shard rows, and commit them.

        An empty frame adds no shard but a version. Columns may have any names but two that
        Spark tells apart only by case. Nulls, long values and repeated rows are kept as they are.
        """
        version = self.version()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", rows_per_shard).option("compression", "zstd").parquet(folder)
        new = self._written(folder).where(F.col("n_rows") > 0).withColumn("seq", (version + 1) * _COMMIT + place("path"))
        return self._commit(self.manifest(version).union(new.select("path", "bytes", "n_rows", "seq")), version + 1)

    def plan(self, version: int) -> DataFrame:
        """path, bytes, n_rows, seq, run and start of the shards that the next compaction merges.

        Works on the manifest alone, one small row for each shard. A run is a stretch of
        one tier, in order of arrival, whose bytes add up to about the target; start is the
        place of its first shard and names it. Sums over a tier are made in two steps, within
        stretches of the manifest and over the stretches, so that no task holds a whole tier.
        """
        tier = F.greatest(F.lit(0), F.floor(F.log(float(self.base), F.col("bytes") / self.unit))).cast("int")
        small = self.manifest(version).where(F.col("bytes") < self.target / 2).withColumn("tier", tier)
        small = cut(small.repartitionByRange("tier", "seq").withColumn("stretch", F.spark_partition_id()), "plan")
        sums = small.groupBy("tier", "stretch").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("shards"))
        whole = Window.partitionBy("tier")
        earlier = F.coalesce(F.sum("bytes").over(whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select("tier", "stretch", earlier.alias("earlier"), F.sum("shards").over(whole).alias("in_tier"))  # a row for each task and tier
        inside = Window.partitionBy("tier", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("bytes").over(inside), F.lit(0))
        ripe = small.withColumn("before", before).join(sums, ["tier", "stretch"]).where(F.col("in_tier") >= self.fan_in)
        placed = ripe.withColumn("part", F.floor((F.col("earlier") + F.col("before")) / self.target))
        runs = Window.partitionBy("tier", "part")  # about a target's bytes
        placed = placed.withColumn("members", F.count("*").over(runs)).withColumn("start", F.min("seq").over(runs))
        return placed.where(F.col("members") > 1).select("path", "bytes", "n_rows", "seq", F.concat_ws("-", "tier", "part").alias("run"), "start")

    def _rows(self, entries: DataFrame) -> tuple[DataFrame, str]:
        """The rows of the entries' files with a struct of path and row number, and that column's name."""
        named = [r[0] for r in entries.select("path").limit(LISTED + 1).collect()]
        if len(named) > LISTED:
            named = [r[0] for r in entries.select(F.regexp_extract("path", r"^(.*/data/[0-9a-f]{32})/", 1)).distinct().collect()]  # one for each commit
        rows = self.spark.read.option("recursiveFileLookup", True).parquet(*named)
        meta, at = rows.metadataColumn("_metadata"), free("_at", rows.columns)
        return rows.withColumn(at, F.struct(meta["file_path"].alias("path"), meta["row_index"].alias("row"))), at

    def compact_once(self) -> bool:
        """Merge the ripe tiers; False if there are none. Old shards stay for older versions.

        Rows of a merged file stand in the order of their arrival.
        """
        version = self.version()
        plan = cut(self.plan(version), "merges")
        shards, runs = plan.agg(F.count("*"), F.count_distinct("run")).first()
        if not shards:
            return False
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows, at = self._rows(plan)
        columns = [c for c in rows.columns if c != at]
        path, run, seq = free("_path", rows.columns), free("_run", rows.columns), free("_seq", rows.columns)
        number = free("_number", rows.columns)
        numbers = plan.select("run").distinct().withColumn("number", F.row_number().over(Window.orderBy("run")) - 1)  # a row for each file to make
        places = plan.join(numbers, "run").select(F.col("path").alias(path), F.col("run").alias(run), F.col("seq").alias(seq), F.col("number").alias(number))
        places = F.broadcast(places) if shards <= BROADCAST_ENTRIES else places
        placed = rows.join(places, F.col(f"{at}.path") == F.col(path))
        # the rows of a run make one file and one task: they are at most about the target
        dealt = placed.repartitionById(runs, F.col(number).cast("int")).sortWithinPartitions(run, seq, f"{at}.row")
        dealt.select(*[F.col(f"`{c}`") for c in columns], run).write.option("compression", "zstd").partitionBy(run).parquet(folder)
        first = plan.select("run", F.col("start").alias("seq")).distinct()
        made = self._written(folder).withColumn("run", F.regexp_extract("path", rf"/{run}=([^/]+)/", 1))
        new = made.join(first, "run").select("path", "bytes", "n_rows", "seq")
        kept = self.manifest(version).join(plan.select("path"), "path", "left_anti")
        self._commit(kept.select("path", "bytes", "n_rows", "seq").union(new), version + 1)
        return True

    def compact(self) -> int:
        """Compact until no tier is ripe; the number of passes is at most that of the tiers."""
        while self.compact_once():
            pass
        return self.version()

    def expire(self, keep: int = 1) -> int:
        """Forget all versions but the last `keep` and remove the files that only they hold; how many files went.

        Readers of a forgotten version fail from then on. Manifests go first, so a run that
        ends half-way leaves files that nothing names, never a version without its files; the next
        call does not see them. Paths pass the driver one part of the list at a time.
        """
        if keep < 1:
            raise ValueError("at least the last version is kept")
        versions = self._versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return 0
        every = [self.manifest(v).select("path") for v in old]
        gone = every[0]
        for more in every[1:]:
            gone = gone.union(more)
        live = self.manifest(kept[0]).select("path")
        for v in kept[1:]:
            live = live.union(self.manifest(v).select("path"))
        dead = cut(gone.distinct().join(live.distinct(), "path", "left_anti"), "dead")
        for v in old:
            fs, path = hadoop_path(self.spark, f"{self.root}/manifest/v{v}")
            fs.delete(path, True)
        n = 0
        for row in dead.toLocalIterator():
            fs, path = hadoop_path(self.spark, row["path"])
            n += bool(fs.delete(path, False))
        return n

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, all of them and no others.

        If all arrivals were empty, an empty frame of their columns; before the first arrival, an error.
        """
        if not self._versions():
            raise ValueError("the table has no shard yet")
        entries = self.manifest(version)
        n = entries.count()
        if not n:
            arrived = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/data")
            return self.spark.createDataFrame([], arrived.schema)
        if n <= LISTED:  # only live files are named, so every row of them counts
            return self.spark.read.option("recursiveFileLookup", True).parquet(*[r[0] for r in entries.select("path").collect()])
        rows, at = self._rows(entries)
        columns, path = [F.col(f"`{c}`") for c in rows.columns if c != at], free("_path", rows.columns)
        live = entries.select(F.col("path").alias(path))
        live = F.broadcast(live) if n <= BROADCAST_ENTRIES else live
        return rows.join(live, F.col(f"{at}.path") == F.col(path), "left_semi").select(*columns)
