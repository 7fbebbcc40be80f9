"""A keyed table as bucketed delta files, merged on read, so that a micro-batch touches only its own buckets.

A batch writes the new rows of its keys to deltas/epoch=N/bucket=B: nothing that was there
is read or written again, and a batch repeated under its number replaces its own files. A
reader takes, bucket by bucket, the merged base and the deltas after it, and of each key the row
that comes last. A bucket with many deltas is merged on its own: the new base is complete
before its marker is, and readers without the marker still see the base and deltas before.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedStore:
    """root: a folder that driver and executors share. key names the rows; schema is that of the rows, without epoch and bucket.

    buckets is fixed when the store is made and bounds what the driver lists; merge_from: deltas of a bucket from which it is merged.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema: T.StructType, buckets: int = 64, merge_from: int = 8):
        self.spark, self.root, self.key, self.buckets, self.merge_from = spark, root.rstrip("/"), key, buckets, merge_from
        self.schema = T.StructType([f for f in schema.fields if f.name not in ("epoch", "bucket")])
        self.stored = T.StructType([*self.schema.fields, T.StructField("_epoch", T.LongType())])

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self, path: str, mark: str) -> list[int]:
        return sorted(int(n[len(mark) :]) for n in self._names(path) if n.startswith(mark))

    def with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that hold these keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in self.with_bucket(keys.select(self.key)).select("bucket").distinct().collect())

    def _layers(self, buckets: Iterable[int], before: int | None) -> dict[int, tuple[int | None, list[int]]]:
        """For each bucket the epoch up to which its base is merged, and the epochs of its later deltas below `before`."""
        # markers are base/bucket=B/upto=N/_SUCCESS; a delta is deltas/epoch=N/bucket=B
        deltas = {e: self._numbers(f"{self.root}/deltas/epoch={e}", "bucket=") for e in self._numbers(f"{self.root}/deltas", "epoch=") if before is None or e < before}
        out = {}
        for b in buckets:
            bases = [n for n in self._numbers(f"{self.root}/base/bucket={b}", "upto=") if (before is None or n < before) and "_SUCCESS" in self._names(f"{self.root}/base/bucket={b}/upto={n}")]
            upto = max(bases, default=None)
            out[b] = upto, [e for e, held in deltas.items() if b in held and (upto is None or e > upto)]
        return out

    def empty(self, before: int | None = None) -> bool:
        """Whether no rows are stored; before: as it was ahead of that epoch."""
        return not any(epochs or upto is not None for upto, epochs in self._layers(range(self.buckets), before).values())

    def read(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The last row of each key, of all buckets or of these; before: as it was ahead of that epoch."""
        layers = self._layers(range(self.buckets) if buckets is None else buckets, before)
        paths = [f"{self.root}/base/bucket={b}/upto={upto}" for b, (upto, _) in layers.items() if upto is not None]
        paths += [f"{self.root}/deltas/epoch={e}/bucket={b}" for b, (_, epochs) in layers.items() for e in epochs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).parquet(*paths)
        if all((upto is not None) + len(epochs) <= 1 for upto, epochs in layers.values()):  # one row a key as they stand
            return rows.select(*self.schema.names)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in self.schema.names if c != self.key]), "_epoch").alias("_row"))
        return last.select(*[F.col(c) if c == self.key else F.col(f"_row.{c}").alias(c) for c in self.schema.names])

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Rows, one a key, become the last of their keys; repeated under its epoch the same rows replace themselves."""
        out = self.with_bucket(rows.select(*self.schema.names)).withColumn("_epoch", F.lit(epoch).cast("long"))
        out.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/deltas/epoch={epoch}")

    def merge(self, epoch: int, buckets: Iterable[int]) -> list[int]:
        """Merge those of the buckets that have merge_from deltas or more up to this epoch; which they were.

        A merged bucket keeps the base before it, so that a batch that starts over still finds what it saw; older files go.
        """
        done = []
        for b, (_, epochs) in self._layers(buckets, epoch + 1).items():
            if len(epochs) < self.merge_from:
                continue
            target = f"{self.root}/base/bucket={b}/upto={epoch}"
            self.read([b], epoch + 1).withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(target)
            bases = self._numbers(f"{self.root}/base/bucket={b}", "upto=")
            keep = max((n for n in bases if n < epoch), default=None)
            gone = [f"{self.root}/base/bucket={b}/upto={n}" for n in bases if keep is not None and n < keep]
            gone += [f"{self.root}/deltas/epoch={e}/bucket={b}" for e in self._numbers(f"{self.root}/deltas", "epoch=") if keep is not None and e <= keep]
            for path in gone:
                fs, p = self._fs(path)
                fs.delete(p, True)
            done.append(b)
        return done

    def finished(self, epoch: int) -> bool:
        """Whether a batch has been written."""
        return "_SUCCESS" in self._names(f"{self.root}/deltas/epoch={epoch}")
