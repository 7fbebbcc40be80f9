"""Shared helpers of the training-data operators: where tables are cut, and how."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: With it, the files of a query's shuffles go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent on one machine (a local master, as in tests) a folder
    of our own is used; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tallyloom/{uuid.uuid4().hex}-{label}"
    _made.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)
    if (spark, path) in _made:
        _made.remove((spark, path))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    The plan behind it ends there: later stages reread files that every executor
    sees, so a lost executor costs only its running tasks.
    """
    return cut_at(df, label)[0]


def cut_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As cut, with the path, so that a table which nothing reads any more can be removed.

    The shuffles behind the table go once it is written, as nothing reads them again; else
    they stay on disk until the driver's next garbage collection.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def free(name: str, *taken: list[str]) -> str:
    """A column name like this one that no list holds, whatever the case."""
    held = {c.lower() for cs in taken for c in cs}
    while name.lower() in held:
        name += "_"
    return name


@atexit.register
def _clean() -> None:
    for spark, path in list(_made):
        with contextlib.suppress(Exception):
            remove(spark, path)
