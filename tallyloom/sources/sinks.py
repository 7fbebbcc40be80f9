"""Sinks: appended JSON, one message a row, XML, CSV by group, warehouse rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str, rows_per_file: int) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """key and value columns for a message sink: each row is its own message, so none grows too large."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def append_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Only the partitions that df has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def csv_by_group(df: DataFrame, path: str, group: str) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(group).csv(path)


def pages_json(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder for each key combination, down to the page."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


def as_xml(columns: Sequence[str]) -> Column:
    return F.to_xml(F.struct(*columns))


def warehouse(df: DataFrame, constants: Mapping[str, object], sentinel: Mapping[str, object]) -> DataFrame:
    """Rows with constant columns and NaN as null; a single sentinel row where there are none."""
    types = dict(df.dtypes)
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in types.items() if t in ("double", "float")})
    made = df.sparkSession.range(1).select(*[F.lit(sentinel.get(c)).cast(t).alias(c) for c, t in types.items()])
    only = made.where(df.limit(1).agg(F.count("*")).scalar() == 0)
    return clean.unionByName(only).withColumns({c: F.lit(v) for c, v in constants.items()})
