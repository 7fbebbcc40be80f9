"""Sources: JSON pages, CSV statements with a header to find, XML reports, feeds, key lookups."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements of a page's JSON array.
PAGE_ROWS = "array<struct<transaction_type:string,transaction_note:string,chq_num:string,amount:double,balance:double,date:string>>"


def by_key(spark: SparkSession, path: str, keys: Mapping[str, object]) -> DataFrame:
    """Rows of a Parquet table with these key values; the conditions reach the scan."""
    df = spark.read.parquet(path)
    for column, value in keys.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def page_rows(pages: DataFrame, last_page: int | None = None) -> DataFrame:
    """Rows of pages (statement_id, page_number, item_data), each with its place on the page.

    Unreadable JSON gives no rows; pages past last_page are left out.
    """
    if last_page is not None:
        pages = pages.where(F.col("page_number") <= last_page)
    items = F.posexplode(F.from_json("item_data", PAGE_ROWS)).alias("sequence_number", "row")
    return pages.select("statement_id", "page_number", items).select("statement_id", "page_number", "sequence_number", "row.*")


def statement_csv(spark: SparkSession, path: str, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """CSV with lines before its header: a file's header is its first line that names every role.

    roles: output column -> names that a header may use (any case). Lines up to a file's header
    and repeats of it are left out, and lines without any role's cell; all others stay. A file without a
    header, such as a later part, is read whole. The first file's header says which column has which role.
    """
    raw = spark.read.option("header", False).csv(path)
    columns, meta = raw.columns, raw.metadataColumn("_metadata")
    cells = F.array(*[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in columns])
    is_header = F.lit(True)
    for names in roles.values():
        is_header = is_header & F.arrays_overlap(cells, F.array(*[F.lit(n.lower()) for n in names]))
    place = F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = raw.withColumns({"_file": meta["file_path"], "_place": place, "_cells": cells, "_header": is_header})
    heads = lines.where("_header").groupBy("_file").agg(F.min(F.struct("_place", "_cells")).alias("h")).select("_file", F.col("h._place").alias("_from"), F.col("h._cells").alias("_names"))
    head = heads.agg(F.min_by("_names", "_file").alias("h")).first()["h"]
    if head is None:
        raise ValueError("no line names every role")
    at = {role: next(i for i, c in enumerate(head) if c in {n.lower() for n in names}) for role, names in roles.items()}
    body = lines.where(~F.col("_header")).join(heads.select("_file", "_from"), "_file", "left").where(F.col("_from").isNull() | (F.col("_place") > F.col("_from")))
    picked = body.select(*[F.nullif(F.trim(F.col(columns[i])), F.lit("")).alias(role) for role, i in at.items()])
    return picked.where(F.coalesce(*[F.col(r) for r in roles]).isNotNull())


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """An account feed: balance and time under either of two names, types in lower case."""
    raw = spark.read.schema("type string, amount string, balance string, currentBalance string, transactionTimestamp string, transactionDateTime string, narration string").json(path)
    number = lambda *names: F.coalesce(*[F.col(n).try_cast("double") for n in names])
    return raw.select(
        F.lower("type").alias("transaction_type"),
        F.abs(number("amount")).alias("amount"),
        number("currentBalance", "balance").alias("balance"),
        F.try_to_timestamp(F.coalesce("transactionTimestamp", "transactionDateTime")).alias("date"),
        F.col("narration").alias("transaction_note"),
    )


def cells_to_rows(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells (page, row, column, text) as one row for each table row."""
    return cells.groupBy("page", "row").pivot("column", list(columns)).agg(F.first("text"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Template files: {kind: [{bbox, regex, ...}]} as one row for each template."""
    raw = spark.read.option("wholetext", True).text(path)
    kinds = F.from_json("value", "map<string, array<struct<uuid:string, regex:string, bbox:array<double>>>>")
    entry = raw.select(F.explode(kinds).alias("kind", "list"))
    return entry.select("kind", F.explode("list").alias("t")).select("kind", "t.*")


def rows(spark: SparkSession, values: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def parameterised(spark: SparkSession, sql: str, frames: Mapping[str, DataFrame], **values: object) -> DataFrame:
    """SQL with named parameters over frames; values never become part of the text."""
    names = {}
    for name, frame in frames.items():
        names[name] = f"{name}_{uuid.uuid4().hex[:8]}"
        frame.createOrReplaceTempView(names[name])
        sql = sql.replace("{" + name + "}", names[name])
    return spark.sql(sql, args=dict(values))


def queue(spark: SparkSession, path: str, schema: str, files_per_trigger: int, keep: bool = True) -> DataFrame:
    """JSON files as a stream; read files are deleted unless kept."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader if keep else reader.option("cleanSource", "delete")).json(path)


def kafka(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """JSON messages of a topic from its start; the checkpoint keeps the offsets."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def checked(c: Column, schema: str) -> Column:
    """A message parsed by a schema; unreadable ones keep their text in _corrupt_record."""
    return F.from_json(c, schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
