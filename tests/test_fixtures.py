"""Small fixtures of the repairs, classifiers, stores and sources: edges that whole tables do not show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import cells
from tallyloom.operators import accounts, channels, repairs, reports, scorecards
from tallyloom.sources import files
from tallyloom.streaming import consumers


def test_csv_head_far_down_and_rows_without_the_last_cell(spark, tmp_path):
    lines = ["Statement,,", *[f"line {i},," for i in range(300)], "Date,Narration,Amount", "01/01/2024,first,10", "02/01/2024,no amount,", ",,", "Date,Narration,Amount", "03/01/2024,last,30"]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    got = files.statement_csv(spark, f"{tmp_path}/s.csv", {"date": ["date"], "note": ["narration"], "amount": ["amount"]}).collect()
    assert sorted((r["date"], r["note"], r["amount"]) for r in got) == [("01/01/2024", "first", "10"), ("02/01/2024", "no amount", None), ("03/01/2024", "last", "30")]


def test_type_repair_gives_rows_back_after_many_turned_signs(spark):
    rows = [(1, i, "credit", 10.0, 10.0 * (i + 1) * (-1 if i % 2 else 1)) for i in range(8)] + [(2, i, "debit" if i == 2 else "credit", -5.0 if i == 1 else 5.0, 5.0 * (i + 1)) for i in range(4)] + [(3, 0, None, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "account_id long, seq long, transaction_type string, amount double, balance double")
    got = {(r["account_id"], r["seq"]): r for r in repairs.repair_types(t, "account_id", ["seq"]).collect()}
    assert len(got) == len(rows)
    assert all(got[1, i]["type"] == "credit" and got[1, i]["sum"] == rows[i][4] and not got[1, i]["optimizations"] for i in range(8))
    assert [got[2, i]["type"] for i in range(4)] == ["credit"] * 4 and got[2, 1]["value"] == 5.0
    assert got[2, 1]["optimizations"] == ["AMOUNT_MADE_POSITIVE"] and got[2, 2]["optimizations"] == ["TRANSACTION_TYPE_CHANGED"]
    assert repairs.repair_types(t.limit(0), "account_id", ["seq"]).count() == 0


def test_names_marks_and_dates(spark):
    names = [("Mr. Ann Lee S/O Bob Lee",), ("THE BANK OF INDIA",), ("dr md 77",), (None,), ("x care of y",)]
    got = [r[0] for r in spark.createDataFrame(names, "n string").select(channels.clean_name(F.col("n"))).collect()]
    assert got == ["ann lee", "None", "md", None, "x"]
    notes = [("SALARY MAY",), ("ADVANCE SALARY",), ("SAL-7",), ("X SAL",), ("SALES",), ("",)]
    got = [r[0] for r in spark.createDataFrame(notes, "n string").select(channels.salary_mark(F.col("n"), ["ADVANCE"])).collect()]
    assert got == ["SALARY", None, "^SAL", "SAL$", None, None]
    dates = [("3 jan 1999",), ("03-JAN-99",), ("Mon, Jan 3 2000",), ("1/2/69",), ("1/2/68",), ("31 Feb 2020",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(dates, "d string").select(cells.any_date(F.col("d")).cast("string")).collect()]
    assert got == ["1999-01-03", "1999-01-03", "2000-01-03", "1969-02-01", "2068-02-01", None, None, None]
    assert cells.patterns(["re.compile('a+')", "b(", "c"]) == (["a+", "c"], ["b("])


def test_results_are_kept_by_input(spark):
    calls: list[int] = []

    def classify(df):
        calls.append(df.count())
        return df.withColumn("label", F.upper("note"))

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, None)], "id long, note string")
    none = spark.createDataFrame([], "input_hash string, label string")
    first, known = channels.classified_once(rows, none, ["note"], classify, ["label"])
    assert sorted((r["id"], r["label"]) for r in first.collect()) == [(1, "A"), (2, "A"), (3, None), (4, "B"), (5, None)] and calls[0] == 3
    again, new = channels.classified_once(rows, known, ["note"], classify, ["label"])
    assert calls[1] == 0 and new.count() == 0 and {r["from_cache"] for r in again.collect()} == {True}


def test_answers_that_lack_a_row_fail(spark):
    rows = spark.createDataFrame([("h1", "n", 1, "x"), ("h2", "n", 2, "y")], "hash string, note string, place int, category string")
    answer = rows.withColumn("category", F.lit("new"))
    assert {r["category"] for r in reports.merged_answer(rows, answer, ["hash", "note"], "place").collect()} == {"new"}
    with pytest.raises(Exception, match="missing from the answer"):
        reports.merged_answer(rows, answer.where("hash = 'h1'"), ["hash", "note"], "place").collect()


def test_missing_days_of_long_and_overlapping_ranges(spark):
    asked = spark.sql("SELECT k, to_date('1900-01-15') AS low, to_date('2199-12-20') AS high FROM VALUES (1), (2), (null) t(k)")
    covered = spark.sql("SELECT 1 AS k, to_date(d) AS low, to_date(d) AS high FROM VALUES ('1900-02-10'), ('1900-02-20'), ('1900-02-20'), ('2199-12-20') t(d)")
    got = {(r["k"], r["month"]): r["days"] for r in accounts.missing_days(asked, covered, "k", 60).collect()}
    assert got[1, "Feb 1900"] == [d for d in range(1, 29) if d not in (10, 20)] and got[1, "Jan 1900"] == list(range(15, 32))
    assert got[1, "Dec 2199"] == list(range(1, 20)) and got[2, "Dec 2199"] == list(range(1, 21)) and len(got) == 7200
    two = spark.sql("SELECT 1 AS k, to_date(a) AS low, to_date(z) AS high FROM VALUES ('2024-01-01', '2024-01-10'), ('2024-01-08', '2024-02-03') t(a, z)")
    got = {r["month"]: r["days"] for r in accounts.missing_days(two, covered, "k", 33).collect()}
    assert got == {"Jan 2024": list(range(1, 32)), "Feb 2024": [1, 2, 3]} and not accounts.missing_days(two, covered, "k", 34).collect()


def test_spills_come_back_and_missing_days(spark, tmp_path):
    rows = spark.createDataFrame([(1, "short"), (2, "long" * 20), (3, None)], "account_id long, data string")
    kept = accounts.spilled(rows, "account_id", "data", 10, f"file://{tmp_path}/o")
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "short", None), (2, None, "account_2"), (3, None, None)]
    back = accounts.unspilled(kept, spark.read.parquet(f"file://{tmp_path}/o"), "account_id")
    assert sorted(map(tuple, back.collect()), key=str) == [(1, "short"), (2, "long" * 20), (3, None)]
    day = "to_date('2024-01-{:02d}')".format
    asked = spark.sql(f"SELECT * FROM VALUES (1, {day(1)}, {day(10)}), (2, {day(1)}, {day(3)}) t(k, low, high)")
    covered = spark.sql(f"SELECT * FROM VALUES (1, {day(3)}, {day(8)}), (1, {day(4)}, {day(5)}), (1, {day(20)}, {day(25)}), (9, {day(1)}, {day(2)}) t(k, low, high)")
    got = {(r["k"], r["month"]): r["days"] for r in accounts.missing_days(asked, covered, "k", 0).collect()}
    assert got == {(1, "Jan 2024"): [1, 2, 9, 10], (2, "Jan 2024"): [1, 2, 3]}


def test_bins_and_handlers(spark):
    t = spark.createDataFrame([(float(i), int(i >= 40)) for i in range(100)] + [(None, 1)], "x double, y int")
    (point,) = scorecards.split_points(t, "x", "y", 2, 5)
    assert 39 <= point <= 40
    bins = t.select(scorecards.bin_of(F.col("x"), [point]).alias("b")).groupBy("b").count().collect()
    assert {(r["b"], r["count"]) for r in bins} == {(0, 40), (1, 60), (None, 1)}
    assert scorecards.split_points(t.limit(0), "x", "y", 4, 5) == []
    assert consumers.handler("tallyloom.streaming.consumers:by_type") is consumers.by_type
    for bad in ("tallyloom.streaming.consumers:nothing", "tallyloom.model:CHANNELS"):
        with pytest.raises(ValueError):
            consumers.handler(bad)


def test_rows_beside_texts_of_frequent_keys(spark):
    given = [("a", i, None) for i in range(40)] + [("b", 40, "x"), ("b", 40, "x"), ("c", 41, "y"), (None, 42, "z")]
    rows = spark.createDataFrame(given, "k string, seq long, note string")
    texts = spark.createDataFrame([("a", "1,2"), ("b", "3"), ("d", "4"), (None, "5")], "k string, text string")
    got = accounts.beside(rows, texts, "k", "text", share=5)
    assert got.columns == ["k", "seq", "note", "text"]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(texts, "k").collect()))
    assert got.where("k = 'a'").select(F.spark_partition_id()).distinct().count() > 1  # not in one task


def test_rows_beside_texts_hold_one_copy(spark):
    """8,000 rows with a text of 2 MB: 16 GB, four times the heap."""
    rows = spark.range(8_000).select(F.lit("a").alias("k"), F.col("id").alias("seq"))
    texts = spark.range(1).select(F.lit("a").alias("k"), F.repeat(F.lit("0123456789"), 200_000).alias("text"))
    accounts.beside(rows, texts, "k", "text").write.format("noop").mode("overwrite").save()
