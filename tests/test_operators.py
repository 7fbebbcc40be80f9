"""Operators whose results SQL does not express, and edge cases of the others."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text, values
from tallyloom.operators import aggregates, features, joins, rules, sets, similarity, windows
from tallyloom.plans.surface import access
from tallyloom.sources import files, sinks
from tallyloom.streaming import streams

DAY = datetime(2024, 1, 1)


def chain(amounts, opening=100.0):
    out, balance = [], opening
    for i, a in enumerate(amounts):
        balance = round(balance + a, 2)
        out.append((1, i, DAY + timedelta(days=i), "credit" if a > 0 else "debit", abs(a), balance))
    return pd.DataFrame(out, columns=["account_id", "seq", "date", "transaction_type", "amount", "balance"])


def test_type_repair_flips_few_and_undoes_many():
    rows = chain([10, -5, 20, -30, 7, 9, -4, 2])
    broken = rows.copy()
    broken.loc[2, "transaction_type"] = "debit"
    assert windows.repaired_types(broken)["transaction_type"].tolist() == rows["transaction_type"].tolist()
    wrong = rows.assign(transaction_type=["debit" if t == "credit" else "credit" for t in rows["transaction_type"]])
    assert windows.repaired_types(wrong)["transaction_type"].tolist() == wrong["transaction_type"].tolist()
    assert windows.repaired_types(rows.iloc[:0]).empty


def test_repeated_blocks():
    rows = pd.DataFrame({"a": [1, 2, 3, 2, 3, 4, 4, 5]})
    assert windows.without_repeated_block(rows, ["a"])["a"].tolist() == [1, 2, 3, 4, 5]


def in_small_batches(spark, run):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        return run().collect()
    finally:
        spark.conf.set(name, before)


def test_clamped_dates(spark):
    days = [0, 3, 1, 2, 20, 4, 5]
    rows = [(k, i, DAY + timedelta(days=d)) for k in (1, 2, None) for i, d in enumerate(days)] + [(1, 7, None), (1, 8, DAY)]
    df = spark.createDataFrame(rows, "k long, seq long, date timestamp")
    got = in_small_batches(spark, lambda: windows.clamped_dates(df, "k", ["seq"]))
    for k in (1, 2, None):
        dates = [r["date"] for r in sorted(got, key=lambda r: r["seq"]) if r["k"] == k]
        assert [(d - DAY).days for d in dates[:7]] == [0, 3, 3, 3, 20, 4, 5]
        assert dates[7:] == ([None, DAY] if k == 1 else [])
    assert windows.clamped_dates(df.limit(0), "k", ["seq"]).count() == 0


def test_recurring_groups(spark):
    dates = [datetime(2024, m, d) for m, d in ((1, 1), (1, 15), (2, 2), (2, 15), (3, 1), (3, 29))]
    amounts = [100.0, 1000.0, 110.0, 1100.0, 90.0, 95.0]
    rows = [(k, i, d, a) for k in (1, None) for i, (d, a) in enumerate(zip(dates, amounts))] + [(2, 0, None, 1.0), (2, 1, dates[0], None), (2, 2, dates[5], 1.0)]
    df = spark.createDataFrame(rows, "k long, seq long, date timestamp, amount double")
    got = in_small_batches(spark, lambda: windows.recurring(df, "k", ["seq"]))
    numbers = {k: [r["group_no"] for r in sorted(got, key=lambda r: r["seq"]) if r["k"] == k] for k in (1, 2, None)}
    assert numbers == {1: [0, 1, 0, 1, 0, 0], 2: [0, 1, 2], None: [0, 1, 0, 1, 0, 0]}


def test_filled_balances(spark):
    rows = chain([10.0, -5.0, 20.0, -30.0])
    holed = spark.createDataFrame([(r.account_id, r.seq, r.date.to_pydatetime(), r.transaction_type, r.amount, r.balance if r.seq == 2 else None) for r in rows.itertuples()] + [(2, 0, DAY, "credit", 1.0, None)], "account_id long, seq long, date timestamp, transaction_type string, amount double, balance double")
    got = windows.fill_balances(holed, ["account_id"], ["date", "seq"]).orderBy("account_id", "seq").collect()
    assert [r["balance"] for r in got] == [*rows["balance"], None]


def test_intervals_and_as_of(spark):
    spans = spark.createDataFrame([(1, DAY, DAY + timedelta(days=40)), (1, DAY + timedelta(days=40), None)], "k long, low timestamp, high timestamp")
    points = spark.createDataFrame([(1, DAY + timedelta(days=d)) for d in (-1, 0, 39, 40)] + [(None, DAY), (1, None)], "k long, date timestamp")
    assert joins.in_intervals(points, spans, ["k"], "date", "low", "high", 7).count() == 2
    assert sets.merged_intervals(spans.limit(0).select("k", F.to_date("low").alias("low"), F.to_date("high").alias("high")), ["k"], "low", "high").count() == 0


def test_rules(spark):
    rows = spark.createDataFrame([(1, "UPI pay"), (2, None), (3, "nothing")], "k long, note string")
    got = {r["k"]: r["label"] for r in rules.classify(rows, [("a", "upi"), ("b", "pay")], "note", "label").collect()}
    assert got == {1: "a", 2: "Other", 3: "Other"}
    patches = spark.createDataFrame([(1, 1, "note", "x"), (1, 2, "note", "y")], "k long, at int, column string, value string")
    assert {r["k"]: r["note"] for r in rules.apply_patches(rows, patches, "k", ["note"], "at").collect()} == {1: "y", 2: None, 3: "nothing"}


def test_functions(spark):
    df = spark.createDataFrame([("Rs. 1,234.50 Cr", "12.000,10", "ab"), ("-", "x", ""), (None, None, None)], "a string, b string, c string")
    got = df.select(values.amount(F.regexp_replace("a", r"Rs\.", "")).alias("amount"), values.locale_number(F.col("b")).alias("number"), text.shingles(F.col("c")).alias("s"), values.with_decimals(F.lit("12345")).alias("d"), text.alike(F.col("c"), F.col("c")).alias("same")).collect()
    assert [r["amount"] for r in got] == [1234.5, None, None]
    assert [r["number"] for r in got] == [12000.1, None, None]
    assert [r["s"] for r in got] == [["ab"], [""], None]
    assert got[0]["d"] == "123.45" and got[1]["same"] is True
    pair = spark.createDataFrame([("a b", "b a"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in pair.select(similarity.ratio("a", "b")).collect()] == [100.0, 100.0, 0.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Statement of account,,\nDate,Narration,Amount\n01/01/2024,first,10\n,,\n02/01/2024,second,20\n")
    got = files.statement_csv(spark, f"{tmp_path}/s.csv", {"date": ["date", "txn date"], "note": ["narration"], "amount": ["amount"]}).collect()
    assert [(r["date"], r["note"], r["amount"]) for r in got] == [("01/01/2024", "first", "10"), ("02/01/2024", "second", "20")]
    with pytest.raises(ValueError):
        files.statement_csv(spark, f"{tmp_path}/s.csv", {"x": ["no such name"]})
    (tmp_path / "t.json").write_text('{"accounts": [{"uuid": "u1", "regex": "a+", "bbox": [1, 2, 3, 4]}], "dates": []}')
    assert [(r["kind"], r["uuid"], r["bbox"]) for r in files.templates(spark, f"{tmp_path}/t.json").collect()] == [("accounts", "u1", [1.0, 2.0, 3.0, 4.0])]
    bad = spark.createDataFrame([("{\"k\": 1}",), ("nonsense",)], "m string").select(files.checked(F.col("m"), "k long").alias("m"))
    assert [r["m"]["_corrupt_record"] for r in bad.collect()] == [None, "nonsense"]
    rows = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "k long, v double")
    assert [tuple(r) for r in sinks.warehouse(rows, {"job": "j"}, {"k": -1}).orderBy("k").collect()] == [(1, 2.0, "j"), (2, None, "j")]
    assert [tuple(r) for r in sinks.warehouse(rows.limit(0), {"job": "j"}, {"k": -1}).collect()] == [(-1, None, "j")]
    out = f"file://{tmp_path}/parts"
    sinks.append_table(rows, out, ["k"])
    sinks.overwrite_partitions(rows.where("k = 1").withColumn("v", F.lit(9.0)), out, ["k"])
    assert sorted((r["k"], str(r["v"])) for r in spark.read.parquet(out).collect()) == [(1, "9.0"), (2, "nan")]


def test_streams_give_what_batches_give(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = spark.createDataFrame([(i, DAY + timedelta(minutes=7 * i), i % 3, float(i)) for i in range(60)], "event_id long, ts timestamp, user_id long, value double")
    rows.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rule = {"high": F.col("value") > 50, "first": F.col("user_id") == 0}
    query = streams.route(stream, rule).writeStream.format("memory").queryName("routed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("routed").collect())) == sorted(map(tuple, streams.route(rows, rule).collect()))
    counts = streams.tumbling_counts(stream, "ts", "user_id", "30 minutes", "10 hours")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, streams.tumbling_counts(rows, "ts", "user_id", "30 minutes", "10 hours").collect()))
    merge = streams.latest_by_key(f"{tmp_path}/latest", "user_id", "ts")
    query = stream.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/latest/v3").collect()) == [57, 58, 59]


def test_access_by_verb(spark):
    assert access(spark, "/root/testdata/sf0.001", "agg_6_global_count").first()["n"] > 0
    with pytest.raises(KeyError):
        access(spark, "/root/testdata/sf0.001", "no_such_verb")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_occurrences_are_all_numbered(spark):
    rows = [("p", 10.0, "2024-01", d, d) for d in range(1, 9)] + [("p", 10.0, "2024-02", 5, 9), ("q", 7.0, "2024-01", 30, 10), (None, 7.0, None, 3, 11)]
    df = spark.createDataFrame(rows, "payee string, amount double, month string, day long, seq long")
    got = sorted(map(tuple, aggregates.occurrences(df, ["payee", "amount"], "month", "day", ["seq"]).collect()), key=str)
    want = [("p", 10.0, "2024-01", d, d, 1, 30) for d in range(1, 9)] + [("p", 10.0, "2024-02", 1, 5, 5, 5), ("q", 7.0, "2024-01", 1, 30, 1, 30), (None, 7.0, None, 1, 3, 3, 3)]
    assert got == sorted(want, key=str)


def test_scores():
    assert similarity.indel("abcd", "abxd") == 75 and similarity.indel("", "") == 100 and similarity.token_set("", "") == 0
    assert similarity.token_set("a b", "b a c") == similarity.partial_token_sort("pay rent", "rent pay") == similarity.partial("bcd", "abcde") == 100
    assert round(similarity.token_set("new york mets", "new york yankees"), 6) == round(100 - 100 * 5 / 21, 6)
    assert similarity.partial("abc", "xxabd") == 200 * 2 / 6 and similarity.partial("abc", "bcxxx") == 200 * 2 / 5
    assert similarity.weighted("rent flat nine", "nine flat rent") == 95 and similarity.weighted("rent", "rent for the flat") <= 90
    for a, b in (("kitten", "sitting"), ("ab" * 40, "ba" * 41), ("x", "")):
        row = [0] * (len(b) + 1)
        for c in a:
            row = [0, *row[1:]]
            old = row[:]
            for j, d in enumerate(b):
                row[j + 1] = old[j] + 1 if c == d else max(old[j + 1], row[j])
        assert similarity.indel(a, b) == 200 * row[-1] / (len(a) + len(b))


def test_recurring_pairs_match_brute_force(spark):
    notes = ["loan emi alpha bank", "loan emi alpha bnk", "short", "alpha bank emi loan for the year", "bank alpha emi loan"]
    rows = [(k % 2, 100.0 + 50 * (k % 3 == 0), k, datetime(2024, 1, 25) + timedelta(days=9 * k % 75), notes[k % 5]) for k in range(60)]
    rows += [(7, 1.0, 100, datetime(2024, 1, 31), "monthly payment"), (7, 1.0, 101, datetime(2024, 3, 1), "monthly payment"), (7, 1.0, 102, datetime(2024, 4, 3), "monthly payment"), (7, 1.0, 103, datetime(2024, 5, 6), "monthly payment")]
    df = spark.createDataFrame(rows, "account_id long, amount double, seq long, date timestamp, note string").withColumn("clean", F.lower("note"))
    near = {1: {29, 30, 31, 1, 2, 3, 4}, 2: {30, 31, 1, 2, 3, 4, 5}, 3: {31, 1, 2, 3, 4, 5, 6}, 29: {26, 27, 28, 29, 30, 31, 1}, 30: {27, 28, 29, 30, 31, 1, 2}, 31: {28, 29, 30, 31, 1, 2, 3}}
    want = set()
    for a in rows:
        for b in rows:
            days = near.get(a[3].day) or set(range(a[3].day - 2, a[3].day + 4))
            if a[:2] == b[:2] and (a[3], a[2]) < (b[3], b[2]) and a[3].date() != b[3].date() and b[3].day in days and abs(len(a[4]) - len(b[4])) < 10:
                if similarity.weighted(a[4], b[4]) > 92 or abs(len(a[4]) - len(b[4])) < 3 and min(len(a[4]), len(b[4])) > 10:
                    want.add((a[2], b[2]))
    got = joins.recurring_pairs(df, ["account_id", "amount"], ["date", "seq"], "date", "note", "clean", "seq").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {(100, 101), (101, 102), (102, 103)} <= want and (100, 103) not in want


def test_text_clusters_by_pair(spark):
    rows = [(i, bank, f"{'rent' if i % 2 else 'fuel'} {'flat' if i % 2 else 'car'}") for i, bank in enumerate(["a"] * 20 + ["b"] * 20 + [None] * 4)] + [(99, "a", None)]
    df = spark.createDataFrame(rows, "seq long, bank string, note string")
    got = {r["seq"]: r["cluster"] for r in similarity.text_clusters(df, "note", 2, ["bank"]).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for first, last in ((0, 20), (20, 40), (40, 44)):
        odd, even = ({got[i] for i in range(first, last) if i % 2 == k} for k in (1, 0))
        assert len(odd) == len(even) == 1 and odd != even


def test_text_clusters_read_each_text_once(spark):
    """Whatever the number of models, which stop words, cases and separators do not change."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(i, f"bank {i % 3}", ("The RENT/flat" if i % 4 == 0 else "rent, of flat") if i % 2 == 0 else "fuel CAR") for i in range(60)] + [(60, "", "rent flat"), (61, None, "fuel car")]
    df = spark.createDataFrame(rows, "seq long, bank string, raw string").repartition(2).select("seq", "bank", seen("raw").alias("note"))
    found = similarity.text_clusters(df, "note", 2, ["bank"])
    got = {r["seq"]: r["cluster"] for r in found.select("seq", "cluster").collect()}
    assert found.columns == ["seq", "bank", "note", "cluster"] and sorted(got) == [r[0] for r in rows] and read.value == len(rows)
    for bank in range(3):
        even, odd = ({got[r[0]] for r in rows if r[1] == f"bank {bank}" and r[0] % 2 == k} for k in (0, 1))
        assert len(even) == len(odd) == 1 and even != odd


def test_keyword_categories(spark):
    rows = [(1, "ATM cash out", "debit", "x"), (2, "paid to online grocry order", "debit", "x"), (3, "paid to online grocry order", "credit", "x"), (4, "lazy pay bank", "debit", "x"), (5, "lazypay", "debit", "x"), (6, "nothing", "debit", "bill_payment"), (7, "cash", "debit", "salary"), (8, None, None, None)]
    df = spark.createDataFrame(rows, "k long, note string, transaction_type string, transaction_channel string")
    got = rules.keyword_categories(df, [("cash", r"\bcash\b"), ("late", "out")], [("bnpl", ["lazypay"]), ("food", ["onlinegrocery"])], "note", "c", {"food": "debit"}, ["salary"], {"bnpl": ["bank"]}, {"bill_payment": "bills"})
    assert {r["k"]: r["c"] for r in got.collect()} == {1: "cash", 2: "food", 3: "", 4: "", 5: "bnpl", 6: "bills", 7: "", 8: ""}
    for a in ("swiggy", "lazypay", "ab", ""):
        for b in ("swigy", "xxswggyxx", "lazy", "laz pay", "", "ba"):
            assert similarity.contained(a, b, 90) == (similarity.partial_token_sort(a, b) > 90)


def test_fuzzy_scores_match_brute_force(spark):
    from tallyloom.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    want = {(a["p_partkey"], b["p_partkey"]) for a in parts for b in parts if a["p_brand"] == b["p_brand"] and a["p_type"] == b["p_type"] and a["p_partkey"] < b["p_partkey"] and similarity.fuzzy(a["p_name"].lower(), b["p_name"].lower()) > 75}
    assert {(r["a"], r["b"]) for r in QUERIES["sca_23_fuzzy_scores"](spark, sf).collect()} == want
    assert similarity.fuzzy("green red", "red green") == similarity.fuzzy("red", "dark red green") == 100


def test_spend_of_any_year(spark):
    df = spark.createDataFrame([("upi", "2024-01", 3.0), ("upi", "2024-01", 1.0), ("chq", "1980-12", 8.0)], "c string, month string, amount double")
    whole = df.select("month").union(spark.createDataFrame([("2031-05",), ("2031-06",)], "month string"))
    got = {(r["c"], r["month"], r["level"]): (r["amount"], r["average"]) for r in aggregates.spend_by_month(df, whole, "c", "month", "amount").collect()}
    assert len(got) == 2 * 4 + 2 + 4 + 1
    assert got["upi", "2024-01", 0] == (4.0, None) and got["chq", "2031-05", 0] == (0.0, None) and got[None, "1980-12", 2] == (8.0, None)
    assert got["upi", None, 1] == (4.0, 1.0) and got[None, None, 3] == (12.0, 3.0)


def test_name_matches_by_share_of_tokens(spark):
    notes = [(1, "NEFT/ACME Industries/99"), (2, "acme"), (3, "river-clinic pay"), (4, None), (5, "pvt ltd"), (6, "industries of acme, acme")]
    names = [("Acme Industries Pvt",), ("River Clinic & Sons",), ("pvt",)]
    df, wanted = spark.createDataFrame(notes, "seq int, note string"), spark.createDataFrame(names, "name string")
    got = features.name_matches(df, "seq", "note", wanted, "name", ["pvt", "ltd"], 0.6).collect()
    assert sorted(map(tuple, got)) == [(1, "Acme Industries Pvt"), (3, "River Clinic & Sons"), (6, "Acme Industries Pvt")]


def test_monthly_averages_make_months_after_grouping(spark):
    rows = [(1, 1, "2020-01-30", 10.0), (1, 2, "2020-01-30", 20.0), (1, 3, "2020-04-01", 5.0), (1, 4, "2020-04-11", 8.0), (1, 5, "2020-06-03", None), (2, 1, None, 4.0), (2, 2, "2021-02-28", 7.0), (None, 1, "2021-01-01", 1.0), (None, 2, "2021-01-03", 4.0)]
    df = spark.createDataFrame(rows, "k int, i int, d string, v double").withColumn("d", F.to_timestamp("d"))
    out = joins.monthly_averages(df, ["k"], "d", "v", ["i"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # a long gap is one row until then
    want = {(1, "2020-01"): 20.0, (1, "2020-02"): 20.0, (1, "2020-03"): 20.0, (1, "2020-04"): (5.0 * 10 + 8.0 * 20) / 30, (1, "2020-05"): 8.0, (1, "2020-06"): 16.0 / 3, (2, "2021-02"): 7.0, (None, "2021-01"): 2.0}
    got = {(r["k"], r["month"]): r["average"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
