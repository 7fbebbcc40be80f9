"""Licence statements, hard negatives and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives, license_index, resample
from tallyloom.llm.oracles import ORACLE_SQL
from tallyloom.llm.queries import QUERIES
from tests.llm.test_text_operators import normal_words as word_bytes
from tests.test_queries import SF, TABLES, rows

TEMPLATES = license_index.BASE + license_index.STATEMENTS


def normal_words(text):
    return [w.decode() for w in word_bytes(text)]


def places_by_brute_force(text, templates):
    w, out = normal_words(text), []
    for t in templates:
        x = t.text.split()
        must = set()
        for key in t.keys:
            k = key.split()
            at = min(i for i in range(len(x)) if x[i : i + len(k)] == k)
            must |= set(range(at, at + len(k)))
        for start in range(-len(x), len(w)):
            met = {i for i in range(len(x)) if 0 <= start + i < len(w) and w[start + i] == x[i]}
            if len(met) >= math.ceil(t.share * len(x) - 1e-9) and must <= met:
                out.append((start, t.label, len(x), round(len(met) / len(x), 9), t.base))
    return sorted(out)


def test_licence_places_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, "!!!"), (3, "CC-BY cc by"), (4, "cc\nBY all RIGHTS reserved; all rights reserved"), (5, "general public"), (6, "license"), (6, "license"), (None, "All rights reserved."), (2**60 + 1, "cc by")]
    for i in range(120):
        words = []
        for _ in range(rng.integers(1, 5)):
            t = TEMPLATES[rng.integers(len(TEMPLATES))].text.split()
            if rng.random() < 0.6:
                t[rng.integers(len(t))] = str(rng.choice(["2024", "é", "license", "the"]))
            t = t[rng.integers(0, 2) :] if rng.random() < 0.3 else t
            words += [*t, *rng.choice(["of", "the", "public", "x1", "3"], rng.integers(0, 4)).tolist()]
        rows.append((100 + i, str(rng.choice([" ", ", ", "-"])).join(words)))
    rows.append((999, "pad " * 30_000 + "released under the MIT licence? the mit license"))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Label string, `n.words` int").repartition(5)
    got = sorted((str(r["doc_id"]), r["n_words"], [(p["start"], p["label"], p["n"], round(p["coverage"], 9), p["base"]) for p in r["places"]]) for r in license_index.scan(docs, TEMPLATES).collect())
    assert got == sorted((str(i), len(normal_words(t)), places_by_brute_force(t, TEMPLATES)) for i, t in rows)
    assert license_index.scan(docs.limit(0), TEMPLATES).collect() == [] and license_index.scan(docs, ()).where("size(places) > 0").count() == 0


def test_templates_without_keys_and_bad_ones(spark):
    loose = (license_index.Template("a", "one two three four five", (), 0.6), license_index.Template("b", "two two two", (), 0.5))
    rows = [(0, "one x three y five"), (1, "x two three four"), (2, "two two"), (3, "one two"), (4, "z two q two two")]
    got = {r["doc_id"]: [(p["start"], p["label"], p["n"], round(p["coverage"], 9), p["base"]) for p in r["places"]] for r in license_index.scan(spark.createDataFrame(rows, "doc_id int, text string"), loose).collect()}
    assert got == {i: places_by_brute_force(t, loose) for i, t in rows}
    for bad in (license_index.Template("c", "one", ("two",)), license_index.Template("c", "")):
        with pytest.raises(ValueError):
            license_index.Vocabulary((bad,))


def test_index_takes_the_rarest_words():
    v = license_index.Vocabulary((license_index.Template("a", "one two three four five", (), 0.8), license_index.Template("k", "two three four", ("three four",), 0.5)))
    frequency = np.array([{"one": 9, "two": 50, "three": 3, "four": 7, "five": 8}[w] for w in sorted(("one", "two", "three", "four", "five"), key=lambda w: int(license_index._hashes(w)[0]))])
    begins, templates, positions = v.index(frequency)
    assert sorted(zip(templates.tolist(), positions.tolist())) == [(0, 2), (0, 3), (1, 1)] and begins[-1] == 3


def mined_by_brute_force(rows, mining):
    sound = [(i, lab, [max(-(2**24), min(2**24, math.floor(256 * float(np.float32(x))))) for x in v], a) for i, v, lab, a in rows if i is not None and lab is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, (i, lab, v, a) in enumerate(sound):
        if not a:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, k) for k, (j, _, w, _) in enumerate(sound) if j != i and len(w) == len(v) and k != n]
        for s, p, _ in sorted(x for x in scores if sound[x[2]][1] == lab)[: mining.positives]:
            fits = sorted(x for x in scores if sound[x[2]][1] != lab and mining.low * -s <= mining.over * -x[0] <= mining.high * -s)
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits[: mining.negatives])]
    return sorted(out)


@pytest.mark.parametrize(("size", "rows_of"), [(512, 16_384), (8, 40)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, size, rows_of):
    for name, value in (("LIST", size), ("SHARD_ROWS", rows_of), ("BLOCK", 7 if size == 8 else 256), ("ROWS_PER_CENTROID", 30)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(size)
    base, rows = rng.normal(size=(6, 12)), []
    for i in range(400):
        v = base[rng.integers(6)] + rng.normal(size=12) * rng.choice([0.0, 0.1, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(4)), i % 10 == 0))
    same = rows[10][1]
    rows += [(1000 + i, same, i % 3, i % 20 == 0) for i in range(150)]  # a very common vector, with ties
    rows += [(2000, None, 1, True), (2001, [None] * 12, 1, True), (2002, [float("nan")] * 12, 1, True), (2003, [float("inf")] * 12, 1, True), (2004, same, None, True), (None, same, 1, True)]
    rows += [(2010, [0.0] * 12, 1, True), (2011, [0.0] * 12, 2, False), (2012, [1.0, 0.5], 1, True), (2013, [1.0, 0.5], 1, False), (2014, [1.0, 0.49], 2, False), (2015, [], 1, True), (2016, [], 2, True), (2017, [], 1, False)]
    rows += [(2020, [3e38] * 3, 5, True), (2021, [-3e38] * 3, 5, False), (2022, [1e30] * 3, 5, False), (2023, [2e38] * 3, 6, False), (2024, [1e5, 0.0, -1e5], 6, True), (2025, [1e5, 1.0, -1e5], 6, False), (2026, [1e5, -9.0, -1e5], 7, False), (30, rows[30][1], rows[30][2], False)]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, a boolean, score int, `number.x` int").repartition(3)
    for mining in (hard_negatives.Mining(), hard_negatives.Mining(2, 3, 50, 90, 100)):
        got = sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("a"), mining=mining).collect())
        assert got == mined_by_brute_force(rows, mining) and len(got) > 100
    assert hard_negatives.mine(frame.limit(0), F.col("a")).collect() == []
    assert hard_negatives.mine(frame, F.lit(None).cast("boolean")).collect() == []


def test_search_skips_lists_beyond_the_bound():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (50, 4)) + c for c in ([90, 0, 0, 0], [0, 90, 0, 0], [-90, 0, 0, 0])])
    centre = np.stack([x[i : i + 50].mean(0) for i in (0, 50, 100)])
    radius = np.array([hard_negatives._radius(x[50 * i : 50 * i + 50], centre[i]) for i in range(3)])
    shard = hard_negatives.Shard([1, 1, 1], np.array([50, 100, 150]), centre, radius, np.arange(150), x.astype(np.int32))
    seen, dot = [], hard_negatives._dot
    whole = np.full((1, 1), np.iinfo(np.int64).max)
    try:
        hard_negatives._dot = lambda a, b: seen.append(len(b)) or dot(a, b)
        top, who = shard.search(x[:1], np.array([0]), [1], True, -whole, whole, -whole, 5)
    finally:
        hard_negatives._dot = dot
    order = sorted(((-int(x[0] @ x[i]), i) for i in range(1, 150)))[:5]
    assert seen == [50] and list(zip((-top[0, 0]).tolist(), who[0, 0].tolist())) == order


def resampled_by_brute_force(docs, target, draw):
    def features(t):
        w = normal_words(t)
        return len(w), [" ".join(w[i : i + n]) for n in range(draw.least_n, draw.most_n + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % draw.buckets

    s, t = (Counter(bucket(f) for x in side for f in features(x)[1]) for side in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()) + draw.buckets, sum(t.values()) + draw.buckets
    out = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= draw.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * draw.percent // 100])}
    return [(*r, ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("draw", [resample.Draw(percent=40, least_words=5), resample.Draw(1, 3, 50, 7, 2, 100), resample.Draw(2, 2, 1000, 1, 0, 35), resample.Draw(percent=0)])
def test_resampling_by_brute_force(spark, draw):
    rng = np.random.default_rng(draw.buckets)
    words = ["Ab", "é", "x9", "the", "THE", "of", "日本", "z"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(90)] + [(200, None), (201, ""), (202, "--"), (203, "the " * 30_000), (None, "the of x9 z é"), (5, "the of z z é x9")]
    docs += [(300, "the of the of x9 z")] * 4
    target = ["the of x9 Z, the of", None, "日本 日本"]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, Rank int, `key.x` int").repartition(4)
    items = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = resample.resample(frame, items, draw)
    order = lambda rows: sorted(rows, key=str)
    got = order((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect())
    assert got == order(resampled_by_brute_force(docs, target, draw))
    taken = resample.drawn(frame, found)
    assert taken.columns == ["doc_id", "text", "Rank", "key.x", "rank_"]
    assert sorted((r["rank_"], str(r["doc_id"])) for r in taken.collect()) == sorted((r[5], str(r[0])) for r in got if r[5])


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(empty, one).collect() == []
    draw = resample.Draw(least_words=1, percent=100)
    assert [r["rank"] for r in resample.resample(one, empty, draw).collect()] == [1]
    with pytest.raises(ValueError):
        resample.Draw(buckets=0)


def test_words_are_those_of_the_contract(spark):
    text = "".join(chr(i) for i in range(1, 300)) + " Ünï cc-BY"
    (got,) = spark.createDataFrame([(text,)], "t string").select(resample.words(F.col("t"))).first()
    assert got == normal_words(text) == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
