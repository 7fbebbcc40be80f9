"""The vector join, URL rules, shards and the pipeline on small fixtures."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np
import pytest

from tallyloom.llm import near_vectors, shards, toxicity, url_filter
from tallyloom.llm.queries import TOXIC, URL_RULES
from tests.llm.test_text_operators import brute_components, normal_words

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def linked_by_brute_force(rows, least=0.98):
    """(id, n_links, component) of each (id, vector, label), by all pairs."""
    good = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[i][1], np.float32).astype(float)) for i in good}
    links = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in good}
    out, seen = [None] * len(rows), set()
    for i, r in enumerate(rows):
        if i not in links:
            out[i] = (r[0], 0, r[0])
        elif i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = set(links[todo.pop()]) - group
                group |= new
                todo += new
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                out[j] = (rows[j][0], len(links[j]), min(ids, default=None))
    return sorted(out, key=str)


@pytest.mark.parametrize("interval", [1024, 16])
def test_vector_links_by_brute_force(spark, monkeypatch, interval):
    monkeypatch.setattr(near_vectors, "INTERVAL", interval)
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(12, 24))
    for i in range(240):
        v = base[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.15, 0.25])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], int(rng.integers(3))))
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] + [1.0] * 23, 1), (303, [None] + [1.0] * 23, 1), (304, rows[0][1], None), (305, rows[0][1], rows[0][2]), (306, [float("inf")] + [1.0] * 23, 1), (307, [1.0, 2.0], 1), (308, [], 1)]
    rows += [(None, rows[0][1], rows[0][2]), (None, [9.0, 1.0, 1.0], 2), (None, [9.0, 1.0, 1.1], 2), (310, [1.0, 2.01], 1), (311, [1.0], 1), (312, [2.0], 1), (313, [-2.0], 1), (5, rows[6][1], 2)]
    out = near_vectors.link_counts(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int"), 0.98)
    assert sorted([tuple(r) for r in out.collect()], key=str) == linked_by_brute_force(rows)
    assert near_vectors.link_counts(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 0.98).count() == 0


def test_vectors_of_the_rarer_length_and_text_ids(spark):
    rows = [("a", [1.0, 0.0, 0.0], 7), ("b", [1.0, 0.01, 0.0], 7), ("c", [0.0, 0.0, 1.0], 7), ("d", [1.0, 0.0], 7), ("e", [1.0, 0.01], 7)]
    out = near_vectors.link_counts(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int"), 0.98)
    assert sorted(map(tuple, out.collect())) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c"), ("d", 1, "d"), ("e", 1, "d")]


def lowered(host):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host)


def judged(url, rules=URL_RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host, fit = lowered(host), []
    for v, r in rules:
        name, slash, start = r.partition("/")
        if (host == lowered(name) or host.endswith("." + lowered(name))) and path.startswith(slash + start):
            fit.append((len(r), r, v))
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


def test_url_rules_by_brute_force(spark):
    urls = [None, "", "no scheme", "://", "http://", "http:///en/7", "HTTP://A.Example.COM/en/7x?q=://b", "x://example.com/en/", "x://example.com/en", "x://example.com/EN/7", "x://notexample.com/en/71", "x://com/en/1", "x://a.net/de/8", "x://example.net/de/8",
            "x://b.example.net/de/81#f", "x://example.net/de/9", "x://q.org/es/?a", "x://q.org#/es/", "x://q.org?/es/", "x://example.com:80/en/7", "x://my-example.com/en/7", "x://\u00c4.com/en/", "x://a.com//en/7", "x://a.com/en/" + "y" * 5000, "x://example_com/en/7"]
    rows = [(i, u, "mine") for i, u in enumerate(urls * 2)] + [(0, urls[9], "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u, _ in rows), key=str)
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, URL_RULES)).count() == 0


def test_url_rules_without_a_token_and_other_spellings(spark):
    rules = [("block", "localhost"), ("block", "A.com/x"), ("block", "\u00e9\u00e9/\u00fc/"), ("allow", "-/p"), ("block", "_/"), ("block", "(x).net/a+b"), ("block", "b.org/1"), ("allow", "b.org/1")]
    urls = ["http://localhost/abc", "http://localhost", "http://a.localhost?x", "http://notlocalhost/abc", "http://localhost.com/", "http://a.com/x/y", "http://Q.A.COM/xy", "http://a.com/X", "http://\u00e9\u00e9/\u00fc/", "http://x.\u00e9\u00e9/\u00fc/q",
            "http://\u00e9\u00e9/\u00fcx", "http://-/pq", "http://_/", "http://(x).net/a+b", "http://(x).net/aab", "http://b.org/12", "http:///localhost", "http://a.com\n/x", "http://y\n.a.com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect())
    assert got == [(i, *judged(u, rules[:-1])) for i, u in enumerate(urls)]
    assert [g[4] for g in got[:3]] == ["block"] * 3 and got[5][4] == got[8][4] == "block"
    for bad in (("block", "/x"), ("", "a.com"), ("block", "")):
        with pytest.raises(ValueError):
            url_filter.rule_table(spark, [bad])


def test_shards_keep_rows_and_versions(spark, tmp_path):
    table = shards.ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=40_000, unit_bytes=512)
    first = spark.range(0, 3000, 1, 3).selectExpr("id", "cast(id * 7 as string) AS text", "CAST(NULL AS string) AS path", "id AS bytes")
    assert table.append(first, rows_per_shard=100) == 1
    assert table.append(first.limit(0), rows_per_shard=100) == 2
    assert table.append(first.limit(50), rows_per_shard=100) == 3
    before = table.manifest().count()
    last = table.compact()
    assert last > 3 and table.manifest().count() < before
    assert sorted(table.read().collect()) == sorted([*first.collect(), *first.limit(50).collect()])
    assert table.read(1).count() == 3000 and table.manifest(0).count() == 0
    entries = table.manifest().collect()
    assert sum(e["n_rows"] for e in entries) == 3050
    assert sorted(e["seq"] for e in entries) == sorted({e["seq"] for e in entries})
    assert table.compact() == last
    with pytest.raises(shards.CommitConflict):
        table._commit(table.manifest(), last)
    with pytest.raises(ValueError):
        shards.ShardedTable(spark, f"file://{tmp_path}/none", target_bytes=1).read()
    bare = shards.ShardedTable(spark, f"file://{tmp_path}/bare", target_bytes=40_000)
    bare.append(first.limit(0), rows_per_shard=100)
    assert bare.compact() == 1 and bare.read().columns == first.columns and bare.read().count() == 0


def test_shards_with_clashing_names_stay_in_order(spark, tmp_path):
    table = shards.ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, unit_bytes=512)
    for k in range(5):
        rows = spark.range(k * 100, k * 100 + 100, 1, 2).selectExpr("id", "id AS _run", "'p' AS _shard_path", "id AS _seq", "'x' AS _path", "'m' AS _metadata", "IF(id % 7 = 0, NULL, 'y') AS `a.b`", "id AS _at")
        table.append(rows, rows_per_shard=40)
    whole = sorted(table.read().collect(), key=str)
    assert len(whole) == 500 and table.read().columns == rows.columns
    table.compact()
    (entry,) = table.manifest().collect()
    assert sorted(table.read().collect(), key=str) == whole
    assert [r["id"] for r in spark.read.parquet(entry["path"]).coalesce(1).collect()] == list(range(500))
    assert table.read(2).count() == 200


def test_place_of_a_file_whose_job_has_a_counter_in_its_name(spark):
    names = ["part-00003-1b2c3d4e-c412-4abc-8def-c0ffee001234-c000.zstd.parquet", "part-00003-1b2c3d4e-c412-4abc-8def-c0ffee001234-c012.zstd.parquet", "part-120000-00000000-0000-c999-0000-00000000c123-c70000.parquet"]
    found = spark.createDataFrame([(f"file:/x/data/{n}",) for n in names], "path string").select(shards.place("path")).collect()
    assert [r[0] for r in found] == [3 * shards._TASK, 3 * shards._TASK + 12, 120_000 * shards._TASK + 70_000]


@pytest.mark.parametrize("listed", [10_000, 2])
def test_expired_versions_leave_live_files_alone(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(shards, "LISTED", listed)
    table = shards.ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=20_000, unit_bytes=512)
    for k in range(4):
        table.append(spark.range(k * 500, k * 500 + 500, 1, 2).selectExpr("id", "cast(hash(id) as string) AS text"), rows_per_shard=50)
    last = table.compact()
    files = lambda: sum(1 for _ in tmp_path.rglob("*.parquet") if "/data/" in str(_))
    live, whole, before = table.manifest().count(), sorted(table.read().collect()), files()
    assert before > live and (listed == 2 or len([f for f in table.read().inputFiles() if "/data/" in f]) == live)
    assert table.expire(2) >= 0 and table.expire() > 0 and files() == live
    assert table.version() == last and sorted(table.read().collect()) == whole and table.expire() == 0
    with pytest.raises(Exception):  # noqa: B017
        table.read(1).count()
    with pytest.raises(ValueError):
        table.expire(0)


def test_urls_beside_columns_of_any_name(spark):
    rows = [("http://a.com/en/7", 1, 2, 3, 4), (None, 5, 6, 7, 8), ("no scheme", 9, 10, 11, 12), ("HTTP://X.example.com/en/7", 13, 14, 15, 16)]
    pages = spark.createDataFrame(rows, "`the.url` string, Host int, `a.b` int, _salt int, VERDICT int")
    out = url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES), "the.url")
    assert out.columns == ["the.url", "a.b", "_salt", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("http://a.com/en/7", 2, 3, "a.com", "/en/7", "com/en/", "block"), (None, 6, 7, "", "", None, "allow"), ("no scheme", 10, 11, "", "", None, "allow"), ("HTTP://X.example.com/en/7", 14, 15, "x.example.com", "/en/7", "example.com/en/7", "allow")], key=str)


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.union(extra).union(docs.limit(2))
    items = [(r["item_id"], normal_words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(13, len(w))]) for _, w in items if w for k in range(len(w) - min(13, len(w)) + 1)}
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        if name != "packing":
            got = sorted((r["doc_id"], r["text"] or "") for r in out.select("doc_id", "text").collect())
        if name == "language_id":
            assert got == sorted(d for d in given if any(map(str.isalpha, d[1] or "")))
        if name == "toxicity":
            marks = spark.read.parquet(f"{sf}/labels.parquet")
            model = toxicity.fit(docs, marks, ~toxicity.fold("doc_id", 3, 1))
            assert got == sorted(d for d, s in zip(given, model.scores([t for _, t in given])) if s < TOXIC)
        if name == "ngram_join":
            assert got == sorted({d for d, (i, _, c) in zip(given, brute_components(given, corpus_pipeline.NEAR)) if i == c})
        if name == "decontamination":
            kept = []
            for d in given:
                w, hit = normal_words(d[1]), set()
                for m in {len(x) for x in windows}:
                    hit.update(*(range(k, k + m) for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in windows))
                if not hit or 20 * len(hit) < len(w):
                    kept.append(d)
            assert got == sorted(kept)
        if name != "packing":
            assert out.columns == docs.columns
            path = f"file://{tmp_path}/{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.count() <= seen
            seen = docs.count()
        if name == "language_id":
            assert docs.where("doc_id > 90000").count() == 0
        if name == "ngram_join":
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    assert out.select("doc_id").distinct().count() == docs.count() > 0


def test_near_duplicates_keep_one_row_whatever_the_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w7 ", "v7 ")
    rows = [(5, long), (5, near), (5, long), (None, near + " more"), (None, long), (8, "alone here is a text"), (None, "another text that is alone"), (None, "another text that is alone"), (9, None), (9, None), (9, ""), (2, "q"), (3, "q")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _key int, gone_id int, root int")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str)
    first = [r for r in left if r[1] and r[1].startswith("w0")]
    assert len(first) == 1 and first[0][0] == 5
    assert [r for r in left if r not in first] == sorted([(8, "alone here is a text"), (None, "another text that is alone"), (9, None), (9, None), (9, ""), (2, "q")], key=str)


def test_language_stage_uses_the_prediction(spark, monkeypatch):
    rows = [(i, f"the cat and the dog number {i} were there with them", "en") for i in range(40)] + [(100 + i, f"der hund und die katze nummer {i} sind nicht hier", "de") for i in range(40)]
    rows += [(200, "12 34", "en"), (201, None, "de"), (None, "the dog and the cat were there", None)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    assert corpus_pipeline.language(spark, docs, "").count() == 81
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en",))
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns and got.count() == 41 and got.where("lang = 'de'").count() == 0
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.01)
    assert corpus_pipeline.language(spark, docs, "").count() == 0
    bare = docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang IS NULL")
    assert corpus_pipeline.language(spark, bare, "").count() == 1  # nothing could be learned: the letters decide
