"""Decontamination, the Jaccard join, languages and toxicity against brute force and held-out labels."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyloom.llm import decontaminate, language_id, ngram_join, toxicity
from tallyloom.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh\u00e9\u00df") for _ in range(RNG.randint(1, 4))) for _ in range(60)]


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


def normal_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def test_decontamination_by_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng.choice([1, 3, 12, 13, 14, 40]), rng)) for i in range(25)] + [(25, None), (26, ""), (27, "..."), (28, "zz YY\u00c9")]
    items += [(30, items[3][1])]
    docs: list[tuple] = [(0, None), (1, ""), (2, "!!!"), (3, "zz yy\u00c9 and zz yy\u00c9")]
    for i in range(4, 70):
        parts = [prose(rng.randint(0, 60), rng)]
        for _ in range(rng.randint(0, 3)):
            w = normal_words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [b" / ".join(w[a : a + rng.randint(1, 30)]).decode().upper(), prose(rng.randint(0, 30), rng)]
        docs.append((i, " ".join(parts)))
    docs += [(5, docs[5][1]), (6, "another text under id six"), (None, items[4][1]), (100, prose(30_000, rng) + " " + (items[5][1] or ""))]
    windows: dict = {}
    for i, t in items:
        w = normal_words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    want = []
    for i, t in docs:
        w, hit, found = normal_words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if got := windows.get(tuple(w[k : k + m])):
                    found |= got
                    hit.update(range(k, k + m))
        want.append((i, len(w), len(hit), sorted(found)))
    out = decontaminate.contamination(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string"))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.collect()], key=order) == sorted(want, key=order)
    nameless = spark.createDataFrame([(None, "a b c"), (4, "d e")], "item_id long, text string")
    assert [tuple(r)[2:] for r in decontaminate.contamination(spark.createDataFrame([(1, "x a b c y d e")], "doc_id long, text string"), nameless).collect()] == [(7, 5, ["4"])]
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()} == {0}
    assert decontaminate.contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def brute_components(docs, rule):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        sets.append({tuple(w[k : k + rule.k]) for k in range(len(w) - rule.k + 1)} if len(w) >= rule.k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and rule.over * n >= rule.share * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize(("k", "share"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("blocks", [4096, 4])
def test_jaccard_join_by_brute_force(spark, monkeypatch, k, share, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", blocks)
    rng = random.Random(k)
    docs: list[tuple] = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two"), (900, prose(9000, rng))]
    bases = [prose(n, rng) for n in (4, 8, 12, 20, 33, 60, 150, 400)]
    for i in range(7, 160):
        w = rng.choice(bases).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        docs.append((i, " ".join(w)))
    docs += [(8, docs[9][1]), (None, docs[10][1]), (9, docs[10][1]), (901, "x a\0b y"), (902, "x a b y"), (903, "\0 q"), (904, "\0 Q")]
    rule = ngram_join.Rule(k=k, share=share, over=100)
    out = ngram_join.jaccard_components(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string"), rule)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()], key=order) == sorted(brute_components(docs, rule), key=order)
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), rule).count() == 0


def test_count_tree_bounds_never_lose_a_pair():
    rng, rule = np.random.default_rng(2), ngram_join.Rule(3, 90, 100)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(1, 300, 200)]
    sets += [np.unique(np.concatenate([s[1:], s[:1] + np.uint64(1)])) for s in sets]
    sets.sort(key=len)
    counts = np.stack([np.bincount((s >> np.uint64(40)).astype(np.int64) % 16, minlength=16) for s in sets]).astype(np.int32)
    tree = ngram_join.CountTree(counts, np.array([len(s) for s in sets]))
    for i, s in enumerate(sets):
        got = set(tree.search(counts[i], len(s), rule)[0].tolist())
        assert {j for j, t in enumerate(sets) if ngram_join.linked(s, t, rule)} <= got


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 300)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(7, 7), (3, 2)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    lone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: find(x) for x in root if x not in lone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


SYLLABLES = {"aa": ["tha", "ing", "er", "ly"], "bb": ["sch", "ung", "ei", "keit"], "cc": ["que", "eau", "oi", "\u00e9"]}


def text_in(lang: str, rng: random.Random, n: int = 30) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    rows = [(i, text_in(lang, rng), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ?!", "cc"), (1003, text_in("bb", rng, 20_000), None), (None, text_in("cc", rng), "cc")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language_id.fit(docs, ~toxicity.fold("doc_id", 4, 2))
    got = language_id.identify(docs, model).select("doc_id", "lang", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert r["lang_pred"] == "und"
        else:
            assert r["lang_pred"] == (r["lang"] or "bb")
    empty = language_id.fit(docs.limit(0), ~toxicity.fold("doc_id", 4, 2))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def kept_bytes(text):
    return bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode().translate(LOWER))


def grams_of(text):
    data = kept_bytes(text)
    return {data[i : i + n] for n in language_id.GRAMS for i in range(len(data) - n + 1)}


def test_language_kernel_and_ridge_are_those_of_the_definition(monkeypatch):
    monkeypatch.setattr(language_id, "MATRIX_TEXTS", 7)
    rng = random.Random(9)
    texts = [text_in(k, rng, rng.randint(3, 20)) + rng.choice(["", " 12!", "\u00e9"]) for k in rng.choices(list(SYLLABLES), k=40)]
    labels = [rng.choice(["x", "y", "z"]) for _ in texts]
    model = language_id.train(texts, labels, ridge=1e-2)
    chosen = [t for k in "xyz" for t, lab in zip(texts, labels) if lab == k][: 3 * language_id.LANDMARKS]
    marks = [grams_of(t) for t in chosen]
    known = set().union(*marks)
    new = [*texts, "", "q w \0 e", text_in("bb", rng, 400)]
    own = [grams_of(t.replace("\0", " ")) & known for t in new]
    want = np.array([[len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5 for b in marks] for a in own])
    assert np.allclose(np.concatenate([model.kernel(p) for _, _, p in model.presence(new)]), want, atol=1e-5)
    # Nystroem with all training texts as landmarks is the dense kernel ridge system
    kernel, y = want[: len(texts)], np.array(labels)
    w = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(w)
    good = values > 1e-6 * values.max()
    phi = kernel @ (vectors[:, good] / np.sqrt(values[good]))
    weight = np.array([1 / (y == k).sum() for k in y])
    for c, k in enumerate("xyz"):
        t = np.where(y == k, 1.0, -1.0)
        dual = np.linalg.solve(phi @ phi.T + 1e-2 * np.diag(1 / weight), t)
        assert np.allclose(kernel @ model.weights[:, c], phi @ phi.T @ dual, atol=2e-2)


def test_languages_of_long_texts_and_repeats_are_learned(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(i, text_in("aa", rng), "aa", 1) for i in range(30)] + [(100 + i, text_in("bb", rng, 2000), "bb", 1) for i in range(20)] + [(500, "qqq vvv", "cc", 1)] * 400
    rows += [(600, text_in("cc", rng), "cc", 1) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _language int")
    seen: list = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda texts, labels: seen.append((texts, labels)) or train(texts, labels))
    model = language_id.fit(docs, toxicity.fold("doc_id", 1, 0))
    texts, labels = seen[0]
    assert model.languages == ["aa", "bb", "cc"] and texts.count("qqq vvv") == 1
    assert max(map(len, texts)) <= language_id.SAMPLE_CHARS
    got = language_id.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "_language", "lang_pred", "score"]
    assert got.where("lang_pred <> lang").count() == 0


def test_toxicity_risk_and_its_gradient():
    rng = np.random.default_rng(5)
    xp, xu, prior = (rng.random((20, 6)) < 0.5).astype(float), (rng.random((50, 6)) < 0.3).astype(float), 0.3
    branches = set()
    for scale in (0.1, 1.0, 4.0):
        for _ in range(6):
            theta = rng.normal(size=7) * scale
            z = lambda x: x @ theta[:-1] + theta[-1]  # noqa: B023, E731
            loss = lambda v: np.log(1 + np.exp(-v))
            up, neg, up_grad, down = toxicity.risk(theta, xp, xu, prior)
            assert np.isclose(up, prior * loss(z(xp)).mean()) and np.isclose(neg, loss(-z(xu)).mean() - prior * loss(-z(xp)).mean())
            near = [toxicity.risk(theta + h * e, xp, xu, prior)[:2] for e in np.eye(7) for h in (1e-5, -1e-5)]
            assert np.allclose(up_grad, [(near[2 * i][0] - near[2 * i + 1][0]) / 2e-5 for i in range(7)], atol=1e-5)
            assert np.allclose(down, [(near[2 * i][1] - near[2 * i + 1][1]) / 2e-5 for i in range(7)], atol=1e-5)
            branches.add(neg >= 0)
            step = toxicity.direction(up_grad, neg, down)
            assert np.allclose(step, up_grad + down if neg >= 0 else -down)
    strong = np.zeros(7)
    strong[-1] = -9.0  # everything is called negative: the unlabelled cost nothing, the positives as negatives nothing
    theta = np.array([8.0] * 6 + [-1.0])
    apart = toxicity.risk(theta, np.ones((5, 6)), np.zeros((5, 6)), 0.9)
    branches.add(apart[1] >= 0)
    assert branches == {True, False}


def test_toxicity_sample_holds_a_text_once(spark, monkeypatch):
    seen: list = []
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.append((p, u, prior)))
    rows = [(1, "same words here")] * 300 + [(i, f"text number {i}") for i in range(2, 40)] + [(50, "long " * 9000), (51, None), (52, "")]
    labels = [(1, 1), (2, 1), (2, 0), (3, 0), (50, 1), (None, 1)]
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), ~toxicity.fold("doc_id", 3, 9))
    positive, unlabelled, prior = seen[0]
    assert sorted(t[:15] for t in positive if "long" not in t) == ["same words here", "text number 2"] and len(positive) == 3 and max(map(len, positive)) == toxicity.SAMPLE_CHARS
    assert len(unlabelled) == len(set(unlabelled)) == 40 and prior > 0.9


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        text, bad = text_in(rng.choice(list(SYLLABLES)), rng), rng.random() < 0.2
        if bad:
            w = text.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbleworst", "nastifying", "vileness"]))
            text = " ".join(w)
        rows.append((i, text, int(bad)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    rows += [(5000, None, 0), (5001, "", 0), (None, "nothing", 0), (5002, text_in("aa", rng, 20_000), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    marks = spark.createDataFrame([*labels, (5001, None), (3, None), labels[0]], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, ~toxicity.fold("doc_id", 3, 1))
    got = toxicity.score(docs, model).select("doc_id", "truth", "score", toxicity.fold("doc_id", 3, 1).alias("held")).collect()
    held = [r for r in got if r["held"]]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] >= 0.7) == bool(r["truth"]) for r in held]) > 0.97
    bare = toxicity.fit(docs, marks.limit(0), ~toxicity.fold("doc_id", 3, 1))
    assert {r["score"] < 0.7 for r in toxicity.score(docs, bare).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0
