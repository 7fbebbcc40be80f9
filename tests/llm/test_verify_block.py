"""The block join of the Jaccard operator against all pairs."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ngram_join, runtime


@pytest.mark.parametrize(("n", "flips"), [(40, 1), (40, 4), (300, 3), (7, 1)])
def test_block_join_connects_what_pairs_connect(n, flips):
    rng, rule = np.random.default_rng(n + flips), ngram_join.Rule(5, 80, 100)
    bases = [rng.integers(0, 2**63, n + k).astype(np.uint64) for k in range(3)]
    sets = []
    for _ in range(90):
        s = bases[rng.integers(3)].copy()
        s[rng.choice(len(s), rng.integers(0, flips + 1), replace=False)] = rng.integers(0, 2**63)
        sets.append(np.unique(s))
    side = rng.integers(0, 2, len(sets))
    for sides, crossing in ((np.zeros(len(sets), int), False), (side, True)):
        pairs = {(a, b) for a in range(len(sets)) for b in range(a) if ngram_join.linked(sets[a], sets[b], rule) and (not crossing or sides[a] != sides[b])}
        links = ngram_join.join_block(sets, sides, rule)
        assert {(max(p), min(p)) for p in links} <= pairs

        def root_of(edges):
            root = list(range(len(sets)))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[max(find(a), find(b))] = min(find(a), find(b))
            return [find(x) for x in range(len(sets))]

        assert root_of(links) == root_of(pairs)


def test_two_sets():
    s = np.arange(1, 20, dtype=np.uint64)
    rule = ngram_join.Rule(3, 90, 100)
    assert ngram_join.join_block([s, s[1:]], np.array([0, 0]), rule) == [(1, 0)]
    assert ngram_join.join_block([s, s[1:]], np.array([1, 1]), rule) == []
    assert ngram_join.join_block([s, s[5:]], np.array([0, 1]), rule) == []


def test_combine_keeps_what_names_tie_together():
    rng = np.random.default_rng(1)
    names, nodes = rng.integers(-40, 40, 600), rng.integers(-(2**62), 2**62, 120)[rng.integers(0, 120, 600)]
    names[:200] = 7  # a name of a third of all rows

    def tied(name, node):
        root = {x: x for x in node}
        for group in {n: node[name == n].tolist() for n in set(name.tolist())}.values():
            low = min(root[x] for x in group)
            for old in {root[x] for x in group}:
                root = {k: low if v == old else v for k, v in root.items()}
        return root

    out_names, out_nodes = ngram_join.combine(names, nodes)
    assert tied(out_names, out_nodes) == tied(names, nodes)
    assert all((out_names == n).sum() == 1 for n in set(names.tolist()))
    assert [len(x) for x in ngram_join.combine(names[:0], nodes[:0])] == [0, 0]


def test_packed_names_tie_the_same_nodes():
    """Names travel as bytes of differences, and each part ties the nodes of its names; 16 bytes a row before."""
    rng = np.random.default_rng(2)
    pool = rng.integers(-(2**62), 2**62, 300_000)
    node = rng.integers(0, 2**48, 5000)
    batches = [(pool[rng.integers(0, len(pool), 200_000)], node[rng.integers(0, len(node), 200_000)]) for _ in range(2)]
    held, size = {}, 0
    for names, nodes in batches:
        for part, *packed in ngram_join.pack(names, nodes, 7):
            held.setdefault(part, []).append(packed)
            size += len(packed[1]) + len(packed[2])
    assert set(held) == set(range(7)) and size <= 13 * 400_000
    want = {}
    for names, nodes in batches:
        for n, x in zip(names.tolist(), nodes.tolist()):
            want.setdefault(n, set()).add(x)
    got = {(a, b) for packed in held.values() for a, b in zip(*(x.tolist() for x in ngram_join.tied(packed)))}
    assert got == {(min(x), b) for x in want.values() for b in x if b != min(x)}
    assert list(ngram_join.pack(pool[:0], node[:0], 3)) == []


def test_a_cut_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in blocks.getAllBlocks().mkString(" ").split() if f.startswith("shuffle")}

    before = files()
    made = runtime.cut(spark.range(5000).groupBy((F.col("id") % 90).alias("k")).count(), "counts")
    end = time.monotonic() + 10
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before
    assert made.count() == 90
