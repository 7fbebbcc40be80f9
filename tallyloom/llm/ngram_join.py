"""N-gram Jaccard join by count vectors in an R-tree.

A document's set of word shingles is hashed into groups, and the numbers of its shingles
by group are a point. The overlap of two sets is at most the sum of the smaller of their
counts, group by group, so an R-tree over the points, whose nodes keep the greatest count
of each group, finds all pairs that may link; survivors are verified on the sets.

How the work is spread. Equal sets are one class. The same bound says that the sets of a
linked pair differ in at most r shingles, with r from their sizes; hashed into more than r
groups they agree in some group entirely. Classes that agree in a group of a size level
(linked sets share a level) are joined into candidate clusters of that level, by a hub for
each group. The names of groups are most of what is shuffled, so they travel sorted, as bytes of their
differences, in parts of a bounded number. The trees are built over blocks of a cluster, in tasks of bounded
size, and return at most one link for each point. A cluster beyond a block meets in rounds:
its blocks apart; then, as long as that halves their number, one representative of each
component found so far; in the end every member outside the cluster's largest component
against all others, block by block. Members that are connected already are not copied, so
a large group of copies costs a few passes over it and not its blocks squared. No pair of linked classes is missed,
and no group of copies is ever written out pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes
from tallyloom.llm.components import components
from tallyloom.llm.runtime import cut

#: Bounds of a block: classes, and shingles in all their sets (32 MB of hashes), but for a single larger set.
BLOCK_CLASSES, BLOCK_SHINGLES = 4096, 1 << 22
#: Clusters beyond a block (12 bytes each) up to which their table is broadcast; a longer one is joined by a shuffle.
BROADCAST_CLUSTERS = 100_000
#: Groups beyond those that the bound needs: a class with no more empty groups than this needs none of them.
SPARE = 2
LEAF = 16
#: Bits of a group's name, and bytes of a node's, in a shuffle: two that are taken for one only share a cluster.
NAME_BITS, NODE_BYTES = 56, 6
#: Shingles, of all sets together, whose names make a part (about as many), which a task holds; names packed at once.
PART_SHINGLES, HELD_NAMES = 1 << 19, 1 << 19
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[32, *range(9, 14)]] = False


@dataclass(frozen=True)
class Rule:
    """Sets of k-word shingles link when over * intersection >= share * union."""

    k: int
    share: int
    over: int

    def needed(self, n: np.ndarray | int) -> np.ndarray | int:
        """The least overlap of a linked pair whose sizes add up to n."""
        return -(-self.share * n // (self.share + self.over))

    def levels(self, most: int) -> np.ndarray:
        """First sizes of the size levels; linked sets lie in one level or in neighbours."""
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, -(-out[-1] * max(13 * self.share, 10 * self.over + self.share) // (10 * self.share))))
        return np.array(out, np.int64)

    def differ(self, size: int) -> int:
        """In how many shingles two linked sets of at most this size can differ."""
        return 2 * size * (self.over - self.share) // (self.over + self.share)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of bytes other than white space (a zero byte is none), A-Z lower-cased. A text of fewer than
    k words has its whole sequence as one shingle, one without words an empty set.
    """
    for first, last, data, starts in textbytes.blocks(texts, 1, b"\0"):
        _, _, h, text = textbytes.words(data, starts, _NOT_SPACE)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=last - first))])
        n = max(0, len(h) - k + 1)
        grams = np.full(n, k, np.uint64)
        for j in range(k):
            grams = textbytes.mix(grams + h[j : n + j])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    one = textbytes.mix(one + h[j])
                yield one
            else:
                yield np.zeros(0, np.uint64)


def set_hash(s: np.ndarray) -> int:
    """A 64-bit name for a set, as a signed integer."""
    total = np.add.reduce(textbytes.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)
    return int(textbytes.mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def levels_of(n: int, rule: Rule, levels: np.ndarray) -> list[int]:
    """The size levels in which a set of n can meet a partner that is no equal set."""
    if not n:
        return []
    at = int(np.searchsorted(levels, n, side="right")) - 1
    both = [at, at + 1] if n * rule.over >= rule.share * levels[at + 1] else [at]
    return [k for k in both if rule.differ(int(levels[k + 1]) - 1)]


def node(h: int, level: int) -> int:
    """The name of a set in a level, of NODE_BYTES."""
    return int(textbytes.mix(np.array([h], np.int64).view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))[0]) >> 64 - 8 * NODE_BYTES


def signatures(s: np.ndarray, level: int, rule: Rule, levels: np.ndarray) -> np.ndarray:
    """Names for a level, such that linked sets have one in common.

    Linked sets differ in at most r shingles. Where r + 1 groups are large enough, the
    names are those of the groups: one agrees. Where they would be too small to tell sets
    apart, there are r / 2 + 1 groups of three parts: one group has a single difference or
    none, so two of its parts agree, and every two parts of a group make a name. Spare
    groups stand in for as many that are empty; only a set with more empty ones uses those.
    """
    top = int(levels[level + 1]) - 1
    r = rule.differ(top)
    triple = top < 7 * (r + 1) and r >= 8
    spare = SPARE + (r // 12 if triple else r // 8 if top < 7 * (r + 1) else 0)
    groups = (r // 2 if triple else r) + 1 + spare
    wide = 3 * groups if triple else groups
    group = (textbytes.mix(s + np.uint64(level + 1)) % np.uint64(wide)).astype(np.int64)
    sums, sizes = np.zeros(wide, np.uint64), np.bincount(group, minlength=wide)
    np.add.at(sums, group, textbytes.mix(s))
    if triple:
        sums, sizes = sums.reshape(-1, 3), sizes.reshape(-1, 3)
        sums, sizes = sums.sum(1, keepdims=True, dtype=np.uint64) - sums, sizes.sum(1, keepdims=True) - sizes
        few = int((sizes == 0).any(1).sum()) <= spare
        sums, sizes = sums.ravel(), sizes.ravel()
    else:
        few = int((sizes == 0).sum()) <= spare
    names = textbytes.mix(textbytes.mix(sums) + np.arange(wide, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(level))
    return names[sizes > 0] if few else names


def combine(names: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, node) rows that tie the same nodes together, with each given name once.

    The least node of a name keeps it; each further one is tied to that by a name of the
    pair's own. So a name that very many sets bear leaves a batch as one row.
    """
    order = np.lexsort((nodes, names))
    names, nodes = names[order], nodes[order]
    first = np.flatnonzero(np.concatenate([np.ones(len(names[:1]), bool), names[1:] != names[:-1]]))
    hub = np.repeat(nodes[first], np.diff(np.append(first, len(names))))
    more = hub != nodes
    a, b = np.unique(np.stack([hub[more], nodes[more]], 1), axis=0).T
    own = textbytes.mix(textbytes.mix(a.astype(np.uint64)) + b.astype(np.uint64)).view(np.int64)
    return np.concatenate([names[first], own, own]), np.concatenate([nodes[first], a, b])


def _bytes(numbers: np.ndarray, width: int) -> bytes:
    """The low bytes of each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack(names: np.ndarray, nodes: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(part, width, names, nodes) of rows (name, node): a part's names, sorted, as bytes of their differences, and the nodes beside them."""
    short = names.view(np.uint64) >> np.uint64(64 - NAME_BITS)
    part, rest = (short % np.uint64(parts)).astype(np.int64), short // np.uint64(parts)
    order = np.lexsort((rest, part))
    part, rest, nodes = part[order], rest[order], nodes[order]
    edges = np.flatnonzero(np.concatenate([np.ones(len(part[:1]), bool), part[1:] != part[:-1]]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
        gaps = np.diff(rest[a:b], prepend=np.uint64(0))
        width = max(1, -(-int(gaps.max()).bit_length() // 8))
        yield int(part[a]), width, _bytes(gaps, width), _bytes(nodes[a:b], NODE_BYTES)


def tied(packed: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), each once: the nodes of every name of a part, tied to the least of them; packed is (width, names, nodes) of that part."""
    names = np.concatenate([np.cumsum(_numbers(data, width), dtype=np.uint64) for width, data, _ in packed])
    nodes = np.concatenate([_numbers(data, NODE_BYTES) for _, _, data in packed]).astype(np.int64)
    order = np.argsort(names, kind="stable")
    names, nodes = names[order], nodes[order]
    same = names[1:] == names[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])  # most names have one node
    names, nodes = names[shared], nodes[shared]
    order = np.lexsort((nodes, names))
    names, nodes = names[order], nodes[order]
    first = np.flatnonzero(np.concatenate([np.ones(len(names[:1]), bool), names[1:] != names[:-1]]))
    hub = np.repeat(nodes[first], np.diff(np.append(first, len(names))))
    more = hub != nodes
    a, b = np.unique(np.stack([hub[more], nodes[more]], 1), axis=0).T
    return a, b


class CountTree:
    """An R-tree, packed once, over count vectors sorted by set size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        edges = np.arange(0, len(sizes), LEAF)
        self.upper = np.maximum.reduceat(counts, edges, axis=0) if len(sizes) else counts
        self.low = sizes[edges] if len(sizes) else sizes
        self.high = sizes[np.minimum(edges + LEAF, len(sizes)) - 1] if len(sizes) else sizes
        tops = np.arange(0, len(edges), LEAF)
        self.top_upper = np.maximum.reduceat(self.upper, tops, axis=0) if len(edges) else self.upper
        self.top_low = self.low[tops] if len(edges) else self.low
        self.top_high = self.high[np.minimum(tops + LEAF, len(edges)) - 1] if len(edges) else self.high

    def search(self, point: np.ndarray, size: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Places, and bounds on the overlap, of the points that may link with this one."""

        def alive(rows: np.ndarray, low: np.ndarray, high: np.ndarray, upper: np.ndarray) -> np.ndarray:
            near = rows[(high[rows] * rule.over >= rule.share * size) & (low[rows] * rule.share <= rule.over * size)]
            bound = np.minimum(upper[near], point).sum(1)
            return near[bound >= rule.needed(np.maximum(low[near], -(-rule.share * size // rule.over)) + size)]

        tops = alive(np.arange(len(self.top_low)), self.top_low, self.top_high, self.top_upper)
        leaves = (tops[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = alive(leaves[leaves < len(self.low)], self.low, self.high, self.upper)
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.sizes)]
        bound = np.minimum(self.counts[rows], point).sum(1)
        good = bound >= rule.needed(self.sizes[rows] + size)
        return rows[good], bound[good]


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return rule.over * both >= rule.share * (len(a) + len(b) - both)


def join_block(sets: list[np.ndarray], side: np.ndarray, rule: Rule, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all linked pairs of a block connect.

    side: 0 and 1 for the two blocks of a task, whose own pairs other tasks see; one
    block alone has side 0 only, and all its pairs count. known: numbers of components that
    are connected already; a pair within one is skipped.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sets, side, sizes = [sets[i] for i in order], side[order], sizes[order]
    wide = 16
    while wide < 512 and 8 * wide < int(np.median(sizes)):
        wide *= 2
    counts = np.stack([np.bincount((s >> np.uint64(40)).astype(np.int64) % wide, minlength=wide) for s in sets]).astype(np.int32)
    cross = bool(side.any())
    if len(sets) == 2:  # a tree of one leaf: the bound, then the sets
        apart = (not cross or side[0] != side[1]) and (known is None or known[0] != known[1])
        near = apart and np.minimum(counts[0], counts[1]).sum() >= rule.needed(int(sizes.sum()))
        return [(1, 0)] if near and linked(sets[0], sets[1], rule) else []
    tree, links = CountTree(counts, sizes), []
    root = np.arange(len(sets)) if known is None else np.unique(known[order], return_inverse=True)[1]
    # shingles as small numbers, so that one set is compared with many by marking its own
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(int(max(c.max() for c in codes)) + 1, bool)
    for i in range(len(sets)):
        rows, bound = tree.search(counts[i], int(sizes[i]), rule)
        keep = (rows < i) & (root[rows] != root[i])
        if cross:
            keep &= side[rows] != side[i]
        rows, step = rows[keep][np.argsort(-bound[keep], kind="stable")], 1
        mark[codes[i]] = True
        while len(rows):  # the likeliest first, then ever more at once
            some, rows, step = rows[:step], rows[step:], min(4 * step, 1024)
            both = np.add.reduceat(mark[np.concatenate([codes[j] for j in some])].astype(np.int64), np.cumsum([0, *sizes[some[:-1]]]))
            for j in some[rule.over * both >= rule.share * (sizes[i] + sizes[some] - both)].tolist():
                if root[j] != root[i]:
                    links.append((int(order[i]), int(order[j])))
                    root[root == root[j]] = root[i]
            rows = rows[root[rows] != root[i]]
        mark[codes[i]] = False
    return links


def _named(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """id, key (of the text), n, h (name of the set) and nodes (its names in levels) of each row."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = rule.levels(1 << 12)
        for batch in batches:
            sets = []
            for s in shingle_sets(batch["text"].tolist(), rule.k):
                levels = levels if len(s) < levels[-2] else rule.levels(4 * len(s))
                h = set_hash(s)
                sets.append((len(s), h, [node(h, k) for k in levels_of(len(s), rule, levels)]))
            n, h, nodes = zip(*sets) if sets else ((), (), ())
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "n": n, "h": h, "nodes": nodes})

    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return given.mapInPandas(run, f"id {id_type}, key long, n long, h long, nodes array<long>")


def _candidates(docs: DataFrame, rule: Rule, text_col: str, parts: int) -> DataFrame:
    """Pairs (a, b) of nodes that have a name in common, each with the least of its name; names are met in so many parts."""

    def packed_rows(names: list[np.ndarray], nodes: list[np.ndarray]) -> pd.DataFrame:
        rows = pack(*combine(np.concatenate(names).view(np.int64), np.concatenate(nodes)), parts)
        return pd.DataFrame(list(rows), columns=["part", "width", "names", "nodes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = rule.levels(1 << 12)
        for batch in batches:
            names, sets, met, held = [], [], set(), 0
            for s in shingle_sets(batch["text"].tolist(), rule.k):
                levels = levels if len(s) < levels[-2] else rule.levels(4 * len(s))
                h = set_hash(s)
                if h in met:
                    continue
                met.add(h)
                for level in levels_of(len(s), rule, levels):
                    got = signatures(s, level, rule, levels)
                    names.append(got)
                    sets.append(np.full(len(got), node(h, level), np.int64))
                    held += len(got)
                if held >= HELD_NAMES:
                    yield packed_rows(names, sets)
                    names, sets, held = [], [], 0
            if names:
                yield packed_rows(names, sets)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for part, *packed in batch[["part", "width", "names", "nodes"]].itertuples(index=False, name=None):
                if part != at:
                    if held:
                        yield pd.DataFrame(dict(zip("ab", tied(held))))
                    at, held = part, []
                held.append(packed)
        if held:
            yield pd.DataFrame(dict(zip("ab", tied(held))))

    packed = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "part long, width int, names binary, nodes binary")
    # a task a part: what goes to Python in one batch is then bounded
    return packed.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").mapInPandas(meet, "a long, b long").distinct()


def _blocks(classes: Column, shingles: Column) -> Column:
    """How many blocks so many classes with so many shingles take."""
    return F.greatest(F.ceil(classes / BLOCK_CLASSES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _compared(docs: DataFrame, tiles: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) of set names, a task for each (cluster, i, j).

    tiles: h, id, key, known (component), cluster, and places, an array of (i, j, side) to which the set goes.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    met = rows.join(tiles, (F.col("row_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("id"))).select("h", "known", "cluster", "places", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [s.tobytes() for s in shingle_sets(batch["text"].tolist(), rule.k)]
            yield batch.drop(columns="text").assign(data=data)

    held = met.mapInPandas(sets, "h long, known long, cluster long, places array<struct<i:int,j:int,side:int>>, data binary")
    spread = held.select("h", "known", "cluster", F.explode("places").alias("at"), "data").select("h", "known", "cluster", "at.*", "data")

    def links(held: list[tuple]) -> list[tuple[int, int]]:
        held = list({r[0]: r for r in held}.values())  # rows of one id and one text may repeat
        if len(held) < 2:
            return []
        found = join_block([np.frombuffer(r[3], np.uint64) for r in held], np.array([r[2] for r in held]), rule, np.array([r[1] for r in held]))
        return [(held[a][0], held[b][0]) for a, b in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for batch in batches:
            for h, known, cluster, i, j, side, data in batch[["h", "known", "cluster", "i", "j", "side", "data"]].itertuples(index=False, name=None):
                if (cluster, i, j) != key:
                    out += links(held)
                    key, held = (cluster, i, j), []
                held.append((h, known, side, data))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(links(held), columns=["a", "b"], dtype="int64")

    return spread.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInPandas(run, "a long, b long")


def _place(i: Column, j: Column, side: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


def _with_roots(frame: DataFrame, roots: DataFrame, on: str) -> DataFrame:
    """frame with the column on replaced by the component that it is in, if it is in one."""
    return frame.join(roots.toDF(on, "_root"), on, "left").withColumn(on, F.coalesce("_root", on)).drop("_root")


def _roots(docs: DataFrame, members: DataFrame, rule: Rule, id_col: str, text_col: str) -> list[DataFrame]:
    """Tables (h, root), to be followed one after the other: first sets to components, then components to larger ones.

    members: id, key, n, h, cluster, a row for each class and level.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    # members meet only the clusters beyond a block, so that no cluster gathers its members in a task
    large = cut(sizes.select("cluster", _blocks(F.col("classes"), F.col("shingles")).alias("blocks")).where(F.col("blocks") > 1), "large")
    n_large = large.count()
    few = n_large <= BROADCAST_CLUSTERS
    placed = members.join(F.broadcast(large) if few else large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod("h", "blocks"))
    alone = placed.select("h", "id", "key", F.col("h").alias("known"), "cluster", F.array(_place(F.col("block"), F.col("block"), F.lit(0))).alias("places"))
    out = [components(_compared(docs, alone, rule, id_col, text_col)).toDF("h", "root")]
    if not n_large:
        return out
    inside = placed.where(F.col("blocks") > 1).select("cluster", "h", "id", "key", "n", F.col("h").alias("root"))
    inside = cut(_with_roots(inside, out[0], "root"), "inside")

    def joined(tiles: DataFrame) -> DataFrame | None:
        """Compares, and puts the components that grew together behind the others; None if none did."""
        nonlocal inside
        links = cut(_compared(docs, tiles, rule, id_col, text_col), "links")
        if not links.limit(1).count():
            return None
        root_of = inside.select("h", "root").distinct()
        edges = links.join(root_of.toDF("a", "x"), "a").join(root_of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        out.append(components(edges).toDF("h", "root"))
        inside = cut(_with_roots(inside, out[-1], "root"), "inside")
        return inside

    before = inside.groupBy("cluster").agg(F.count("*").alias("before"))
    while True:  # one representative of each component, in clusters where the last round left at most half as many
        first = inside.groupBy("cluster", "root").agg(F.min(F.struct("h", "id", "key", "n")).alias("r")).select("cluster", "root", "r.*")
        counts = first.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).join(before, "cluster").where((F.col("classes") > 1) & (2 * F.col("classes") <= F.col("before")))
        counts = cut(counts.select("cluster", "classes", _blocks(F.col("classes"), F.col("shingles")).alias("blocks")), "counts")
        more = counts.agg(F.max("blocks")).first()[0]
        if more is None:
            break
        dealt = first.join(counts, "cluster").withColumn("block", F.pmod(F.xxhash64("h", F.lit(len(out))), F.col("blocks")))
        tiles = dealt.select("h", "id", "key", F.col("root").alias("known"), "cluster", F.array(_place(F.col("block"), F.col("block"), F.lit(0))).alias("places"))
        before = counts.select("cluster", F.col("classes").alias("before"))
        if joined(tiles) is None or more == 1:
            break

    # what is left: members outside the largest component of their cluster meet all others of it.
    # Where they are most of the cluster its blocks, compared apart before, meet each other;
    # else the members outside are dealt into blocks of their own, and only these meet the rest.
    sums = inside.groupBy("cluster", "root").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    tops = sums.groupBy("cluster").agg(F.max(F.struct("classes", "root", "shingles")).alias("t"), F.sum("classes").alias("classes"), F.sum("shingles").alias("shingles"))
    rest = F.col("classes") - F.col("t.classes"), F.col("shingles") - F.col("t.shingles")
    apart = tops.where(rest[0] > 0).select(
        "cluster", F.col("t.root").alias("top"), (2 * rest[0] >= F.col("classes")).alias("dense"), _blocks(F.col("classes"), F.col("shingles")).alias("all"), _blocks(*rest).alias("odd"), _blocks(F.col("t.classes"), F.col("t.shingles")).alias("even")
    )
    apart = cut(apart, "apart")
    if apart.limit(1).count():
        is_odd = F.col("root") != F.col("top")
        block = F.when(F.col("dense"), F.pmod("h", "all")).when(is_odd, F.pmod("h", "odd")).otherwise(F.col("odd") + F.pmod("h", "even")).cast("long")
        last = F.when(F.col("dense"), F.col("all") - 1).when(is_odd, F.col("odd") + F.col("even") - 1).otherwise(F.col("odd") - 1).cast("long")
        dealt = inside.join(apart, "cluster").withColumn("block", block).withColumn("last", last)
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda other: ~F.col("dense") | (other != F.col("block")))
        places = F.transform(others, lambda other: _place(F.least("block", other), F.greatest("block", other), F.col("block") > other))
        joined(dealt.select("h", "id", "key", F.col("root").alias("known"), "cluster", places.alias("places")))
    return out


def jaccard_components(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, key (of the text), n_shingles, component_id, root.

    component_id is the least id reachable over links, root a number of the component (null
    for empty sets). Null texts and texts without words have an empty set and stand alone,
    under their own id. Rows of equal sets are one class; a null id never names a component
    unless all of its rows have null. Whole texts are read, whatever their length; other
    columns are not. An empty table gives no rows.
    """
    named = cut(_named(docs, rule, id_col, text_col), "sets")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n", "nodes"))
    classes = cut(named.where(F.col("n") > 0).groupBy("h").agg(first.alias("r")).select("h", "r.id", "r.key", "r.n", "r.nodes"), "classes")
    shingles = named.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // PART_SHINGLES))
    clusters = components(_candidates(docs, rule, text_col, parts)).select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    members = cut(classes.select("h", "id", "key", "n", F.explode("nodes").alias("node")).join(clusters, "node").drop("node"), "members")
    found = classes.select("h", "id", F.col("h").alias("root"))
    for roots in _roots(docs, members, rule, id_col, text_col):
        found = _with_roots(found, roots, "root")
    found = cut(found, "roots")
    least = found.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = found.join(least, "root").select("h", "root", "component_id")
    full = named.where(F.col("n") > 0).join(by_class, "h").select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), "component_id", "root")
    empty = named.where(F.col("n") == 0).select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.union(empty)
