"""Hard negatives for contrastive training, from inverted lists with exact bounds.

Rows are dealt to the centroids of a k-means fitted on a bounded sample. Sorted by
centroid and label they are cut into lists of one label, each stored with its own
centroid and radius, and runs of lists make shards. For an anchor a and a list of
centroid c and radius r, Cauchy-Schwarz bounds every inner product by a.c + |a| r above and
a.c - |a| r below. A search visits a shard's lists by descending upper bound, skips those
wholly outside the window that is asked for, and stops an anchor once its bound falls
strictly below the kth score it has. Anchors travel in blocks; a block first meets its own
shard, which gives it a kth score, and then only the shards whose bound reaches it.

There are two searches: the best rows of the anchor's label (its positives), and the best
rows of other labels within a window of each positive's score. The centroids only decide
how much is skipped: results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.runtime import cut

#: Rows that the centroids are fitted on, rows for each centroid, the most centroids, rounds of fitting.
SAMPLE, ROWS_PER_CENTROID, MOST_CENTROIDS, ROUNDS = 8192, 512, 256, 8
#: Rows of a list; rows and lists at which a shard is closed; anchors of a block.
LIST, SHARD_ROWS, SHARD_LISTS, BLOCK = 512, 16_384, 1024, 256
#: Scaled components end here on both sides, so that scores fit 64 bits.
LIMIT = 1 << 24
#: Groups of shards that a block is sent to when blocks look for shards.
_GROUPS = 64


@dataclass(frozen=True)
class Mining:
    """positives an anchor has at most, negatives of each, and the window low/over to high/over of the positive's score."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    over: int = 100
    scale: int = 256


def centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means by Lloyd's rounds from evenly spaced rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(sample, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row; ties go to the first."""
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two integer matrices."""
    size = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if size < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)  # every partial sum is a whole number that doubles hold
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Shard:
    """Lists of rows: label and end of each list, its centroid and radius, ids and integer vectors in list order."""

    labels: list
    ends: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    ids: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, row) -> Shard:
        ids = np.frombuffer(row.ids, np.int64)
        ends = np.frombuffer(row.ends, np.int64)
        return cls(list(row.labels), ends, np.frombuffer(row.centre, float).reshape(len(ends), row.size), np.frombuffer(row.radius, float), ids, np.frombuffer(row.data, np.int32).reshape(len(ids), row.size))

    def search(self, a: np.ndarray, own: np.ndarray, labels: list, same: bool, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and window: the k best scores of rows, greatest first, and their ids; -1 << 62 where there are fewer.

        a: anchors' vectors; own: their ids, whose rows do not count; same: whether rows of
        the anchor's label are sought or of other labels. low, high, least: windows of
        scores and the score that a row must reach, (anchors, windows).
        """
        none = np.int64(-1) << np.int64(62)
        m, w = low.shape
        top, who = np.full((m, w, k), none), np.full((m, w, k), np.iinfo(np.int64).max)
        if not m:
            return top, who
        norm = np.sqrt((a.astype(float) ** 2).sum(1))
        middle = a.astype(float) @ self.centre.T
        reach = norm[:, None] * self.radius
        slack = 1e-9 * (norm[:, None] * np.sqrt((self.centre**2).sum(1)) + reach) + 1e-3  # scores are whole numbers
        above, below = middle + reach + slack, middle - reach - slack
        codes = {label: i for i, label in enumerate(dict.fromkeys([*labels, *self.labels]))}
        kind, of_list = np.array([codes[x] for x in labels]), np.array([codes[x] for x in self.labels])
        usable = (kind[:, None] == of_list) == same
        for i in np.argsort(-np.where(usable, above, -np.inf).max(0), kind="stable"):
            kth = np.maximum(np.maximum(top[:, :, -1], least), low)  # a row below it is not among the k
            alive = usable[:, i, None] & (above[:, i, None] >= kth) & (below[:, i, None] <= high)
            rows = np.flatnonzero(alive.any(1))
            if not len(rows):
                continue
            begin, end = (self.ends[i - 1] if i else 0), self.ends[i]
            ids = self.ids[begin:end]
            score = _dot(a[rows], self.x[begin:end])
            for j in range(w):
                fits = (score >= kth[rows, j, None]) & (score <= high[rows, j, None]) & (ids != own[rows, None])
                some = np.flatnonzero(fits.any(1))
                if not len(some):
                    continue
                found = np.where(fits[some], score[some], none)
                best = np.argsort(-found, axis=1, kind="stable")[:, :k]  # ids ascend within a list, so ties go to the smaller
                found = np.take_along_axis(found, best, 1)
                names = np.where(found > none, ids[best], np.iinfo(np.int64).max)
                at = rows[some]
                scores, names = np.concatenate([top[at, j], found], 1), np.concatenate([who[at, j], names], 1)
                order = np.lexsort((names, -scores), axis=1)[:, :k]
                top[at, j], who[at, j] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        return top, who


def _sound(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """id, label, is_anchor and the scaled vector of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x).cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT))).cast("int"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), v.alias("v"), whole.alias("x"))
    return given.where(sound).select("id", "label", "is_anchor", "x", F.size("x").alias("size"))


def _fitted(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by vector length, for the commonest lengths; rows of others are one cluster, which is as right."""
    counts = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(8).collect()
    out = {}
    for size, n in counts:
        share = int((1 << 20) * min(1.0, SAMPLE / n))
        drawn = rows.where((F.col("size") == size) & (F.pmod(F.xxhash64("id", "x"), F.lit(1 << 20)) < share)).select("x").limit(2 * SAMPLE).toPandas()
        if len(drawn) and size:
            out[size] = centroids(np.stack(drawn["x"]).astype(float), max(1, min(MOST_CENTROIDS, n // ROWS_PER_CENTROID)))
    return out


def _pack(kind: int, shard: int, number: int, size: int, labels: list, ends, centre, radius, ids, x, seeds) -> tuple:
    return kind, shard, number, size, labels, ends.tobytes(), centre.tobytes(), radius.tobytes(), ids.tobytes(), x.astype(np.int32).tobytes(), seeds.tobytes()


def _index(rows: DataFrame, label_type: str, mining: Mining) -> DataFrame:
    """Shards (kind 0: lists) and the blocks of the anchors that stand in them (kind 1: each label and end is an anchor's).

    A block has its own ball as centre and radius, and as seeds the kth best score of its
    label in its own shard, which its true kth score cannot be below.
    """
    fitted = _fitted(rows)

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, same in batch.groupby("size"):
                near = nearest(np.stack(same["x"]).astype(float), fitted[size]) if size in fitted else 0
                yield same.assign(cluster=near)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["size", "cluster", "label", "id", F.xxhash64("x")]
    placed = rows.mapInPandas(cluster, f"id long, label {label_type}, is_anchor boolean, x array<int>, size int, cluster int")
    dealt = cut(placed, "clusters").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        lists: list[tuple] = []  # (key, ids, vectors, anchors)
        held: list[tuple] = []
        key = None

        def close() -> None:
            if held:
                lists.append((key, np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int32).reshape(len(held), key[0]), np.array([h[2] for h in held], bool)))
                held.clear()

        def shard() -> pd.DataFrame:
            size, labels = lists[0][0][0], [each[0][2] for each in lists]
            ids, x = np.concatenate([each[1] for each in lists]), np.concatenate([each[2] for each in lists])
            ends = np.cumsum([len(each[1]) for each in lists])
            centre = np.stack([each[2].mean(0) if size else np.zeros(0) for each in lists])
            radius = np.array([_radius(each[2], c) for each, c in zip(lists, centre)])
            made = Shard(labels, ends, centre, radius, ids, x)
            ball = x.mean(0) if size else np.zeros(0)
            out = [_pack(0, number, number, size, labels, ends, centre, radius, ids, x, np.append(ball, _radius(x, ball)))]
            anchors = np.flatnonzero(np.concatenate([each[3] for each in lists]))
            for k, at in enumerate(np.split(anchors, range(BLOCK, len(anchors), BLOCK)) if len(anchors) else []):
                names = [labels[np.searchsorted(ends, i, side="right")] for i in at]
                whole = np.full((len(at), 1), np.iinfo(np.int64).max)
                top, _ = made.search(x[at], ids[at], names, True, -whole, whole, -whole, mining.positives)
                middle = x[at].mean(0) if size else np.zeros(0)
                out.append(_pack(1, number, (number << 8) + k, size, names, np.arange(1, len(at) + 1), middle, np.array([_radius(x[at], middle)]), ids[at], x[at], top[:, 0, -1]))
            lists.clear()
            return pd.DataFrame(out, columns=["kind", "shard", "number", "size", "labels", "ends", "centre", "radius", "ids", "data", "seeds"])

        for batch in batches:
            for i, label, is_anchor, x, size, near in zip(batch["id"].tolist(), batch["label"].tolist(), batch["is_anchor"].tolist(), batch["x"], batch["size"].tolist(), batch["cluster"].tolist()):
                if (size, near, label) != key or len(held) == LIST:
                    close()
                    if lists and (len(lists) >= SHARD_LISTS or sum(len(each[1]) for each in lists) >= SHARD_ROWS or lists[0][0][0] != size):
                        yield shard()
                        number += 1
                    key = (size, near, label)
                held.append((i, x, is_anchor))
        close()
        if lists:
            yield shard()

    kind = f"kind int, shard long, number long, size int, labels array<{label_type}>, ends binary, centre binary, radius binary, ids binary, data binary, seeds binary"
    return cut(dealt.select("id", "label", "is_anchor", "x", "size", "cluster").mapInPandas(build, kind), "lists")


def _radius(x: np.ndarray, c: np.ndarray) -> float:
    return float(np.sqrt(((x - c) ** 2).sum(1).max(initial=0))) * (1 + 1e-9)


def _meetings(blocks: DataFrame, shards: DataFrame, asked: DataFrame | None, own: bool) -> DataFrame:
    """number and shard of the blocks and shards that must meet.

    own: each block with its own shard. Otherwise every block with every other shard of its
    vector length whose ball reaches the least score that the block still asks for (asked:
    number, least). Balls alone travel: one row a block and one a shard, dealt by groups of shards.
    """
    if own:
        return blocks.select("number", "shard")
    balls = shards.select(F.col("shard").alias("other"), "size", F.col("seeds").alias("ball"), F.pmod("shard", F.lit(_GROUPS)).alias("group"))
    sides = blocks.select("number", "shard", "size", "centre", "radius").join(asked, "number").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(_GROUPS - 1))))
    pairs = sides.join(balls, ["group", "size"]).where(F.col("shard") != F.col("other"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for _, same in batch.groupby("size"):
                at = batch.index.get_indexer(same.index)
                c = np.frombuffer(b"".join(same["centre"])).reshape(len(same), -1)
                ball = np.frombuffer(b"".join(same["ball"])).reshape(len(same), -1)
                r, s, d = np.frombuffer(b"".join(same["radius"])), ball[:, -1], ball[:, :-1]
                nc, nd = np.sqrt((c * c).sum(1)), np.sqrt((d * d).sum(1))
                most = ((c * d).sum(1) + nc * s + nd * r + r * s) + 1e-9 * (nc + r) * (nd + s) + 1e-3
                keep[at] = most >= same["least"].to_numpy()
            yield pd.DataFrame({"number": batch["number"], "shard": batch["other"]})[keep]

    return pairs.select("number", "other", "size", "centre", "radius", "ball", "least").mapInPandas(reach, "number long, shard long")


def _searched(index: DataFrame, meetings: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor (number in block), j (window), id, score: the best k of each met shard. windows: number, low, high, least (long matrices as bytes)."""
    shards = index.where("kind = 0").select("shard", "size", *[F.col(c).alias(f"s_{c}") for c in ("labels", "ends", "centre", "radius", "ids", "data")])
    blocks = index.where("kind = 1").select("number", "labels", "ids", "data")
    joined = meetings.join(blocks, "number").join(windows, "number").join(shards, "shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ends = np.frombuffer(r.s_ends, np.int64)
                ids = np.frombuffer(r.s_ids, np.int64)
                shard = Shard(list(r.s_labels), ends, np.frombuffer(r.s_centre).reshape(len(ends), r.size), np.frombuffer(r.s_radius), ids, np.frombuffer(r.s_data, np.int32).reshape(len(ids), r.size))
                own = np.frombuffer(r.ids, np.int64)
                low, high, least = (np.frombuffer(x, np.int64).reshape(len(own), -1) for x in (r.low, r.high, r.least))
                top, who = shard.search(np.frombuffer(r.data, np.int32).reshape(len(own), r.size), own, list(r.labels), same, low, high, least, k)
                a, j, place = np.nonzero(who != np.iinfo(np.int64).max)
                if len(a):
                    yield pd.DataFrame({"number": r.number, "anchor": a, "j": j, "id": who[a, j, place], "score": top[a, j, place]})

    return joined.mapInPandas(run, "number long, anchor int, j int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window with their rank; the sort of a window keeps k rows a task before the shuffle."""
    order = Window.partitionBy("number", "anchor", "j").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, label: Column | None = None, mining: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:  # noqa: B008
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x) (held within LIMIT); a score is the integer inner
    product. anchor says which rows are anchors, label what a row's label is (the column
    itself if none is given). An anchor's positives are its best rows of its label and of
    other ids; the negatives of a positive are the best rows of other labels with low *
    positive score <= over * score <= high * positive score. Ties go to the smaller id. Rows
    with a null id, label or vector or a null or non-finite component take no part; vectors of
    different lengths do not meet, empty ones score 0. Every row of a repeated id is a row of
    its own, and so is every anchor row; ids are integers, labels of any type with an order.
    Empty tables and anchors without positives give no rows. Other columns are not read.
    """
    label_type = rows.select((label if label is not None else F.col(f"`{label_col}`")).alias("label")).schema["label"].dataType.simpleString()
    sound = cut(_sound(rows, id_col, vector_col, label if label is not None else F.col(f"`{label_col}`"), anchor, mining.scale), "vectors")
    index = _index(sound, label_type, mining)
    blocks, shards = index.where("kind = 1"), index.where("kind = 0")
    most = np.iinfo(np.int64).max

    def open_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All scores, from the kth that the block's own shard gave."""
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                seeds = np.frombuffer(r.seeds, np.int64)
                whole = np.full(len(seeds), most)
                out.append((r.number, (-whole).tobytes(), whole.tobytes(), seeds.tobytes(), float(seeds.min(initial=most))))
            yield pd.DataFrame(out, columns=["number", "low", "high", "least", "asked"])

    shape = "number long, low binary, high binary, least binary, asked double"
    windows = blocks.select("number", "seeds").mapInPandas(open_windows, shape)
    asked = windows.select("number", F.col("asked").alias("least"))
    meetings = _meetings(blocks, shards, None, own=True).union(_meetings(blocks, shards, asked, own=False))
    positives = cut(_best(_searched(index, meetings, windows.drop("asked"), True, mining.positives), mining.positives).select("number", "anchor", "rank", "id", "score"), "positives")

    def windowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A window for each positive; a missing one has an empty window."""
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                low, high = (np.full((r.n, mining.positives), x) for x in (most, -most))
                for p in r.positives:
                    s = int(p["score"])
                    low[p["anchor"], p["rank"] - 1] = -(-mining.low * s // mining.over)
                    high[p["anchor"], p["rank"] - 1] = mining.high * s // mining.over
                least = low.copy() if r.seen is None else np.frombuffer(r.seen, np.int64).reshape(low.shape)
                out.append((r.number, low.tobytes(), high.tobytes(), least.tobytes(), float(np.where(low <= high, np.maximum(low, least), most).min())))
            yield pd.DataFrame(out, columns=["number", "low", "high", "least", "asked"])

    per_block = positives.groupBy("number").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("positives"))  # a block's anchors times their positives
    sized = blocks.select("number", F.size("labels").alias("n")).join(per_block, "number")
    windows = cut(sized.withColumn("seen", F.lit(None).cast("binary")).mapInPandas(windowed, shape), "windows")
    near = cut(_searched(index, _meetings(blocks, shards, None, own=True), windows.drop("asked"), False, mining.negatives), "near")

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows with the kth scores that the own shard gave as what a row must reach."""
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                low, high = np.frombuffer(r.low, np.int64), np.frombuffer(r.high, np.int64)
                least = low.copy()
                for p in r.kth if r.kth is not None else ():
                    at = p["anchor"] * mining.positives + p["j"]
                    least[at] = max(least[at], p["score"])
                out.append((r.number, r.low, r.high, least.tobytes(), float(np.where(low <= high, least, most).min(initial=most))))
            yield pd.DataFrame(out, columns=["number", "low", "high", "least", "asked"])

    kth = near.groupBy("number", "anchor", "j").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == mining.negatives)
    kth = kth.groupBy("number").agg(F.collect_list(F.struct("anchor", "j", "score")).alias("kth"))
    windows = cut(windows.join(kth, "number", "left").select("number", "low", "high", "kth").mapInPandas(seeded, shape), "windows")
    far = _searched(index, _meetings(blocks, shards, windows.select("number", F.col("asked").alias("least")), own=False), windows.drop("asked"), False, mining.negatives)
    negatives = _best(near.union(far), mining.negatives)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"number": r.number, "anchor": np.arange(len(ids)), "anchor_id": ids})

    names = blocks.select("number", "ids").mapInPandas(named, "number long, anchor int, anchor_id long")
    chosen = positives.select("number", "anchor", (F.col("rank") - 1).alias("j"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(chosen, ["number", "anchor", "j"]).join(names, ["number", "anchor"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
