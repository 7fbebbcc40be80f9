"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as bit planes, most significant bit
first, each plane's zeros before its ones in the next (a wavelet matrix). The file has
for each plane a running count of ones per block (its rank directory), so a plane answers
rank and select by reading one count and at most one block, and one shard file gives any
token, how often an id occurs before a place, and where its k-th occurrence is, without
being decoded. Shards are the rows of a compressed Parquet table, one row to a file; the
documents' ids stand beside them as text, so that they may be of any type.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.codecs import codec
from tallyloom.llm.runtime import free

#: Ids in a shard, more only where its last document is longer (2 bits to 16 MB of planes).
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sBxxxQQ")
_MAGIC = b"WMT2"
#: Bits of a plane to one count of its rank directory.
_BLOCK = 512
_POP = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def encode_shard(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of a shard: head, document ends (uint64), zeros per plane, rank directories (uint32), planes."""
    levels = max(1, int(ids.max(initial=0)).bit_length())
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, planes, sums = [], [], []
    for shift in range(levels - 1, -1, -1):
        ones = (x & x.dtype.type(1 << shift)) != 0
        plane = np.packbits(ones)
        planes.append(plane.tobytes())
        sums.append(_directory(plane).tobytes())
        low = np.flatnonzero(~ones)  # taking by place is twice as fast as by mask here
        zeros.append(len(low))
        x = np.concatenate([x.take(low), x.take(np.flatnonzero(ones))])
    return b"".join([_HEAD.pack(_MAGIC, levels, len(ids), len(ends)), ends.astype("<u8").tobytes(), np.array(zeros, "<u8").tobytes(), *sums, *planes])


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane."""
    starts = np.arange(0, len(plane), _BLOCK // 8)
    each = np.add.reduceat(_POP[plane], starts, dtype=np.uint32) if len(plane) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(each)]).astype("<u4")


class Shard:
    """Reads a shard's file; only decode() unpacks all of it."""

    def __init__(self, data: bytes):
        magic, self.levels, self.n, docs = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        at = _HEAD.size
        self.ends = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        self.zeros = np.frombuffer(data, "<u8", self.levels, at + 8 * docs).astype(np.int64)
        at, width = at + 8 * docs + 8 * self.levels, (self.n + 7) // 8
        counts = -(-width // (_BLOCK // 8)) + 1
        self.sums = np.frombuffer(data, "<u4", counts * self.levels, at).reshape(self.levels, counts)
        at += 4 * counts * self.levels
        self.planes = [np.frombuffer(data, np.uint8, width, at + k * width) for k in range(self.levels)]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // _BLOCK
        ones, plane, start = int(self.sums[level, block]), self.planes[level], block * _BLOCK // 8
        ones += int(_POP[plane[start : i // 8]].sum(dtype=np.int64))
        return ones + (int(_POP[plane[i // 8] >> (8 - i % 8)]) if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value, i = 2 * value + bit, int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of token among the first i ids lie below the last plane."""
        low, high = 0, i
        for k in range(self.levels):
            a, b = self._rank1(k, low), self._rank1(k, high)
            if token >> (self.levels - 1 - k) & 1:
                low, high = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of token among the first i ids (all, if i is left out)."""
        if token < 0 or token >> self.levels:
            return 0
        low, high = self._range(token, self.n if i is None else min(i, self.n))
        return high - low

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of token, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of this kind in a plane, from 0."""
        sums = self.sums[level].astype(np.int64)
        before = sums if bit else np.minimum(np.arange(len(sums)) * _BLOCK, self.n) - sums
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * _BLOCK
        bits = np.unpackbits(self.planes[level][start // 8 : (start + _BLOCK) // 8], count=min(_BLOCK, self.n - start))
        return start + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            ones, zeros = np.unpackbits(self.planes[k], count=self.n).view(bool), int(self.zeros[k])
            up = np.empty_like(x)
            up[np.flatnonzero(ones)] = x[zeros:] | x.dtype.type(1 << (self.levels - 1 - k))
            up[np.flatnonzero(~ones)] = x[:zeros]
            x = up
        return x.astype("<u4")


def write_token_store(docs: DataFrame, out: str, path: str, end_id: int, parts: int, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs (whole texts, null as empty, each followed by end_id) into shards at out.

    Shards hold whole documents in ascending id order, rows with a null id first. The rows
    are dealt by ranges of the id and a hash of the text, so that repeats of one id can be
    spread; each part is encoded and cut into shards as it streams by. Ids may be of any
    type that has an order and a text form. Columns of the table: shard_no (ascends with the
    ids), first_id, n_docs, n_tokens, ids (as text), shard (the file's bytes). An empty
    table gives none; other columns of docs are not read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, held, ids, size = codec(path, spaced=False).encode, [], [], 0
        number = TaskContext.get().partitionId() << 32

        def shard() -> pd.DataFrame:
            ends = np.cumsum([len(h) // 4 for h in held], dtype=np.int64)
            data = encode_shard(np.frombuffer(b"".join(held), "<u4"), ends)
            return pd.DataFrame({"shard_no": [number], "first_id": [ids[0]], "n_docs": [len(ids)], "n_tokens": [size], "ids": [ids], "shard": [data]})

        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["text"]):
                coded = encode(text) + end
                held.append(coded)
                ids.append(doc)
                size += len(coded) // 4
                if size >= shard_tokens:
                    yield shard()
                    held, ids, size, number = [], [], 0, number + 1
        if held:
            yield shard()

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]  # a task that runs again makes the same shards
    dealt = given.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.col("id").cast("string").alias("id"), "text")
    made = dealt.mapInPandas(run, "shard_no long, first_id string, n_docs long, n_tokens long, ids array<string>, shard binary")
    id_type = docs.schema[id_col].dataType
    made.withColumn("first_id", F.col("first_id").cast(id_type)).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(out)


def _bases(table: DataFrame) -> DataFrame:
    """shard_no and base, the ids in all shards before it, in two steps: within the parts that wrote the shards, and over these parts."""
    heads = table.select("shard_no", "n_tokens", F.shiftright("shard_no", 32).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("part").orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    within = heads.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return within.join(parts, "part").select("shard_no", (F.col("earlier") + F.col("within")).alias("base"))


def read_token_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per stored document, read back from the shards' files.

    id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    table = spark.read.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, names, data in zip(batch["shard_no"], batch["ids"], batch["shard"]):
                shard = Shard(data)
                ids, cuts = shard.decode().tobytes(), np.append(0, shard.ends)
                checks = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pd.DataFrame({"id": names, "shard_no": number, "within": cuts[:-1], "n_tokens": np.diff(cuts), "ids_crc32": checks})

    rows = table.select("shard_no", "ids", "shard").mapInPandas(run, "id string, shard_no long, within long, n_tokens long, ids_crc32 long")
    joined = rows.join(_bases(table), "shard_no")
    return joined.select(F.col("id").cast(table.schema["first_id"].dataType).alias(id_col), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_occurrences(spark: SparkSession, path: str, tokens: list[int], places: bool = True) -> DataFrame:
    """Where token ids stand in a store: token, shard_no, n (in that shard), places (from the store's start, ascending).

    Counts come from two ranks for each plane and places from selects; no shard is decoded.
    Shards that do not hold a token give no row for it; without places the column is null.
    """
    table, wanted = spark.read.parquet(path), sorted(set(tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, data in zip(batch["shard_no"], batch["shard"]):
                shard, rows = Shard(data), []
                for token in wanted:
                    if n := shard.count(token):
                        rows.append((token, number, n, [shard.locate(token, k) for k in range(n)] if places else None))
                yield pd.DataFrame(rows, columns=["token", "shard_no", "n", "within"])

    rows = table.select("shard_no", "shard").mapInPandas(run, "token long, shard_no long, n long, within array<long>").join(_bases(table), "shard_no")
    return rows.select("token", "shard_no", "n", F.transform("within", lambda x: x + F.col("base")).alias("places"))


def tokens_at(store_places: DataFrame, path: str, place_col: str = "place") -> DataFrame:
    """store_places with the column token: the id at each place of the store, null beyond it or where the place is null.

    Places meet the shards by ranges of the store; each is read by one walk down the planes.
    Columns may have any names; the new one has a _ behind it while store_places has that name.
    """
    spark, name = store_places.sparkSession, free("token", store_places.columns)
    place, at = F.col(f"`{place_col}`"), free("_at", store_places.columns, [name])
    token = free("_found", store_places.columns, [name, at])
    table = spark.read.parquet(path)
    ends = table.select("shard_no", "n_tokens").join(_bases(table), "shard_no").select("shard_no", F.col("base").alias("low"), (F.col("base") + F.col("n_tokens")).alias("high"))
    wide = 1 << 20
    cells = ends.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {wide}"), F.expr(f"(high - 1) div {wide}"))))
    asked = store_places.select(place.cast("long").alias("at")).distinct().withColumn("cell", F.expr(f"at div {wide}"))
    met = asked.join(cells, "cell").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("shard_no", "at", (F.col("at") - F.col("low")).alias("within"))
    lists = met.groupBy("shard_no").agg(F.collect_list(F.struct("at", "within")).alias("asked"))  # at most a shard's places

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, data in zip(batch["asked"], batch["shard"]):
                shard = Shard(data)
                yield pd.DataFrame([(r["at"], shard.access(int(r["within"]))) for r in asked], columns=["at", "found"])

    found = lists.join(table.select("shard_no", "shard"), "shard_no").select("asked", "shard").mapInPandas(run, "at long, found long")
    return store_places.join(found.toDF(at, token), place == F.col(at), "left").select(*[F.col(f"`{c}`") for c in store_places.columns], F.col(token).alias(name))
