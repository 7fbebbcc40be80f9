"""Best-fit packing of tokenised documents into sequences.

Documents are encoded where they are read; from then on only (document, piece, length,
checksum) rows move. These are dealt into shares of at most about SHARE pieces by a hash,
and each share is packed by best-fit decreasing. A share leaves about one poorly filled
sequence in tens of thousands, so packing shares apart costs next to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.codecs import codec
from tallyloom.llm.runtime import cut

#: Pieces packed together in one task (a few MB there).
SHARE = 65_536


class OpenBins:
    """Open bins by remaining room: a segment tree over the rooms 0..size.

    A node counts the open bins below it. The tightest bin that takes a piece is the
    first non-empty leaf at or after its length, found in O(log size).
    """

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least room that is at least length, removed; None if there is none."""
        count, at = self.count, length + self.leaves
        while not count[at]:
            while at & 1:  # up until a right neighbour exists
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        number = self.bins[room].pop()
        while at:
            count[at] -= 1
            at //= 2
        return room, number


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece; lengths are 0..size."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = OpenBins(size), 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        found = tree.take(n) if n < size else None
        if found is None:
            found, made = (size, made), made + 1
        room, number = found
        bins[i], offsets[i] = number, size - room
        if room > n:
            tree.add(room - n, number)
    return bins, offsets


def tokenised_pieces(docs: DataFrame, path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with end_id appended, cut into pieces of size ids where longer.

    Only the first piece of a cut document may be shorter. One row per piece: id, piece
    (from 0), start (ids of the document before it), length, ids_crc32.
    """
    id_type = dict(docs.dtypes)[id_col]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = codec(path, spaced=True).encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInPandas(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, size: int, share: int = SHARE) -> DataFrame:
    """pieces (any columns, among them length long, 0..size) with sequence_id and offset.

    The share of a piece is a hash of the whole row, so equal rows may meet in a share
    but no key can gather rows there beyond its own repeats.
    """
    n = max(1, -(-pieces.count() // share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        rows = rows.sort_values(rows.columns.tolist(), ignore_index=True)  # the same bins if the task runs again
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), size)
        yield rows.assign(sequence_id=bins + (TaskContext.get().partitionId() << 40), offset=offsets)

    schema = ", ".join(f"`{c}` {t}" for c, t in [*pieces.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])
    return pieces.repartition(n, F.xxhash64(*pieces.columns)).mapInPandas(run, schema)


def best_fit_pack(docs: DataFrame, path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in sequences of at most size tokens: one row per piece.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are one piece that holds the end id. Repeated rows are packed each. An empty
    table gives no rows; other columns of docs are not read.
    """
    return pack(cut(tokenised_pieces(docs, path, end_id, size, id_col, text_col), "pieces"), size)
