"""Token counts by the whole-token shortcut.

Before any text is read, the driver proves which vocabulary strings encode alone as one
token: it encodes each of them. Text that matches one of these strings between two cuts
counts as one token without a merge; only the rest is merged by the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.codecs import KEEP, KEEP_CHARS, PieceCodec, codec


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, alone, encode as one token: at most one for each vocabulary entry."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    names = sorted(t.removesuffix("</w>") for t in tokenizer.get_vocab() if t.endswith("</w>") and t.isascii())
    names = [t for t in names if t.isalpha() and t == t.lower()]
    encoded = tokenizer.encode_batch(names, add_special_tokens=False)
    return frozenset(t for t, e in zip(names, encoded) if len(e.ids) == 1)


class _Counts(dict):
    """Piece -> number of tokens; starts with the proven ones and learns the rest."""

    def __init__(self, whole: frozenset[str], pieces: PieceCodec):
        super().__init__(dict.fromkeys(whole, 1))
        self.pieces, self.fixed = pieces, len(whole)

    def __missing__(self, piece: str) -> int:
        words = self.pieces.words_of(piece)
        if words is None:
            n = len(self.pieces.library(piece)) // 4
        elif len(words) == 1 and words[0] == piece:
            n = len(self.pieces.merge(piece)) // 4
        else:  # a word among them may be a whole token
            n = sum(map(self.__getitem__, words))
        if len(piece) <= KEEP_CHARS:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > self.fixed + KEEP:
            first = list(islice(self.items(), self.fixed + KEEP // 5))
            self.clear()
            self.update(first)
        if self.pieces.whole(text):
            return len(self.pieces.library(text)) // 4
        return sum(map(self.__getitem__, text.split()))


_counts: dict[str, _Counts] = {}


def count_tokens(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of a text by the vocabulary at path (one whose words carry no space).

    Null counts as empty: 0. The table of proven strings is broadcast; the vocabulary
    bounds its size.
    """
    proven = spark.sparkContext.broadcast(whole_tokens(path))

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counts:
            _counts[path] = _Counts(proven.value, codec(path, spaced=False))
        counts = _counts[path]
        for texts in batches:
            yield pd.Series([counts.count(t) if t else 0 for t in texts], dtype="int64")

    return run(text)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows, an
    empty table an empty one; other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), count_tokens(docs.sparkSession, F.col(text_col), path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
