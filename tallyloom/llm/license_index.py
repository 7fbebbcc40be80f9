"""Licence statements found by a positional index of their rarest words.

A template is a run of words, some of them mandatory key phrases, and the share of its
words that must match at one alignment. Its words are ordered by their inverse document
frequency over all texts scanned. Every match holds the rarest mandatory word; without key
phrases, if m of n words must match, it holds one of the n - m + 1 rarest. These alone are
indexed, as word -> (template, position). The licence words of a text that the index holds,
those of highest inverse frequency, give alignments (place in the text minus position in
the template); the postings of a template are intersected by alignment, first those of the
key phrases, then all others. So no template is missed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes

#: Templates that one scan takes, and words of one: they bound the index, which goes to every task.
MAX_TEMPLATES, MAX_WORDS = 10_000, 1_000
#: Share of a statement's words that must match.
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    """A statement of a licence. keys: phrases of it that must match word by word; share: of its words, in (0, 1]."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = SHARE
    base: bool = False


def phrase(label: str, text: str) -> Template:
    """A phrase that must stand word by word."""
    return Template(label, text, (text,), 1.0, base=True)


#: Phrases whose every place counts.
BASE = (phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved"))
#: Statements by which public licences are known, and the words of them that must stand.
STATEMENTS = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ("distribute this software",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
)

_PLACES = "array<struct<label:string,start:bigint,n:int,coverage:double,base:boolean>>"


def _hashes(text: str) -> np.ndarray:
    """Hashes of the words of one text."""
    (_, _, data, starts), *_ = textbytes.blocks([text], 1)
    return textbytes.words(data, starts)[2]


def _least(template: Template, n: int) -> int:
    """How many of n words must match; a count that rounding puts just above a whole number is that number."""
    return max(1, int(np.ceil(template.share * n - 1e-9)))


@dataclass
class Vocabulary:
    """The templates' words: sorted hashes, each template's words as numbers into them and its mandatory positions."""

    templates: tuple[Template, ...]

    def __post_init__(self) -> None:
        found = [_hashes(t.text) for t in self.templates]
        if len(found) > MAX_TEMPLATES or any(not 1 <= len(f) <= MAX_WORDS for f in found):
            raise ValueError(f"up to {MAX_TEMPLATES} templates of 1 to {MAX_WORDS} words")
        self.hashes = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        self.words = [np.searchsorted(self.hashes, f) for f in found]
        self.needed = [_mandatory(t, f) for t, f in zip(self.templates, found)]

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that no template has."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def index(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings by word: where each word's begin, then templates and positions, of the rarest words of each template."""
        rows = []
        for t, (template, w) in enumerate(zip(self.templates, self.words)):
            must = np.flatnonzero(self.needed[t])
            rarest = np.lexsort((np.arange(len(w)), frequency[w]))
            # every match holds all mandatory words, so the rarest of them is enough; else one of the n - m + 1 rarest
            taken = [must[np.argmin(frequency[w[must]])]] if len(must) else rarest[: len(w) - _least(template, len(w)) + 1]
            rows += [(int(w[q]), t, int(q)) for q in taken]
        held = np.array(sorted(rows), np.int64).reshape(-1, 3)
        return np.searchsorted(held[:, 0], np.arange(len(self.hashes) + 1)), held[:, 1], held[:, 2]


def _mandatory(template: Template, words: np.ndarray) -> np.ndarray:
    """Which positions are in a key phrase; a phrase that stands several times in the template is bound to its first place."""
    needed = np.zeros(len(words), bool)
    for key in template.keys:
        k = _hashes(key)
        at = next((i for i in range(len(words) - len(k) + 1) if (words[i : i + len(k)] == k).all()), None)
        if at is None or not len(k):
            raise ValueError(f"{key!r} does not stand in the template {template.label!r}")
        needed[at : at + len(k)] = True
    return needed


def _numbered(texts: list[str | None], vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: first, last + 1, word numbers, the text of each word."""
    for first, last, data, starts in textbytes.blocks(texts, 1):
        _, _, h, text = textbytes.words(data, starts)
        yield first, last, vocabulary.codes(h), text


def document_frequency(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> np.ndarray:
    """In how many texts of docs each word of the vocabulary stands; counted in the tasks, a row a word reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(len(vocabulary.hashes), np.int64)
        for batch in batches:
            for first, last, code, text in _numbered(batch["text"].tolist(), vocabulary):
                known = code >= 0
                pairs = np.unique(text[known] * len(held) + code[known]) % max(1, len(held))
                held += np.bincount(pairs, minlength=len(held))
        at = np.flatnonzero(held)
        yield pd.DataFrame({"word": at, "n": held[at]})

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary.hashes), np.int64)
    for word, n in rows:
        out[word] = n
    return out


def places(code: np.ndarray, text: np.ndarray, vocabulary: Vocabulary, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each template with the places (of its first word, counted over the block) and matched words of its alignments that hold."""
    begins, templates, positions = index
    at = np.flatnonzero(code >= 0)
    counts = begins[code[at] + 1] - begins[code[at]]
    at, counts = at[counts > 0], counts[counts > 0]
    if not len(at):
        return
    ends = np.cumsum(counts)
    post = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(begins[code[at]], counts)
    hit, t, q = np.repeat(at, counts), templates[post], positions[post]
    order = np.argsort(t, kind="stable")
    for k, where in zip(*(lambda u: (u[0], np.split(order, u[1][1:])))(np.unique(t[order], return_index=True))):
        words, needed = vocabulary.words[k], vocabulary.needed[k]
        start, first = np.unique(hit[where] - q[where], return_index=True)
        owner = text[hit[where][first]]

        def met(position: int, start: np.ndarray, owner: np.ndarray, words: np.ndarray = words) -> np.ndarray:
            place = start + position
            inside = (place >= 0) & (place < len(code))
            place = np.where(inside, place, 0)
            return inside & (code[place] == words[position]) & (text[place] == owner)

        total = np.zeros(len(start), np.int64)
        for position in [*np.flatnonzero(needed), *np.flatnonzero(~needed)]:
            same = met(position, start, owner)
            if needed[position]:
                start, owner, total, same = start[same], owner[same], total[same], same[same]
            total += same
        keep = total >= _least(vocabulary.templates[k], len(words))
        if keep.any():
            yield int(k), start[keep], owner[keep], total[keep]


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + STATEMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_words, places (label, start, n, coverage, base), ordered by start and label.

    Words are runs of letters, digits and characters past ASCII, A-Z lower-cased; a start is
    the place of the template's first word, words counted from 0 (it may lie before the text
    where a template's share allows that its first words are missing). Null and empty texts
    have no words and no places. A template that fits at several places has each; equal
    statements under two labels give both. Texts of any length are read whole; repeated rows
    give equal rows; other columns are not read, whatever their names. Words are compared by
    64-bit hashes.
    """
    vocabulary = Vocabulary(tuple(templates))
    index = vocabulary.index(document_frequency(docs, vocabulary, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n", pa.int32()), ("coverage", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
            for first, last, code, text in _numbered(batch.column("text").to_pylist(), vocabulary):
                counts = np.bincount(text, minlength=last - first)
                begin = np.concatenate([[0], np.cumsum(counts)])
                n[first:last] = counts
                for k, starts, owners, totals in places(code, text, vocabulary, index):
                    t, size = vocabulary.templates[k], len(vocabulary.words[k])
                    for start, owner, total in zip(starts.tolist(), owners.tolist(), totals.tolist()):
                        rows[first + owner].append((start - int(begin[owner]), t.label, size, total / size, t.base))
            out = [[{"label": r[1], "start": r[0], "n": r[2], "coverage": r[3], "base": r[4]} for r in sorted(found)] for found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(out, kind)], ["id", "n_words", "places"])

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, f"id {id_type}, n_words long, places {_PLACES}").withColumnRenamed("id", id_col)


def labels(places: Column) -> Column:
    """The distinct labels of some places, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def coverage(places: Column) -> Column:
    """The best share of matched words, 0 without a place."""
    return F.coalesce(F.array_max(F.transform(places, lambda p: p["coverage"])), F.lit(0.0))
