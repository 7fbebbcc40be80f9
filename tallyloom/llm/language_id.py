"""Language identification by a string kernel.

The kernel of two texts is the number of byte grams of 1 to 3 bytes that both hold
(presence, a blended spectrum), divided by the root of the product of their own numbers.
Landmark texts span a Nyström map; one ridge regression against the rest for each
language is solved on it. A batch of texts is scored by two matrix multiplications:
presence by landmarks, then by the folded weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes
from tallyloom.llm.runtime import free

GRAMS = (1, 2, 3)
#: For each language: landmarks, training texts; and the characters of a training text at most (of longer ones a passage).
LANDMARKS, TRAINING, SAMPLE_CHARS = 48, 500, 4096
#: Texts in one matrix of presence (each a byte for every gram of the landmarks).
MATRIX_TEXTS = 256
UNKNOWN = "und"
#: Letters and characters past ASCII stay; the rest is space.
_KEPT = np.where(np.isin(np.arange(256), [*range(97, 123), *range(128, 256)]), np.arange(256), 32).astype(np.uint8)
_KEPT[0] = 0


@dataclass
class Model:
    """Grams of the landmarks, the landmarks' presence, the folded weights, the languages."""

    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def __post_init__(self) -> None:
        self.tables = []
        for n in GRAMS:
            low, high = (0 if n == 1 else 1 << (8 * (n - 1))), 1 << (8 * n)
            table = np.full(high, -1, np.int32)
            inside = (self.grams >= low) & (self.grams < high)
            table[self.grams[inside]] = np.flatnonzero(inside)
            self.tables.append(table)
        own = self.landmarks.sum(1)
        self.columns = np.ascontiguousarray((self.landmarks / np.sqrt(np.maximum(own, 1))[:, None]).T)

    def presence(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of at most MATRIX_TEXTS texts with the matrix of which grams they hold."""
        wide = len(self.grams)
        for base in range(0, len(texts), MATRIX_TEXTS):
            for first, last, data, starts in textbytes.blocks(texts[base : base + MATRIX_TEXTS], 3):
                data = _KEPT[data]
                text = np.repeat(np.arange(last - first) * wide, np.diff(np.append(starts, len(data))))
                held = np.zeros((last - first) * wide, bool)
                for n, table in zip(GRAMS, self.tables):
                    g = table[textbytes.grams(data, n)]
                    at = np.flatnonzero(g >= 0)
                    held[text[at] + g[at]] = True
                yield base + first, base + last, held.reshape(last - first, wide)

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        x = presence.astype(np.float32)
        return (x @ self.columns) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return labels, scores
        for first, last, presence in self.presence(texts):
            out = self.kernel(presence) @ self.weights
            best = out.argmax(1)
            for i in range(first, last):
                if texts[i] and any(map(str.isalpha, texts[i])):
                    labels[i] = self.languages[best[i - first]]
                    scores[i] = min(1.0, max(0.0, (1 + float(out[i - first, best[i - first]])) / 2))
        return labels, scores


def train(texts: list[str], labels: list[str], ridge: float = 1e-3) -> Model:
    """Landmarks are the first LANDMARKS texts of each language; all texts fit the regressions.

    Without texts the model answers UNKNOWN with score 0 for everything.
    """
    languages, y = sorted(set(labels)), np.array(labels)
    if not languages:
        return Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), [])
    chosen = [i for k in languages for i in np.flatnonzero(y == k)[:LANDMARKS].tolist()]
    parts = []
    for i in chosen:
        for _, _, data, _ in textbytes.blocks([texts[i]], 3):
            parts += [np.unique(textbytes.grams(_KEPT[data[:-3]], n)).astype(np.int64) for n in GRAMS]
    grams = np.unique(np.concatenate(parts))
    bare = Model(grams, np.zeros((1, len(grams)), np.float32), np.zeros((0, 0)), languages)
    rows = lambda some: np.concatenate([p for _, _, p in bare.presence(some)]).astype(np.float32)
    model = Model(grams, rows([texts[i] for i in chosen]), np.zeros((0, 0)), languages)
    w = model.kernel(model.landmarks > 0).astype(np.float64)
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    x = np.concatenate([model.kernel(p) for _, _, p in model.presence(texts)]).astype(np.float64) @ nystrom
    target = np.where(y[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1 / np.array([np.sum(y == k) for k in y])  # languages count alike
    gram = x.T @ (x * weight[:, None]) + ridge * np.eye(x.shape[1])
    beta = np.linalg.solve(gram, x.T @ (target * weight[:, None]))
    return Model(grams, model.landmarks, (nystrom @ beta).astype(np.float32), languages)


def passage(text: Column, most: int, at: Column) -> Column:
    """The text, or of one longer than most characters a stretch of that length from a place chosen by the hash at."""
    start = F.pmod(at, F.greatest(F.lit(1), F.length(text) - most + 1)) + 1
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, start.cast("int"), F.lit(most)))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with a language and a text for which learn holds.

    The sample is bounded: of each language about TRAINING different (id, text) rows chosen
    by a hash, whatever their length; of a text longer than SAMPLE_CHARS characters a passage
    of that length stands in the sample, so a language that has only long texts is learned too.
    """
    text = F.col(text_col)
    usable = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"), text.alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return train([], [])
    # the share of each language's hashes that gives about the wanted number of texts
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * TRAINING / max(1, n)))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    picked = drawn.dropDuplicates(["lang", "h"]).select("lang", "h", passage(F.col("text"), SAMPLE_CHARS, F.shiftright("h", 20)).alias("text")).collect()
    kept: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["h"], r["text"])):
        kept.setdefault(r["lang"], []).append(r["text"])
    pairs = [(t, lang) for lang, texts in sorted(kept.items()) for t in texts[:TRAINING]]
    return train([t for t, _ in pairs], [lang for _, lang in pairs])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0..1).

    The score is half of one more than the regression's value; below 0.5 every language's
    classifier says no. Null texts and texts without a letter are UNKNOWN with score 0, as
    is every text where no language was learned; of equal values the first language wins.
    The text alone decides, so repeated rows get equal answers. Columns of docs that bear
    the new names are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, model.landmarks, model.weights, model.languages))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Model(*shared.value)
        for texts in batches:
            labels, scores = held.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": labels, "score": scores})

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = free("_language", docs.columns)
    return docs.select(*kept, run(F.col(text_col)).alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score")
