"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over byte grams (whether one occurs, and whether it does so again) is trained in numpy from confirmed
toxic documents and unlabelled ones. Its risk is prior * (loss of the positives as
positive) + max(0, loss of the unlabelled as negative - prior * loss of the positives as
negative): the second part estimates the negatives' loss, and where it falls below zero
the step climbs it again instead of letting the classifier overfit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes
from tallyloom.llm.language_id import passage

#: Gram lengths in bytes. Bytes that are not of words are spaces.
GRAMS = (5, 6)
#: A gram has a weight for each of so many occurrences in a text; more count no further.
TIMES = 3
#: Bounds of the training sample (texts of each kind, characters of one; of longer ones a passage) and of the grams used.
POSITIVES, UNLABELLED, SAMPLE_CHARS, FEATURES = 1500, 3000, 16_384, 768
#: A gram is used from so many positives, and so many deviations beyond the rate of the unlabelled.
LEAST, EXCESS = 8, 7.5
_FILTER = 1 << 20
_SPACED = np.where(textbytes._WORD, np.arange(256), 32).astype(np.uint8)
_SPACED[0] = 0


@dataclass
class Model:
    """Sorted grams, for each the weights of its first occurrences, and the bias; of bounded size."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def present(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of texts with the (text, gram, occurrence) triples there are: (text * grams + gram) * TIMES + occurrence."""
        n = max(1, len(self.grams))
        for first, last, data, starts in textbytes.blocks(texts, 8):
            data, found = _SPACED[data], []
            for length in GRAMS if len(self.grams) else ():
                g = textbytes.grams(data, length).astype(np.uint64)
                at = np.flatnonzero(self.filter[self._slot(g)])
                place = np.minimum(np.searchsorted(self.grams, g[at]), n - 1)
                same = self.grams[place] == g[at]
                text = np.searchsorted(starts, at[same], side="right") - 1
                found.append(text * n + place[same])
            pairs, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield first, last, np.concatenate([pairs[times > k] * TIMES + k for k in range(TIMES)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, n = np.full(len(texts), self.bias), max(1, len(self.grams) * TIMES)
        for first, last, pairs in self.present(texts):
            out[first:last] += np.bincount(pairs // n, self.weights[pairs % n] if len(self.grams) else None, minlength=last - first)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every gram of the texts, and in how many of them it occurs."""
    parts = []
    for text in texts:
        for _, _, data, _ in textbytes.blocks([text], 8):
            parts.append(np.unique(np.concatenate([textbytes.grams(_SPACED[data[:-8]], n).astype(np.uint64) for n in GRAMS])))
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def choose_grams(positive: list[str], unlabelled: list[str]) -> np.ndarray:
    """The grams that occur most beyond expectation among the positives."""
    g, p = _grams_of(positive)
    often = p >= LEAST
    g, p = g[often], p[often]
    counts = np.zeros(len(g))
    for at in range(0, len(unlabelled), 200):
        h, u = _grams_of(unlabelled[at : at + 200])
        place = np.minimum(np.searchsorted(h, g), max(0, len(h) - 1))
        counts += np.where(h[place] == g, u[place], 0) if len(h) else 0
    rate = (counts + 1) / (len(unlabelled) + 2)
    excess = (p - rate * len(positive)) / np.sqrt(rate * len(positive) * (1 - rate) + 1e-9)
    best = np.argsort(-excess, kind="stable")[:FEATURES]
    return np.sort(g[best[excess[best] > EXCESS]])


def risk(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk at theta (weights, then bias) with the logistic loss, and their gradients.

    xp, xu: occurrences of the grams in the positive and the unlabelled texts. The first part
    is that of the positives, the second the estimate of the negatives', which may be below zero.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    w = theta[:-1].astype(xp.dtype)
    zp, zu = xp @ w + theta[-1], xu @ w + theta[-1]

    def back(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.append(x.T @ d.astype(x.dtype), d.sum())

    positive, up = prior * loss(zp).mean(), prior * back(xp, -sig(-zp) / len(zp))
    negative, down = loss(-zu).mean() - prior * loss(-zp).mean(), back(xu, sig(zu) / len(zu)) - prior * back(xp, sig(zp) / len(zp))
    return float(positive), float(negative), up, down


def direction(positive_up: np.ndarray, negative: float, down: np.ndarray) -> np.ndarray:
    """What a step descends: both parts, or, where the negatives' part fell below zero, that part upwards."""
    return positive_up + down if negative >= 0 else -down


def train(positive: list[str], unlabelled: list[str], prior: float, steps: int = 600, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss.

    Without positives, or without unlabelled texts, the model scores every text the prior.
    """
    prior = min(max(prior, 1e-4), 0.9)
    model = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return model
    model = Model(choose_grams(positive, unlabelled), np.zeros(0), model.bias)
    n = len(model.grams) * TIMES
    if not n:
        return model

    def matrix(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), n), np.float32)
        for first, _, pairs in model.present(texts):
            x[first + pairs // n, pairs % n] = 1
        return x

    xp, xu = matrix(positive), matrix(unlabelled)
    theta = np.zeros(n + 1)
    theta[-1] = model.bias
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        _, negative, up, down = risk(theta, xp, xu, prior)
        grad = direction(up, negative, down) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(model.grams, theta[:-1], float(theta[-1]))


def fold(id_col: str, folds: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on rows of docs for which learn holds.

    Positives are rows with label 1 (an id with several labels has the greatest; null labels
    do not count); the unlabelled sample is drawn from all rows, whatever their label; the
    prior is the share of 1 among the labelled. The sample is bounded: up to POSITIVES and
    UNLABELLED different texts chosen by a hash, of each at most SAMPLE_CHARS characters in one passage.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("mark_id")).agg(F.max(label_col).alias("mark"))
    # texts stay where they are: only ids and hashes meet the labels
    keys = docs.where(learn).select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col) > 0, F.lit(False)).alias("fits"), F.xxhash64(id_col, text_col).alias("h"))
    marked = F.coalesce(F.col("mark") == 1, F.lit(False))
    held = keys.join(marks, F.col("id") == F.col("mark_id"), "left").select("id", "h", marked.alias("toxic"), F.col("mark").isNotNull().alias("labelled"), "fits")
    fits, toxic = F.col("fits"), F.col("toxic")
    distinct = lambda which: F.approx_count_distinct(F.when(which, F.col("h")))
    n, n_toxic, all_toxic, all_rows = held.agg(F.count_if("labelled"), F.count_if(toxic), distinct(toxic & fits), distinct(fits)).first()

    def drawn(bits: Column, most: int, of: int) -> Column:
        """Rows whose hash bits fall under the share that gives about most of them."""
        return F.pmod(bits, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.1 * most / max(1, of)))

    flags = held.where(fits).select("id", "h", (toxic & drawn(F.col("h"), POSITIVES, all_toxic)).alias("p"), drawn(F.shiftright("h", 20), UNLABELLED, all_rows).alias("u"))
    picked = flags.where(F.col("p") | F.col("u")).distinct().toDF("pick_id", "pick_h", "p", "u")  # about POSITIVES + UNLABELLED rows
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(picked), F.col("id").eqNullSafe(F.col("pick_id")) & (F.col("h") == F.col("pick_h")))
    once = met.dropDuplicates(["h"]).select("h", passage(F.col("text"), SAMPLE_CHARS, F.shiftright("h", 40)).alias("text"), "p", "u")
    rows = sorted(once.collect())
    positive = list(dict.fromkeys(r["text"] for r in rows if r["p"]))[:POSITIVES]  # a text counts once
    unlabelled = list(dict.fromkeys(r["text"] for r in rows if r["u"]))[:UNLABELLED]
    return train(positive, unlabelled, n_toxic / n if n else 0.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores in 0..1 named by out, which replaces one of that name.

    Null and empty texts get the bias's score; the text alone decides, so repeated rows get
    equal scores; texts of any length are read whole. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, model.weights, model.bias))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model(*shared.value)
        for texts in batches:
            yield pd.Series(held.scores(texts.tolist()), dtype="float64")

    return docs.withColumn(out, run(F.col(text_col)))
