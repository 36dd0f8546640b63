"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.llm import textarrays as A
from tracesieve.llm.common import labelled_sample, small_batches, spare_name

#: Bound on the labelled rows used for fitting.
TRAIN_ROWS = 20_000
#: Rows whose crc32 remainder modulo 5 is 0 are never learnt from.
FOLDS, HELD_OUT = 5, 0
CUT = 0.3
TREES, DEPTH, BINS, RATE, SMOOTH = 80, 4, 64, 0.15, 5.0

FEATURES = (
    "log_words", "word_length", "distinct", "repeats", "dup_lines", "line_words", "symbols", "bars",
    "exclaims", "stops", "digits", "upper", "letters",
)


def features(t: A.Texts) -> np.ndarray:
    s = {k: v.astype(np.float64) for k, v in A.statistics(t).items()}
    words, chars, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_letters"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_distinct_words"] / words, s["n_repeat_words"] / words,
        s["n_dup_lines"] / lines, np.log1p(s["n_words"] / lines), (s["n_symbols"] - s["n_bars"]) / words, s["n_bars"] / words,
        s["n_exclaim"] / words, s["n_stops"] / words, s["n_digits"] / chars, s["n_upper"] / letters, s["n_letters"] / chars,
    ])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def feature_vector(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        parts = [features(t) for _, _, t in A.slices(column)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))


@dataclass
class Trees:
    """Full binary trees in arrays: node k has children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for 0/1 labels; one constant where there is nothing to learn."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) < 20 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.column_stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)])
    n_features = x.shape[1]
    total, trees = np.full(len(y), model.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            best = np.zeros(width)
            cell = (node - first)[:, None] * BINS + binned
            for f in range(n_features):
                g = np.bincount(cell[:, f], grad, width * BINS).reshape(width, BINS)
                h = np.bincount(cell[:, f], hess, width * BINS).reshape(width, BINS)
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                gr, hr = g.sum(1, keepdims=True) - gl, h.sum(1, keepdims=True) - hl
                gain = gl**2 / (hl + SMOOTH) + gr**2 / (hr + SMOOTH) - (gl + gr) ** 2 / (hl + hr + SMOOTH)
                gain[(hl < 1) | (hr < 1)] = 0
                at = gain[:, : len(edges[f])].argmax(1) if len(edges[f]) else np.zeros(width, int)
                for k in range(width):
                    if len(edges[f]) and gain[k, at[k]] > best[k] + 1e-9:
                        best[k], feature[first + k], threshold[first + k] = gain[k, at[k]], f, edges[f][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g = np.bincount(node - inner, grad, leaves)
        h = np.bincount(node - inner, hess, leaves)
        leaf = RATE * g / (h + SMOOTH)
        total += leaf[node - inner]
        trees.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.array([t[i] for t in trees]) for i in range(3))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most about ``rows`` labelled texts; only their statistics reach the driver."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", rows, FOLDS, HELD_OUT)
    got = sorted((r.doc_id, r.label, r.x) for r in sample.select("doc_id", "label", feature_vector("text").alias("x")).collect())
    return fit_trees(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], float))


def score(text: Column, model: Trees) -> Column:
    """Probability that a text has label 1; an empty or null text is scored by its statistics (all zero)."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [model.score(features(t)) for _, _, t in A.slices(column)]
            yield pa.array(np.concatenate([*parts, []]))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.DoubleType())(text)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``; all columns stay.

    Each row is judged by its text alone, so repeated rows share one fate, and null ids or
    other null columns do not matter. A null text is judged like an empty one; texts are read
    whole, however long. A score equal to ``cut`` stays. An empty table gives an empty one.
    Without any usable label every text gets the prior of 0.5 and stays.
    """
    name = spare_name(docs, "quality_score")
    scored = docs.withColumn(name, score(F.col("text"), fit(docs, labels)))
    return scored.where(F.col(name) >= cut).drop(name)
