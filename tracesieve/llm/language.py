"""Language identification with blended-spectrum string kernels, Nyström landmarks and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.llm import textarrays as A
from tracesieve.llm.common import remainder, small_batches

#: n-grams of 1 to SPECTRUM letters; a text is the set of its n-grams, as bits of 2^BITS.
SPECTRUM, BITS = 3, 13
#: Bounds on the rows used for fitting: landmarks and training rows of all languages together.
LANDMARKS, TRAIN_ROWS = 240, 2400
FOLDS, HELD_OUT = 3, 1
RIDGE, SHARPNESS = 1e-2, 4.0
UNKNOWN = "und"


def presence(t: A.Texts) -> np.ndarray:
    """texts x 2^BITS: which hashed n-grams of letters and gaps each text has."""
    letters = A.letter_table()[t.codes]
    codes = np.where(letters, A.lower_table()[t.codes], np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(t.n), np.diff(t.bounds))
    out = np.zeros(t.n << BITS, bool)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, SPECTRUM + 1):
        usable = len(codes) - n + 1
        if usable <= 0:
            break
        gram = A.mix(gram[:usable] + codes[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
        inside = (owner[:usable] == owner[n - 1 :]) & ((codes[:usable] != 32) | (codes[n - 1 :] != 32))
        out[(owner[:usable][inside] << BITS) + (gram[inside] >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return out.reshape(t.n, 1 << BITS)


@F.arrow_udf(T.BinaryType())
def _packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([row.tobytes() for _, _, t in A.slices(column) for row in np.packbits(presence(t), axis=1)], pa.binary())


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of the set sizes."""
    x = x.astype(np.float32)
    shared = x @ landmarks.T
    return shared / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(landmarks.sum(1), 1)[None])


@dataclass
class LanguageModel:
    names: list[str]
    landmarks: np.ndarray
    weights: np.ndarray  # landmarks x languages: Nyström map and ridge weights in one matrix

    def predict(self, t: A.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: no letter) and score of each text."""
        spoken = t.per_text(A.letter_table()[t.codes]) > 0
        best, score = np.full(t.n, -1), np.zeros(t.n)
        if self.names and t.n:
            margin = kernel(presence(t), self.landmarks).astype(np.float64) @ self.weights
            p = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best, score = np.where(spoken, p.argmax(1), -1), np.where(spoken, p.max(1), 0.0)
        return best, score


def fit(docs: DataFrame) -> LanguageModel:
    """A model from about ``TRAIN_ROWS`` texts with a language, spread evenly over the languages.

    Texts of fold ``HELD_OUT`` are not used. Only bit sets of a fixed size reach the driver.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0)))
    each = max(1, TRAIN_ROWS // len(names))
    shares = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, each / counts[n]) * 10**9))])
    key = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(10**9))
    rows = known.where(key < F.element_at(shares, F.col("lang"))).select("lang", "doc_id", _packed("text").alias("bits")).collect()
    rows = sorted((r.lang, r.doc_id, bytes(r.bits)) for r in rows)
    x = np.unpackbits(np.array([np.frombuffer(r[2], np.uint8) for r in rows]), axis=1).astype(np.float32)
    y = np.array([names.index(r[0]) for r in rows])
    per = max(1, LANDMARKS // len(names))
    marks = np.concatenate([np.flatnonzero(y == k)[:per] for k in range(len(names))])
    landmarks = x[marks]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(x, landmarks).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weights = np.linalg.solve(phi.T @ phi + RIDGE * len(rows) * np.eye(phi.shape[1]), phi.T @ target)
    return LanguageModel(names, landmarks, root @ weights)


def predicted(text: Column, model: LanguageModel) -> Column:
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            names, scores = [], []
            for _, _, t in A.slices(column):
                best, score = model.predict(t)
                names += [model.names[b] if b >= 0 else UNKNOWN for b in best]
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([*scores, []]))], names=["lang_pred", "score"])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(text)


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    A null, empty or letterless text is ``und`` with score 0, and so is every text if no
    language is known. A null id is never learnt from and not held out. Repeated rows are
    predicted alike; ties go to the first language by name; other columns are ignored.
    """
    found = docs.select("doc_id", predicted(F.col("text"), fit(docs)).alias("p"))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "p.lang_pred", "p.score")
