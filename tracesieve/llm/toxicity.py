"""Toxicity from the nearest labelled examples by exact cosine of label-weighted TF-IDF over a block-max index of all their words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.llm import textarrays as A
from tracesieve.llm.common import discard, labelled_sample, remainder, small_batches
from tracesieve.session import cut

#: Bound on the labelled examples in the index.
EXAMPLES = 8192
FOLDS, HELD_OUT = 5, 0
BLOCK, NEIGHBOURS, CUT = 64, 15, 0.5
#: Terms in at least this share of the examples are held as dense columns, the others as postings.
FREQUENT = 0.05
#: Blocks looked at before the bounds decide on the rest, and queries in one search.
FIRST_BLOCKS, QUERIES = 4, 64
#: Postings added up at once; long texts take several turns.
POSTINGS = 1 << 19


@F.arrow_udf(T.ArrayType(T.LongType()))
def distinct_terms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hashes of the different words (runs of letters, lower-cased) of each text."""
    for column in texts:
        out = []
        for _, _, t in A.slices(column):
            words, owner = A.lower_words(t)
            _, first = A.count_repeats(words, owner)
            words, owner = words[first].view(np.int64), owner[first]
            out += np.split(words, np.cumsum(np.bincount(owner, minlength=t.n))[:-1])
        yield pa.array(out, pa.list_(pa.int64()))


def term_counts(text: Column, vocabulary: np.ndarray) -> Column:
    """Struct of the vocabulary's terms (numbers, ascending), how often a text has them, and all its words."""
    kind = T.StructType([
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("words", T.LongType()),
    ])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            ids, counts, sizes, every = [], [], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
            for _, _, t in A.slices(column):
                words, owner = A.lower_words(t)
                at = np.searchsorted(vocabulary, words)
                known = np.flatnonzero((at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == words)) if len(vocabulary) else []
                cell, count = np.unique(owner[known] * max(1, len(vocabulary)) + at[known], return_counts=True)
                ids.append(cell % max(1, len(vocabulary)))
                counts.append(count)
                sizes.append(np.bincount(cell // max(1, len(vocabulary)), minlength=t.n))
                every.append(np.bincount(owner, minlength=t.n))
            offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, []]).astype(np.int32))) for x in (ids, counts)]
            yield pa.StructArray.from_arrays([*lists, pa.array(np.concatenate(every).astype(np.int64))], names=["ids", "counts", "words"])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(text)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs ``starts`` to ``starts + sizes``, end to end."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Index:
    """Examples in blocks of ``BLOCK``, over every term that an example has.

    Frequent terms are dense columns with the largest weight in each block; every other
    term has its postings (places and weights).
    """

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    column: np.ndarray  # of a frequent term, else -1
    dense: np.ndarray  # examples x frequent terms
    largest: np.ndarray  # blocks x frequent terms
    starts: np.ndarray  # of the postings of each term, and their end
    places: np.ndarray
    weights: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def weighted(self, owner: np.ndarray, ids: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Weights of the terms of ``n`` texts, which have length 1 per text (``owner``)."""
        weight = (1 + np.log(counts)) * self.idf[ids]
        return weight / np.maximum(np.sqrt(np.bincount(owner, weight**2, n)), 1e-300)[owner]

    def vectors(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.idf)))
        owner = np.repeat(np.arange(len(rows)), [len(ids) for ids, _ in rows])
        ids, counts = (np.concatenate([np.zeros(0, int), *[r[i] for r in rows]]) for i in (0, 1))
        x[owner, ids] = self.weighted(owner, ids, counts, len(rows))
        return x

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for the rows of a dense matrix."""
        owner, ids = np.nonzero(x)
        return self.search(owner, ids, x[owner, ids], len(x), k)

    def search(self, owner: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosine and place of the ``k`` nearest examples of ``n`` texts, exactly; ties to the smaller place.

        The postings of rare terms are added up for all examples. With the largest
        weights of the frequent terms they bound what an example of a block can reach: the
        blocks of the highest bounds are filled in first, then all others whose bound
        reaches the k-th cosine found.
        """
        size, blocks = len(self.ids), len(self.largest)
        wide, row = blocks * BLOCK, np.arange(n)[:, None]
        rare = self.column[ids] < 0
        who, term, w = owner[rare].astype(np.int64), ids[rare], weight[rare]
        lengths = self.starts[term + 1] - self.starts[term]
        score = np.zeros(n * wide)
        turns = np.flatnonzero(np.diff(np.cumsum(lengths) // POSTINGS)) + 1
        for a, b in zip([0, *turns], [*turns, len(term)], strict=True):
            entry = _spread(self.starts[term[a:b]], lengths[a:b])
            cell = np.repeat(who[a:b] * wide, lengths[a:b]) + self.places[entry]
            score += np.bincount(cell, np.repeat(w[a:b], lengths[a:b]) * self.weights[entry], n * wide)
        score = score.reshape(n, blocks, BLOCK)
        x = np.zeros((n, self.dense.shape[1]))
        x[owner[~rare], self.column[ids[~rare]]] = weight[~rare]
        bound = score.max(2) + x @ self.largest.T + 1e-9
        full = np.zeros((n, blocks), bool)

        def fill(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                rows = np.flatnonzero(wanted[:, b])
                piece = self.dense[b * BLOCK : (b + 1) * BLOCK]
                score[rows, b, : len(piece)] += x[rows] @ piece.T
            full[wanted] = True

        first = min(FIRST_BLOCKS, blocks)
        wanted = np.zeros((n, blocks), bool)
        wanted[row, np.argpartition(-bound, first - 1, axis=1)[:, :first]] = True
        fill(wanted & (bound > 1e-8))
        some = np.where(full[:, :, None], score, 0).reshape(n, wide)
        limit = np.partition(some, wide - min(k, wide), axis=1)[:, wide - min(k, wide)]
        fill(~full & (bound >= limit[:, None]) & (bound > 1e-8))
        score[~full] = 0
        score = score.reshape(n, wide)[:, :size]
        limit = np.partition(score, size - min(k, size), axis=1)[:, size - min(k, size)]
        at, place_of = np.nonzero((score >= limit[:, None] - 2e-12) & (score > 0))
        got = score[at, place_of]
        order = np.lexsort((place_of, -got.round(12), at))
        at, place_of, got = at[order], place_of[order], got[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < k
        cosine, place = np.full((n, k), -1.0), np.full((n, k), 1 << 60)
        cosine[at[best], rank[best]], place[at[best], rank[best]] = got[best], place_of[best]
        return cosine, place

    def votes(self, cosine: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, weighted by closeness, drawn to the prior."""
        real = cosine > 0
        weight = np.where(real, 1 / (1.05 - np.minimum(cosine, 1)), 0)
        label = self.labels[np.where(real, place, 0)] if len(self.labels) else np.zeros_like(weight)
        return ((weight * label).sum(1) + self.prior) / (weight.sum(1) + 1)

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        logit = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        return 1 / (1 + np.exp(-(self.slope * logit + self.shift)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, lightly held at (1, 0)."""
    a, b = 1.0, 0.0
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        grad = design.T @ (p - y) + np.array([a - 1, b])
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return float(a), float(b)


def association(rows: list[tuple], terms: int) -> np.ndarray:
    """Factor of each term's weight: 1 and its chi-square with the label (Yates), from (doc_id, label, ids, counts).

    It draws neighbours together that share telling words; no term is left out.
    """
    n, n1, none = len(rows), sum(r[1] for r in rows), np.zeros(0, np.int32)
    ids = np.concatenate([none, *[np.asarray(r[2]) for r in rows]])
    label = np.repeat(np.array([r[1] for r in rows], bool), [len(r[2]) for r in rows])
    a, b = (np.bincount(x, minlength=terms).astype(float) for x in (ids, ids[label]))
    apart = np.maximum(0, np.abs(b * n - a * n1) - n / 2)
    return 1 + n * apart**2 / (a * (n - a) * n1 * (n - n1) + 1e-9)


def build_index(rows: list[tuple], idf: np.ndarray) -> Index:
    """From (doc_id, label, ids, counts). Similar examples share blocks: they are ordered by their heaviest frequent term."""
    prior0 = [r[1] for r in rows if not len(r[2])]
    used = sorted((r for r in rows if len(r[2])), key=lambda r: r[0])
    n, none = len(used), np.zeros(0, np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r[2]) for r in used])
    ids, counts = (np.concatenate([none, *[np.asarray(r[i]) for r in used]]) for i in (2, 3))
    column = np.full(len(idf), -1, np.int32)
    often = np.flatnonzero(np.bincount(ids, minlength=len(idf)) >= max(1, FREQUENT * n))
    column[often] = np.arange(len(often))
    index = Index(idf, none, np.zeros(0), column, np.zeros((n, len(often))), np.zeros((0, len(often))), np.zeros(len(idf) + 1, np.int64), none, np.zeros(0), 0.5)
    index.prior = (sum(r[1] for r in rows) + 0.5) / (len(rows) + 1)
    if used:
        weight = index.weighted(owner, ids, counts, n)
        rare = column[ids] < 0
        index.dense[owner[~rare], column[ids[~rare]]] = weight[~rare]
        order = np.lexsort((-index.dense.max(1), index.dense.argmax(1))) if len(often) else np.arange(n)
        index.dense, used = index.dense[order], [used[i] for i in order]
        index.largest = np.array([index.dense[lo : lo + BLOCK].max(0) for lo in range(0, n, BLOCK)])
        owner = np.argsort(order).astype(np.int32)[owner]
        index.ids, index.labels = np.array([r[0] for r in used]), np.array([float(r[1]) for r in used])
        by_term = np.lexsort((owner[rare], ids[rare]))
        index.places, index.weights = owner[rare][by_term], weight[rare][by_term]
        index.starts = np.concatenate([[0], np.cumsum(np.bincount(ids[rare], minlength=len(idf)))])
        by_place = np.argsort(owner, kind="stable")
        owner, ids, weight, shares = owner[by_place], ids[by_place], weight[by_place], []
        del by_term, by_place, counts
        for lo in range(0, n, QUERIES):  # leave one out: an example is its own nearest
            hi = min(lo + QUERIES, n)
            a, b = np.searchsorted(owner, [lo, hi])
            cosine, place = index.search(owner[a:b] - lo, ids[a:b], weight[a:b], hi - lo, NEIGHBOURS + 1)
            own = place == np.arange(lo, hi)[:, None]
            own[~own.any(1), -1] = True
            shares.append(index.votes(cosine[~own].reshape(len(own), -1), place[~own].reshape(len(own), -1)))
        share = np.concatenate(shares)
        index.slope, index.shift = _logistic(np.log(share / (1 - share)), index.labels)
    # texts without any word have a score of their own
    index.prior0 = (sum(prior0) + 0.5 * index.prior) / (len(prior0) + 0.5)
    return index


def fit_vocabulary(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[DataFrame, np.ndarray]:
    """The example sample (doc_id, label, text) and the vocabulary: every term that an example has."""
    small_batches(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, "toxic", examples, FOLDS, HELD_OUT).select("doc_id", "label", "text"))
    terms = sample.select(F.explode(distinct_terms("text")).alias("term")).distinct().toArrow()
    return sample, np.sort(terms.column(0).to_numpy().view(np.uint64))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, end to end, and their bounds."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def document_frequency(ids: DataFrame, terms: int) -> np.ndarray:
    """How many rows of ``ids`` (arrays of different term numbers) have each of the ``terms`` terms.

    A task sends one row per term that it met, however many documents it has read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["id", "n"])

    out = np.zeros(terms)
    found = ids.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs``.

    ``evidence`` has the ids of the three nearest examples. The vocabulary is every word
    of the examples, so each text that shares a word with an example is searched for and
    has evidence. A text without a word (an empty or null one) gets the share of label 1
    among the examples without one; one whose words no example has gets the score of no
    neighbours. With no usable label every score is 0.5 at most, and no evidence is
    given. Rows with a null id are never learnt from and not held out; repeated rows are
    scored alike; other columns are ignored. Term weights are the inverse frequency over all
    documents times the ``association`` with the label.
    """
    sample, vocabulary = fit_vocabulary(docs, labels, examples)
    found = cut(docs.select("doc_id", term_counts(F.col("text"), vocabulary).alias("t")))
    total = found.count()
    frequency = document_frequency(found.select("t.ids"), len(vocabulary))
    idf = np.log((1 + total) / (1 + frequency)) + 1
    taken = sample.select("doc_id", "label", term_counts(F.col("text"), vocabulary).alias("t")).select("doc_id", "label", "t.ids", "t.counts").toArrow()
    flat = [_flat(taken.column(c).combine_chunks()) for c in ("ids", "counts")]
    rows = list(zip(taken["doc_id"].to_pylist(), taken["label"].to_pylist(), *[np.split(x, bounds[1:-1]) for x, bounds in flat], strict=True)) if taken.num_rows else []
    index = build_index(rows, idf * association(rows, len(vocabulary)))
    discard(sample)
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            (ids, bounds), (counts, _) = (_flat(column.field(c)) for c in ("ids", "counts"))
            words = column.field("words").to_numpy(zero_copy_only=False)
            none = index.calibrated(np.array([index.prior]))[0] if len(index.ids) else index.prior0
            score, evidence = np.where(words > 0, none, index.prior0), [[]] * len(words)
            some = np.flatnonzero(np.diff(bounds)) if len(index.ids) else []
            for lo in range(0, len(some), QUERIES):
                rows = some[lo : lo + QUERIES]
                sizes = bounds[rows + 1] - bounds[rows]
                at, owner = _spread(bounds[rows], sizes), np.repeat(np.arange(len(rows)), sizes)
                cosine, place = index.search(owner, ids[at], index.weighted(owner, ids[at], counts[at], len(rows)), len(rows), NEIGHBOURS)
                score[rows] = index.calibrated(index.votes(cosine, place))
                for i, c, p in zip(rows, cosine, place, strict=True):
                    evidence[i] = index.ids[p[:3][c[:3] > 0]].tolist()
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(evidence, pa.list_(pa.int64()))], names=["score", "evidence"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = found.select("doc_id", F.arrow_udf(run, kind)("t").alias("s"))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "s.score", (F.col("s.score") >= CUT).cast("int").alias("predicted"), "s.evidence")
