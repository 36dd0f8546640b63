"""Quality rules as a cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.llm import textarrays as A
from tracesieve.llm.common import small_batches

#: Texts on which cost and selectivity are estimated; this fixes the order, never a verdict.
SAMPLE = 2000

_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint32)


def _words(t: A.Texts) -> np.ndarray:
    return np.bincount(A.words(t)[2], minlength=t.n)


def too_few_words(t: A.Texts) -> np.ndarray:
    return _words(t) < 10


def too_many_symbols(t: A.Texts) -> np.ndarray:
    """Over one symbol for two words."""
    return 2 * t.per_text(np.isin(t.codes, _SYMBOLS)) > _words(t)


def shouting(t: A.Texts) -> np.ndarray:
    """Over half of the letters A-Z and a-z are capitals."""
    upper = t.per_text((t.codes >= 65) & (t.codes <= 90))
    return 2 * upper > upper + t.per_text((t.codes >= 97) & (t.codes <= 122))


def odd_word_length(t: A.Texts) -> np.ndarray:
    """Mean word length outside 2 to 15 code points."""
    starts, ends, owner = A.words(t)
    n, chars = np.bincount(owner, minlength=t.n), np.bincount(owner, ends - starts, t.n)
    return (chars < 2 * n) | (chars > 15 * n)


def repeated_lines(t: A.Texts) -> np.ndarray:
    """Over 30 % of the lines with a word repeat an earlier one."""
    s = A.statistics(t)
    return 100 * s["n_dup_lines"] > 30 * s["n_lines"]


def repeated_windows(t: A.Texts) -> np.ndarray:
    """Over 20 % of the words stand in five-word windows found twice or more."""
    s = A.statistics(t)
    return 100 * s["n_repeat_words"] > 20 * s["n_words"]


RULES: dict[str, Callable[[A.Texts], np.ndarray]] = {
    f.__name__: f for f in (too_few_words, too_many_symbols, shouting, odd_word_length, repeated_lines, repeated_windows)
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def select(t: A.Texts, rows: np.ndarray) -> A.Texts:
    """The texts with the numbers ``rows``."""
    sizes = np.diff(t.bounds)
    keep = np.zeros(t.n, bool)
    keep[rows] = True
    return A.Texts(t.codes[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
def _measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """For each text and rule: seconds (shared out by length) and whether it rejects."""
    for column in texts:
        out = []
        for _, _, t in A.slices(column):
            share = np.diff(t.bounds) + 1.0
            found = [{} for _ in range(t.n)]
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejects = rule(t)
                cost = (time.perf_counter() - began) * share / share.sum()
                for i in range(t.n):
                    found[i][name] = [float(cost[i]), float(rejects[i])]
            out += [list(x.items()) for x in found]
        yield pa.array(out, pa.map_(pa.string(), pa.list_(pa.float64())))


def cascade_order(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The rules by rejections per second on about ``sample`` texts, the best first.

    Greedy: after a rule is placed, the next is judged on the texts it leaves. An empty
    table keeps the written order.
    """
    total = docs.count()
    share = 1.0 if total <= sample else sample / total
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("cascade"), "doc_id"), F.lit(10**9)) < int(share * 10**9))
    rows = [r[0] for r in chosen.select(_measure("text").alias("m")).limit(4 * sample).collect()]
    order, names = [], list(RULES)
    while names and rows:
        rate = {n: (sum(r[n][1] for r in rows) / max(1e-12, sum(r[n][0] for r in rows))) for n in names}
        best = max(names, key=lambda n: rate[n])
        order.append(best)
        names.remove(best)
        rows = [r for r in rows if not r[best][1]]
    return order + names


def counts_and_verdict(text: Column, order: list[str]) -> Column:
    """Struct of the base counts and ``rejected_by`` (first rule that rejects, null: kept)."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("rejected_by", T.StringType())]

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            counts, by = {c: [] for c in COUNTS}, []
            for _, _, t in A.slices(column):
                s = A.statistics(t)
                for c in COUNTS:
                    counts[c].append(s[c])
                verdict = np.full(t.n, -1)
                alive = np.arange(t.n)
                for k, name in enumerate(order):  # each rule sees only what the rules before it left
                    if not len(alive):
                        break
                    rejects = RULES[name](select(t, alive) if len(alive) < t.n else t)
                    verdict[alive[rejects]] = k
                    alive = alive[~rejects]
                by += [None if v < 0 else order[v] for v in verdict]
            arrays = [pa.array(np.concatenate([*counts[c], []]).astype(np.int64)) for c in COUNTS]
            yield pa.StructArray.from_arrays([*arrays, pa.array(by, pa.string())], names=[f.name for f in fields])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.StructType(fields))(text)


def quality_rules(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, counts, base_failed, kept, rejected_by) for every row of ``docs``.

    A text is kept if no rule rejects it; the order decides what work is saved and which
    rule is named, not who is kept. A null or empty text has no words and fails. Repeated
    rows are judged one by one; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", counts_and_verdict(F.col("text"), cascade_order(docs, sample)).alias("r"))
    failed = (F.col("r.n_words") < 10) | (100 * F.col("r.n_repeat_words") > 20 * F.col("r.n_words"))
    return found.select(
        "doc_id", *[F.col(f"r.{c}") for c in COUNTS], failed.alias("base_failed"),
        (~failed & F.col("r.rejected_by").isNull()).alias("kept"), "r.rejected_by",
    )
