"""Uniform, failure-weighted and diverse sampling without replacement.

Randomness is a hash of (id, seed), so a sample does not depend on partitions,
order or retries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracesieve.functions.rules import failure_weight
from tracesieve.operators.ordering import number_rows
from tracesieve.operators.vectors import as_double
from tracesieve.session import checkpoint_dir, cut

TOP_LIMIT = 100_000
HISTOGRAM = 1024
POOL = 1024
MIN_U = 1e-12
_PICKS = "id string, pick int"


def hash_uniform(id_column: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by id and seed: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", id_column.cast("string"), F.lit(str(seed))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def _need(df: DataFrame, n: int) -> None:
    have = df.count()
    if n > have:
        raise ValueError(f"sample of {n} asked from {have} rows")


def _first_by(df: DataFrame, key: str, id_column: str, n: int) -> DataFrame:
    """The n rows of smallest (key, id); ids are unique.

    Only keys and ids are ordered: they give the n-th pair, and a filter keeps the rows up
    to it where they lie. Histograms narrow a large n down to the bucket that holds the pair.
    """
    value, left = F.col(key), n
    narrow = df.select(key, id_column)
    while left > TOP_LIMIT:
        first, last = narrow.agg(F.min(key), F.max(key)).first()
        bucket = F.floor((value - first) / (last - first) * HISTOGRAM) if last > first else F.lit(0)
        rows = narrow.groupBy(bucket.alias("b")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
        ).orderBy("b").collect()  # at most HISTOGRAM + 1 rows
        for row in rows:
            if left <= row.n:
                break
            left -= row.n
        narrowed = (row.low, row.high) != (first, last)
        narrow = narrow.filter(value.between(row.low, row.high))
        if not narrowed:
            break
    if not left:
        return df.limit(0)
    pair = F.struct(value.alias("key"), F.col(id_column).alias("id"))
    if left <= TOP_LIMIT:
        edge = narrow.orderBy(key, id_column).limit(left).agg(F.max(pair).alias("p")).first().p
    else:  # one key for more rows than fit a reducer: the ids alone decide
        edge = number_rows(narrow, [key, id_column], "place").filter(F.col("place") == left).select(pair.alias("p")).first().p
    return df.filter((value < edge.key) | ((value == edge.key) & (F.col(id_column) <= edge.id)))


def sample_random(logs: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows, uniformly; an error when there are fewer."""
    _need(logs, n)
    keyed = logs.withColumn("_key", hash_uniform(F.col("log_id"), seed))
    return _first_by(keyed, "_key", "log_id", n).drop("_key")


def sample_failure_biased(logs: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows with probability by failure weight (Efraimidis and Spirakis 2006).

    The n largest u^(1/w) are the n smallest -ln(u)/w, which does not underflow.
    """
    _need(logs, n)
    u = F.greatest(hash_uniform(F.col("log_id"), seed), F.lit(MIN_U))
    keyed = logs.withColumn("_key", -F.log(u) / failure_weight())
    return _first_by(keyed, "_key", "log_id", n).drop("_key")


def _nearer(points: DataFrame, picks: list[tuple[str, list[float]]]) -> DataFrame:
    """``points`` (id, v, d) with ``d`` lowered to the nearest of ``picks``; a picked point gets -1."""
    chosen, vectors = {i for i, _ in picks}, np.array([v for _, v in picks])

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, least = np.array(pdf["v"].tolist()), pdf["d"].to_numpy().copy()
                for pick in vectors:
                    least = np.minimum(least, np.sqrt(((x - pick) ** 2).sum(axis=1)))
                least[pdf["id"].isin(chosen).to_numpy()] = -1.0
                yield pdf.assign(d=least)

    return points.mapInPandas(lower, points.schema)


def sample_diverse(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """Greedy farthest-point picks: columns id, pick (1 is the first).

    Every point keeps its distance to the nearest pick, which a pass lowers by the new
    picks only. Distances only shrink, so among the ``POOL`` farthest points the best one is
    the true next pick as long as it stays ahead of the first point outside the pool. The
    driver holds one pool; picks go to a table as they are made.
    """
    spark = vectors.sparkSession
    if n <= 0:
        return spark.createDataFrame([], _PICKS)
    points = cut(vectors.select("id", as_double(F.col("v")).alias("v"), F.lit(float("inf")).alias("d")))
    _need(points, n)
    first = points.orderBy(hash_uniform(F.col("id"), seed), "id").limit(1).first()
    path = f"{checkpoint_dir(spark)}/picks-{uuid.uuid4().hex}"
    new, done = [(first.id, first.v)], 0
    while True:
        made = spark.createDataFrame([(i, done + k) for k, (i, _) in enumerate(new, 1)], _PICKS)
        made.coalesce(1).write.mode("append").parquet(path)
        done += len(new)
        if done >= n:
            return spark.read.schema(_PICKS).parquet(path)
        points = cut(_nearer(points, new))
        far = points.filter("d >= 0").orderBy(F.desc("d"), "id").limit(POOL + 1).collect()
        new = _greedy(far, n - done)


def _greedy(far: list[Row], most: int) -> list[tuple[str, list[float]]]:
    """Picks that are certain from the farthest points (id, v, d), in order."""
    outside = far[POOL] if len(far) > POOL else None
    pool = far[:POOL]
    ids, near = [r.id for r in pool], np.array([r.d for r in pool])
    x, open_, picks = np.array([r.v for r in pool]), np.ones(len(pool), dtype=bool), []
    while len(picks) < most and open_.any():
        best = min(np.nonzero(open_ & (near == near[open_].max()))[0], key=lambda i: ids[i])
        if outside is not None and (-near[best], ids[best]) > (-outside.d, outside.id):
            break
        picks.append((ids[best], pool[best].v))
        open_[best] = False
        near = np.minimum(near, np.sqrt(((x - x[best]) ** 2).sum(axis=1)))
    return picks
