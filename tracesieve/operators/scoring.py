"""Novelty, coverage and the value score of a log as an evaluation case."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.rules import MAX_FAILURE_WEIGHT, failure_weight, prompt_preview
from tracesieve.operators.vectors import as_double, cluster_centroids, distance, nearest_centroid
from tracesieve.schemas import NOISE
from tracesieve.session import cut

# Noise novelty lies in [0.9, 1.0].
NOISE_BASE, NOISE_SPAN = 0.9, 0.1


@dataclass(frozen=True)
class Weights:
    failure: float = 1.0
    novelty: float = 1.0
    feature_impact: float = 1.0
    coverage_gap: float = 1.0


#: Parts into which the rows of one cluster are dealt when they meet the facts of their cluster.
SALTS = 8


def _with_cluster_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Join on cluster_id; the rows of a cluster are dealt to ``SALTS`` keys, each with a copy of its facts."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("log_id"), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["cluster_id", "_salt"]).drop("_salt")


def novelty(assigned: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Novelty of each log: log_id, cluster_id, novelty.

    ``assigned``: log_id, cluster_id, embedding. Members are scored by their
    distance to the own centroid, noise by the distance to the nearest one,
    each relative to the largest such distance.
    """
    if centroids is None:
        centroids = cut(cluster_centroids(assigned))
    embedding = as_double(F.col("embedding"))
    clustered = F.col("cluster_id") != NOISE
    members = _with_cluster_facts(assigned.filter(clustered), centroids.drop("size")).select(
        "log_id", "cluster_id", distance(embedding, F.col("centroid")).alias("d")
    )
    noise = assigned.filter(~clustered)
    nearest = nearest_centroid(noise.select(F.col("log_id").alias("id"), F.col("embedding").alias("v")), centroids)
    outliers = noise.select("log_id", "cluster_id").join(
        nearest.select(F.col("id").alias("log_id"), F.col("distance").alias("d")), "log_id", "left"
    )
    # three narrow columns, read twice: once for the largest distance, once to scale
    distances = cut(members.unionByName(outliers))
    inside = distances.filter(clustered)
    largest = inside.groupBy("cluster_id").agg(F.max("d").alias("top"), F.count("*").alias("members"))
    inside = _with_cluster_facts(inside, largest).withColumn(
        "novelty", F.when(F.col("members") == 1, 1.0).when(F.col("top") > 0, F.col("d") / F.col("top")).otherwise(0.0)
    )
    # all noise is one group: its largest distance is a single value, so it needs no join
    outside = distances.filter(~clustered)
    top = outside.agg(F.max("d")).scalar()
    share = F.when(top.isNull(), 1.0).otherwise(F.when(top > 0, F.col("d") / top).otherwise(0.0) * NOISE_SPAN + NOISE_BASE)
    columns = ["log_id", "cluster_id", "novelty"]
    return inside.select(columns).unionByName(outside.withColumn("novelty", share).select(columns))


def coverage_counts(case_vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Approved cases nearest to each current cluster: cluster_id, approved.

    Clusters without cases get 0; without any case the result is empty.
    ``case_vectors``: id, v.
    """
    counted = nearest_centroid(case_vectors, centroids).groupBy("cluster_id").agg(F.count("*").alias("approved"))
    any_case = case_vectors.limit(1).agg(F.count("*")).scalar()
    return cut(
        centroids.select("cluster_id").join(counted, "cluster_id", "left")
        .filter(any_case > 0)
        .select("cluster_id", F.coalesce("approved", F.lit(0)).alias("approved"))
    )


def coverage_gap(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``coverage_gap``: 1 for uncovered clusters and noise, 0 for the best covered."""
    top = counts.agg(F.max("approved")).scalar()
    gaps = counts.select(
        "cluster_id", F.when(top > 0, F.lit(1.0) - F.col("approved") / top).otherwise(1.0).alias("coverage_gap")
    )
    return rows.join(gaps, "cluster_id", "left").withColumn("coverage_gap", F.coalesce("coverage_gap", F.lit(1.0)))


def feature_impact(rows: DataFrame, feature_weights: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``feature_impact``: the caller's weight of the feature, else 1."""
    if not feature_weights:
        return rows.withColumn("feature_impact", F.lit(1.0))
    table = rows.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in feature_weights.items()], "feature_name string, feature_impact double"
    )
    joined = rows.join(F.broadcast(table), "feature_name", "left")
    return joined.withColumn("feature_impact", F.coalesce("feature_impact", F.lit(1.0)))


def score_candidates(
    logs: DataFrame,
    assigned: DataFrame,
    counts: DataFrame,
    feature_weights: Mapping[str, float] | None = None,
    weights: Weights = Weights(),
    centroids: DataFrame | None = None,
) -> DataFrame:
    """Every log that has a vector with its four terms and ``value_score``.

    ``counts`` (cluster_id, approved) comes from :func:`coverage_counts`.
    """
    rows = logs.withColumn("failure_signal", failure_weight() / MAX_FAILURE_WEIGHT).join(
        novelty(assigned, centroids), "log_id"
    )
    rows = coverage_gap(feature_impact(rows, feature_weights), counts)
    value = (
        F.col("failure_signal") * weights.failure
        + F.col("novelty") * weights.novelty
        + F.col("feature_impact") * weights.feature_impact
        + F.col("coverage_gap") * weights.coverage_gap
    )
    return rows.withColumn("value_score", value)


def scored_cluster_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``cluster_label``; rows of unnamed clusters get ``noise``."""
    named = rows.join(labels.select("cluster_id", F.col("label").alias("cluster_label")), "cluster_id", "left")
    return named.withColumn("cluster_label", F.coalesce("cluster_label", F.lit("noise")))


def top_candidates(scored: DataFrame, labels: DataFrame, n: int = 30, texts: DataFrame | None = None) -> DataFrame:
    """The best n logs with preview, cluster name and rounded scores.

    ``texts``: log_id, prompt. Only the prompts of the n best leave their files.
    """
    best = cut(scored.orderBy(F.desc("value_score"), "log_id").limit(n))
    if texts is not None:
        best = best.drop("prompt").join(texts.select("log_id", "prompt"), "log_id", "left")
    preview = prompt_preview(F.col("prompt")) if "prompt" in best.columns else F.lit(None).cast("string")
    return scored_cluster_label(best, labels).select(
        "log_id", "feature_name", preview.alias("prompt_preview"), "cluster_id", "cluster_label",
        *[F.round(c, 3).alias(c) for c in ("value_score", "failure_signal", "novelty")],
    )
