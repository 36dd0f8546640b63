"""From logs and vectors to ranked candidates and sample previews."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.operators import clusters, density, sampling, scoring
from tracesieve.operators.modelmap import Model, label_clusters
from tracesieve.operators.vectors import cluster_centroids
from tracesieve.session import cut


def sample_previews(logs: DataFrame, embeddings: DataFrame, n: int, seed: int) -> DataFrame:
    """The three samples side by side: sampler, log_id."""
    n = min(n, logs.limit(n).count())
    points = embeddings.select(F.col("log_id").alias("id"), F.col("embedding").alias("v"))
    n_diverse = min(n, points.limit(n).count()) if n else 0
    drawn = {
        "random": sampling.sample_random(logs, n, seed),
        "failure_biased": sampling.sample_failure_biased(logs, n, seed),
        "diversity": sampling.sample_diverse(points, n_diverse, seed).withColumnRenamed("id", "log_id"),
    }
    rows = [df.select(F.lit(name).alias("sampler"), "log_id") for name, df in drawn.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def rank_candidates(
    logs: DataFrame,
    embeddings: DataFrame,
    approved: DataFrame,
    min_cluster_size: int = 5,
    top_n: int = 30,
    preview_n: int = 10,
    seed: int = 42,
    model: Model | None = None,
    feature_weights: Mapping[str, float] | None = None,
    weights: scoring.Weights = scoring.Weights(),
) -> dict[str, DataFrame]:
    """Cluster, measure coverage, score and select.

    ``embeddings``: log_id, embedding. ``approved``: id, v of approved cases.
    Returns the tables assigned, clusters, candidates and previews.
    """
    points = embeddings.select(F.col("log_id").alias("id"), F.col("embedding").alias("v"))
    found = density.density_cluster(points, min_cluster_size)
    assigned = cut(
        embeddings.select("log_id", "embedding").join(
            found.select(F.col("id").alias("log_id"), "cluster_id", "probability"), "log_id"
        )
    )
    if model is None:
        names = clusters.unnamed_clusters(assigned)
    else:
        names = label_clusters(assigned, logs.select("log_id", "prompt"), model)
    names = cut(names)
    centroids = cut(cluster_centroids(assigned))
    counts = scoring.coverage_counts(approved, centroids)
    scored = scoring.score_candidates(logs.drop("system_prompt", "prompt", "response"), assigned, counts, feature_weights, weights, centroids)
    return {
        "assigned": assigned.drop("embedding"),
        "clusters": names,
        "candidates": scoring.top_candidates(scored, names, top_n, logs),
        "previews": sample_previews(logs, embeddings, preview_n, seed),
    }
