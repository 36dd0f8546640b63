"""Sizes, representatives and names of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.operators.vectors import as_double, cluster_centroids, distance
from tracesieve.schemas import NOISE


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """Members per cluster, noise included as cluster -1."""
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """One row: points, clusters without noise, noise points."""
    noise = F.col("cluster_id") == NOISE
    return cluster_sizes(assigned).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_points"),
        F.count_if(~noise).alias("n_clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("size"))), F.lit(0)).alias("n_noise"),
    )


def representatives(assigned: DataFrame, k: int = 5, centroids: DataFrame | None = None) -> DataFrame:
    """The k members nearest to their centroid: cluster_id, log_id, distance, rank.

    The limit is applied before the shuffle (window group limit), so a large
    cluster sends k rows per partition.
    """
    if centroids is None:
        centroids = cluster_centroids(assigned)
    placed = assigned.filter(F.col("cluster_id") != NOISE).join(centroids.drop("size"), "cluster_id").select(
        "cluster_id", "log_id", distance(as_double(F.col("embedding")), F.col("centroid")).alias("distance")
    )
    order = Window.partitionBy("cluster_id").orderBy("distance", "log_id")
    return placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unnamed_clusters(assigned: DataFrame, description: str = "(labeling skipped)") -> DataFrame:
    """Placeholder names, used when no model is asked."""
    return cluster_sizes(assigned).filter(F.col("cluster_id") != NOISE).select(
        "cluster_id", F.format_string("cluster_%d", "cluster_id").alias("label"),
        F.lit(description).alias("description"), "size",
    )
