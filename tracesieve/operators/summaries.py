"""Counts and shares over logs, cases, edits and run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.schemas import DIFFICULTIES, LABEL_SOURCES


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def log_summary(logs: DataFrame) -> DataFrame:
    """Long table (metric, item, value): totals, counts per feature and feedback, rates.

    Both breakdowns share one scan through grouping sets.
    """
    n = F.count("*")
    level = F.col("level")
    breakdown = (
        logs.groupingSets([[F.col("feature_name")], [F.col("user_feedback")]], "feature_name", "user_feedback")
        .agg(F.grouping_id().alias("level"), n.cast("double").alias("value"))
        .select(
            F.when(level == 1, "feature").otherwise("feedback").alias("metric"),
            F.when(level == 1, F.col("feature_name")).otherwise(F.col("user_feedback")).alias("item"), "value",
        )
    )
    entries = [F.struct(F.lit("total").alias("metric"), F.col("n").cast("double").alias("value"))]
    for name in ("error", "redacted", "safety_edge_case", "retry"):
        entries.append(F.struct(F.lit(f"{name}_count").alias("metric"), F.col(name).cast("double").alias("value")))
        entries.append(F.struct(F.lit(f"{name}_rate").alias("metric"), _share(F.col(name), F.col("n")).alias("value")))
    totals = logs.agg(
        n.alias("n"),
        F.count_if(F.col("error_status").isNotNull()).alias("error"),
        F.count_if("redacted").alias("redacted"),
        F.count_if("is_safety_edge_case").alias("safety_edge_case"),
        F.count_if(F.col("retry_count") > 0).alias("retry"),
    ).select(F.explode(F.array(*entries)).alias("e")).select("e.metric", F.lit(None).cast("string").alias("item"), "e.value")
    return breakdown.unionByName(totals)


def case_summary(cases: DataFrame, rejections: DataFrame) -> DataFrame:
    """Long table (metric, item, value) of a case table and its dedup rejections."""
    keys = ("status", "eval_type", "difficulty")
    counted = cases.groupingSets(
        [[F.col(k)] for k in keys], *keys
    ).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    level = F.col("level")
    breakdown = counted.select(
        F.when(level == 3, "status").when(level == 5, "eval_type").otherwise("difficulty").alias("metric"),
        F.when(level == 3, F.col("status")).when(level == 5, F.col("eval_type")).otherwise(F.col("difficulty")).alias("item"),
        F.col("n").cast("double").alias("value"),
    )
    no_item = F.lit(None).cast("string").alias("item")
    totals = cases.agg(F.count("*").cast("double").alias("n"), F.avg("confidence_score").alias("mean")).select(
        F.explode(F.array(
            F.struct(F.lit("total").alias("metric"), F.col("n").alias("value")),
            F.struct(F.lit("mean_confidence").alias("metric"), F.col("mean").alias("value")),
        )).alias("e")
    ).select("e.metric", no_item, "e.value")
    rejected = rejections.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("dedup_rejections").alias("metric"), no_item, "value"
    )
    return breakdown.unionByName(totals).unionByName(rejected)


def approved(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("status") == "approved")


def cases_by_cluster(cases: DataFrame) -> DataFrame:
    """Approved cases per cluster, largest first."""
    counts = approved(cases).groupBy(F.col("source_cluster_id").alias("cluster_id")).agg(F.count("*").alias("cases"))
    return counts.orderBy(F.desc("cases"), "cluster_id")


def _counts_for(cases: DataFrame, column: str, values) -> DataFrame:
    """Counts of each fixed value, zeros kept, from one aggregate row."""
    counts = cases.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("_all"))
    rows = F.array(*[
        F.struct(F.lit(v).alias(column), F.col(v).alias("cases"), _share(F.col(v), F.col("_all")).alias("share"))
        for v in values
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def cases_by_difficulty(cases: DataFrame) -> DataFrame:
    return _counts_for(approved(cases), "difficulty", DIFFICULTIES).drop("share")


def label_provenance(cases: DataFrame) -> DataFrame:
    """Approved cases labelled automatically against edited by people."""
    return _counts_for(approved(cases), "label_source", LABEL_SOURCES)


def cluster_freshness(cases: DataFrame, as_of: Column) -> DataFrame:
    """Per cluster the approved cases and whole days since the last approval."""
    seconds = F.expr("extract(day from gap) * 86400 + extract(hour from gap) * 3600"
                     " + extract(minute from gap) * 60 + extract(second from gap)")
    return (
        approved(cases).groupBy(F.col("source_cluster_id").alias("cluster_id"))
        .agg(F.count("*").alias("cases"), F.max("approved_at").alias("latest"))
        .withColumn("gap", as_of - F.col("latest"))
        .select("cluster_id", "cases", F.floor(seconds / 86400).cast("bigint").alias("days_since_last_added"))
    )


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "draft", "rejected")],
    )


def edits_by_field(edits: DataFrame) -> DataFrame:
    counts = edits.groupBy("field_changed").agg(F.count("*").alias("edits"))
    return counts.orderBy(F.desc("edits"), "field_changed")


def build_counters(outcomes: DataFrame) -> DataFrame:
    """Created (auto-approved, draft), deduplicated and failed candidates.

    ``outcomes`` has ``outcome`` (created, deduped, failed) and ``status``.
    """
    created = F.col("outcome") == "created"
    return outcomes.agg(
        F.count_if(created).alias("created"),
        F.count_if(created & (F.col("status") == "approved")).alias("auto_approved"),
        F.count_if(created & (F.col("status") == "draft")).alias("draft"),
        F.count_if(F.col("outcome") == "deduped").alias("deduped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
