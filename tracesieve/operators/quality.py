"""Validation rules and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.rules import classify_log
from tracesieve.schemas import FEEDBACK, NOISE

# Report thresholds.
MIN_FEATURES, MAX_FEATURE_SHARE, MAX_REDACTION_RATE, MAX_BLANK_RATE = 3, 0.5, 0.6, 0.1
MAX_NOISE_RATIO, MAX_CLUSTER_SHARE, MIN_UNIQUE_SCORES = 0.30, 0.45, 0.7
SAMPLERS = ("random", "failure_biased", "diversity")


def _broken(rule: Column, reason: str) -> Column:
    return F.when(F.coalesce(rule, F.lit(True)), F.lit(reason))


def _blank(name: str) -> Column:
    return ~F.coalesce(F.col(name).rlike(r"(?U)\S"), F.lit(False))


def log_errors() -> Column:
    """Names of the rules a log row breaks."""
    real_method = ~F.coalesce(F.col("redaction_method"), F.lit("none")).isin("none")
    checks = [_broken(F.length(c) == 0, f"empty {c}") for c in ("system_prompt", "prompt", "response")]
    checks += [
        _broken(F.col(c) < 0, f"negative {c}")
        for c in ("latency_ms", "prompt_tokens", "completion_tokens", "retry_count")
    ]
    checks += [
        _broken(~F.col("user_feedback").isin(*FEEDBACK), "unknown user_feedback"),
        _broken(~F.coalesce("redaction_method", F.lit("none")).isin("regex_v1", "none"), "unknown redaction_method"),
        _broken(F.col("redacted") & ~real_method, "redacted without method"),
        _broken(~F.col("redacted") & real_method, "method without redaction"),
    ]
    return F.array_compact(F.array(*checks))


def case_errors() -> Column:
    """Names of the rules a case row breaks. Deprecated cases keep ``approved_at``."""
    behaviour = F.col("eval_type").isin("golden_answer", "expected_refusal") & _blank("expected_behavior")
    rubric = (F.col("eval_type") == "rubric") & (F.coalesce(F.array_size("rubric"), F.lit(0)) == 0)
    checks = [
        _broken(behaviour, "needs expected_behavior"),
        _broken(rubric, "needs rubric"),
        _broken(~F.col("confidence_score").between(0.0, 1.0), "confidence_score out of range"),
        _broken((F.col("status") == "approved") & F.col("approved_at").isNull(), "approved without approved_at"),
        _broken(
            F.col("status").isin("draft", "rejected") & F.col("approved_at").isNotNull(),
            "approved_at on unapproved case",
        ),
    ]
    return F.array_compact(F.array(*checks))


def _split(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def validate_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid rows with an ``errors`` column."""
    return _split(logs, log_errors())


def validate_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(cases, case_errors())


def _rows(one_row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Turn a one-row frame into ``(check, value, verdict)`` rows."""
    entries = [
        F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), verdict.alias("verdict"))
        for name, value, verdict in checks
    ]
    return one_row.select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def _verdict(fails: Column, level: str = "warn") -> Column:
    return F.when(fails, F.lit(level)).otherwise(F.lit("ok"))


def log_quality_report(logs: DataFrame) -> DataFrame:
    """Distribution, redaction, signal and field checks of a log table."""
    shares = logs.groupBy("feature_name").count().agg(
        F.count("*").alias("features"), (F.max("count") / F.sum("count")).alias("share")
    )
    n = F.count("*")
    totals = logs.agg(
        n.alias("n"),
        (F.count_if("redacted") / n).alias("redaction_rate"),
        F.count_if(F.col("retry_count") > 0).alias("retries"),
        F.count_if(F.col("error_status").isNotNull()).alias("failed"),
        F.count_if("is_safety_edge_case").alias("safety"),
        F.count_if(F.col("user_feedback") == "negative").alias("negative"),
        F.count_if(_blank("prompt")).alias("blank_prompts"),
        F.count_if(_blank("response")).alias("blank_responses"),
        F.count_if((F.col("prompt_tokens") == 0) | (F.col("completion_tokens") == 0)).alias("zero_tokens"),
        (n - F.count_distinct("log_id")).alias("duplicates"),
    ).withColumn("blank_rate", F.expr("(blank_prompts + blank_responses) / (2 * n)"))
    col = F.col
    return _rows(shares, [
        ("features", col("features"), _verdict(col("features") < MIN_FEATURES)),
        ("largest_feature_share", col("share"), _verdict(col("share") > MAX_FEATURE_SHARE)),
    ]).unionByName(_rows(totals, [
        ("redaction_rate", col("redaction_rate"),
         _verdict((col("redaction_rate") == 0) | (col("redaction_rate") > MAX_REDACTION_RATE))),
        ("retries", col("retries"), _verdict(col("retries") == 0)),
        ("errors", col("failed"), _verdict(col("failed") == 0)),
        ("safety", col("safety"), _verdict(col("safety") == 0)),
        ("negative_feedback", col("negative"), F.lit("ok")),
        ("blank_prompts", col("blank_prompts"), _verdict(col("blank_prompts") > 0)),
        ("blank_responses", col("blank_responses"), _verdict(col("blank_responses") > 0)),
        ("zero_tokens", col("zero_tokens"), _verdict(col("zero_tokens") > 0)),
        ("duplicate_ids", col("duplicates"), _verdict(col("duplicates") > 0)),
        ("blank_rate", col("blank_rate"), _verdict(col("blank_rate") > MAX_BLANK_RATE, "fail")),
    ]))


def candidate_quality_report(
    assigned: DataFrame, clusters: DataFrame, candidates: DataFrame, previews: DataFrame
) -> DataFrame:
    """Checks of a candidate selection.

    ``assigned`` (log_id, cluster_id) covers all logs, ``clusters`` names them
    (cluster_id, label, description), ``candidates`` is the top list
    (cluster_id, value_score) and ``previews`` holds (sampler, log_id).
    """
    col = F.col
    sizes = assigned.groupBy("cluster_id").count()
    clustered = col("cluster_id") != NOISE
    health = sizes.agg(
        F.count_if(clustered).alias("n_clusters"),
        (F.coalesce(F.sum(F.when(~clustered, col("count"))), F.lit(0)) / F.sum("count")).alias("noise_ratio"),
        (F.max(F.when(clustered, col("count"))) / F.sum(F.when(clustered, col("count")))).alias("largest_share"),
    )
    labels = clusters.agg(F.count_if(
        F.contains("label", F.lit("_unlabeled")) | F.contains("description", F.lit("labeling failed"))
    ).alias("placeholders"))
    scores = candidates.agg(
        F.count("*").alias("n"), F.count_distinct("value_score").alias("unique_scores"),
        F.count_if(~clustered).alias("noise"),
    )
    present = previews.agg(*[F.count_if(col("sampler") == name).alias(name) for name in SAMPLERS])
    absent = sum((F.when(col(name) == 0, 1).otherwise(0) for name in SAMPLERS), F.lit(0))
    parts = [
        _rows(health, [
            ("clusters", col("n_clusters"),
             F.when(col("n_clusters") == 0, "fail").when(col("n_clusters") == 1, "warn").otherwise("ok")),
            ("noise_ratio", col("noise_ratio"), _verdict((col("n_clusters") > 1) & (col("noise_ratio") > MAX_NOISE_RATIO))),
            ("largest_cluster_share", col("largest_share"), _verdict(col("largest_share") > MAX_CLUSTER_SHARE)),
        ]),
        _rows(labels, [("placeholder_labels", col("placeholders"), _verdict(col("placeholders") > 0))]),
        _rows(scores, [
            ("candidates", col("n"), _verdict(col("n") == 0, "fail")),
            ("unique_scores", col("unique_scores"), _verdict(col("unique_scores") < col("n") * MIN_UNIQUE_SCORES)),
            ("noise_in_top", col("noise"),
             F.when(col("noise") == 0, "note").when(col("noise") == col("n"), "warn").otherwise("ok")),
        ]),
        _rows(present, [("missing_previews", absent, _verdict(absent > 0))]),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def samples_per_category(logs: DataFrame) -> DataFrame:
    """The first log (by id) of each category."""
    kept = [c for c in logs.columns if c != "log_id"]
    return (
        logs.withColumn("category", classify_log())
        .groupBy("category")
        .agg(F.min_by(F.struct("log_id", *kept), "log_id").alias("row"))
        .select("category", "row.*")
    )
