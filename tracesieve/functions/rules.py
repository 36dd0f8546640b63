"""Row-level rules: failure weight, type, difficulty, confidence, routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.schemas import TRANSITIONS

# Failure weights and thresholds.
NEGATIVE_WEIGHT, RETRY_WEIGHT, RETRY_CAP, ERROR_WEIGHT, SAFETY_WEIGHT = 3.0, 2.0, 3, 4.0, 5.0
MAX_FAILURE_WEIGHT = 19.0
FEATURE_EVAL_TYPES = {"sql_query_generator": "golden_answer", "code_review_assistant": "golden_answer"}
AGREEMENT_SCORE, DISAGREEMENT_SCORE = 1.0, 0.3
APPROVE_AT = 0.75
HIGH_PRIORITY_BELOW = 0.65
PREVIEW_CHARS = 150


def failure_weight() -> Column:
    """1 plus a boost per failure signal of the log row; between 1 and 19."""
    return (
        F.lit(1.0)
        + F.when(F.col("user_feedback") == "negative", NEGATIVE_WEIGHT).otherwise(0.0)
        + F.least(F.col("retry_count"), F.lit(RETRY_CAP)) * RETRY_WEIGHT
        + F.when(F.col("error_status").isNotNull(), ERROR_WEIGHT).otherwise(0.0)
        + F.when(F.col("is_safety_edge_case"), SAFETY_WEIGHT).otherwise(0.0)
    )


def classify_log() -> Column:
    """First matching category of a log row."""
    return (
        F.when(F.col("is_safety_edge_case"), "safety")
        .when(F.col("error_status") == "malformed_output", "malformed")
        .when(F.col("retry_count") > 0, "retry")
        .when(F.col("user_feedback") == "negative", "bad")
        .otherwise("good")
    )


def decide_eval_type(hints: Mapping[str, str] = FEATURE_EVAL_TYPES) -> Column:
    """Safety logs expect a refusal; hinted features their type; the rest a rubric."""
    chosen = F.when(F.col("is_safety_edge_case"), "expected_refusal")
    for feature, eval_type in hints.items():
        chosen = chosen.when(F.col("feature_name") == feature, eval_type)
    return chosen.otherwise("rubric")


def decide_difficulty() -> Column:
    hard = F.col("is_safety_edge_case") | F.col("error_status").isNotNull() | (F.col("retry_count") > 0)
    return F.when(hard, "hard").when(F.col("user_feedback") == "negative", "medium").otherwise("easy")


def label_confidence(quality: Column, agreed: Column) -> Column:
    """Half judge quality, half agreement; null when the quality is out of range."""
    agreement = F.when(agreed, AGREEMENT_SCORE).otherwise(DISAGREEMENT_SCORE)
    return F.when(quality.between(0.0, 1.0), quality * 0.5 + agreement * 0.5)


def confidence_error(quality: Column) -> Column:
    return F.when(
        ~F.coalesce(quality.between(0.0, 1.0), F.lit(False)),
        F.concat(F.lit("quality_score out of range: "), F.coalesce(quality.cast("string"), F.lit("null"))),
    )


def route_cases(df: DataFrame, as_of: Column, threshold: float = APPROVE_AT) -> DataFrame:
    """Approve confident cases automatically; keep the others as drafts."""
    confident = F.col("confidence_score") >= threshold
    return df.withColumns({
        "status": F.when(confident, "approved").otherwise("draft"),
        "reviewer_id": F.when(confident, "auto"),
        "approved_at": F.when(confident, as_of),
    })


def confidence_bucket(score: Column) -> Column:
    return (
        F.when(score < HIGH_PRIORITY_BELOW, "High review priority")
        .when(score < APPROVE_AT, "Review required")
        .otherwise("Higher confidence")
    )


def prompt_preview(prompt: Column) -> Column:
    return F.substring(prompt, 1, PREVIEW_CHARS)


def transition_status(df: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Apply ``new_status`` (with optional ``by`` and ``notes``) to case rows.

    Returns the changed rows and the rows whose transition is not allowed.
    """
    pair = F.struct(F.col("status").alias("from_status"), F.col("new_status").alias("to_status"))
    allowed = F.lit(False)
    for before, after in TRANSITIONS:
        allowed = allowed | ((F.col("status") == before) & (F.col("new_status") == after))
    checked = df.withColumn("_allowed", F.coalesce(allowed, F.lit(False)))
    changed = checked.filter("_allowed").withColumns({
        "reviewer_id": F.coalesce("by", "reviewer_id"),
        "review_notes": F.coalesce("notes", "review_notes"),
        "approved_at": F.when(F.col("new_status") == "approved", as_of).otherwise(F.col("approved_at")),
        "status": F.col("new_status"),
    }).drop("_allowed", "new_status", "by", "notes")
    refused = checked.filter("not _allowed").select(
        "*", F.concat(F.lit("invalid transition: "), pair["from_status"], F.lit(" -> "), pair["to_status"]).alias("error")
    ).drop("_allowed")
    return changed, refused
