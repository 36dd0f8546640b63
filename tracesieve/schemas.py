"""Table schemas. Times are UTC without zone; ids are always explicit columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the data model.
FEEDBACK = ("positive", "negative", "none")
REDACTION_METHODS = ("regex_v1", "none")
EVAL_TYPES = ("golden_answer", "rubric", "expected_refusal")
DIFFICULTIES = ("easy", "medium", "hard")
LABEL_SOURCES = ("auto", "human_edited")
STATUSES = ("draft", "approved", "rejected", "deprecated")
TRANSITIONS = (("draft", "approved"), ("draft", "rejected"), ("approved", "deprecated"))
EDITABLE_FIELDS = ("expected_behavior", "rubric", "forbidden_assertions", "tags", "difficulty")
LIST_FIELDS = ("rubric", "forbidden_assertions", "tags")
NOISE = -1

_STRINGS = T.ArrayType(T.StringType())


def _fields(*specs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in specs])


LOG = _fields(
    ("log_id", T.StringType()),
    ("timestamp", T.TimestampNTZType()),
    ("feature_name", T.StringType()),
    ("model", T.StringType()),
    ("system_prompt", T.StringType()),
    ("prompt", T.StringType()),
    ("response", T.StringType()),
    ("latency_ms", T.IntegerType()),
    ("prompt_tokens", T.IntegerType()),
    ("completion_tokens", T.IntegerType()),
    ("user_feedback", T.StringType()),
    ("retry_count", T.IntegerType()),
    ("error_status", T.StringType()),
    ("redacted", T.BooleanType()),
    ("redaction_method", T.StringType()),
    ("is_safety_edge_case", T.BooleanType()),
)

CASE = _fields(
    ("case_id", T.StringType()),
    ("source_log_id", T.StringType()),
    ("source_cluster_id", T.IntegerType()),
    ("input", _fields(("system_prompt", T.StringType()), ("prompt", T.StringType()))),
    ("eval_type", T.StringType()),
    ("expected_behavior", T.StringType()),
    ("rubric", _STRINGS),
    ("forbidden_assertions", _STRINGS),
    ("difficulty", T.StringType()),
    ("tags", _STRINGS),
    ("confidence_score", T.DoubleType()),
    ("label_source", T.StringType()),
    ("status", T.StringType()),
    ("reviewer_id", T.StringType()),
    ("review_notes", T.StringType()),
    ("created_at", T.TimestampNTZType()),
    ("approved_at", T.TimestampNTZType()),
    ("revises_case_id", T.StringType()),
)

DEDUP_REJECTION = _fields(
    ("rejection_id", T.StringType()),
    ("source_log_id", T.StringType()),
    ("rejected_at", T.TimestampNTZType()),
    ("most_similar_case_id", T.StringType()),
    ("similarity", T.DoubleType()),
    ("reason", T.StringType()),
)

REVIEW_EDIT = _fields(
    ("edit_id", T.StringType()),
    ("case_id", T.StringType()),
    ("field_changed", T.StringType()),
    ("before_value", T.StringType()),
    ("after_value", T.StringType()),
    ("reason", T.StringType()),
    ("reviewer_id", T.StringType()),
    ("timestamp", T.TimestampNTZType()),
)

EVAL_RUN = _fields(
    ("run_id", T.StringType()),
    ("case_id", T.StringType()),
    ("timestamp", T.TimestampNTZType()),
    ("target_model", T.StringType()),
    ("judge_model", T.StringType()),
    ("eval_type", T.StringType()),
    ("source_cluster_id", T.IntegerType()),
    ("difficulty", T.StringType()),
    ("model_response", T.StringType()),
    ("passed", T.BooleanType()),
    ("judge_reasoning", T.StringType()),
)

LABEL_REPLY = _fields(
    ("expected_behavior", T.StringType()),
    ("rubric", _STRINGS),
    ("forbidden_assertions", _STRINGS),
    ("tags", _STRINGS),
)
QUALITY_REPLY = _fields(("quality_score", T.DoubleType()), ("reasoning", T.StringType()))
VERDICT_REPLY = _fields(("passed", T.BooleanType()), ("reasoning", T.StringType()))
CLUSTER_REPLY = _fields(("label", T.StringType()), ("description", T.StringType()))
