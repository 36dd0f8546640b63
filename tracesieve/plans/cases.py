"""From ranked candidates to evaluation cases."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.rules import APPROVE_AT, decide_difficulty, decide_eval_type, route_cases
from tracesieve.functions.text import stable_id
from tracesieve.operators.dedup import THRESHOLD, arrange, decide_again, dedup_rejections, first_decision, outcome
from tracesieve.operators.modelmap import Model, generate_labels, judge_labels
from tracesieve.operators.quality import validate_cases
from tracesieve.schemas import CASE
from tracesieve.operators.vectors import usable
from tracesieve.session import checkpoint_dir, cut


def candidates_with_logs(candidates: DataFrame, logs: DataFrame) -> DataFrame:
    """Candidates with their full log; ``found`` is false where there is none."""
    marked = logs.drop("cluster_id").withColumn("found", F.lit(True))
    joined = candidates.join(marked, "log_id", "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def build_cases(
    candidates: DataFrame,
    logs: DataFrame,
    vectors: DataFrame,
    existing: DataFrame | None,
    model: Model,
    as_of: Column,
    guidance: DataFrame | None = None,
    threshold: float = THRESHOLD,
    approve_at: float = APPROVE_AT,
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, dedup rejections and the outcome of every candidate with its reason.

    ``candidates``: log_id, cluster_id, value_score. ``vectors`` and
    ``existing``: id, v. Duplicates are dropped before any model call. A
    candidate whose label fails must not shadow a later near-copy: only the rows
    near it and after it are decided again, and what they change in turn. Labels are
    kept and never asked twice; ``options`` go to ``llm_map``, so with ``store`` a
    job that starts again asks only the rest. If a round of calls brings no text at
    all, the model is taken for dead and nothing more is asked. A candidate without a log
    or a usable vector fails with that reason.
    """
    options.setdefault("store", f"{checkpoint_dir(candidates.sparkSession)}/answers-{uuid.uuid4().hex}")
    joined = cut(candidates_with_logs(candidates.select("log_id", "cluster_id", "value_score"), logs))
    typed = cut(
        joined.filter("found").withColumns({"eval_type": decide_eval_type(), "difficulty": decide_difficulty()})
        .drop("found")
    )
    scores = typed.select(F.col("log_id").alias("id"), F.col("value_score").alias("score"))
    # vectors that a view derives are derived once, and only those asked for
    derived = cut(vectors.select("id", "v").join(scores.select("id"), "id", "left_semi"))
    ranked = cut(usable(scores.join(derived, "id"), "euclidean", True))
    rows = arrange(ranked, existing, threshold)
    accepted = first_decision(rows)
    labelled = _as_cases(typed.limit(0).withColumns({
        "expected_behavior": F.lit(None).cast("string"), "rubric": F.lit(None).cast("array<string>"),
        "forbidden_assertions": F.lit(None).cast("array<string>"), "tags": F.lit(None).cast("array<string>"),
        "confidence_score": F.lit(None).cast("double"), "error": F.lit(None).cast("string"), "replied": F.lit(True),
    }), as_of, approve_at)
    dead = False
    while True:
        todo = cut(typed.join(accepted.select(F.col("id").alias("log_id")), "log_id").join(labelled.select("log_id"), "log_id", "left_anti"))
        if todo.isEmpty():
            break
        fresh = cut(_as_cases(judge_labels(generate_labels(todo, model, guidance, **options), model, **options), as_of, approve_at))
        labelled = cut(labelled.unionByName(fresh))
        bad = fresh.filter("error is not null").select(F.col("log_id").alias("id"))
        dead = fresh.filter("replied").isEmpty()
        if dead or bad.isEmpty():
            break
        failed = labelled.filter("error is not null").select(F.col("log_id").alias("id"))
        accepted = decide_again(rows, accepted, failed, bad)
    good = accepted.join(labelled.filter("error is null").select(F.col("log_id").alias("id")), "id", "left_semi")
    # a row that failed, or was not tried, counts as a duplicate if a near row before it made a case
    decided = cut(outcome(rows, cut(good)).filter("accepted or most_similar_id is not null"))
    rejected = dedup_rejections(decided, as_of, threshold)
    kept = labelled.filter("error is null").join(good.select(F.col("id").alias("log_id")), "log_id", "left_semi")
    cases = kept.select([f.name for f in CASE.fields])
    known = ranked.select(F.col("id").alias("log_id"), F.lit(True).alias("has_vector"))
    outcomes = (
        joined.select("log_id", "found").join(known, "log_id", "left").join(kept.select("log_id", "status"), "log_id", "left")
        .join(rejected.select(F.col("source_log_id").alias("log_id"), F.col("reason").alias("dup")), "log_id", "left")
        .join(labelled.select("log_id", "error"), "log_id", "left")
    )
    reason = (
        F.when(F.col("status").isNotNull(), F.lit(None).cast("string")).when(F.col("dup").isNotNull(), F.col("dup"))
        .when(~F.col("found"), "no log").when(F.col("has_vector").isNull(), "no usable vector")
        .otherwise(F.coalesce("error", F.lit("not tried: the model gave no answers")))
    )
    return cases, rejected, outcomes.select(
        "log_id", "status",
        F.when(F.col("status").isNotNull(), "created").when(F.col("dup").isNotNull(), "deduped").otherwise("failed").alias("outcome"),
        reason.alias("reason"),
    )


def _as_cases(judged: DataFrame, as_of: Column, approve_at: float) -> DataFrame:
    """Judged labels as case rows with log_id and error; invalid ones get an error."""
    shaped = judged.withColumns({
        "case_id": stable_id("case", F.col("log_id")),
        "source_log_id": F.col("log_id"),
        "source_cluster_id": F.col("cluster_id").cast("int"),
        "input": F.struct("system_prompt", "prompt"),
        "label_source": F.lit("auto"),
        "review_notes": F.lit(None).cast("string"),
        "created_at": as_of,
        "revises_case_id": F.lit(None).cast("string"),
    })
    routed = route_cases(shaped, as_of, approve_at)
    keep = ["log_id", "error", "replied", *[f.name for f in CASE.fields]]
    fine = routed.filter("error is null").select(*keep)
    broken = routed.filter("error is not null").select(*keep)
    valid, invalid = validate_cases(fine)
    invalid = invalid.withColumn("error", F.array_join("errors", "; ")).drop("errors")
    return valid.unionByName(invalid.select(*keep)).unionByName(broken)
