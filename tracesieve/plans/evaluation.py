"""Run approved cases against a target model and grade the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions import text
from tracesieve.operators.modelmap import Model, llm_map, prompt_hash
from tracesieve.schemas import EVAL_RUN, VERDICT_REPLY
from tracesieve.session import cut

VERDICT_SYSTEM = (
    "Decide whether a response satisfies the criteria of an evaluation case. Answer with one JSON object: "
    '{"passed": true or false, "reasoning": "..."}.'
)


def run_cases(
    cases: DataFrame, run_id: str, target: Model, judge: Model, target_name: str, judge_name: str,
    as_of: Column, limit: int | None = None, **options,
) -> DataFrame:
    """One result row per approved case; a failed call counts as a failed case."""
    if target_name == judge_name:
        raise ValueError("the judge must be another model than the target")
    approved = cases.filter(F.col("status") == "approved")
    if limit is not None:
        approved = approved.orderBy("case_id").limit(limit)
    asked = cut(approved.withColumns({
        "system": F.coalesce("input.system_prompt", F.lit("")), "user": F.col("input.prompt"),
    }).withColumn("call_id", prompt_hash(f"target:{run_id}", F.col("system"), F.col("user"), F.col("case_id"))))
    answers = llm_map(asked, target, "target", **options).select(
        "call_id", F.col("reply").alias("model_response"),
        F.when(F.col("error") != "empty reply", F.col("error")).alias("target_error"),
    )
    answered = asked.join(answers, "call_id", "left").drop("call_id", "system", "user")
    graded = cut(
        answered.withColumns({
            "system": F.lit(VERDICT_SYSTEM),
            "user": text.render_judge_prompt(
                F.col("eval_type"), F.col("expected_behavior"), F.col("rubric"),
                F.col("forbidden_assertions"), F.coalesce("model_response", F.lit("")),
            ),
        }).withColumn("call_id", prompt_hash(f"verdict:{run_id}", F.col("system"), F.col("user"), F.col("case_id")))
    )
    def parse(reply: Column) -> Column:
        return text.parse_model_json(reply, VERDICT_REPLY, ["passed"], fenced=False)

    verdicts = llm_map(graded.filter("target_error is null"), judge, "verdict", check=lambda r: parse(r)["error"], **options)
    parsed = parse(F.col("reply"))
    judged = graded.join(verdicts, "call_id", "left").withColumn("r", parsed)
    error = F.coalesce("target_error", "error", "r.error")
    return judged.select(
        F.lit(run_id).alias("run_id"), "case_id", as_of.alias("timestamp"), F.lit(target_name).alias("target_model"),
        F.lit(judge_name).alias("judge_model"), "eval_type", "source_cluster_id", "difficulty",
        F.when(error.isNull(), F.col("model_response")).otherwise("").alias("model_response"),
        F.when(error.isNull(), F.coalesce("r.value.passed", F.lit(False))).otherwise(False).alias("passed"),
        F.when(error.isNull(), F.coalesce("r.value.reasoning", F.lit("")))
        .otherwise(F.concat(F.lit("RUNNER ERROR: "), error)).alias("judge_reasoning"),
    ).select([f.name for f in EVAL_RUN.fields])


def run_summary(results: DataFrame, run_id: str) -> DataFrame:
    """One row: total, passed, failed and errors; zeros for a run without cases."""
    return results.agg(
        F.lit(run_id).alias("run_id"), F.count("*").alias("total"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.startswith("judge_reasoning", F.lit("RUNNER ERROR: "))).alias("errors"),
    )
