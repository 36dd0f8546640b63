"""The way of a log through the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.operators.ordering import number_rows
from tracesieve.operators.runs import latest_result

#: Edits that one row of a trace lists; further ones follow in rows of their own.
EDITS_PER_ROW = 1000


def edit_pages(edits: DataFrame, per_row: int = EDITS_PER_ROW) -> DataFrame:
    """(case_id, page, edits, last_edit, history): the edits of each case in time order, at most ``per_row`` a row."""
    numbered = number_rows(edits, ["edit_ts", "edit_id"], "seq", keys=["case_id"])
    per_case = edits.groupBy("case_id").agg(F.count("*").alias("edits"), F.max("edit_ts").alias("last_edit"))
    listed = F.struct("seq", *[c for c in edits.columns if c != "case_id"])
    pages = numbered.groupBy("case_id", F.floor((F.col("seq") - 1) / per_row).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(listed)).alias("history")
    )
    return pages.join(per_case, "case_id")


def trace_logs(logs: DataFrame, cases: DataFrame, edits: DataFrame, runs: DataFrame, per_row: int = EDITS_PER_ROW) -> DataFrame:
    """One row per log and case (or per log without case), with its edits in time order and the stage reached.

    ``history`` holds the edits as an array. A case may have any number of them, so a row
    lists ``per_row`` at most and the next ones follow in a row with the next ``page``;
    ``edits`` counts all. Stages: logged, labelled, reviewed, approved, evaluated.
    """
    last_run = latest_result(runs).select("case_id", F.col("run_id").alias("last_run"), F.col("passed").alias("last_passed"))
    followed = (
        cases.withColumnRenamed("source_log_id", "log_id")
        .join(edit_pages(edits, per_row), "case_id", "left").join(last_run, "case_id", "left")
    )
    traced = logs.join(followed, "log_id", "left")
    stage = (
        F.when(F.col("case_id").isNull(), "logged")
        .when(F.col("last_run").isNotNull(), "evaluated")
        .when(F.col("status") == "approved", "approved")
        .when(F.col("edits") > 0, "reviewed")
        .otherwise("labelled")
    )
    return traced.withColumns({
        "edits": F.coalesce("edits", F.lit(0)), "page": F.coalesce("page", F.lit(0)), "history": F.coalesce("history", F.array()), "stage": stage,
    })


def in_demo_order(traced: DataFrame) -> DataFrame:
    """Number the rows (``place``): logs that became cases first, then by id."""
    without = traced.withColumn("_without", F.col("case_id").isNull())
    return number_rows(without, ["_without", "log_id", "case_id", "page"], "place").drop("_without")
