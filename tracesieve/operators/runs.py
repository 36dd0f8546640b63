"""Evaluation runs: list, rate, compare, inspect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = ("regression", "improvement", "unchanged_pass", "unchanged_fail", "only_in_previous", "only_in_current")


def list_runs(runs: DataFrame) -> DataFrame:
    """One row per run, newest first."""
    return (
        runs.groupBy("run_id")
        .agg(
            F.min("run_ts").alias("run_ts"), F.count("*").alias("total"),
            F.count_if("passed").alias("passed"),
        )
        .withColumn("pass_rate", F.col("passed") / F.col("total"))
        .orderBy(F.desc("run_ts"), F.desc("run_id"))
    )


def pass_rate(runs: DataFrame, run_id: str) -> DataFrame:
    """One row; the rate is null for a run without rows."""
    return runs.filter(F.col("run_id") == run_id).agg(
        F.try_divide(F.count_if("passed"), F.count("*")).alias("pass_rate")
    )


def latest_two_runs(runs: DataFrame) -> DataFrame:
    """One row: previous and current run id, null where there is none."""
    newest = list_runs(runs).limit(2)
    order = F.struct("run_ts", "run_id")
    return newest.agg(
        F.when(F.count("*") > 1, F.min_by("run_id", order)).alias("previous_run"),
        F.max_by("run_id", order).alias("current_run"),
    )


def regression_diff(runs: DataFrame, previous: str, current: str) -> DataFrame:
    """Each case of two runs with its change.

    Both runs are read in one filtered scan and meet in one aggregate, so no
    join is needed. Of repeated rows for a (run, case) the newest counts.
    """
    newest = {
        side: F.max(F.when(F.col("run_id") == run, F.struct("run_ts", "passed"))).alias(side)
        for side, run in (("prev", previous), ("cur", current))
    }
    both = (
        runs.filter(F.col("run_id").isin(previous, current))
        .groupBy("case_id").agg(*newest.values())
        .select("case_id", F.col("prev.passed").alias("before"), F.col("cur.passed").alias("now"))
    )
    change = (
        F.when(F.col("before").isNull(), "only_in_current")
        .when(F.col("now").isNull(), "only_in_previous")
        .when(F.col("before") & ~F.col("now"), "regression")
        .when(~F.col("before") & F.col("now"), "improvement")
        .when(F.col("now"), "unchanged_pass")
        .otherwise("unchanged_fail")
    )
    return both.select("case_id", change.alias("change"))


def regression_counts(diff: DataFrame) -> DataFrame:
    """Cases per change, zeros kept."""
    counts = diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in CHANGES])
    rows = F.array(*[F.struct(F.lit(c).alias("change"), F.col(c).alias("cases")) for c in CHANGES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def duplicate_results(runs: DataFrame) -> DataFrame:
    """(run, case) pairs stored more than once."""
    return runs.groupBy("run_id", "case_id").agg(F.count("*").alias("rows")).filter("rows > 1")


def latest_result(runs: DataFrame) -> DataFrame:
    """The last result of every case."""
    kept = [c for c in runs.columns if c not in ("case_id", "run_ts", "run_id")]
    return (
        runs.groupBy("case_id")
        .agg(F.max_by(F.struct("run_ts", "run_id", *kept), F.struct("run_ts", "run_id")).alias("last"))
        .select("case_id", "last.*")
    )


def run_failures(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Failed cases of the newest run, with the length of the response."""
    newest = latest_two_runs(runs).select(F.col("current_run").alias("run_id"))
    failed = runs.filter(~F.col("passed")).join(F.broadcast(newest), "run_id", "left_semi")
    return (
        failed.withColumn("response_chars", F.length("model_response"))
        .orderBy("case_id").limit(limit)
    )


def last_results(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("run_ts"), "run_id", "case_id").limit(n)
