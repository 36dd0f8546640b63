"""Reading, merging and writing the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.operators.quality import log_errors
from tracesieve.schemas import CASE, LIST_FIELDS, LOG

_BAD = "_bad_line"

UNREADABLE = "unreadable line"


def read_logs_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid log rows, and bad lines with ``errors``: unreadable, or breaking a rule.

    Lines are split and parsed on executors; blank lines are skipped.
    """
    parsed = parsed_lines(spark.read.text(path))
    rows = with_defaults(parsed.select("value", "r.*", "readable"))
    errors = F.when(F.col("readable"), log_errors()).otherwise(F.array(F.lit(UNREADABLE)))
    checked = rows.withColumn("errors", errors)
    valid = checked.filter(F.size("errors") == 0).drop("value", "readable", "errors")
    return valid, checked.filter(F.size("errors") > 0).select("value", "errors")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``value`` (the line), ``r`` (its log record) and ``readable``; blank lines are skipped.

    The record is a generated row, so that conditions on its fields do not parse the line again.
    """
    lines = lines.filter(F.length(F.trim("value")) > 0)
    schema = T.StructType(LOG.fields + [T.StructField(_BAD, T.StringType(), True)])
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    parsed = lines.select("value", F.explode(F.array(record)).alias("r"))
    readable = F.col("r").isNotNull() & F.col(f"r.{_BAD}").isNull()
    return parsed.select("value", F.col("r").dropFields(_BAD).alias("r"), readable.alias("readable"))


def with_defaults(logs: DataFrame) -> DataFrame:
    """Fields a record may leave out."""
    return logs.withColumns({
        "user_feedback": F.coalesce("user_feedback", F.lit("none")),
        "retry_count": F.coalesce("retry_count", F.lit(0)),
        "redacted": F.coalesce("redacted", F.lit(False)),
        "is_safety_edge_case": F.coalesce("is_safety_edge_case", F.lit(False)),
    })


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table; a missing one is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, LOG)


def scan_cases(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """All cases, or those of one status (the filter reaches the files)."""
    cases = scan(spark, path, CASE)
    return cases if status is None else cases.filter(F.col("status") == status)


def lookup_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Cases whose case_id is in ``ids``."""
    return cases.join(ids.select("case_id"), "case_id", "left_semi")


def latest_by_key(batch: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key; combined map-side, so repeated keys do not pile up."""
    rest = [c for c in batch.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return last.select(key, "row.*").select(*batch.columns)


def upsert_by_key(existing: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """New rows replace rows of the same key; within the batch the last by ``seq`` wins."""
    newest = latest_by_key(batch, key, [seq]).drop(seq)
    return existing.join(newest.select(key), key, "left_anti").unionByName(newest)


def encode_case_lists(cases: DataFrame) -> DataFrame:
    """List columns as JSON text; null stays null, missing tags become ``[]``."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return cases.withColumns({
        name: F.to_json(tags if name == "tags" else F.col(name)) for name in LIST_FIELDS
    })


def decode_case_lists(cases: DataFrame) -> DataFrame:
    """JSON text back to lists; empty text gives null, for tags an empty list."""

    def parse(name: str) -> Column:
        return F.when(F.length(name) > 0, F.from_json(name, "array<string>"))

    empty = F.array().cast("array<string>")
    return cases.withColumns({
        name: F.coalesce(parse(name), empty) if name == "tags" else parse(name) for name in LIST_FIELDS
    })


def add_missing_columns(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of an older layout with the newer columns as nulls."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return empty.unionByName(rows, allowMissingColumns=True)


def write_candidates(result: dict[str, DataFrame], path: str) -> None:
    """The cluster, candidate and preview tables of a selection."""
    for name in ("clusters", "candidates", "previews"):
        result[name].write.mode("overwrite").parquet(f"{path}/{name}")


def append_run(results: DataFrame, path: str) -> None:
    """Add run results; readers of one run only open its folder."""
    results.write.mode("append").partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed("timestamp", "run_ts")
