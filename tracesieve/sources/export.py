"""Versioned JSONL exports of approved cases and their changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesieve.sources.snapshots import commit, committed


def export_record(cases: DataFrame, as_of: Column) -> DataFrame:
    """Cases in the shape of an export line."""
    added = F.date_format(F.coalesce("approved_at", as_of), "yyyy-MM-dd'T'HH:mm:ss")
    return cases.select(
        "case_id", "input", "eval_type", "expected_behavior", "rubric", "forbidden_assertions", "tags", "difficulty",
        F.col("source_cluster_id").alias("source_cluster"), added.alias("date_added"),
    )


ENTRY = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("exported_at", T.TimestampNTZType()), T.StructField("total", T.LongType()),
    T.StructField("added", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("note", T.StringType()),
])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the exports under ``path``, from the names of its folders."""
    return committed(spark, path, "eval_dataset_v")


def export_diff(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """case_id and change (added, removed) against the version before."""
    now = current.select("case_id")
    if previous is None:
        return now.select("case_id", F.lit("added").alias("change"))
    before = previous.select("case_id")
    added = now.join(before, "case_id", "left_anti").select("case_id", F.lit("added").alias("change"))
    removed = before.join(now, "case_id", "left_anti").select("case_id", F.lit("removed").alias("change"))
    return added.unionByName(removed)


def changelog_entry(current: DataFrame, diff: DataFrame, version: int, as_of: Column) -> DataFrame:
    """One row: version, time, total, added, removed and a note."""
    total = current.agg(F.count("*").alias("n")).scalar()
    counts = diff.agg(
        F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed")
    )
    note = (
        F.when(F.lit(version == 1), "initial export")
        .when((F.col("added") == 0) & (F.col("removed") == 0), "no change from previous version")
    )
    return counts.select(
        F.lit(version).alias("version"), as_of.alias("exported_at"), total.alias("total"), "added", "removed",
        note.alias("note"),
    )


def render_changelog(entry: DataFrame, diff: DataFrame, listed: int = 50) -> DataFrame:
    """An entry as text; it names the first ids of each kind and counts them all.

    Every id is in the table that ``changes`` reads.
    """
    def first(change: str) -> Column:
        names = diff.filter(F.col("change") == change).orderBy("case_id").limit(listed)
        return names.agg(F.array_join(F.array_sort(F.collect_list("case_id")), ", ").alias("ids")).scalar()

    def line(change: str) -> Column:
        more = F.when(F.col(change) > listed, F.lit(", ... (all in changes)")).otherwise("")
        return F.when(
            F.col(change) > 0, F.concat(F.lit(f"- {change} ("), F.col(change).cast("string"), F.lit("): "), first(change), more)
        )

    return entry.select(F.concat_ws(
        "\n",
        F.concat(F.lit("## v"), F.col("version").cast("string"), F.lit(" "), F.date_format("exported_at", "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("- total approved cases: "), F.col("total").cast("string")),
        line("added"), line("removed"), F.concat(F.lit("- "), F.col("note")),
    ).alias("text"))


def changes(spark: SparkSession, path: str, version: int) -> DataFrame:
    """case_id and change of every case that a version added or removed."""
    return spark.read.schema("case_id string, change string").parquet(f"{path}/eval_dataset_v{version}/_changes")


def changelog(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all versions."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(*[f"{path}/eval_dataset_v{v}/_entry" for v in known])


def export_versioned(cases: DataFrame, path: str, as_of: Column) -> DataFrame:
    """Write the approved cases as the next version; returns the changelog row.

    JSON lines go to ``path/eval_dataset_v{n}``, with every added and removed id (case_id,
    change) in ``_changes`` and the entry in ``_entry`` of the same folder; the three appear
    together by one rename, so no version lacks its entry. Nulls are kept, and no cases
    give a valid empty export.
    """
    spark = cases.sparkSession
    known = versions(spark, path)
    version = max(known, default=0) + 1
    records = export_record(cases.filter(F.col("status") == "approved"), as_of)
    previous = spark.read.schema("case_id string").json(f"{path}/eval_dataset_v{version - 1}") if known else None

    def write(staging: str) -> None:
        records.write.option("ignoreNullFields", "false").json(staging)
        written = spark.read.schema(records.schema).json(staging)
        export_diff(written, previous).write.parquet(f"{staging}/_changes")
        diff = spark.read.schema("case_id string, change string").parquet(f"{staging}/_changes")
        entry = changelog_entry(written, diff, version, as_of)
        entry.select([F.col(f.name).cast(f.dataType) for f in ENTRY.fields]).write.parquet(f"{staging}/_entry")

    commit(spark, path, f"eval_dataset_v{version}", write)
    return changelog(spark, path).filter(F.col("version") == version)
