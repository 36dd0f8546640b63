"""Resumable ingestion of new log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracesieve.functions.text import redact_log_fields, redact_text
from tracesieve.operators.quality import log_errors
from tracesieve.session import cut
from tracesieve.sources.snapshots import commit, committed, discard, size_of
from tracesieve.sources.tables import UNREADABLE, latest_by_key, parsed_lines, with_defaults


#: Parts of the resolved rows; a batch writes anew only those that it touches.
BUCKETS = 64
#: Stored rows that one task merges, in bytes of their files; small batches give one file for each bucket.
MERGE_BYTES = 64 << 20
#: Codec of everything that is stored: texts are most of it.
CODEC = "zstd"


def ingest_stream(
    spark: SparkSession, source: str, table: str, checkpoint: str, redact: bool = True, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append new JSONL files of ``source`` to ``table``; start it again to resume.

    Each batch is parsed once into a folder beside ``table`` that is dropped with the batch. It
    overwrites its own ``batch_id`` folder, and its newest row of every log_id is merged into the resolved rows of its bucket. A manifest, committed by one rename, names
    the folder of each bucket, so a replayed batch changes nothing and readers open resolved
    rows only. Rows of a later batch replace those of earlier ones whatever their time.
    Invalid rows go to ``{table}_invalid``; ``line`` there has the text of an unreadable line.
    Personal data is masked everywhere unless ``redact`` is off. There is no watermark.
    """
    parsed = parsed_lines(spark.readStream.text(source))
    line = redact_text(F.col("value")) if redact else F.col("value")
    rows = with_defaults(parsed.select("r.*", "readable", F.when(~F.col("readable"), line).alias("line")))
    if redact:
        rows = redact_log_fields(rows).drop("matched_types")
    errors = F.when(F.col("readable"), log_errors()).otherwise(F.array(F.lit(UNREADABLE)))
    checked = rows.withColumn("errors", errors).drop("readable")

    def store(batch: DataFrame, batch_id: int) -> None:
        # parsed once for both folders; a cached batch would lie on disk as it is, not compressed
        staged = f"{table}_staged/batch_id={batch_id}"
        _store(batch, staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        _store(rows.filter(F.size("errors") == 0).drop("errors", "line"), f"{table}/batch_id={batch_id}")
        _store(rows.filter(F.size("errors") > 0), f"{table}_invalid/batch_id={batch_id}")
        discard(spark, f"{table}_staged")
        merge_batch(spark, table, batch_id, buckets)

    return (
        checked.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _store(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("compression", CODEC).partitionBy(*by).parquet(path)


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, str]:
    """Bucket and folder of the resolved rows after the last batch, or after those ``before`` a batch."""
    known = [n for n in committed(spark, f"{table}_resolved", "manifest_") if before is None or n < before]
    if not known:
        return {}
    return {r.bucket: r.folder for r in spark.read.parquet(f"{table}_resolved/manifest_{known[-1]}").collect()}


def merge_batch(spark: SparkSession, table: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Merge a stored batch into the resolved rows; nothing happens if that was done before."""
    path = f"{table}_resolved"
    if batch_id in committed(spark, path, "manifest_"):
        return
    batch = spark.read.parquet(f"{table}/batch_id={batch_id}")
    bucket = F.pmod(F.xxhash64("log_id"), F.lit(buckets)).cast("int")
    newest = _newest(batch).withColumn("bucket", bucket)
    folders = _manifest(spark, table, batch_id)
    touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` rows
    merged, old = newest, [f"{path}/{folders[b]}" for b in touched if b in folders]
    if old:
        before = spark.read.schema(newest.schema).option("basePath", path).parquet(*old)
        # only ids are shuffled, unless more are replaced than a broadcast takes
        replaced = cut(before.select("log_id").join(batch.select("log_id"), "log_id", "left_semi"))
        merged = before.join(replaced, "log_id", "left_anti").select(newest.columns).unionByName(newest)
    if touched:
        stored = sum(size_of(spark, folder) for folder in (f"{table}/batch_id={batch_id}", *old))
        _store(merged.coalesce(-(-stored // MERGE_BYTES)), f"{path}/batch={batch_id}", "bucket")
    folders |= {b: f"batch={batch_id}/bucket={b}" for b in touched}
    rows = spark.createDataFrame(list(folders.items()), "bucket int, folder string")
    commit(spark, path, f"manifest_{batch_id}", lambda staging: rows.coalesce(1).write.parquet(staging))


def _newest(batch: DataFrame) -> DataFrame:
    """The newest row of every log_id; only ids, and rows of ids that come again, are shuffled."""
    again = cut(batch.groupBy("log_id").count().filter("count > 1").select(F.col("log_id").alias("again")))
    same = F.col("log_id").eqNullSafe(F.col("again"))
    repeated = latest_by_key(batch.join(again, same, "left_semi"), "log_id", ["timestamp"])
    return batch.join(again, same, "left_anti").unionByName(repeated)


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of every log_id over all batches: the resolved rows, nothing else is opened."""
    folders = _manifest(spark, table)
    schema = spark.read.option("basePath", table).parquet(f"{table}/batch_id=*").drop("batch_id").schema
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table}_resolved/{folder}" for folder in folders.values()])


def compact(spark: SparkSession, table: str, target: str) -> None:
    """Write the resolved rows as the first batch of a new table folder."""
    _store(read_ingested(spark, table), f"{target}/batch_id=0")
    merge_batch(spark, target, 0)
