"""Numbered versions of a table, each committed by one rename.

A version is written whole into a staging folder beside the others and then renamed to
its number. A job that stops before the rename leaves no version behind, only a staging
folder that no reader sees; one that finds its number taken stops with an error.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracesieve.sources.tables import upsert_by_key

STAGING = "_staging-"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a folder."""
    folder, files = _files(spark, path)
    return files.getContentSummary(folder).getLength()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder, files = _files(spark, path)
    files.delete(folder, True)


def committed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the versions ``{prefix}{n}`` under ``path``, from the names of the folders."""
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    names = (status.getPath().getName() for status in files.listStatus(folder))
    found = (re.fullmatch(re.escape(prefix) + r"(\d+)", name) for name in names)
    return sorted(int(m.group(1)) for m in found if m)


def commit(spark: SparkSession, path: str, name: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a staging folder, then rename it to ``name``; returns the new path."""
    staging = f"{path}/{STAGING}{uuid.uuid4().hex}"
    write(staging)
    source, files = _files(spark, staging)
    target, _ = _files(spark, f"{path}/{name}")
    if files.exists(target) or not files.rename(source, target):
        raise FileExistsError(f"{path}/{name} was written by another job")
    return f"{path}/{name}"


def abandoned(spark: SparkSession, path: str) -> list[str]:
    """Staging folders of jobs that stopped, or that still run."""
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    return sorted(str(s.getPath()) for s in files.listStatus(folder) if s.getPath().getName().startswith(STAGING))


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last; no version gives no rows."""
    known = committed(spark, path, "snapshot_")
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/snapshot_{version or known[-1]}")


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, key: str, seq: str) -> int:
    """Write the next snapshot: rows of ``batch`` replace those of the same key, the last by ``seq`` wins.

    Doing it again with the same batch gives an equal snapshot. Returns the version.
    """
    known = committed(spark, path, "snapshot_")
    merged = upsert_by_key(read_snapshot(spark, path, batch.drop(seq).schema), batch, key, seq)
    version = (known[-1] if known else 0) + 1
    commit(spark, path, f"snapshot_{version}", lambda staging: merged.write.parquet(staging))
    return version
