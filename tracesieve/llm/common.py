"""Shared pieces: column checks, training samples, components of a graph, clean-up of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.session import cut

#: Rows in one Arrow batch: long texts are held a few hundred at a time.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``cut`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int, modulus: int, out: int) -> DataFrame:
    """About ``cap`` rows (text, label), a uniform sample by hash of the documents with a 0/1 label.

    Rows whose crc32 remainder is ``out`` and rows with a null id, text or label stay
    away. A document with several labels counts with the highest. ``cap`` bounds the
    broadcast: its ids are all that is shipped.
    """
    own = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != out))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    total = own.count()
    share = 10**9 if total <= cap else int(cap / total * 10**9)
    own = own.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(10**9)) < share)
    return (
        docs.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(own), "doc_id").select("doc_id", "text", "label")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates two contractions until nothing changes. *Large star* links every larger
    neighbour of a node to the smallest node in sight, *small star* does so for the
    smaller ones; the number of edges never grows and hubs shrink to stars, so rounds
    grow with the logarithm of the longest path. Minima are combined map-side and
    written before the join, so that adaptive execution can split a hub's rows.
    """
    edges = cut(_ordered(edges))
    known = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        lowest = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        star = large.join(lowest, "a")
        small = cut(_ordered(star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b")))))
        for old in (edges, least, large, lowest):
            discard(old)
        edges = small
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == known:
            break
        known = state
    links = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return links.union(links.select(F.col("component").alias("node"), "component").distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
