"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.llm import align, language, licenses, mixing, phrases, pieces, private, quality, rules, simhash, toxicity, urls, vectors
from tracesieve.llm.common import remainder, small_batches, table
from tracesieve.llm.oracles import MIX_SQL, PHRASES_SQL, RULES_SQL, URLS_SQL


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op2_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_data(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    taken = F.col("mix.whole") * F.col("mix.size") + F.col("mix.extra")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.cast("long").alias("taken"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recall = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("recall", F.lit(recall).cast("double"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    scored = docs.select("doc_id", quality.score(F.col("text"), quality.fit(docs, table(spark, sf_dir, "labels"))).alias("score"))
    held = F.coalesce(remainder(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned_documents(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_private, op3_pieces, op4_toxicity, op5_mixing, op6_rules, op7_vectors, op8_quality, op9_simhash, op10_licenses,
        op11_alignment, op12_phrases, op13_urls,
    )
}
ORACLES = {"op5_mixing": MIX_SQL, "op6_rules": RULES_SQL, "op12_phrases": PHRASES_SQL, "op13_urls": URLS_SQL}
