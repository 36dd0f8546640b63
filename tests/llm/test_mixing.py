"""Mixing where rows repeat, against the SQL and the targets."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tracesieve.llm import mixing
from tracesieve.llm.oracles import MIX_SQL

ROW = "doc_id long, text string, source string, n_chars long"


def compare(docs):
    mix = F.col("mix.whole") * F.col("mix.size") + F.col("mix.extra")
    got = [tuple(r) for r in mixing.mix_sources(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", mix.cast("long").alias("taken")).collect()]
    documents = docs.toArrow()  # noqa: F841 - read by the query
    assert Counter(got) == Counter(duckdb.sql(MIX_SQL).fetchall())
    return got


def test_one_row_repeated(spark):
    rows = [(7, "w " * 10, "a", 20)] * 1000 + [(i, "w " * 11, "b", 22) for i in range(1000, 1900)]
    docs = spark.createDataFrame(rows, ROW).repartition(7)
    got = compare(docs)
    for source in {r[2] for r in got}:
        taken = [(r[4], r[3]) for r in got if r[2] == source]
        assert sum(t for t, _ in taken) == pytest.approx(taken[0][1], abs=0.5)
    sizes = mixing.repeated_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in sizes} == {"a": 6633, "b": 13267}


def test_repeated_ids_with_other_texts_and_null_sources(spark):
    rows = [(5, "a b c", None, 5)] * 40 + [(5, "d e f", None, 5)] * 30 + [(5, "x", None, 1)] * 9 + [(None, "p q", None, 3)] * 12 + [(None, None, None, None), (5, "", None, 0)]
    rows += [(i, "w " * (i % 9), "z", i) for i in range(80)] + [(3, "w w w", "z", 3)] * 50
    docs = spark.createDataFrame(rows, ROW).withColumn("number", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit(3)).withColumn("same", F.lit(4))
    got = compare(docs)
    assert len(got) == len(rows)
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "mix"] and out.filter("number = 1 and row = 2 and key = 3 and same = 4").count() == len(rows)


def test_cut_at_a_repeated_word_count(spark):
    docs = spark.createDataFrame([(1, "one two three", "s", 13)] * 5 + [(2, "four five", "t", 9)] * 7, ROW)
    got = compare(docs)
    assert max(r[4] / r[1] for r in got) <= mixing.MAX_EPOCHS
