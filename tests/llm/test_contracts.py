"""Every operator on odd tables: nulls, empty and long texts, repeats, clashing columns, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracesieve.llm import language, licenses, mixing, pieces, private, quality, rules, simhash, toxicity, vectors
from tracesieve.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.compare import compare, connect
from workload import catalog

BY_TEXT = {
    "language": lambda d, l: language.identify_languages(d),
    "private": lambda d, l: private.private_data(d),
    "pieces": lambda d, l: pieces.encode_documents(d),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "mixing": lambda d, l: mixing.mix_sources(d).select("doc_id", F.col(mixing.spare_name(d, "mix")).alias("m")),
    "rules": lambda d, l: rules.quality_rules(d).drop("rejected_by"),
    "quality": lambda d, l: d.select("doc_id", quality.score(F.col("text"), quality.fit(d, l)).alias("s")),
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "licenses": lambda d, l: licenses.license_scan(d),
}
CLASHES = ("h", "words", "score", "mix", "fp", "rep", "component_id", "size", "u", "kind", "label", "times", "turn", "cuts", "p", "s")


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", BY_TEXT)
def test_odd_rows_clashes_and_no_rows(spark, odd, odd_rows, odd_labels, name):
    run = BY_TEXT[name]
    plain = rows(run(odd, odd_labels))
    assert len(plain) == len(odd_rows)
    clashing = odd.select("*", *[F.lit(1).alias(c) for c in CLASHES])
    assert rows(run(clashing, odd_labels.withColumn("text", F.lit("x")))) == plain
    assert run(odd.limit(0), odd_labels.limit(0)).collect() == []
    run(odd, odd_labels.limit(0)).count()


def test_pipeline_stages_on_odd_rows(spark, odd, odd_labels, tmp_path):
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        clashing = odd.select("*", *[F.lit(1).alias(c) for c in CLASHES])
        out = stage(spark, clashing, str(tmp_path))
        if name != "pieces":
            assert out.columns == clashing.columns
        assert out.count() > 0
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_vectors_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0])]
    data += [(9, [1.0]), (10, []), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (11, [0.0, 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(0)).withColumn("n", F.lit(1))
    got, recall = vectors.near_vectors(table)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert recall == 1.0
    assert got == {i: (2, 1, i == 1) for i in (1, 2, 3)} | {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)}
    assert vectors.near_vectors(table.limit(0))[0].count() == 0


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, monkeypatch, name):
    monkeypatch.setattr(catalog, "QUERIES", QUERIES)
    monkeypatch.setattr(catalog, "ORACLES", ORACLES)
    outcome, n = compare(spark, duck, SF, name)
    assert outcome in ("ok", "rows only") and n > 0
