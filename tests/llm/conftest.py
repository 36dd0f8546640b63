from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ing", "sh", "ou"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(40)) + ".\n" + word(), ("en", "fr")[i % 2], f"s{i % 3}", 10) for i in range(60)]
    rows += [(60 + i, rows[i][1], "en", None, None) for i in range(5)]  # exact copies
    rows += [(70 + i, rows[6][1] + " " + word(), None, "s0", 3) for i in range(6)]  # near copies
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "   \n\t ", "de", "s2", 6), (103, "x", "en", "s0", 1)]
    rows += [(104, "long " * 60_000 + "a@b.cd 4111 1111 1111 1111", "en", "s1", 9), (105, "1" * 20_000 + "." * 5_000, "en", "s1", 9)]
    rows += [(106, "Zoë ñandú 日本語 ▁ 😀 +1 (609) 555-7932 10.0.0.1 released under the MIT License", "en", "s0", 9)] * 2
    rows += [(None, "some text without id", "en", "s0", 20), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None), (3, 1, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
