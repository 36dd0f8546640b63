from __future__ import annotations

import pytest

from tracesieve.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def source(spark):
    from workload.registry import Source

    return Source(spark, SF)
