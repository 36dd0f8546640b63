"""Every query against its SQL twin, whole results, at the smallest scale."""

from __future__ import annotations

import pytest

from tests.compare import compare, connect
from tests.conftest import SF
from workload import catalog


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    outcome, rows = compare(spark, duck, SF, name)
    assert outcome in ("ok", "rows only")
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
