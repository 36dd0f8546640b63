"""Shape of the plans, and independence from partitioning."""

from __future__ import annotations

import re

import pytest

from tests.compare import rows_of
from tests.conftest import SF
from workload import catalog
from workload.registry import Source

ROW_WISE = ("redact_text", "token_count", "failure_weight", "decide_eval_type", "render_label", "failure_signal")


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_functions_do_not_shuffle(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "hashpartitioning" not in plan or name == "render_label"


def test_scans_read_only_what_is_used(spark):
    plan = catalog.QUERIES["regression_diff"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    columns = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_comment" not in columns and "l_extendedprice" not in columns


@pytest.mark.parametrize("name", ["edits_for_case", "review_guidance", "representatives", "latest_result"])
def test_windows_have_partition_columns(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\([a-z_]+#\d+ (ASC|DESC)", plan)


@pytest.mark.parametrize("name", ["sample_random", "log_summary", "edits_for_case", "dedup_ordered", "novelty"])
def test_results_do_not_depend_on_partitioning(spark, name, monkeypatch):
    def result(n):
        plain = Source.__call__
        with monkeypatch.context() as patch:
            patch.setattr(Source, "__call__", lambda self, view: plain(self, view).repartition(n))
            df = catalog.QUERIES[name](spark, SF)
            return rows_of(df.columns, df.collect())

    assert result(1) == result(7) == result(60)
