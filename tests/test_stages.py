from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesieve.functions.text import parse_model_json
from tracesieve.operators import modelmap, quality, review, runs
from tracesieve.plans import cases as building
from tracesieve.plans import evaluation
from tracesieve.schemas import CLUSTER_REPLY
from workload.stage_queries import _case_table, _digest, stub_model
from workload.table_queries import as_of


def prompts(spark, n, lead="q"):
    return spark.createDataFrame([(f"{lead}{i}", "Answer.", f"{lead} {i}") for i in range(n)], "call_id string, system string, user string")


def test_errors_and_empty_replies_become_columns(spark):
    def model(batch):
        if any(user.endswith("3") for _, user in batch):
            raise RuntimeError("down")
        return ["" if user.endswith("5") else "ok" for _, user in batch]

    got = {r.call_id: (r.reply, r.error) for r in modelmap.llm_map(prompts(spark, 8), model, "t", retries=1, base_delay=0.0).collect()}
    assert got["q3"] == (None, "RuntimeError: down") and got["q5"][1] == "empty reply" and got["q0"] == ("ok", None)
    assert len(got) == 8


def test_answered_rows_are_not_asked_again(spark):
    def failing(batch):
        return ["ok" if int(user.split()[1]) % 2 else "" for _, user in batch]

    first = modelmap.llm_map(prompts(spark, 10), failing, "t", retries=0)

    def second_model(batch):
        assert all(int(user.split()[1]) % 2 == 0 for _, user in batch)
        return ["late"] * len(batch)

    second = {r.call_id: r.reply for r in modelmap.llm_map(prompts(spark, 10), second_model, "t", answered=first, retries=0).collect()}
    assert {second[f"q{i}"] for i in (1, 3, 5, 7, 9)} == {"ok"} and {second[f"q{i}"] for i in (0, 2, 4, 6, 8)} == {"late"}


def test_malformed_and_empty_replies_are_asked_again(spark, tmp_path):
    def model(batch):
        replies = []
        for _, user in batch:
            seen = tmp_path / user.replace(" ", "_")
            replies.append('{"label": "a", "description": "b"}' if seen.exists() else "" if user.endswith("1") else "no idea")
            seen.touch()
        return replies

    def check(reply):
        return parse_model_json(reply, CLUSTER_REPLY, ["label"])["error"]

    once = modelmap.llm_map(prompts(spark, 6, "once"), lambda batch: ["no idea"] * len(batch), "t", retries=0, check=check)
    got = modelmap.llm_map(prompts(spark, 6, "once"), model, "t", answered=once, retries=2, check=check)
    assert got.count() == 6 and got.filter("error is null and reply like '{%'").count() == 6


def recorder(folder, reply="ok", stop_at=None):
    """A model that notes each prompt as a file, and ends its process at one."""

    def model(batch):
        for _, user in batch:
            if user == stop_at:
                raise SystemExit(1)
            (folder / user.replace(" ", "_")).write_text("")
        return [reply] * len(batch)

    return model


def test_a_stopped_job_asks_only_the_rest(spark, tmp_path):
    asked = prompts(spark, 40)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    how = {"store": str(tmp_path / "store"), "wave": 5, "batch": 1, "retries": 0}
    with pytest.raises(Exception):
        modelmap.llm_map(asked, recorder(tmp_path / "a", stop_at="q 17"), "t", **how)
    kept = {r.call_id for r in modelmap.stored_answers(spark, str(tmp_path / "store" / "t")).collect()}
    assert 0 < len(kept) < 40 and "q17" not in kept
    got = {r.call_id: r.reply for r in modelmap.llm_map(asked, recorder(tmp_path / "b"), "t", **how).collect()}
    assert got == {f"q{i}": "ok" for i in range(40)}
    assert {f.name.replace("_", "") for f in (tmp_path / "b").iterdir()} == {f"q{i}" for i in range(40)} - kept


def test_retries_are_one_budget_over_all_starts(spark, tmp_path):
    how = {"store": str(tmp_path / "store"), "base_delay": 0.0}
    for start, retries in enumerate((1, 1, 2)):
        got = modelmap.llm_map(prompts(spark, 3), lambda batch: [""] * len(batch), "t", retries=retries, **how).collect()
        assert {(r.reply, r.error) for r in got} == {("", "empty reply")}
        attempts = {r.attempt for r in modelmap.stored_answers(spark, str(tmp_path / "store" / "t")).collect()}
        assert attempts == {(2, 2, 3)[start]}


def test_a_dead_model_ends_the_loop(spark, source, tmp_path):
    def down(batch):
        for _, user in batch:
            (tmp_path / str(_digest(user))).write_text("")
        raise RuntimeError("down")

    logs = source("fx_records").filter("length(prompt) > 0")
    vectors = source("fx_blobs").select(F.col("log_id").alias("id"), F.when(F.col("log_id") != "log_000000000003", F.col("v")).alias("v"))
    candidates = vectors.select(F.col("id").alias("log_id"), F.lit(0).alias("cluster_id"), F.lit(1.0).alias("value_score"))
    cases, rejected, outcomes = building.build_cases(candidates, logs, vectors, None, down, as_of(), retries=0)
    got = outcomes.collect()
    assert {r.outcome for r in got} == {"failed"} and cases.count() == rejected.count() == 0
    reasons = {r.log_id: r.reason for r in got}
    assert reasons.pop("log_000000000003") == "no usable vector"
    assert set(reasons.values()) - {"no log"} == {"RuntimeError: down", "not tried: the model gave no answers"}
    asked = sum(r == "RuntimeError: down" for r in reasons.values())
    assert len(list(tmp_path.iterdir())) == asked < len(reasons) / 2  # one round: the rows first accepted


def sequential_cases(rows):
    """The one-by-one loop: dedup, label, judge, accept."""
    def ask(system, user):
        return stub_model([(system, user)])[0]

    accepted, outcome = [], {}
    for r in rows:
        if any(float(np.einsum("i,i->", r["v"], v)) >= 0.92 for v in accepted):
            outcome[r["log_id"]] = "deduped"
            continue
        eval_type = "expected_refusal" if r["safety"] else "golden_answer" if r["feature"] in (
            "sql_query_generator", "code_review_assistant") else "rubric"
        user = f"Feature under test: {r['feature']}\n=== instructions ===\n{r['system']}\n=== request ===\n{r['prompt']}"
        reply = ask(modelmap.LABEL_SYSTEM[eval_type], user).replace("```json\n", "").replace("\n```", "")
        try:
            label = json.loads(reply)
            shown = f"= {label['expected_behavior']}" if "expected_behavior" in label else "\n".join(f"+ {x}" for x in label["rubric"])
            score = json.loads(ask(modelmap.QUALITY_SYSTEM, f"eval_type: {eval_type}\n\n{shown}"))["quality_score"]
        except ValueError:
            outcome[r["log_id"]] = "failed"
            continue
        outcome[r["log_id"]] = "approved" if 0.5 * score + 0.5 >= 0.75 else "draft"
        accepted.append(r["v"])
    return outcome


def test_build_cases_equals_the_loop(spark, source):
    logs = source("fx_records").filter("length(prompt) > 0")
    blobs = source("fx_blobs").select("log_id", F.col("v"))
    ranked = logs.select("log_id").join(blobs.select("log_id"), "log_id").select(
        "log_id", F.lit(0).alias("cluster_id"), (F.xxhash64("log_id") % 50).cast("double").alias("value_score")
    )
    missing = spark.createDataFrame([("log_gone", 0, 1.0)], "log_id string, cluster_id int, value_score double")
    candidates = ranked.unionByName(missing)
    cases, rejected, outcomes = building.build_cases(
        candidates, logs, blobs.withColumnRenamed("log_id", "id"), None, stub_model, as_of(), retries=0)
    rows = ranked.join(logs, "log_id").join(blobs, "log_id").collect()
    ordered = [
        {"log_id": r.log_id, "v": np.array(r.v), "safety": r.is_safety_edge_case, "feature": r.feature_name,
         "system": r.system_prompt, "prompt": r.prompt}
        for r in sorted(rows, key=lambda r: (-r.value_score, r.log_id))
    ]
    want = sequential_cases(ordered)
    got = {r.log_id: r.status or r.outcome for r in outcomes.collect()}
    assert got.pop("log_gone") == "failed"
    assert got == want and {"failed", "deduped"} <= set(want.values())
    assert quality.validate_cases(cases)[1].count() == 0
    assert cases.count() == sum(v in ("approved", "draft") for v in want.values())
    assert rejected.count() == sum(v == "deduped" for v in want.values())


def test_run_summary_and_limits(spark, source):
    table = _case_table(source)
    args = ("r1", stub_model, stub_model, "target", "judge", as_of())
    results = evaluation.run_cases(table, *args, limit=7, retries=0)
    first = [r.case_id for r in table.filter("status = 'approved'").orderBy("case_id").limit(7).collect()]
    assert sorted(r.case_id for r in results.collect()) == first
    row = evaluation.run_summary(results, "r1").first()
    assert row.total == 7 and row.passed + row.failed == 7
    empty = evaluation.run_summary(evaluation.run_cases(table.limit(0), *args, retries=0), "r1").first()
    assert (empty.total, empty.passed, empty.failed, empty.errors) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        evaluation.run_cases(table, "r", stub_model, stub_model, "same", "same", as_of())


def test_changes_partition_the_cases(spark, source):
    table = source("fx_runs")
    diff = runs.regression_diff(table, "run_1", "run_2")
    ids = table.filter("run_id in ('run_1', 'run_2')").select("case_id").distinct()
    assert diff.count() == ids.count() == diff.select("case_id").distinct().count()
    assert runs.duplicate_results(table).count() == 0
    assert runs.duplicate_results(table.union(table.filter("run_id = 'run_1'"))).count() > 0


def test_guidance_is_empty_without_edits(spark, source):
    got = review.review_guidance(source("fx_edits").limit(0)).collect()
    assert {(r.eval_type, r.guidance) for r in got} == {(t, "") for t in ("golden_answer", "rubric", "expected_refusal")}


def test_cluster_names_fall_back(spark, source):
    def down(batch):
        raise RuntimeError("down")

    named = modelmap.label_clusters(source("fx_emb"), source("fx_records"), down, retries=0).collect()
    assert {r.label for r in named} == {f"cluster_{i}_unlabeled" for i in range(9)}
    assert {r.description for r in named} == {"(labeling failed)"}
    assert _digest("x") == _digest("x")
