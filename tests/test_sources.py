from __future__ import annotations

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracesieve.schemas import CASE, LOG
from tracesieve.sources import export, snapshots, tables
from tracesieve.streaming import ingest
from workload.stage_queries import _case_table, _log_table
from workload.table_queries import as_of


def test_missing_table_is_empty(spark, tmp_path):
    assert tables.scan_cases(spark, str(tmp_path / "none"), "draft").count() == 0


def test_status_filter_reaches_the_files(spark, source, tmp_path):
    _case_table(source).write.parquet(str(tmp_path / "c"))
    plan = tables.scan_cases(spark, str(tmp_path / "c"), "approved")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,approved)" in plan


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    batch = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k string, v int, seq int")
    once = tables.upsert_by_key(old, batch, "k", "seq")
    twice = tables.upsert_by_key(once, batch, "k", "seq")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 6), ("c", 7)] == sorted(map(tuple, twice.collect()))


def test_lists_survive_the_file(spark):
    rows = spark.createDataFrame(
        [("a", ["x", "y"], None, []), ("b", None, [], None)],
        "case_id string, rubric array<string>, forbidden_assertions array<string>, tags array<string>",
    )
    back = {r.case_id: r for r in tables.decode_case_lists(tables.encode_case_lists(rows)).collect()}
    assert (back["a"].rubric, back["a"].forbidden_assertions, back["a"].tags) == (["x", "y"], None, [])
    assert (back["b"].rubric, back["b"].forbidden_assertions, back["b"].tags) == (None, [], [])


def test_export_versions_and_changelog(spark, source, tmp_path):
    path, cases = str(tmp_path / "exports"), _case_table(source)
    first = export.export_versioned(cases, path, as_of()).first()
    assert (first.version, first.total, first.added, first.removed, first.note) == (
        1, cases.filter("status = 'approved'").count(), first.total, 0, "initial export")
    second = export.export_versioned(cases, path, as_of()).first()
    assert (second.version, second.added, second.removed, second.note) == (2, 0, 0, "no change from previous version")
    third = export.export_versioned(cases.filter("status = 'draft'"), path, as_of()).first()
    assert (third.version, third.total, third.removed) == (3, 0, first.total)
    assert export.versions(spark, path) == [1, 2, 3]
    assert spark.read.schema(export.export_record(cases, as_of()).schema).json(f"{path}/eval_dataset_v3").count() == 0
    lines = [r.value for r in spark.read.text(f"{path}/eval_dataset_v1").collect()]
    assert all("rubric" in json.loads(line) for line in lines)  # nulls are kept
    diff = export.export_diff(cases.filter("status = 'approved'"), None)
    entry = export.changelog(spark, path).filter("version = 1")
    note = export.render_changelog(entry, diff, listed=2).first().text
    assert note.startswith("## v1 ") and f"- added ({first.total}): case_" in note and note.endswith("- initial export")


def test_export_keeps_every_changed_id(spark, source, tmp_path):
    path, one = str(tmp_path / "exports"), _case_table(source).filter("status = 'approved'").limit(1).drop("case_id")
    cases = one.crossJoin(spark.range(130).selectExpr("concat('id_', id) as case_id"))
    export.export_versioned(cases, path, as_of())
    later = cases.filter("case_id not in ('id_0', 'id_129')").unionByName(one.withColumn("case_id", F.lit("new")))
    second = export.export_versioned(later, path, as_of())
    got = [{(r.case_id, r.change) for r in export.changes(spark, path, v).collect()} for v in (1, 2)]
    assert got[0] == {(f"id_{i}", "added") for i in range(130)}
    assert got[1] == {("id_0", "removed"), ("id_129", "removed"), ("new", "added")}
    assert (second.first().added, second.first().removed) == (1, 2)
    text = export.render_changelog(export.changelog(spark, path).filter("version = 1"), export.changes(spark, path, 1)).first().text
    assert "- added (130): " in text and "all in changes" in text


def test_a_stopped_export_leaves_no_version(spark, source, tmp_path, monkeypatch):
    path, cases = str(tmp_path / "exports"), _case_table(source)
    export.export_versioned(cases, path, as_of())

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("export_diff", "changelog_entry"):  # after the lines, after the changes
        with monkeypatch.context() as patch:
            patch.setattr(export, step, stop)
            with pytest.raises(KeyboardInterrupt):
                export.export_versioned(cases.filter("status = 'draft'"), path, as_of())
        assert export.versions(spark, path) == [1] and export.changelog(spark, path).count() == 1
    assert len(snapshots.abandoned(spark, path)) == 2
    again = export.export_versioned(cases.filter("status = 'draft'"), path, as_of()).first()
    assert (again.version, again.total) == (2, 0) and export.changes(spark, path, 2).count() == again.removed > 0


def test_two_exports_of_one_version_do_not_mix(spark, source, tmp_path, monkeypatch):
    path, cases = str(tmp_path / "exports"), _case_table(source)
    export.export_versioned(cases, path, as_of())
    monkeypatch.setattr(export, "versions", lambda *_: [])  # as another job saw the folder before
    with pytest.raises(FileExistsError):
        export.export_versioned(cases, path, as_of())


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v int, seq int")
    assert snapshots.upsert_table(spark, path, batch, "k", "seq") == 1
    assert snapshots.upsert_table(spark, path, batch, "k", "seq") == 2  # as after a restart
    snapshots.upsert_table(spark, path, spark.createDataFrame([("b", 9, 1), ("c", 4, 1)], batch.schema), "k", "seq")
    rows = lambda *v: sorted(map(tuple, snapshots.read_snapshot(spark, path, batch.drop("seq").schema, *v).collect()))
    assert rows(1) == rows(2) == [("a", 2), ("b", 3)] and rows() == [("a", 2), ("b", 9), ("c", 4)]
    assert snapshots.read_snapshot(spark, str(tmp_path / "none"), batch.schema).count() == 0


def test_stream_resumes_and_replaces(spark, source, tmp_path):
    places = [str(tmp_path / x) for x in ("in", "logs", "ckpt")]
    logs = _log_table(source).filter("length(prompt) > 0 and length(response) > 0")
    n = logs.count()
    logs.withColumn("retry_count", F.lit(9)).write.mode("append").json(places[0])
    ingest.ingest_stream(spark, *places).awaitTermination()
    assert ingest.read_ingested(spark, places[1]).filter("retry_count = 9").count() == n
    ingest.ingest_stream(spark, *places).awaitTermination()  # nothing new: nothing done
    logs.withColumn("retry_count", F.lit(-1)).write.mode("append").json(places[0])
    logs.limit(5).withColumn("retry_count", F.lit(3)).write.mode("append").json(places[0])
    ingest.ingest_stream(spark, *places, redact=True).awaitTermination()
    now = ingest.read_ingested(spark, places[1])
    assert now.count() == n and now.filter("retry_count = 3").count() == 5
    assert spark.read.parquet(places[1] + "_invalid").count() == n
    ingest.compact(spark, places[1], str(tmp_path / "compact"))
    assert ingest.read_ingested(spark, str(tmp_path / "compact")).count() == n


def test_replayed_and_late_rows(spark, source, tmp_path):
    places = [str(tmp_path / x) for x in ("in", "logs", "ckpt")]
    logs = _log_table(source).filter("length(prompt) > 0 and length(response) > 0").limit(40)
    logs.write.mode("append").json(places[0])
    ingest.ingest_stream(spark, *places, buckets=8).awaitTermination()
    few = logs.orderBy("log_id").limit(2)
    few.withColumn("timestamp", F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).withColumn("retry_count", F.lit(7)).write.mode("append").json(places[0])
    ingest.ingest_stream(spark, *places, buckets=8).awaitTermination()
    rows = lambda: sorted(map(repr, ingest.read_ingested(spark, places[1]).collect()))
    now = rows()
    # a late row of an old time replaces, as it comes in a later batch
    assert len(now) == 40 and ingest.read_ingested(spark, places[1]).filter("retry_count = 7").count() == 2
    # the second batch wrote only the buckets it touched, and reads open each bucket once
    files = ingest.read_ingested(spark, places[1]).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == len(files) <= 8 and all("_resolved/" in f for f in files)
    assert 1 <= sum("batch=1/" in f for f in files) <= 2
    # replays: of a merged batch, and of one that stopped after the write of the rows
    ingest.merge_batch(spark, places[1], 1, 8)
    assert rows() == now
    (tmp_path / "logs_resolved" / "manifest_1").rename(tmp_path / "lost")
    assert ingest.read_ingested(spark, places[1]).filter("retry_count = 7").count() == 0
    ingest.merge_batch(spark, places[1], 1, 8)
    assert rows() == now


def test_stream_keeps_unreadable_lines_and_masks_by_default(spark, tmp_path):
    good = {f.name: None for f in LOG.fields} | {
        "log_id": "l1", "feature_name": "f", "model": "m", "system_prompt": "s", "prompt": "mail ann@site.org", "response": "r",
        "latency_ms": 1, "prompt_tokens": 1, "completion_tokens": 1,
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps(good), "{broken bob@site.org", json.dumps(good | {"log_id": "l2", "latency_ms": -1})]))
    places = [str(tmp_path / x) for x in ("in", "logs", "ckpt")]
    ingest.ingest_stream(spark, *places).awaitTermination()
    rows = ingest.read_ingested(spark, places[1]).collect()
    assert [r.log_id for r in rows] == ["l1"] and "ann@" not in rows[0].prompt
    bad = {r.log_id: r for r in spark.read.parquet(places[1] + "_invalid").collect()}
    assert bad[None].line.startswith("{broken ") and "bob@" not in bad[None].line and bad[None].errors == ["unreadable line"]
    assert bad["l2"].line is None and len(bad) == 2


def test_ingestion_stores_little(spark, tmp_path):
    good = {f.name: None for f in LOG.fields} | {
        "feature_name": "f", "model": "m", "system_prompt": "s", "response": "r",
        "latency_ms": 1, "prompt_tokens": 1, "completion_tokens": 1, "timestamp": "2024-01-01T00:00:00",
    }
    places = [str(tmp_path / x) for x in ("in", "logs", "ckpt")]
    (tmp_path / "in").mkdir()

    def arrive(name, ids, prompt):
        for at in range(0, len(ids), 25):
            rows = [json.dumps(good | {"log_id": i, "prompt": prompt}) for i in ids[at : at + 25]]
            (tmp_path / "in" / f"{name}-{at}.json").write_text("\n".join(rows))
        ingest.ingest_stream(spark, *places, buckets=4).awaitTermination()

    arrive("a", [f"l{i:03d}" for i in range(100)], "old")
    arrive("b", [f"l{i:03d}" for i in range(50, 150)] + [None, "l060"], "new")
    found = ingest.read_ingested(spark, places[1])
    assert {r.log_id: r.prompt for r in found.collect()} == {f"l{i:03d}": "old" if i < 50 else "new" for i in range(150)} | {None: "new"}
    assert found.count() == 151
    # a small batch is one file for each bucket, however many files it came in
    assert len(found.inputFiles()) == 4
    # no copy of a batch stays behind, and texts are stored compressed well
    assert not (tmp_path / "logs_staged").exists()
    stored = [f for folder in ("logs", "logs_resolved") for f in (tmp_path / folder).glob("batch*/**/*.parquet")]
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in stored if pq.ParquetFile(f).metadata.num_row_groups}
    assert codecs == {"ZSTD"}


def test_old_layout_gains_columns(spark):
    old = spark.createDataFrame([("c1", "draft")], "case_id string, status string")
    assert tables.add_missing_columns(old, CASE).columns == [f.name for f in CASE.fields]


def test_unreadable_lines_are_kept_apart(spark, tmp_path):
    good = {f.name: None for f in LOG.fields} | {
        "log_id": "l1", "feature_name": "f", "model": "m", "system_prompt": "s", "prompt": "p", "response": "r",
        "latency_ms": 1, "prompt_tokens": 1, "completion_tokens": 1,
    }
    lines = [json.dumps(good), "", "   ", "{broken", json.dumps(good | {"log_id": "l2", "latency_ms": -1}),
             json.dumps(good | {"log_id": "l3", "user_feedback": "meh"})]
    (tmp_path / "logs.jsonl").write_text("\n".join(lines))
    valid, bad = tables.read_logs_jsonl(spark, str(tmp_path / "logs.jsonl"))
    assert [r.log_id for r in valid.collect()] == ["l1"]
    assert sorted(r.errors[0] for r in bad.collect()) == ["negative latency_ms", "unknown user_feedback", "unreadable line"]


def test_cluster_without_checkpoint_dir_is_refused(spark, monkeypatch):
    from tracesieve import session

    class Context:
        master = "yarn"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_a_line_is_parsed_once(spark, tmp_path):
    """Conditions on the fields of a record do not parse its line again."""
    lines = ['{"log_id": "a", "system_prompt": "s", "prompt": "p", "response": "r"}', '{"log_id": "b", "prompt": ""}', '{"log_id": "c", ', "  ", "null", "7"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/in")
    valid, bad = tables.read_logs_jsonl(spark, f"{tmp_path}/in")
    for part in (valid, bad):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.log_id for r in valid.collect()}.isdisjoint({"b", "c"})
    assert {r.value for r in bad.collect()} >= set(lines[1:3]) and bad.count() + valid.count() == len(lines) - 1


def test_newest_rows_move_only_repeated_ids(spark, monkeypatch):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "x"), (None, 1, "p"), (None, 2, "q")]
    batch = spark.createDataFrame(rows, "log_id string, timestamp long, prompt string")
    moved = []
    latest = ingest.latest_by_key
    monkeypatch.setattr(ingest, "latest_by_key", lambda df, *a: moved.append(df.count()) or latest(df, *a))
    got = sorted((r.log_id or "", r.timestamp, r.prompt) for r in ingest._newest(batch).collect())
    assert got == [("", 2, "q"), ("a", 3, "y"), ("b", 1, "x")] and moved == [5]
