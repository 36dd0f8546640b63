"""Sources, exports, traces, density clustering and the model stages."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from tracesieve.functions import rules
from tracesieve.operators import dedup, density, embedding, modelmap, summaries, trace, vectors
from tracesieve.plans import candidates as ranking
from tracesieve.plans import cases as building
from tracesieve.plans import evaluation
from tracesieve.schemas import CASE, LOG
from tracesieve.session import checkpoint_dir
from tracesieve.sources import export, snapshots, tables
from tracesieve.streaming import ingest
from workload.registry import Source, query
from workload.table_queries import _cases_for_review, as_of
from workload.text_queries import DUCK_JUDGE_PROMPT, DUCK_WEIGHT, duck_redact
from workload.vector_queries import _CENTROIDS, _DIST, _DUCK_SCORED, _DUCK_U, _blobs


def _scratch(s: Source) -> str:
    return f"{checkpoint_dir(s.spark)}/run-{uuid.uuid4().hex}"


def _log_table(s: Source):
    """fx_records as whole log records that pass validation wherever a text exists."""
    return s("fx_records").selectExpr(
        "log_id", "log_ts as timestamp", "feature_name", "model", "system_prompt", "prompt", "response", "latency_ms",
        "prompt_tokens", "completion_tokens", "user_feedback", "retry_count", "error_status", "redacted",
        "case when redacted then 'regex_v1' end as redaction_method", "is_safety_edge_case",
    )


def _case_table(s: Source):
    rows = _cases_for_review(s).withColumn(
        "input", F.struct(F.lit("You are a helpful assistant.").alias("system_prompt"), "prompt")
    )
    return rows.select([f.name for f in CASE.fields])


# ---- sources and sinks ----

_DUCK_VALID = "length(system_prompt) > 0 and length(prompt) > 0 and length(response) > 0"


@query("read_logs_jsonl", f"""
select case when {_DUCK_VALID} then 'valid' else 'invalid' end as outcome, log_id, sha256(prompt) as prompt_key,
       sha256(response) as response_key, retry_count, error_status
from fx_records
union all
select 'unreadable', '{{"log_id": "' || conv_id || '_' || turn || '", ' || role, null, null, null, null from conversations""")
def _read_logs_jsonl(s: Source):
    path = _scratch(s)
    lines = _log_table(s).select(F.to_json(F.struct(*[f.name for f in LOG.fields])).alias("value"))
    broken = s("conversations").selectExpr("concat('{\"log_id\": \"', conv_id, '_', turn, '\", ', role) as value")
    lines.unionByName(broken).unionByName(broken.selectExpr("'  ' as value")).write.text(path)
    valid, bad = tables.read_logs_jsonl(s.spark, path)
    key = [F.sha2("prompt", 256).alias("prompt_key"), F.sha2("response", 256).alias("response_key")]
    good = valid.select(F.lit("valid").alias("outcome"), "log_id", *key, "retry_count", "error_status")
    unreadable = F.array_contains("errors", "unreadable line")
    record = F.from_json("value", LOG)
    rest = bad.withColumn("r", record).select(
        F.when(unreadable, "unreadable").otherwise("invalid").alias("outcome"),
        F.when(unreadable, F.col("value")).otherwise(F.col("r.log_id")).alias("log_id"),
        F.when(~unreadable, F.sha2("r.prompt", 256)).alias("prompt_key"),
        F.when(~unreadable, F.sha2("r.response", 256)).alias("response_key"),
        F.when(~unreadable, F.col("r.retry_count")).alias("retry_count"),
        F.when(~unreadable, F.col("r.error_status")).alias("error_status"),
    )
    return good.unionByName(rest)


@query("scan_logs", "select log_id, feature_name, user_feedback, retry_count, error_status, latency_ms from fx_records")
def _scan_logs(s: Source):
    path = _scratch(s)
    _log_table(s).write.parquet(path)
    return tables.scan_logs(s.spark, path).select(
        "log_id", "feature_name", "user_feedback", "retry_count", "error_status", "latency_ms"
    )


@query("scan_cases", "select case_id, eval_type, prompt from fx_case_lists where status = 'approved'")
def _scan_cases(s: Source):
    path = _scratch(s)
    _case_table(s).write.parquet(path)
    return tables.scan_cases(s.spark, path, "approved").select("case_id", "eval_type", F.col("input.prompt").alias("prompt"))


@query("upsert_by_key", """
select case_id as case_id, coalesce(n.status, c.status) as status from fx_cases c
left join (select case_id, arg_max(field_changed, [epoch(edit_ts) * 1e9, cast(substr(edit_id, 6) as bigint)]) as status from fx_edits group by case_id) n using (case_id)
union all
select case_id, arg_max(field_changed, [epoch(edit_ts) * 1e9, cast(substr(edit_id, 6) as bigint)]) from fx_edits
where case_id not in (select case_id from fx_cases) group by case_id""")
def _upsert_by_key(s: Source):
    batch = s("fx_edits").select("case_id", F.col("field_changed").alias("status"), F.struct("edit_ts", "edit_id").alias("seq"))
    path = _scratch(s)
    first = s("fx_cases").select("case_id", "status", F.lit(0).alias("seq"))
    for rows in (first, batch, batch.filter("case_id is null")):  # a batch without rows changes nothing
        snapshots.upsert_table(s.spark, path, rows, "case_id", "seq")
    return snapshots.read_snapshot(s.spark, path, first.drop("seq").schema)


@query("lookup_cases", """
select case_id, status from fx_cases where case_id in (select case_id from fx_edits)""")
def _lookup_cases(s: Source):
    return tables.lookup_cases(s("fx_cases").select("case_id", "status"), s("fx_edits"))


@query("encode_case_lists", """
select case_id, cast(to_json(rubric) as varchar) as rubric, cast(to_json(forbidden_assertions) as varchar) as forbidden_assertions,
       coalesce(cast(to_json(tags) as varchar), '[]') as tags from fx_case_lists""")
def _encode_case_lists(s: Source):
    return tables.encode_case_lists(s("fx_case_lists")).select("case_id", "rubric", "forbidden_assertions", "tags")


@query("decode_case_lists", """
select case_id, array_to_string(case when n_chars % 9 = 0 then null else rubric end, '|') as rubric,
       array_to_string(forbidden_assertions, '|') as forbidden_assertions,
       case when n_chars % 5 = 0 then 0 else len(tags) end as n_tags from fx_case_lists""")
def _decode_case_lists(s: Source):
    stored = tables.encode_case_lists(s("fx_case_lists")).withColumns({
        "rubric": F.expr("case when n_chars % 9 = 0 then '' else rubric end"),
        "tags": F.expr("case when n_chars % 5 = 0 then null else tags end"),
    })
    return tables.decode_case_lists(stored).select(
        "case_id", F.array_join("rubric", "|").alias("rubric"),
        F.array_join("forbidden_assertions", "|").alias("forbidden_assertions"),
        F.size("tags").cast("bigint").alias("n_tags"),
    )


@query("add_missing_columns", """
select case_id, status, cast(null as varchar) as revises_case_id, 0 as n_input from fx_cases""")
def _add_missing_columns(s: Source):
    old = s("fx_cases").select("case_id", "status", "confidence_score")
    return tables.add_missing_columns(old, CASE).select(
        "case_id", "status", "revises_case_id", F.col("input").isNotNull().cast("bigint").alias("n_input")
    )


@query("append_run", "select run_id, case_id, passed from fx_runs")
def _append_run(s: Source):
    path = _scratch(s)
    results = s("fx_runs").withColumnRenamed("run_ts", "timestamp")
    for run in ("run_1", "run_2"):
        tables.append_run(results.filter(F.col("run_id") == run), path)
    tables.append_run(results.filter(~F.col("run_id").isin("run_1", "run_2")), path)
    return tables.read_runs(s.spark, path).select("run_id", "case_id", "passed")


_DUCK_EXPORT = """
select case_id, prompt, eval_type, expected_behavior, cast(to_json(rubric) as varchar) as rubric,
       cast(to_json(forbidden_assertions) as varchar) as forbidden, difficulty, source_cluster_id as source_cluster,
       strftime(coalesce(approved_at, timestamp '2024-06-01 00:00:00'), '%Y-%m-%dT%H:%M:%S') as date_added
from fx_case_lists"""


def _flat_export(df):
    return df.select(
        "case_id", "input.prompt", "eval_type", "expected_behavior", F.to_json("rubric").alias("rubric"),
        F.to_json("forbidden_assertions").alias("forbidden"), "difficulty", "source_cluster", "date_added",
    )


@query("export_record", _DUCK_EXPORT)
def _export_record(s: Source):
    return _flat_export(export.export_record(_case_table(s), as_of()))


@query("export_versioned", f"{_DUCK_EXPORT} where status = 'approved'")
def _export_versioned(s: Source):
    path = _scratch(s)
    export.export_versioned(_case_table(s), path, as_of())
    shape = export.export_record(_case_table(s), as_of()).schema
    return _flat_export(s.spark.read.schema(shape).json(f"{path}/eval_dataset_v1"))


def _two_versions(s: Source):
    cases = s("fx_cases")
    return cases.filter("status = 'approved'"), cases.filter("status = 'approved' and eval_type <> 'rubric' or status = 'deprecated'")


_DUCK_VERSIONS = """
with a as (select case_id from fx_cases where status = 'approved'),
     b as (select case_id from fx_cases where status = 'approved' and eval_type <> 'rubric' or status = 'deprecated'),
     diff as (select case_id, 'added' as change from a where case_id not in (select case_id from b)
              union all select case_id, 'removed' from b where case_id not in (select case_id from a))"""


@query("export_diff", f"{_DUCK_VERSIONS} select * from diff")
def _export_diff(s: Source):
    return export.export_diff(*_two_versions(s))


@query("changelog_entry", f"""{_DUCK_VERSIONS}
select 2 as version, (select count(*) from a) as total, count(*) filter (change = 'added') as added,
       count(*) filter (change = 'removed') as removed, null as note from diff
union all select 1, (select count(*) from a), (select count(*) from a), 0, 'initial export'
union all select 3, (select count(*) from a), 0, 0, 'no change from previous version'""")
def _changelog_entry(s: Source):
    now, before = _two_versions(s)
    entries = [
        export.changelog_entry(now, export.export_diff(now, previous), version, as_of())
        for version, previous in ((2, before), (1, None), (3, now))
    ]
    return entries[0].unionByName(entries[1]).unionByName(entries[2]).drop("exported_at")


@query("ingest_stream", f"""with {duck_redact('fx_records', 'log_id', 'prompt', 'p')}
select log_id, p8.t as prompt, retry_count from fx_records join p8 using (log_id) where {_DUCK_VALID}""")
def _ingest_stream(s: Source):
    path = _scratch(s)

    def lines(rows, to: str) -> None:
        rows.write.option("compression", "gzip").json(to)

    def take() -> None:
        ingest.ingest_stream(s.spark, f"{path}/in/*", f"{path}/logs", f"{path}/ckpt", buckets=8).awaitTermination()

    def arrive(staging: str) -> None:
        # the joins of the view run once; the stale lines, which come first, are taken from the others
        lines(_log_table(s), staging)
        stale = s.spark.read.schema(LOG).json(staging).filter("error_status is not null")
        lines(stale.withColumn("retry_count", F.lit(0)), f"{path}/in/stale")
        take()

    snapshots.commit(s.spark, path, "in/logs", arrive)
    take()
    return ingest.read_ingested(s.spark, f"{path}/logs").select("log_id", "prompt", "retry_count")


# ---- joins over the stages ----


@query("candidates_with_logs", """
select log_id, l.feature_name, l.log_id is not null as found
from (select source_log_id as log_id from fx_cases) c left join fx_logs l using (log_id)""")
def _candidates_with_logs(s: Source):
    wanted = s("fx_cases").select(F.col("source_log_id").alias("log_id"))
    return building.candidates_with_logs(wanted, s("fx_logs")).select("log_id", "feature_name", "found")


@query("trace_logs", """
with e as (select case_id, count(*) as edits, max(edit_ts) as last_edit,
             string_agg(edit_id || ':' || field_changed || ':' || before_value || ':' || after_value, ',' order by edit_ts, edit_id) as history
           from fx_edits group by case_id),
     r as (select case_id, arg_max(run_id, run_ts) as last_run, arg_max(passed, run_ts) as last_passed from fx_runs group by case_id)
select l.log_id, c.case_id, c.status, coalesce(e.edits, 0) as edits, strftime(e.last_edit, '%Y-%m-%d') as last_edit, r.last_run, r.last_passed,
       coalesce(e.history, '') as history,
       case when c.case_id is null then 'logged' when r.last_run is not null then 'evaluated'
            when c.status = 'approved' then 'approved' when e.edits > 0 then 'reviewed' else 'labelled' end as stage
from fx_logs l left join fx_cases c on c.source_log_id = l.log_id left join e using (case_id) left join r using (case_id)""")
def _trace_logs(s: Source):
    edit = lambda e: F.concat_ws(":", e.edit_id, e.field_changed, e.before_value, e.after_value)
    return _traced(s).select(
        "log_id", "case_id", "status", "edits", F.date_format("last_edit", "yyyy-MM-dd").alias("last_edit"),
        "last_run", "last_passed", F.array_join(F.transform("history", edit), ",").alias("history"), "stage",
    )


def _traced(s: Source):
    return trace.trace_logs(
        s("fx_logs").select("log_id"), s("fx_cases").select("case_id", "source_log_id", "status"), s("fx_edits"), s("fx_runs")
    )


@query("trace_in_order", """
select l.log_id, c.case_id, row_number() over (order by c.case_id is null, l.log_id, c.case_id) as place
from fx_logs l left join fx_cases c on c.source_log_id = l.log_id""")
def _trace_in_order(s: Source):
    return trace.in_demo_order(_traced(s).select("log_id", "case_id", "page")).select("log_id", "case_id", "place")


# ---- vectors and clusters ----


@query("embed_text", """
select doc_id, true as unit, 256 as dims from documents""")
def _embed_text(s: Source):
    embedded = embedding.embed_text(s("documents").select("doc_id", "text"), "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    return embedded.select(
        "doc_id", (F.abs(norm - 1.0) < 1e-5).alias("unit"), F.size("embedding").cast("bigint").alias("dims")
    )


@query("similar_approved_prompts")
def _similar_approved_prompts(s: Source):
    """From the texts: every draft against every approved case by prompt."""
    cases = s("fx_case_rows").select("case_id", "status", "prompt")
    _, of_cases = embedding.prompt_vectors(s("fx_records").select("log_id", "prompt").limit(0), cases)
    found = vectors.most_similar(of_cases.filter("status = 'draft'"), of_cases.filter("status = 'approved'"), 3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("check_duplicate_prompts")
def _check_duplicate_prompts(s: Source):
    """From the texts: the prompt of every log against all approved cases; prompts without words have no match."""
    cases = s("fx_case_rows").filter("status = 'approved'").select("case_id", "status", "prompt")
    of_logs, of_cases = embedding.prompt_vectors(s("fx_records").select("log_id", "prompt"), cases)
    found = dedup.check_duplicates(of_logs.select(F.col("log_id").alias("id"), F.col("embedding").alias("v")), of_cases)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("density_cluster", """
select log_id as id, dense_rank() over (order by first_id) - 1 as cluster_id
from (select log_id, min(log_id) over (partition by label) as first_id from fx_blobs)""")
def _density_cluster(s: Source):
    return density.density_cluster(_blobs(s)).select("id", F.col("cluster_id").cast("bigint").alias("cluster_id"))


_DUCK_BLOB_SCORED = _DUCK_SCORED.replace("fx_emb", "fx_blob_emb").replace(
    "case l.feature_name when 'meal_planner' then 0.5 when 'customer_support_bot' then 2.0 else 1.0 end", "1.0"
)


@query("rank_candidates", f"""{_DUCK_BLOB_SCORED}
select v.log_id, v.feature_name, substr(r.prompt, 1, 150) as prompt_preview, cluster_id, 'cluster_' || cluster_id as cluster_label,
       round(value_score, 3) as value_score, round(failure_signal, 3) as failure_signal, round(novelty, 3) as novelty
from valued v join fx_records r on r.log_id = v.log_id order by v.value_score desc, v.log_id limit 30""")
def _rank_candidates(s: Source):
    emb = s("fx_blobs").select("log_id", F.col("v").alias("embedding"))
    cases = s("fx_cases").filter("status = 'approved'").join(s("fx_blobs").select("vec_id", "v"), "vec_id")
    result = ranking.rank_candidates(s("fx_records"), emb, cases.select(F.col("case_id").alias("id"), "v"))
    path = _scratch(s)
    tables.write_candidates(result, path)
    return s.spark.read.parquet(f"{path}/candidates")


@query("write_candidates", f"""
with p as (select log_id as id, cast(embedding as double[]) as v from fx_emb),
first as (select id, v from p order by {_DUCK_U.format('id')}, id limit 1),
g as (
  select 1 as pick, p.id, p.v, list_distance(p.v, f.v) as d, f.id as chosen, f.v as chosen_v from p cross join first f
  union all
  select g.pick + 1, g.id, g.v, least(g.d, list_distance(g.v, n.v)), n.id, n.v
  from g join (select g.pick, g.id, g.v from g order by g.d desc, g.id limit 1) n on n.pick = g.pick
  where g.pick < 10)
select distinct 'diversity' as sampler, chosen as log_id from g
union all select 'random', log_id from (select log_id from fx_logs order by {_DUCK_U.format('log_id')}, log_id limit 10)
union all select 'failure_biased', log_id from (
  select log_id from fx_logs order by -ln(greatest({_DUCK_U.format('log_id')}, 1e-12)) / ({DUCK_WEIGHT}), log_id limit 10)""")
def _write_candidates(s: Source):
    logs = s("fx_records").select("log_id", "feature_name", "prompt")
    named = s("fx_emb").groupBy("cluster_id").agg(F.count("*").alias("size"))
    path = _scratch(s)
    tables.write_candidates({
        "clusters": named, "candidates": logs,
        "previews": ranking.sample_previews(s("fx_logs"), s("fx_emb"), 10, 42),
    }, path)
    return s.spark.read.parquet(f"{path}/previews")


# ---- model stages: a stub whose reply is a function of the prompt ----


def _digest(user: str) -> int:
    return int(hashlib.md5(user.encode()).hexdigest()[:8], 16)


def stub_model(prompts):
    """Replies in the shape the system prompt asks for; one in eleven is not JSON."""
    replies = []
    for system, user in prompts:
        h = _digest(user)
        if h % 11 == 0:
            replies.append("no idea")
        elif '"label"' in system:
            replies.append(json.dumps({"label": f"topic {h % 97}", "description": "a group of prompts"}))
        elif '"rubric"' in system:
            rubric = [f"point {i}" for i in range(1 + h % 4)]
            replies.append("```json\n" + json.dumps({"rubric": rubric, "forbidden_assertions": [], "tags": ["stub"]}) + "\n```")
        elif '"expected_behavior"' in system:
            replies.append(json.dumps({"expected_behavior": "answers " * (1 + h % 5), "tags": ["stub"]}))
        elif '"quality_score"' in system:
            replies.append(json.dumps({"quality_score": (h % 101) / 100, "reasoning": "stub"}))
        elif '"passed"' in system:
            replies.append(json.dumps({"passed": h % 3 > 0, "reasoning": "stub"}))
        else:
            replies.append(f"reply {h}")
    return replies


_FAST = {"retries": 0}

# the stub's digest of a user prompt, in DuckDB
_DUCK_H = "cast('0x' || substr(md5({0}), 1, 8) as bigint)"


@query("llm_map", f"""
select doc_id, case when {_DUCK_H.format('text')} % 11 = 0 then 'no idea' else 'reply ' || {_DUCK_H.format('text')} end as reply,
       null as error from documents""")
def _llm_map(s: Source):
    prompts = s("documents").select("doc_id", F.lit("Answer.").alias("system"), F.col("text").alias("user"))
    keyed = prompts.withColumn("call_id", modelmap.prompt_hash("ask", F.col("system"), F.col("user"), F.lit(1)))
    answers = modelmap.llm_map(keyed, stub_model, "ask", **_FAST)
    return keyed.join(answers, "call_id").select("doc_id", "reply", "error")


@query("label_clusters", f"""
with {_CENTROIDS},
near as (select e.cluster_id, log_id, row_number() over (partition by e.cluster_id order by {_DIST.format('embedding', 'centroid')}, log_id) as rank
         from fx_emb e join cent c on c.cluster_id = e.cluster_id),
shown as (select cluster_id, 'Prompts near the middle of one group, nearest first:' || chr(10) || chr(10)
            || string_agg(rank || '. ' || substr(prompt, 1, 150), chr(10) order by rank) as text
          from near join fx_records using (log_id) where rank <= 5 group by cluster_id),
h as (select cluster_id, {_DUCK_H.format('text')} as h from shown)
select cluster_id, case when h % 11 = 0 then 'cluster_' || cluster_id || '_unlabeled' else 'topic ' || h % 97 end as label,
       case when h % 11 = 0 then '(labeling failed)' else 'a group of prompts' end as description,
       (select count(*) from fx_emb e where e.cluster_id = h.cluster_id) as size from h""")
def _label_clusters(s: Source):
    return modelmap.label_clusters(s("fx_emb"), s("fx_records").select("log_id", "prompt"), stub_model, **_FAST)


def _to_label(s: Source):
    logs = s("fx_turns").join(s("fx_turns").select("log_id").distinct(), "log_id", "left_semi")
    signals = s("fx_logs").select(
        "feature_name", "is_safety_edge_case", "error_status", "retry_count", "user_feedback",
        F.expr("cast(substr(log_id, 5) as bigint)").alias("n"),
    )
    numbered = logs.withColumn("n", F.expr("cast(split(substr(log_id, 6), '_')[0] as bigint)"))
    return numbered.join(signals, "n").withColumns({
        "eval_type": rules.decide_eval_type(), "difficulty": rules.decide_difficulty(),
    })


_DUCK_LABEL_USER = """
'Feature under test: ' || l.feature_name || chr(10) || '=== instructions ===' || chr(10) || t.system_prompt
|| chr(10) || '=== request ===' || chr(10) || t.prompt"""


@query("generate_labels", f"""
with t as (select *, cast(string_split(substr(log_id, 6), '_')[1] as bigint) as n from fx_turns),
l as (select cast(substr(log_id, 5) as bigint) as n, feature_name,
        case when is_safety_edge_case then 'expected_refusal'
          when feature_name in ('sql_query_generator', 'code_review_assistant') then 'golden_answer' else 'rubric' end as eval_type,
        is_safety_edge_case or error_status is not null or retry_count > 0 as hard from fx_logs),
h as (select t.log_id, l.*, {_DUCK_H.format(_DUCK_LABEL_USER)} as h
      from t join l on l.n = t.n)
select log_id, eval_type, case when hard then 3 else 1 end as n_passes,
       case when not hard then true when eval_type = 'rubric' then true else h % 11 <> 0 end as agreed,
       case when h % 11 <> 0 and eval_type <> 'rubric' then repeat('answers ', cast(1 + h % 5 as bigint)) end as expected_behavior,
       case when h % 11 <> 0 and eval_type = 'rubric' then
         cast(to_json(list_transform(range(1 + h % 4), lambda i: 'point ' || i)) as varchar) end as rubric,
       case when h % 11 = 0 then 'malformed reply' end as error
from h""")
def _generate_labels(s: Source):
    labels = modelmap.generate_labels(_to_label(s), stub_model, **_FAST)
    return labels.select("log_id", "eval_type", "n_passes", "agreed", "expected_behavior", F.to_json("rubric").alias("rubric"), "error")


@query("judge_labels", f"""
select case_id, case when h % 11 <> 0 then round(0.5 * (h % 101) / 100 + 0.5 * case when label_source = 'auto' then 1.0 else 0.3 end, 6) end as confidence_score,
       case when h % 11 = 0 then 'malformed reply' end as error
from (select *, {_DUCK_H.format("'eval_type: ' || eval_type || chr(10) || chr(10) || '= ' || prompt")} as h from fx_case_lists)""")
def _judge_labels(s: Source):
    labels = s("fx_case_lists").select(
        F.col("case_id").alias("log_id"), "eval_type", F.col("prompt").alias("expected_behavior"),
        F.lit(None).cast("array<string>").alias("rubric"), F.lit(None).cast("array<string>").alias("forbidden_assertions"),
        (F.col("label_source") == "auto").alias("agreed"), F.lit(None).cast("string").alias("error"),
    )
    judged = modelmap.judge_labels(labels, stub_model, **_FAST)
    return judged.select(F.col("log_id").alias("case_id"), F.round("confidence_score", 6).alias("confidence_score"), "error")


# the loop: dedup, label, judge; a candidate whose label or judgement fails shadows nobody
_DUCK_BUILT = f"""
with ranked as (select b.log_id, b.v, {DUCK_WEIGHT} as weight, l.* exclude (log_id),
    case when l.is_safety_edge_case then 'expected_refusal'
      when l.feature_name in ('sql_query_generator', 'code_review_assistant') then 'golden_answer' else 'rubric' end as eval_type
  from fx_blobs b join fx_records l on l.log_id = b.log_id),
asked as (select *, {_DUCK_H.format("'Feature under test: ' || feature_name || chr(10) || '=== instructions ===' || chr(10) || system_prompt || chr(10) || '=== request ===' || chr(10) || prompt")} as h from ranked),
shown as (select *, case when eval_type = 'rubric' then array_to_string(list_transform(range(1 + h % 4), lambda i: '+ point ' || i), chr(10))
                    else '= ' || repeat('answers ', cast(1 + h % 5 as bigint)) end as label_text from asked),
judged as (select *, {_DUCK_H.format("'eval_type: ' || eval_type || chr(10) || chr(10) || label_text")} as q from shown),
r as (select row_number() over (order by weight desc, log_id) as rn, log_id as id, v, h % 11 = 0 or q % 11 = 0 as bad, 0.5 * (q % 101) / 100 + 0.5 as confidence from judged),
nb as (select a.rn, a.bad, list(b.rn) filter (b.rn is not null) as before
       from r a left join r b on b.rn < a.rn and list_dot_product(a.v, b.v) >= 0.92 group by a.rn, a.bad),
walk as (
  select cast(0 as bigint) as rn, cast([] as bigint[]) as acc
  union all
  select nb.rn, case when nb.bad or list_has_any(coalesce(nb.before, []), walk.acc) then walk.acc else list_append(walk.acc, nb.rn) end
  from walk join nb on nb.rn = walk.rn + 1),
acc as (select unnest(acc) as rn from walk where rn = (select max(rn) from r)),
best as (select a.rn, arg_max(b.id, list_dot_product(a.v, b.v)) as other, max(list_dot_product(a.v, b.v)) as sim
  from r a join r b on b.rn < a.rn and b.rn in (select rn from acc) and list_dot_product(a.v, b.v) >= 0.92
  where a.rn not in (select rn from acc) group by a.rn),
built as (select id as log_id, case when r.rn in (select rn from acc) then case when confidence >= 0.75 then 'approved' else 'draft' end end as status,
  case when r.rn in (select rn from acc) then 'created' when other is not null then 'deduped' else 'failed' end as outcome,
  case when r.rn in (select rn from acc) then null when other is not null then 'repeats ' || other || ' (cosine ' || printf('%.3f', sim) || ', limit 0.92)'
       else 'malformed reply' end as reason
  from r left join best on best.rn = r.rn)
"""


@query("build_cases", f"{_DUCK_BUILT} select * from built")
def _build_cases(s: Source):
    emb = s("fx_blobs")
    ranked = emb.select("log_id", F.col("label").alias("cluster_id")).join(
        s("fx_logs").select("log_id", rules.failure_weight().alias("value_score")), "log_id"
    )
    cases, rejected, outcomes = building.build_cases(
        ranked, s("fx_records"), _blobs(s), None, stub_model, as_of(), **_FAST
    )
    return outcomes


_DUCK_RUN = f"""
with h as (select case_id, status, eval_type, prompt, expected_behavior, rubric, forbidden_assertions,
             case when {_DUCK_H.format('prompt')} % 11 = 0 then 'no idea' else 'reply ' || {_DUCK_H.format('prompt')} end as response
           from fx_case_lists where status = 'approved'),
j as (select *, {_DUCK_H.format(DUCK_JUDGE_PROMPT.format('response'))} as v from h)
select case_id, case when v % 11 = 0 then '' else response end as model_response, v % 11 <> 0 and v % 3 > 0 as passed,
       case when v % 11 = 0 then 'RUNNER ERROR: malformed reply' else 'stub' end as judge_reasoning
from j"""


@query("run_cases", _DUCK_RUN)
def _run_cases(s: Source):
    return _run(s).select("case_id", "model_response", "passed", "judge_reasoning")


def _run(s: Source):
    return evaluation.run_cases(_case_table(s), "run_x", stub_model, stub_model, "target", "judge", as_of(), **_FAST)


@query("run_summary", f"""
select 'run_x' as run_id, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed,
       count(*) filter (judge_reasoning like 'RUNNER ERROR: %') as errors from ({_DUCK_RUN}) x""")
def _run_summary(s: Source):
    return evaluation.run_summary(_run(s), "run_x")


@query("build_outcome_counters", f"""{_DUCK_BUILT}
select count(*) filter (outcome = 'created') as created, count(*) filter (status = 'approved') as auto_approved, count(*) filter (status = 'draft') as draft,
       count(*) filter (outcome = 'deduped') as deduped, count(*) filter (outcome = 'failed') as failed from built""")
def _build_outcome_counters(s: Source):
    return summaries.build_counters(_build_cases(s))
