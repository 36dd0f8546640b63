"""Validation, summaries, runs and review over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.operators import quality, review, runs, summaries
from workload.registry import Source, query
from workload.text_queries import DUCK_CATEGORY



def as_of():
    return F.expr("timestamp_ntz '2024-06-01 00:00:00'")


_DUCK_AS_OF = "timestamp '2024-06-01 00:00:00'"
_BLANK = r"len(regexp_replace({0}, '[\s\x0B\x85\p{{Z}}]+', '', 'g')) = 0"

# ---- validation ----


@query("validate_logs", """
with checks as (
  select log_id, unnest([
    case when length(system_prompt) = 0 then 'empty system_prompt' end,
    case when length(prompt) = 0 then 'empty prompt' end,
    case when length(response) = 0 then 'empty response' end,
    case when latency_ms < 0 then 'negative latency_ms' end,
    case when retry_count < 0 then 'negative retry_count' end,
    case when redacted and coalesce(redaction_method, 'none') = 'none' then 'redacted without method' end,
    case when not redacted and coalesce(redaction_method, 'none') <> 'none' then 'method without redaction' end]) as error
  from fx_records)
select error, count(distinct log_id) as logs from checks where error is not null group by error
union all
select 'valid' as error, (select count(*) from fx_records) - (select count(distinct log_id) from checks where error is not null) as logs""")
def _validate_logs(s: Source):
    valid, invalid = quality.validate_logs(s("fx_records"))
    reasons = invalid.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("logs"))
    return reasons.unionByName(valid.agg(F.lit("valid").alias("error"), F.count("*").alias("logs")))


@query("validate_cases", f"""
select case_id, nullif(array_to_string(list_filter([
  case when eval_type <> 'rubric' and {_BLANK.format("coalesce(expected_behavior, '')")} then 'needs expected_behavior' end,
  case when eval_type = 'rubric' and coalesce(len(rubric), 0) = 0 then 'needs rubric' end,
  case when not (confidence_score between 0 and 1) then 'confidence_score out of range' end,
  case when status = 'approved' and approved_at is null then 'approved without approved_at' end,
  case when status in ('draft', 'rejected') and approved_at is not null then 'approved_at on unapproved case' end],
  lambda x: x is not null), ','), '') as errors
from (select * exclude (approved_at),
        case when n_chars % 17 = 0 then null when n_chars % 19 = 0 then {_DUCK_AS_OF} else approved_at end as approved_at
      from fx_case_lists)""")
def _validate_cases(s: Source):
    cases = s("fx_case_lists").withColumn(
        "approved_at",
        F.expr("case when n_chars % 17 = 0 then null when n_chars % 19 = 0 "
               "then timestamp_ntz '2024-06-01 00:00:00' else approved_at end"),
    )
    valid, invalid = quality.validate_cases(cases)
    return valid.select("case_id", F.lit(None).cast("string").alias("errors")).unionByName(
        invalid.select("case_id", F.array_join("errors", ",").alias("errors"))
    )


@query("log_quality_report", f"""
with f as (select count(*) as n from fx_records group by feature_name),
t as (select count(*) as n, count(*) filter (redacted) as red, count(*) filter (retry_count > 0) as ret,
        count(error_status) as err, count(*) filter (is_safety_edge_case) as saf,
        count(*) filter (user_feedback = 'negative') as neg,
        count(*) filter ({_BLANK.format('prompt')}) as bp, count(*) filter ({_BLANK.format('response')}) as br,
        count(*) filter (prompt_tokens = 0 or completion_tokens = 0) as zt,
        count(*) - count(distinct log_id) as dup from fx_records),
r as (
  select 'features' as name, cast(count(*) as double) as value, case when count(*) < 3 then 'warn' else 'ok' end as verdict from f
  union all select 'largest_feature_share', max(n) / sum(n), case when max(n) / sum(n) > 0.5 then 'warn' else 'ok' end from f
  union all select 'redaction_rate', red / n, case when red = 0 or red / n > 0.6 then 'warn' else 'ok' end from t
  union all select 'retries', ret, case when ret = 0 then 'warn' else 'ok' end from t
  union all select 'errors', err, case when err = 0 then 'warn' else 'ok' end from t
  union all select 'safety', saf, case when saf = 0 then 'warn' else 'ok' end from t
  union all select 'negative_feedback', neg, 'ok' from t
  union all select 'blank_prompts', bp, case when bp > 0 then 'warn' else 'ok' end from t
  union all select 'blank_responses', br, case when br > 0 then 'warn' else 'ok' end from t
  union all select 'zero_tokens', zt, case when zt > 0 then 'warn' else 'ok' end from t
  union all select 'duplicate_ids', dup, case when dup > 0 then 'warn' else 'ok' end from t
  union all select 'blank_rate', (bp + br) / (2 * n), case when (bp + br) / (2 * n) > 0.1 then 'fail' else 'ok' end from t)
select name as "check", round(value, 6) as value, verdict from r""")
def _log_quality_report(s: Source):
    return quality.log_quality_report(s("fx_records")).withColumn("value", F.round("value", 6))


@query("samples_per_category", f"""
with c as (select log_id, feature_name, prompt, {DUCK_CATEGORY} as category from fx_records)
select category, arg_min(log_id, log_id) as log_id, arg_min(feature_name, log_id) as feature_name,
       arg_min(prompt, log_id) as prompt
from c group by category""")
def _samples_per_category(s: Source):
    return quality.samples_per_category(s("fx_records")).select("category", "log_id", "feature_name", "prompt")


# ---- summaries ----


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("log_summary", """
with t as (select count(*) as n, count(error_status) as err, count(*) filter (redacted) as red,
             count(*) filter (is_safety_edge_case) as saf, count(*) filter (retry_count > 0) as ret from fx_logs)
select 'feature' as metric, feature_name as item, cast(count(*) as double) as value from fx_logs group by feature_name
union all select 'feedback', user_feedback, count(*) from fx_logs group by user_feedback
union all select 'total', null, n from t
union all select 'error_count', null, err from t union all select 'error_rate', null, round(err / n, 6) from t
union all select 'redacted_count', null, red from t union all select 'redacted_rate', null, round(red / n, 6) from t
union all select 'safety_edge_case_count', null, saf from t union all select 'safety_edge_case_rate', null, round(saf / n, 6) from t
union all select 'retry_count', null, ret from t union all select 'retry_rate', null, round(ret / n, 6) from t""")
def _log_summary(s: Source):
    return _rounded(summaries.log_summary(s("fx_logs")))


@query("case_summary", """
select 'status' as metric, status as item, cast(count(*) as double) as value from fx_cases group by status
union all select 'eval_type', eval_type, count(*) from fx_cases group by eval_type
union all select 'difficulty', difficulty, count(*) from fx_cases group by difficulty
union all select 'total', null, count(*) from fx_cases
union all select 'mean_confidence', null, round(avg(confidence_score), 6) from fx_cases
union all select 'dedup_rejections', null, count(*) from fx_edits""")
def _case_summary(s: Source):
    return _rounded(summaries.case_summary(s("fx_cases"), s("fx_edits")))


@query("cases_by_cluster", """
select source_cluster_id as cluster_id, count(*) as cases from fx_cases where status = 'approved' group by 1""")
def _cases_by_cluster(s: Source):
    return summaries.cases_by_cluster(s("fx_cases"))


@query("cases_by_difficulty", """
select d as difficulty, count(case_id) as cases
from (values ('easy'), ('medium'), ('hard')) v(d)
left join fx_cases on difficulty = d and status = 'approved' group by d""")
def _cases_by_difficulty(s: Source):
    return summaries.cases_by_difficulty(s("fx_cases"))


@query("label_provenance", """
select label_source, count(*) as cases, round(count(*) / sum(count(*)) over (), 6) as share
from fx_cases where status = 'approved' group by label_source""")
def _label_provenance(s: Source):
    return summaries.label_provenance(s("fx_cases")).withColumn("share", F.round("share", 6))


@query("cluster_freshness", f"""
select source_cluster_id as cluster_id, count(*) as cases,
       cast(floor(epoch({_DUCK_AS_OF} - max(approved_at)) / 86400) as bigint) as days_since_last_added
from fx_cases where status = 'approved' group by 1""")
def _cluster_freshness(s: Source):
    return summaries.cluster_freshness(s("fx_cases"), as_of())


@query("status_counts", """
select count(*) as total, count(*) filter (status = 'approved') as approved,
       count(*) filter (status = 'draft') as draft, count(*) filter (status = 'rejected') as rejected from fx_cases""")
def _status_counts(s: Source):
    return summaries.status_counts(s("fx_cases"))


@query("edits_by_field", "select field_changed, count(*) as edits from fx_edits group by field_changed")
def _edits_by_field(s: Source):
    return summaries.edits_by_field(s("fx_edits"))


@query("build_counters", """
with o as (select case when status in ('approved', 'draft') then 'created' when status = 'rejected' then 'deduped' else 'failed' end as outcome, status from fx_cases)
select count(*) filter (outcome = 'created') as created,
       count(*) filter (outcome = 'created' and status = 'approved') as auto_approved,
       count(*) filter (outcome = 'created' and status = 'draft') as draft,
       count(*) filter (outcome = 'deduped') as deduped, count(*) filter (outcome = 'failed') as failed from o""")
def _build_counters(s: Source):
    outcome = F.expr("case when status in ('approved', 'draft') then 'created' when status = 'rejected' then 'deduped' else 'failed' end")
    return summaries.build_counters(s("fx_cases").withColumn("outcome", outcome))


# ---- runs ----


@query("list_runs", """
select run_id, strftime(min(run_ts), '%Y-%m-%d %H:%M:%S') as run_ts, count(*) as total,
       count(*) filter (passed) as passed, round(count(*) filter (passed) / count(*), 6) as pass_rate
from fx_runs group by run_id""")
def _list_runs(s: Source):
    return runs.list_runs(s("fx_runs")).select(
        "run_id", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss").alias("run_ts"), "total", "passed",
        F.round("pass_rate", 6).alias("pass_rate"),
    )


@query("pass_rate", """
select round(count(*) filter (passed) / count(*), 6) as pass_rate from fx_runs where run_id = 'run_3'
union all select null as pass_rate""")
def _pass_rate(s: Source):
    rates = runs.pass_rate(s("fx_runs"), "run_3").unionByName(runs.pass_rate(s("fx_runs"), "run_none"))
    return rates.select(F.round("pass_rate", 6).alias("pass_rate"))


@query("latest_two_runs", """
with r as (select run_id, row_number() over (order by min(run_ts) desc, run_id desc) as n from fx_runs group by run_id)
select max(run_id) filter (n = 2) as previous_run, max(run_id) filter (n = 1) as current_run from r""")
def _latest_two_runs(s: Source):
    return runs.latest_two_runs(s("fx_runs"))


_DUCK_DIFF = """
with p as (select case_id, passed from fx_runs where run_id = 'run_6'),
     c as (select case_id, passed from fx_runs where run_id = 'run_7'),
     diff as (select case_id, case when p.passed is null then 'only_in_current' when c.passed is null then 'only_in_previous'
                when p.passed and not c.passed then 'regression' when not p.passed and c.passed then 'improvement'
                when p.passed then 'unchanged_pass' else 'unchanged_fail' end as change
              from p full join c using (case_id))"""


@query("regression_diff", f"{_DUCK_DIFF} select case_id, change from diff")
def _regression_diff(s: Source):
    return runs.regression_diff(s("fx_runs"), "run_6", "run_7")


@query("regression_counts", f"{_DUCK_DIFF} select change, count(*) as cases from diff group by change")
def _regression_counts(s: Source):
    return runs.regression_counts(runs.regression_diff(s("fx_runs"), "run_6", "run_7"))


@query("latest_result", """
select case_id, arg_max(run_id, run_ts) as run_id, arg_max(passed, run_ts) as passed from fx_runs group by case_id""")
def _latest_result(s: Source):
    return runs.latest_result(s("fx_runs")).select("case_id", "run_id", "passed")


@query("run_failures", """
select r.run_id, r.case_id, length(d.text) as response_chars
from fx_runs r left join (select 'case_' || lpad(cast(doc_id as varchar), 12, '0') as case_id, text from documents) d using (case_id)
where run_id = 'run_7' and not passed order by r.case_id limit 10""")
def _run_failures(s: Source):
    texts = s("documents").selectExpr("'case_' || lpad(cast(doc_id as string), 12, '0') as case_id", "text as model_response")
    results = s("fx_runs").join(texts, "case_id", "left")
    return runs.run_failures(results).select("run_id", "case_id", F.col("response_chars").cast("bigint").alias("response_chars"))


@query("last_results", """
select run_id, case_id, passed from fx_runs order by run_ts desc, run_id, case_id limit 5""")
def _last_results(s: Source):
    return runs.last_results(s("fx_runs")).select("run_id", "case_id", "passed")


# ---- review ----


@query("review_queue", "select case_id, confidence_score from fx_cases where status = 'draft'")
def _review_queue(s: Source):
    return review.review_queue(s("fx_cases")).select("case_id", "confidence_score")


@query("review_queue_top", """
select case_id, confidence_score from fx_cases where status = 'draft' order by confidence_score, case_id limit 20""")
def _review_queue_top(s: Source):
    return review.review_queue(s("fx_cases"), 20).select("case_id", "confidence_score")


@query("queue_with_source", """
select c.case_id, c.source_log_id, l.feature_name, l.user_feedback, l.error_status
from fx_cases c left join fx_logs l on l.log_id = c.source_log_id where c.status = 'draft'""")
def _queue_with_source(s: Source):
    logs = s("fx_logs").select("log_id", "feature_name", "user_feedback", "error_status")
    return review.queue_with_source(s("fx_cases"), logs).select(
        "case_id", "source_log_id", "feature_name", "user_feedback", "error_status"
    )


@query("edits_for_case", """
select case_id, edit_id, field_changed,
       row_number() over (partition by case_id order by edit_ts, edit_id) as seq from fx_edits""")
def _edits_for_case(s: Source):
    return review.edits_for_case(s("fx_edits")).select("case_id", "edit_id", "field_changed", "seq")


@query("review_guidance", """
with t(eval_type, field_changed) as (values ('golden_answer', 'expected_behavior'), ('expected_refusal', 'expected_behavior'),
       ('rubric', 'rubric'), ('rubric', 'forbidden_assertions')),
u as (select * from fx_edits join t using (field_changed) where before_value <> '' and after_value <> ''),
c as (select eval_type, string_agg('''' || field_changed || ''' (' || n || ' edits)', ', ' order by n desc, field_changed) as counts
      from (select eval_type, field_changed, count(*) as n from u group by all) group by eval_type),
e as (select eval_type, string_agg('- Before: ' || substr(before_value, 1, 200) || chr(10) || '  After:  ' || substr(after_value, 1, 200), chr(10) order by rn desc) as ex
      from (select *, row_number() over (partition by eval_type order by edit_ts desc, edit_id desc) as rn from u) where rn <= 2 group by eval_type)
select eval_type, chr(10) || chr(10) || 'Fields that people fix by hand here: ' || counts
  || '. Aim for texts that need none of these edits, such as:' || chr(10) || ex as guidance
from c join e using (eval_type)""")
def _review_guidance(s: Source):
    return review.review_guidance(s("fx_edits"))


def _cases_for_review(s: Source):
    return s("fx_case_lists").selectExpr(
        "case_id", "source_log_id", "source_cluster_id", "prompt", "eval_type", "expected_behavior", "rubric",
        "forbidden_assertions", "difficulty", "tags", "confidence_score", "label_source", "status",
        "cast(null as string) as reviewer_id", "cast(null as string) as review_notes",
        "timestamp_ntz '2024-01-01 00:00:00' as created_at", "approved_at",
        "cast(null as string) as revises_case_id",
    )


def _decisions(s: Source):
    """One decision per case and a second one for some; every kind of mistake occurs."""
    return s("fx_case_lists").selectExpr(
        "*",
        "case vec_id % 7 when 0 then 'approve' when 1 then 'edit_approve' when 2 then 'reject' when 3 then 'edit_approve' "
        "when 4 then 'reject' when 5 then 'approve' else 'escalate' end as action",
    ).selectExpr(
        "case when vec_id % 13 = 0 then array(0, 1) else array(0) end as copies", "case_id", "action",
        "'rev_' || (vec_id % 5) as reviewer_id",
        "case when vec_id % 7 = 2 then 'off topic' end as reason",
        "case vec_id % 7 when 0 then array('difficulty') when 1 then array('difficulty', 'tags') when 3 then null "
        "when 5 then array('status') else array('tags') end as edited_fields",
        "named_struct('expected_behavior', cast(null as string), 'rubric', cast(null as array<string>), "
        "'forbidden_assertions', cast(null as array<string>), 'tags', array(lang), "
        "'difficulty', case when n_chars % 3 = 0 then 'hard' else 'easy' end) as edits",
    ).select("*", F.explode("copies").alias("copy")).selectExpr(
        "case_id || '_' || copy as decision_id", "case_id", "action", "reviewer_id", "reason", "edited_fields", "edits"
    )


_DUCK_DECIDED = """
with d as (
  select *, case vec_id % 7 when 0 then 'approve' when 1 then 'edit_approve' when 2 then 'reject' when 3 then 'edit_approve'
      when 4 then 'reject' when 5 then 'approve' else 'escalate' end as action,
    case vec_id % 7 when 3 then 'edit_approve needs edits' when 4 then 'reject needs a reason'
      when 5 then 'not editable: status' when 6 then 'unknown action: escalate' end as own_error,
    case when n_chars % 3 = 0 then 'hard' else 'easy' end as new_difficulty
  from fx_case_lists),
j as (
  select *, coalesce(own_error, case when status <> 'draft' then 'invalid transition: ' || status || ' -> '
      || case when action = 'reject' then 'rejected' else 'approved' end end) as error from d)"""


@query("apply_reviews", f"""{_DUCK_DECIDED}
select case_id, case when action = 'reject' then 'rejected' else 'approved' end as status,
       'rev_' || (vec_id % 5) as reviewer_id, case when action = 'reject' then 'off topic' end as review_notes,
       case when action = 'reject' then difficulty else new_difficulty end as difficulty,
       case when action = 'edit_approve' then lang else lang || ',' || source end as tags,
       case when action = 'edit_approve' or (action = 'approve' and difficulty <> new_difficulty)
            then 'human_edited' else label_source end as label_source,
       action <> 'reject' as has_approved_at
from j where error is null""")
def _apply_reviews(s: Source):
    changed, _, _ = review.apply_reviews(_cases_for_review(s), _decisions(s), as_of())
    return changed.select(
        "case_id", "status", "reviewer_id", "review_notes", "difficulty", F.array_join("tags", ",").alias("tags"),
        "label_source", F.col("approved_at").isNotNull().alias("has_approved_at"),
    )


@query("review_edits", f"""{_DUCK_DECIDED}
select case_id, 'difficulty' as field_changed, difficulty as before_value, new_difficulty as after_value,
       'rev_' || (vec_id % 5) as reviewer_id
from j where error is null and action <> 'reject' and difficulty <> new_difficulty
union all
select case_id, 'tags', '["' || lang || '","' || source || '"]', '["' || lang || '"]', 'rev_' || (vec_id % 5)
from j where error is null and action = 'edit_approve'""")
def _review_edits(s: Source):
    _, edits, _ = review.apply_reviews(_cases_for_review(s), _decisions(s), as_of())
    return edits.select("case_id", "field_changed", "before_value", "after_value", "reviewer_id")


@query("refused_reviews", f"""{_DUCK_DECIDED}
select case_id || '_0' as decision_id, error from j where error is not null
union all
select case_id || '_1', coalesce(error, 'case already decided') from j where vec_id % 13 = 0""")
def _refused_reviews(s: Source):
    _, _, refused = review.apply_reviews(_cases_for_review(s), _decisions(s), as_of())
    return refused.select("decision_id", "error")


@query("deprecate_and_revise", """
with hit as (select c.*, t.quality from fx_case_lists c join labels t on t.doc_id = c.vec_id where c.status = 'approved' and t.toxic = 1)
select case_id, 'deprecated' as status, 'flawed by rubric' as review_notes, label_source,
       cast(null as varchar) as revises_case_id, true as has_approved_at, prompt from hit
union all
select 'case_' || substr(sha256('{"k0":"' || case_id || '","k1":"revision","k2":"flawed by rubric"}'), 1, 16), 'draft',
       'Revision of ' || case_id || ': flawed by rubric', 'human_edited', case_id, false, prompt from hit""")
def _deprecate_and_revise(s: Source):
    flags = s("labels").filter("toxic = 1").selectExpr(
        "'case_' || lpad(cast(doc_id as string), 12, '0') as case_id", "'flawed by rubric' as reason", "'rev_1' as reviewer_id"
    )
    rows, _ = review.deprecate_and_revise(_cases_for_review(s), flags, as_of())
    return rows.select(
        "case_id", "status", "review_notes", "label_source", "revises_case_id",
        F.col("approved_at").isNotNull().alias("has_approved_at"), "prompt",
    )
