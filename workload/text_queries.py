"""Text functions and row rules (expressions only: no shuffle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.functions import rules, text
from tracesieve.schemas import QUALITY_REPLY
from workload.registry import Source, query

# The redaction patterns and masks in RE2 syntax, rule by rule.
_DUCK_RULES = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
    ("phone", r"(\+\d{1,3}[\s-]?)?(\(\d{3}\)[\s-]?|\d{3}[\s.-])\d{3}[\s.-]\d{4}\b", "[REDACTED_PHONE]"),
    ("secret:openai_key", r"sk-[A-Za-z0-9]{20,}", "[REDACTED_SECRET]"),
    ("secret:aws_key", r"AKIA[0-9A-Z]{16}", "[REDACTED_SECRET]"),
    ("secret:github_token", r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED_SECRET]"),
    ("secret:generic_bearer", r"Bearer\s+[A-Za-z0-9\-._~+/]{20,}", "[REDACTED_SECRET]"),
    ("secret:generic_secret_kv",
     r"""(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*["'']?[A-Za-z0-9\-._~+/]{8,}["'']?""",
     "[REDACTED_SECRET]"),
    ("name", r"((?:my name is|i''?m|this is|i am)\s+)([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)", r"\1[REDACTED_NAME]"),
)


def duck_redact(source: str, key: str, column: str, prefix: str) -> str:
    """Common table expressions ``{prefix}0 .. {prefix}8``: the text after each rule."""
    ctes = [f"{prefix}0 as (select {key}, {column} as t, [] :: varchar[] as fired from {source})"]
    for i, (name, pattern, mask) in enumerate(_DUCK_RULES):
        ctes.append(
            f"{prefix}{i + 1} as (select {key}, regexp_replace(t, '{pattern}', '{mask}', 'g') as t, "
            f"case when regexp_matches(t, '{pattern}') then list_append(fired, '{name}') else fired end as fired "
            f"from {prefix}{i})"
        )
    return ",\n".join(ctes)


@query("redact_text", f"with {duck_redact('fx_texts', 'text_id', 'text', 'r')} select text_id, t as masked from r8")
def _redact_text(s: Source):
    return s("fx_texts").select("text_id", text.redact_text(F.col("text")).alias("masked"))


@query("redaction_types", f"""with {duck_redact('fx_texts', 'text_id', 'text', 'r')}
select text_id, t as masked, array_to_string(fired, ',') as fired from r8""")
def _redaction_types(s: Source):
    found = text.with_redaction(s("fx_texts"), "text", "masked", "fired")
    return found.select("text_id", "masked", F.array_join("fired", ",").alias("fired"))


_REDACT_LOGS = f"""with {duck_redact('fx_records', 'log_id', 'prompt', 'p')},
{duck_redact('fx_records', 'log_id', 'response', 'q')}"""


@query("redact_log_fields", f"""{_REDACT_LOGS}
select p.log_id, p.t as prompt, q.t as response, len(p.fired) + len(q.fired) > 0 as redacted,
       case when len(p.fired) + len(q.fired) > 0 then 'regex_v1' end as redaction_method,
       array_to_string(list_sort(list_distinct(list_concat(p.fired, q.fired))), ',') as matched_types
from p8 p join q8 q on q.log_id = p.log_id""")
def _redact_log_fields(s: Source):
    masked = text.redact_log_fields(s("fx_records"))
    return masked.select(
        "log_id", "prompt", "response", "redacted", "redaction_method",
        F.array_join("matched_types", ",").alias("matched_types"),
    )


_DUCK_WORDS = r"cast(greatest(1, len(regexp_extract_all({0}, '[^\s\x0B\x85\p{{Z}}]+'))) as int)"


@query("token_count", f"select text_id, {_DUCK_WORDS.format('text')} as tokens from fx_texts")
def _token_count(s: Source):
    return s("fx_texts").select("text_id", text.token_count(F.col("text")).alias("tokens"))


@query("normalize_logs", f"""with {duck_redact('fx_turns', 'log_id', 'prompt', 'p')},
{duck_redact('fx_turns', 'log_id', 'response', 'q')}
select l.log_id, l.system_prompt, p.t as prompt, q.t as response,
       {_DUCK_WORDS.format('l.prompt')} as prompt_tokens, {_DUCK_WORDS.format('l.response')} as completion_tokens,
       len(p.fired) + len(q.fired) > 0 as redacted
from fx_turns l join p8 p on p.log_id = l.log_id join q8 q on q.log_id = l.log_id""")
def _normalize_logs(s: Source):
    return text.normalize_logs(s("fx_turns")).select(
        "log_id", "system_prompt", "prompt", "response", "prompt_tokens", "completion_tokens", "redacted"
    )


@query("parse_model_json", """
select case_id,
       case when shape in (0, 1, 2) then confidence_score end as quality_score,
       case when shape in (0, 1) then lang end as reasoning,
       case shape when 3 then 'missing keys: quality_score' when 4 then 'empty reply'
            when 5 then 'malformed reply' when 6 then 'malformed reply' end as error
from (select r.*, c.confidence_score, c.lang from fx_replies r join fx_case_rows c on c.case_id = r.case_id)""")
def _parse_model_json(s: Source):
    parsed = text.parse_model_json(F.col("reply"), QUALITY_REPLY, ["quality_score"])
    return (
        s("fx_replies").select("case_id", parsed.alias("r"))
        .select("case_id", "r.value.quality_score", "r.value.reasoning", "r.error")
    )


DUCK_LABEL = """array_to_string(list_filter([
  case when length({expected}) > 0 then '= ' || {expected} end,
  case when len({rubric}) > 0 then array_to_string(list_transform({rubric}, lambda x: '+ ' || x), chr(10)) end,
  case when len({forbidden}) > 0 then array_to_string(list_transform({forbidden}, lambda x: '! ' || x), chr(10)) end], lambda p: p is not null), chr(10))"""
_BY_TYPE = DUCK_LABEL.format(
    expected="(case when eval_type <> 'rubric' then expected_behavior end)", rubric="(case when eval_type = 'rubric' then rubric end)",
    forbidden="(case when eval_type = 'rubric' then forbidden_assertions end)",
)
DUCK_JUDGE_PROMPT = f"""
'<answer>' || chr(10) || {{}} || chr(10) || '</answer>' || chr(10) || '<' || eval_type || '>' || chr(10)
|| {_BY_TYPE} || chr(10) || '</' || eval_type || '>'"""


@query("render_label", f"""
select case_id, {DUCK_LABEL.format(expected="expected_behavior", rubric="rubric", forbidden="forbidden_assertions")} as label_text
from fx_case_lists""")
def _render_label(s: Source):
    rendered = text.render_label(F.col("expected_behavior"), F.col("rubric"), F.col("forbidden_assertions"))
    return s("fx_case_lists").select("case_id", rendered.alias("label_text"))


@query("render_judge_prompt", f"select case_id, {DUCK_JUDGE_PROMPT.format('prompt')} as judge_prompt from fx_case_lists")
def _render_judge_prompt(s: Source):
    rendered = text.render_judge_prompt(
        F.col("eval_type"), F.col("expected_behavior"), F.col("rubric"),
        F.col("forbidden_assertions"), F.col("prompt"),
    )
    return s("fx_case_lists").select("case_id", rendered.alias("judge_prompt"))


@query("passes_agree", """
with x as (select vec_id, coalesce(len(rubric), 0) as n_rules, length(coalesce(expected_behavior, '')) as n_text from fx_case_lists),
p as (select c.case_id, c.eval_type, c.difficulty, list_filter([a.n_rules, x2.n_rules, x3.n_rules], lambda v: v is not null) as r,
        list_filter([a.n_text, x2.n_text, x3.n_text], lambda v: v is not null) as t
      from fx_case_lists c join x a on a.vec_id = c.vec_id
      left join x x2 on x2.vec_id = c.vec_id + 1 and c.difficulty = 'hard'
      left join x x3 on x3.vec_id = c.vec_id + 2 and c.difficulty = 'hard')
select case_id, eval_type, len(r) as n_passes,
       case when len(r) <= 1 then true when eval_type = 'rubric' then list_max(r) - list_min(r) <= 1
            when list_min(t) = 0 then false else list_max(t) / list_min(t) <= 1.5 end as agreed
from p""")
def _passes_agree(s: Source):
    cases = s("fx_case_lists")
    answer = F.struct("expected_behavior", "rubric")

    def other(step: int):
        return cases.select((F.col("vec_id") - step).alias("vec_id"), F.lit("hard").alias("difficulty"), answer.alias(f"p{step}"))

    joined = (
        cases.select("case_id", "vec_id", "eval_type", "difficulty", answer.alias("p0"))
        .join(other(1), ["vec_id", "difficulty"], "left").join(other(2), ["vec_id", "difficulty"], "left")
        .withColumn("passes", F.array_compact(F.array("p0", "p1", "p2")))
    )
    return joined.select(
        "case_id", "eval_type", F.size("passes").cast("bigint").alias("n_passes"),
        text.passes_agree(F.col("passes"), F.col("eval_type")).alias("agreed"),
    )


@query("field_as_text", """
select case_id, coalesce(cast(to_json(rubric) as varchar), '') as rubric_text,
       coalesce(cast(to_json(tags) as varchar), '') as tags_text,
       coalesce(expected_behavior, '') as expected_text, coalesce(difficulty, '') as difficulty_text
from fx_case_lists""")
def _field_as_text(s: Source):
    cases = s("fx_case_lists")
    return cases.select(
        "case_id",
        text.field_as_text(cases, "rubric").alias("rubric_text"),
        text.field_as_text(cases, "tags").alias("tags_text"),
        text.field_as_text(cases, "expected_behavior").alias("expected_text"),
        text.field_as_text(cases, "difficulty").alias("difficulty_text"),
    )


@query("to_utc_ntz", """
select event_id, strftime(ts - to_hours(cast(user_id % 5 as int)), '%Y-%m-%d %H:%M:%S') as utc from events""")
def _to_utc_ntz(s: Source):
    stamped = F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss') || '+0' || cast(user_id % 5 as string) || ':00'")
    return s("events").select(
        "event_id", F.date_format(text.to_utc_ntz(stamped), "yyyy-MM-dd HH:mm:ss").alias("utc")
    )


@query("stable_id", """
select log_id, 'case_' || substr(sha256('{"k0":"' || log_id || '","k1":"' || feature_name || '"}'), 1, 16) as new_id
from fx_logs""")
def _stable_id(s: Source):
    return s("fx_logs").select("log_id", text.stable_id("case", F.col("log_id"), F.col("feature_name")).alias("new_id"))


@query("parse_list_field", r"""
select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
         lambda x: regexp_replace(x, '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g')), lambda x: x <> ''), '|') as lines,
       array_to_string(list_filter(list_transform(string_split(text, ','),
         lambda x: regexp_replace(x, '^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$', '', 'g')), lambda x: x <> ''), '|') as parts
from documents""")
def _parse_list_field(s: Source):
    return s("documents").select(
        "doc_id",
        F.array_join(text.parse_list_field(F.col("text")), "|").alias("lines"),
        F.array_join(text.parse_list_field(F.col("text"), ","), "|").alias("parts"),
    )


# ---- row rules ----

DUCK_WEIGHT = """1.0 + case when user_feedback = 'negative' then 3 else 0 end + 2 * least(retry_count, 3)
  + case when error_status is not null then 4 else 0 end + case when is_safety_edge_case then 5 else 0 end"""


@query("failure_weight", f"select log_id, cast({DUCK_WEIGHT} as double) as weight from fx_logs")
def _failure_weight(s: Source):
    return s("fx_logs").select("log_id", rules.failure_weight().alias("weight"))


DUCK_CATEGORY = """case when is_safety_edge_case then 'safety' when error_status = 'malformed_output' then 'malformed'
  when retry_count > 0 then 'retry' when user_feedback = 'negative' then 'bad' else 'good' end"""


@query("classify_log", f"select log_id, {DUCK_CATEGORY} as category from fx_logs")
def _classify_log(s: Source):
    return s("fx_logs").select("log_id", rules.classify_log().alias("category"))


@query("decide_eval_type", """
select log_id, case when is_safety_edge_case then 'expected_refusal'
  when feature_name in ('sql_query_generator', 'code_review_assistant') then 'golden_answer' else 'rubric' end as eval_type
from fx_logs""")
def _decide_eval_type(s: Source):
    return s("fx_logs").select("log_id", rules.decide_eval_type().alias("eval_type"))


@query("decide_difficulty", """
select log_id, case when is_safety_edge_case or error_status is not null or retry_count > 0 then 'hard'
  when user_feedback = 'negative' then 'medium' else 'easy' end as difficulty from fx_logs""")
def _decide_difficulty(s: Source):
    return s("fx_logs").select("log_id", rules.decide_difficulty().alias("difficulty"))


@query("label_confidence", """
select case_id, case when q between 0 and 1 then round(0.5 * q + 0.5 * case when label_source = 'auto' then 1.0 else 0.3 end, 6) end as confidence,
       not (q between 0 and 1) as out_of_range
from (select case_id, label_source, cast(n_chars % 111 as double) / 100 as q from fx_case_rows)""")
def _label_confidence(s: Source):
    quality = F.expr("cast(n_chars % 111 as double) / 100")
    return s("fx_case_rows").select(
        "case_id",
        F.round(rules.label_confidence(quality, F.col("label_source") == "auto"), 6).alias("confidence"),
        rules.confidence_error(quality).isNotNull().alias("out_of_range"),
    )


@query("route_cases", """
select case_id, case when confidence_score >= 0.75 then 'approved' else 'draft' end as status,
       case when confidence_score >= 0.75 then 'auto' end as reviewer_id,
       confidence_score >= 0.75 as has_approved_at
from fx_cases""")
def _route_cases(s: Source):
    as_of = F.expr("timestamp_ntz '2024-06-01 00:00:00'")
    routed = rules.route_cases(s("fx_cases").drop("status", "approved_at"), as_of)
    return routed.select("case_id", "status", "reviewer_id", F.col("approved_at").isNotNull().alias("has_approved_at"))


@query("confidence_bucket", """
select case_id, case when confidence_score < 0.65 then 'High review priority'
  when confidence_score < 0.75 then 'Review required' else 'Higher confidence' end as bucket from fx_cases""")
def _confidence_bucket(s: Source):
    return s("fx_cases").select("case_id", rules.confidence_bucket(F.col("confidence_score")).alias("bucket"))


@query("prompt_preview", """
select doc_id, substr(text, 1, 150) as preview, round(n_chars / 7.0, 3) as score from documents""")
def _prompt_preview(s: Source):
    return s("documents").select(
        "doc_id", rules.prompt_preview(F.col("text")).alias("preview"),
        F.round(F.col("n_chars") / F.lit(7.0), 3).alias("score"),
    )


@query("transition_status", """
select case_id, case when ok then new_status else status end as status,
       case when ok then asked_by end as reviewer_id,
       case when ok and new_status = 'approved' then '2024-06-01 00:00:00'
            else strftime(approved_at, '%Y-%m-%d %H:%M:%S') end as approved_at,
       case when not ok then 'invalid transition: ' || status || ' -> ' || new_status end as error
from (select *, (status = 'draft' and new_status in ('approved', 'rejected'))
             or (status = 'approved' and new_status = 'deprecated') as ok
      from (select c.*, case vec_id % 3 when 0 then 'approved' when 1 then 'rejected' else 'deprecated' end as new_status,
              case when vec_id % 2 = 0 then 'rev_1' end as asked_by from fx_cases c))""")
def _transition_status(s: Source):
    asked = s("fx_cases").selectExpr(
        "*", "cast(null as string) as reviewer_id", "cast(null as string) as review_notes",
        "case vec_id % 3 when 0 then 'approved' when 1 then 'rejected' else 'deprecated' end as new_status",
        "case when vec_id % 2 = 0 then 'rev_1' end as by", "cast(null as string) as notes",
    )
    changed, refused = rules.transition_status(asked, F.expr("timestamp_ntz '2024-06-01 00:00:00'"))
    keep = ["case_id", "status", "reviewer_id", "approved_at"]
    both = changed.select(*keep, F.lit(None).cast("string").alias("error")).unionByName(
        refused.select(*keep, "error")
    )
    return both.withColumn("approved_at", F.date_format("approved_at", "yyyy-MM-dd HH:mm:ss"))
