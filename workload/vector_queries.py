"""Vectors, clusters, sampling, scoring and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.functions import rules
from tracesieve.operators import clusters, dedup, quality, sampling, scoring, vectors
from workload.registry import Source, query
from workload.table_queries import as_of
from workload.text_queries import DUCK_WEIGHT

_CENTROIDS = """
cent as (select cluster_id, list(m order by i) as centroid, max(n) as size
         from (select cluster_id, i, avg(x) as m, count(*) as n
               from (select cluster_id, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as i
                     from fx_emb where cluster_id <> -1) group by cluster_id, i) group by cluster_id)"""
_DIST = "list_distance(cast({0} as double[]), {1})"


@query("cluster_centroids", f"""
with {_CENTROIDS}
select cluster_id, size, unnest(range(64)) as dim, round(unnest(centroid), 6) as mean from cent""")
def _cluster_centroids(s: Source):
    return vectors.cluster_centroids(s("fx_emb")).select(
        "cluster_id", "size", F.posexplode("centroid").alias("dim", "mean")
    ).withColumns({"mean": F.round("mean", 6), "dim": F.col("dim").cast("bigint")})


@query("cluster_summary", """
select count(*) as n_points, count(distinct cluster_id) filter (cluster_id <> -1) as n_clusters,
       count(*) filter (cluster_id = -1) as n_noise from fx_emb""")
def _cluster_summary(s: Source):
    return clusters.cluster_summary(s("fx_emb"))


@query("cluster_sizes", "select cluster_id, count(*) as size from fx_emb group by cluster_id")
def _cluster_sizes(s: Source):
    return clusters.cluster_sizes(s("fx_emb"))


@query("nearest_centroid", f"""
with {_CENTROIDS}
select log_id as id, arg_min(c.cluster_id, [d, c.cluster_id]) as cluster_id, round(min(d), 6) as distance
from (select e.log_id, c.cluster_id, {_DIST.format('e.embedding', 'c.centroid')} as d from fx_emb e cross join cent c) c
group by log_id""")
def _nearest_centroid(s: Source):
    emb = s("fx_emb")
    found = vectors.nearest_centroid(
        emb.select(F.col("log_id").alias("id"), F.col("embedding").alias("v")), vectors.cluster_centroids(emb)
    )
    return found.withColumn("distance", F.round("distance", 6))


@query("representatives", f"""
with {_CENTROIDS}
select cluster_id, log_id, rank from (
  select e.cluster_id, log_id, row_number() over (partition by e.cluster_id
         order by {_DIST.format('embedding', 'centroid')}, log_id) as rank
  from fx_emb e join cent c on c.cluster_id = e.cluster_id) where rank <= 5""")
def _representatives(s: Source):
    return clusters.representatives(s("fx_emb")).select("cluster_id", "log_id", "rank")


_DUCK_LINKS = """
with p as (select {id} as id, cast({v} as double[]) as v, min({id}) over (partition by {v}) as class_id from {rows}),
pairs as (select a.id, b.id as other_id, case when a.v = b.v then 1.0 else list_cosine_similarity(a.v, b.v) end as sim
          from p a join p b on a.id <> b.id and list_cosine_similarity(a.v, b.v) >= {within}),
best as (select id, count(*) as n_links, arg_min(other_id, [-sim, cast(substr(other_id, 5) as double)]) as other_id, max(sim) as similarity from pairs group by id)
select p.id, class_id, coalesce(n_links, 0) as n_links, other_id, round(similarity, 6) as similarity from p left join best on best.id = p.id"""


@query("similarity_pairs", _DUCK_LINKS.format(id="log_id", v="v", rows="fx_blobs", within=0.92))
def _similarity_pairs(s: Source):
    found = vectors.similarity_pairs(_blobs(s), 0.92)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("similarity_pairs_raw", _DUCK_LINKS.format(id="log_id", v="embedding", rows="fx_emb", within=0.4))
def _similarity_pairs_raw(s: Source):
    """The given embeddings, of any length; they lie far apart, so the threshold is low."""
    found = vectors.similarity_pairs(_raw(s), 0.4)
    return found.withColumn("similarity", F.round("similarity", 6))


def _raw(s: Source):
    return s("fx_emb").select(F.col("log_id").alias("id"), F.col("embedding").alias("v"))


def _blobs(s: Source):
    return s("fx_blobs").select(F.col("log_id").alias("id"), "v")


def _case_vectors(s: Source, statuses: list[str]):
    cases = s("fx_cases").filter(F.col("status").isin(*statuses)).select("case_id", "vec_id")
    return cases.join(s("fx_blobs").select("vec_id", "v"), "vec_id").select(F.col("case_id").alias("id"), "v")


_DUCK_CASE_VECTORS = """
approved as (select c.case_id as id, b.v from fx_cases c join fx_blobs b using (vec_id) where c.status = 'approved'),
open as (select c.case_id as id, b.v from fx_cases c join fx_blobs b using (vec_id) where c.status = 'draft'),
fresh as (select log_id as id, vec_id, v from fx_blobs where vec_id not in (select vec_id from fx_cases where status = 'approved'))"""


@query("similar_approved", f"""
with {_DUCK_CASE_VECTORS}
select id, other_id, round(sim, 6) as similarity, n as rank from (
  select o.id, a.id as other_id, list_dot_product(o.v, a.v) as sim,
         row_number() over (partition by o.id order by list_dot_product(o.v, a.v) desc, a.id) as n
  from open o cross join approved a) where n <= 3""")
def _similar_approved(s: Source):
    found = vectors.most_similar(_case_vectors(s, ["draft"]), _case_vectors(s, ["approved"]), 3)
    return found.withColumn("similarity", F.round("similarity", 6))


def _fresh(s: Source):
    known = s("fx_cases").filter("status = 'approved'").select("vec_id")
    return s("fx_blobs").join(known, "vec_id", "left_anti").select(F.col("log_id").alias("id"), "v")


@query("check_duplicates", f"""
with {_DUCK_CASE_VECTORS},
m as (select f.id, a.id as case_id, list_dot_product(f.v, a.v) as sim,
        row_number() over (partition by f.id order by list_dot_product(f.v, a.v) desc, a.id) as n
      from fresh f cross join approved a)
select id, sim >= 0.92 as is_duplicate, case_id as most_similar_case_id, round(sim, 6) as similarity,
       case when sim >= 0.92 then 'repeats ' else 'new; nearest is ' end || case_id || ' (cosine ' || printf('%.3f', sim) || ', limit 0.92)' as reason
from m where n = 1""")
def _check_duplicates(s: Source):
    found = dedup.check_duplicates(_fresh(s), _case_vectors(s, ["approved"]))
    return found.withColumn("similarity", F.round("similarity", 6))


# the one-by-one pass as recursion over the rank; {existing} blocks candidates beforehand
_DUCK_GREEDY = """
r as (select row_number() over (order by weight desc, id) as rn, id, v from ranked),
nb as (select a.rn, list(b.rn) filter (b.rn is not null) as before
       from r a left join r b on b.rn < a.rn and list_dot_product(a.v, b.v) >= 0.92 group by a.rn),
walk as (
  select cast(0 as bigint) as rn, cast([] as bigint[]) as acc
  union all
  select nb.rn, case when list_has_any(coalesce(nb.before, []), walk.acc) or nb.rn in (select rn from blocked)
                     then walk.acc else list_append(walk.acc, nb.rn) end
  from walk join nb on nb.rn = walk.rn + 1),
acc as (select unnest(acc) as rn from walk where rn = (select max(rn) from r)),
best as (select a.rn, arg_max(o.id, sim) as other, max(sim) as sim from r a join (
    select a.rn, b.id, list_dot_product(a.v, b.v) as sim from r a join r b on b.rn < a.rn and b.rn in (select rn from acc)
    union all select a.rn, e.id, list_dot_product(a.v, e.v) from r a cross join existing e) o on o.rn = a.rn and o.sim >= 0.92
  where a.rn not in (select rn from acc) group by a.rn)"""


@query("dedup_ordered", f"""
with ranked as (select b.log_id as id, b.v, {DUCK_WEIGHT} as weight from fx_blobs b join fx_logs l on l.log_id = b.log_id),
existing as (select id, v from ranked where false), blocked as (select cast(null as bigint) as rn where false),
{_DUCK_GREEDY}
select r.id, r.rn in (select rn from acc) as accepted, other as most_similar_id, round(sim, 6) as similarity
from r left join best on best.rn = r.rn""")
def _dedup_ordered(s: Source):
    weighted = s("fx_logs").select(F.col("log_id").alias("id"), rules.failure_weight().alias("score"))
    decided = dedup.dedup_ordered(_blobs(s).join(weighted, "id"))
    return decided.withColumn("similarity", F.round("similarity", 6))


@query("dedup_ordered_raw", f"""
with ranked as (select b.log_id as id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) as v, weight
                from (select log_id, cast(embedding as double[]) as w from fx_emb) b join (select log_id, {DUCK_WEIGHT} as weight from fx_logs l) l using (log_id)),
existing as (select id, v from ranked where false), blocked as (select cast(null as bigint) as rn where false),
{_DUCK_GREEDY.replace("0.92", "0.4")}
select r.id, r.rn in (select rn from acc) as accepted, other as most_similar_id, round(sim, 6) as similarity
from r left join best on best.rn = r.rn""")
def _dedup_ordered_raw(s: Source):
    weighted = s("fx_logs").select(F.col("log_id").alias("id"), rules.failure_weight().alias("score"))
    decided = dedup.dedup_ordered(_raw(s).join(weighted, "id"), threshold=0.4)
    return decided.withColumn("similarity", F.round("similarity", 6))


@query("dedup_rejections", f"""
with {_DUCK_CASE_VECTORS},
ranked as (select b.id, b.v, {DUCK_WEIGHT} as weight from fresh b join fx_logs l on l.log_id = b.id),
existing as (select id, v from approved),
r0 as (select row_number() over (order by weight desc, id) as rn, v from ranked),
blocked as (select distinct r0.rn from r0 join existing e on list_dot_product(r0.v, e.v) >= 0.92),
{_DUCK_GREEDY}
select 'rej_' || substr(sha256('{{"k0":"' || r.id || '","k1":"' || other || '"}}'), 1, 16) as rejection_id,
       r.id as source_log_id, other as most_similar_case_id, round(sim, 6) as similarity,
       'repeats ' || other || ' (cosine ' || printf('%.3f', sim) || ', limit 0.92)' as reason
from r join best on best.rn = r.rn""")
def _dedup_rejections(s: Source):
    weighted = s("fx_logs").select(F.col("log_id").alias("id"), rules.failure_weight().alias("score"))
    decided = dedup.dedup_ordered(_fresh(s).join(weighted, "id"), _case_vectors(s, ["approved"]))
    return dedup.dedup_rejections(decided, as_of()).drop("rejected_at").withColumn("similarity", F.round("similarity", 6))


# ---- sampling ----

_DUCK_U = "(cast('0x' || substr(md5({0} || ':42'), 1, 13) as bigint) + 0.5) / 4503599627370496.0"


@query("sample_random", f"select log_id, feature_name from fx_logs order by {_DUCK_U.format('log_id')}, log_id limit 200")
def _sample_random(s: Source):
    return sampling.sample_random(s("fx_logs"), 200, 42).select("log_id", "feature_name")


@query("sample_failure_biased", f"""
select log_id, feature_name from fx_logs order by -ln(greatest({_DUCK_U.format('log_id')}, 1e-12)) / ({DUCK_WEIGHT}), log_id limit 200""")
def _sample_failure_biased(s: Source):
    return sampling.sample_failure_biased(s("fx_logs"), 200, 42).select("log_id", "feature_name")


_DUCK_DIVERSE = f"""
with p as (select log_id as id, cast(embedding as double[]) as v from fx_emb),
first as (select id, v from p order by {_DUCK_U.format('id')}, id limit 1),
g as (
  select 1 as pick, p.id, p.v, list_distance(p.v, f.v) as d, f.id as chosen, f.v as chosen_v from p cross join first f
  union all
  select g.pick + 1, g.id, g.v, least(g.d, list_distance(g.v, n.v)), n.id, n.v
  from g join (select g.pick, g.id, g.v from g order by g.d desc, g.id limit 1) n on n.pick = g.pick
  where g.pick < {{}})
select distinct chosen as id, pick from g"""


def _diverse(s: Source, n: int):
    return sampling.sample_diverse(s("fx_emb").select(F.col("log_id").alias("id"), F.col("embedding").alias("v")), n, 42)


@query("sample_diverse", _DUCK_DIVERSE.format(10))
def _sample_diverse(s: Source):
    return _diverse(s, 10)


@query("sample_diverse_many", _DUCK_DIVERSE.format(300))
def _sample_diverse_many(s: Source):
    return _diverse(s, 300)


# ---- scoring ----

_DUCK_SCORED = f"""
with {_CENTROIDS},
near as (select e.log_id, e.cluster_id,
           case when e.cluster_id = -1 then min({_DIST.format('e.embedding', 'c.centroid')})
                else min({_DIST.format('e.embedding', 'c.centroid')}) filter (c.cluster_id = e.cluster_id) end as d
         from fx_emb e cross join cent c group by e.log_id, e.cluster_id),
nov as (select log_id, cluster_id,
          case when cluster_id = -1 then case when max(d) over w > 0 then 0.9 + 0.1 * d / max(d) over w else 0.9 end
               when count(*) over w = 1 then 1.0 when max(d) over w > 0 then d / max(d) over w else 0.0 end as novelty
        from near window w as (partition by cluster_id)),
cv as (select b.embedding from fx_cases c join fx_emb b using (vec_id) where c.status = 'approved'),
cnt as (select c.cluster_id, count(n.cluster_id) as approved from cent c left join (
          select (select arg_min(c.cluster_id, [{_DIST.format('cv.embedding', 'c.centroid')}, c.cluster_id]) from cent c) as cluster_id from cv) n
        on n.cluster_id = c.cluster_id group by c.cluster_id),
gap as (select cluster_id, case when max(approved) over () > 0 then 1 - approved / max(approved) over () else 1 end as coverage_gap from cnt),
scored as (select l.log_id, l.feature_name, n.cluster_id, ({DUCK_WEIGHT}) / 19 as failure_signal, n.novelty,
             case l.feature_name when 'meal_planner' then 0.5 when 'customer_support_bot' then 2.0 else 1.0 end as feature_impact,
             coalesce(g.coverage_gap, 1.0) as coverage_gap
           from fx_logs l join nov n on n.log_id = l.log_id left join gap g on g.cluster_id = n.cluster_id),
valued as (select *, failure_signal + novelty + feature_impact + coverage_gap as value_score from scored)"""
_FEATURE_WEIGHTS = {"meal_planner": 0.5, "customer_support_bot": 2.0}


def _approved_emb(s: Source):
    cases = s("fx_cases").filter("status = 'approved'").select("case_id", "vec_id")
    return cases.join(s("fx_emb").select("vec_id", "embedding"), "vec_id").select(
        F.col("case_id").alias("id"), F.col("embedding").alias("v")
    )


def scored(s: Source, logs: str = "fx_logs"):
    emb = s("fx_emb")
    centroids = vectors.cut(vectors.cluster_centroids(emb))
    counts = scoring.coverage_counts(_approved_emb(s), centroids)
    return scoring.score_candidates(s(logs), emb, counts, _FEATURE_WEIGHTS, centroids=centroids)


@query("novelty", f"{_DUCK_SCORED} select log_id, cluster_id, round(novelty, 6) as novelty from nov")
def _novelty(s: Source):
    return scoring.novelty(s("fx_emb")).withColumn("novelty", F.round("novelty", 6))


@query("failure_signal", f"select log_id, round(({DUCK_WEIGHT}) / 19, 6) as failure_signal from fx_logs")
def _failure_signal(s: Source):
    return s("fx_logs").select("log_id", F.round(rules.failure_weight() / rules.MAX_FAILURE_WEIGHT, 6).alias("failure_signal"))


@query("feature_impact", """
select log_id, case feature_name when 'meal_planner' then 0.5 when 'customer_support_bot' then 2.0 else 1.0 end :: double as feature_impact
from fx_logs""")
def _feature_impact(s: Source):
    return scoring.feature_impact(s("fx_logs"), _FEATURE_WEIGHTS).select("log_id", "feature_impact")


@query("coverage_counts", f"{_DUCK_SCORED} select cluster_id, approved from cnt")
def _coverage_counts(s: Source):
    return scoring.coverage_counts(_approved_emb(s), vectors.cut(vectors.cluster_centroids(s("fx_emb"))))


@query("coverage_gap", f"""{_DUCK_SCORED}
select log_id, round(coalesce(coverage_gap, 1.0), 6) as coverage_gap from fx_emb e left join gap g on g.cluster_id = e.cluster_id""")
def _coverage_gap(s: Source):
    emb = s("fx_emb")
    counts = scoring.coverage_counts(_approved_emb(s), vectors.cut(vectors.cluster_centroids(emb)))
    return scoring.coverage_gap(emb, counts).select("log_id", F.round("coverage_gap", 6).alias("coverage_gap"))


@query("score_candidates", f"""{_DUCK_SCORED}
select log_id, cluster_id, round(failure_signal, 6) as failure_signal, round(novelty, 6) as novelty, feature_impact :: double as feature_impact,
       round(coverage_gap, 6) as coverage_gap, round(value_score, 6) as value_score from valued""")
def _score_candidates(s: Source):
    rounded = ["failure_signal", "novelty", "coverage_gap", "value_score"]
    return scored(s).select("log_id", "cluster_id", "feature_impact", *[F.round(c, 6).alias(c) for c in rounded])


@query("scored_cluster_label", """
select log_id, case when cluster_id = -1 then 'noise' else 'cluster_' || cluster_id end as cluster_label from fx_emb""")
def _scored_cluster_label(s: Source):
    emb = s("fx_emb")
    return scoring.scored_cluster_label(emb, clusters.unnamed_clusters(emb)).select("log_id", "cluster_label")


@query("top_candidates", f"""{_DUCK_SCORED}
select v.log_id, v.feature_name, substr(r.prompt, 1, 150) as prompt_preview, cluster_id,
       case when cluster_id = -1 then 'noise' else 'cluster_' || cluster_id end as cluster_label,
       round(value_score, 3) as value_score, round(failure_signal, 3) as failure_signal, round(novelty, 3) as novelty
from valued v join fx_records r on r.log_id = v.log_id
order by v.value_score desc, v.log_id limit 30""")
def _top_candidates(s: Source):
    return scoring.top_candidates(scored(s), clusters.unnamed_clusters(s("fx_emb")), texts=s("fx_records"))


@query("candidate_quality_report", f"""{_DUCK_SCORED},
top as (select cluster_id, value_score from valued order by value_score desc, log_id limit 30),
sizes as (select cluster_id, count(*) as n from fx_emb group by cluster_id),
h as (select count(*) filter (cluster_id <> -1) as nc, sum(n) filter (cluster_id = -1) / sum(n) as noise,
        max(n) filter (cluster_id <> -1) / sum(n) filter (cluster_id <> -1) as share from sizes),
t as (select count(*) as n, count(distinct value_score) as u, count(*) filter (cluster_id = -1) as z from top),
r as (select 'clusters' as name, cast(nc as double) as value, case nc when 0 then 'fail' when 1 then 'warn' else 'ok' end as verdict from h
  union all select 'noise_ratio', noise, case when nc > 1 and noise > 0.3 then 'warn' else 'ok' end from h
  union all select 'largest_cluster_share', share, case when share > 0.45 then 'warn' else 'ok' end from h
  union all select 'placeholder_labels', 0, 'ok'
  union all select 'candidates', n, case when n = 0 then 'fail' else 'ok' end from t
  union all select 'unique_scores', u, case when u < n * 0.7 then 'warn' else 'ok' end from t
  union all select 'noise_in_top', z, case when z = 0 then 'note' when z = n then 'warn' else 'ok' end from t
  union all select 'missing_previews', 0, 'ok')
select name as "check", round(value, 6) as value, verdict from r""")
def _candidate_quality_report(s: Source):
    emb = s("fx_emb")
    logs = s("fx_logs")
    best = scored(s).orderBy(F.desc("value_score"), "log_id").limit(30)
    previews = (
        sampling.sample_random(logs, 10, 42).select(F.lit("random").alias("sampler"), "log_id")
        .unionByName(sampling.sample_failure_biased(logs, 10, 42).select(F.lit("failure_biased").alias("sampler"), "log_id"))
        .unionByName(_sample_diverse(s).select(F.lit("diversity").alias("sampler"), F.col("id").alias("log_id")))
    )
    report = quality.candidate_quality_report(emb, clusters.unnamed_clusters(emb), best, previews)
    return report.withColumn("value", F.round("value", 6))
