"""Queries over rendered sequences: what was seen of them, which claims hold, what may be rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.operators import critique as C
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("q5_32_inspect_sequences", with_tables("spans", """, sq as (select media_id, max(out_ms) as duration_ms, bool_or(event_type = 'signup' and value > 10) as has_context, count(*) filter (where event_type = 'click') >= count(*) filter (where event_type = 'view') as claim from spans group by 1),
 ed as (select media_id, pt, sum(d) as d from (select media_id, in_ms as pt, 1 as d from spans where value > 1 union all select media_id, out_ms + 80000, -1 from spans where value > 1) group by 1, 2),
 sw as (select media_id, lead(pt) over w - pt as ms, sum(d) over w as depth from ed window w as (partition by media_id order by pt)),
 cv as (select media_id, cast(coalesce(sum(ms) filter (where depth = 1), 0) as bigint) as once_ms, cast(coalesce(sum(ms) filter (where depth > 1), 0) as bigint) as more_ms from sw group by 1),
 df as (select media_id, count(*) as n_windows, count(*) filter (where value > 1) as n_observed, count(*) filter (where value > 400 or floor(value * 30) < 2) + count(*) filter (where event_type = 'purchase' and value > 300) as crit, count(*) filter (where event_type = 'purchase' and value > 200 and value <= 300) as n_warning from spans group by 1),
 al as (select *, crit + case when has_context then 0 else 1 end as n_critical, least(1.0, (coalesce(once_ms, 0) + coalesce(more_ms, 0)) / cast(greatest(duration_ms, 1) as double)) as coverage from sq join df using (media_id) left join cv using (media_id))
 select media_id, coalesce(once_ms, 0) as once_ms, coalesce(more_ms, 0) as more_ms, n_windows, n_observed, round(coverage, 9) as coverage, n_critical, n_warning, n_critical + n_warning = 0 and coverage >= 0.95 and has_context as all_clear,
   claim and not (n_critical + n_warning = 0 and coverage >= 0.95 and has_context) as refused,
   case when claim then concat_ws(';', case when n_critical > 0 then n_critical || ' critical defect(s)' when n_warning > 0 then n_warning || ' warning defect(s)' end, case when coverage < 0.95 then 'incomplete temporal coverage (' || cast(round(coverage * 100, 1) as varchar) || '%)' end, case when not has_context then 'missing aligned source context' end) else '' end as reasons from al"""))
def inspect_sequences(spark, d):
    """Every recording's events as critique windows of it: depth of coverage, defects, and all-clear claims that are refused."""
    s = T.spans(spark, d)
    kind = lambda k: F.count_if(F.col("event_type") == k)
    sequences = s.groupBy("media_id").agg(F.max("out_ms").alias("duration_ms"), F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 10)).alias("has_context"), (kind("click") >= kind("view")).alias("claim"))
    windows = s.select("media_id", F.col("in_ms").alias("start_ms"), (F.col("out_ms") + 80_000).alias("end_ms"), (F.col("value") > 1).alias("observed"), F.floor(F.col("value") * 30).alias("frames"), (F.col("value") <= 400).alias("motion"))
    observations = s.where("event_type = 'purchase' and value > 200").select("media_id", F.when(F.col("value") > 300, "critical").otherwise("warning").alias("severity"))
    out = C.inspect_sequences(sequences, windows, observations, "media_id")
    return out.select("media_id", "once_ms", "more_ms", "n_windows", "n_observed", F.round("coverage", 9).alias("coverage"), "n_critical", "n_warning", "all_clear", "refused", F.array_join("reasons", ";").alias("reasons"))


@query("q2_30_propose_render", with_tables("spans", """, rv as (select media_id as run, case when value > 200 then '../r' else 'r' end || event_id as revision_id, case event_type when 'click' then 'boundary' when 'purchase' then 'caption' when 'signup' then '' when 'error' then case when value > 60 then 'colour' else 'boundary' end end as kind, case when value < 5 then 'rendered' else 'approved_pending_render' end as status, in_ms, out_ms, value from spans),
 rp as (select media_id as run, count(*) filter (where event_type = 'click') > 5 as has_clip, count(*) filter (where event_type = 'view') as n_sentences, count(*) filter (where event_type = 'purchase') % 2 = 0 as has_output, (min(in_ms) + max(in_ms)) // 2 as anchor_in, (min(in_ms) + max(in_ms)) // 2 + 5000 as anchor_out, bool_or(event_type = 'signup' and value > 100) as complete from spans group by 1 having count(*) filter (where value > 100) > 2),
 ak as (select run, revision_id from rv union all select run, 'gone' || revision_id from rv where value between 100 and 110),
 jn as (select ak.run, ak.revision_id, rv.run is not null as rev, case when rv.run is not null then coalesce(kind, 'boundary') end as kind, status, in_ms, out_ms, rp.run is not null as rep, has_clip, n_sentences, has_output, anchor_in, anchor_out, complete from ak left join rv on rv.run = ak.run and rv.revision_id = ak.revision_id left join rp on rp.run = ak.run),
 vi as (select *, case when contains(revision_id, '/') then 'unsafe revision id' when not rev then 'no revision record' when kind not in ('boundary', 'caption') then 'unknown revision kind' when status <> 'approved_pending_render' then 'not approved, or rendered already' when not rep then 'no report' when not has_clip then 'no clip' when n_sentences = 0 then 'no selected sentences'
   when kind = 'caption' and not has_output then 'no output block' when kind = 'boundary' and not complete then 'sentence not complete' when kind = 'boundary' and in_ms > anchor_in then 'starts mid-sentence' when kind = 'boundary' and out_ms < anchor_out then 'ends mid-sentence' end as violation from jn)
 select run, revision_id, case when not contains(revision_id, '/') then kind end as kind, violation is null as valid, violation from vi"""))
def propose_render(spark, d):
    """Revisions asked for, some under names that lead out of their folder and some that nobody made."""
    s, kind = T.spans(spark, d), F.col("event_type")
    named = F.concat(F.when(F.col("value") > 200, "../r").otherwise("r"), F.col("event_id").cast("string"))
    of = F.when(kind == "click", "boundary").when(kind == "purchase", "caption").when(kind == "signup", "").when(kind == "error", F.when(F.col("value") > 60, "colour").otherwise("boundary"))
    revisions = s.select(F.col("media_id").alias("run"), named.alias("revision_id"), of.alias("kind"), F.when(F.col("value") < 5, "rendered").otherwise(C.APPROVED).alias("status"), "in_ms", "out_ms", "value")
    middle = F.expr("(min(in_ms) + max(in_ms)) div 2")
    count = lambda k: F.count_if(kind == k)
    reports = s.groupBy(F.col("media_id").alias("run")).agg((count("click") > 5).alias("has_clip"), count("view").alias("n_sentences"), (count("purchase") % 2 == 0).alias("has_output"), middle.alias("anchor_in"), (middle + 5000).alias("anchor_out"), F.bool_or((kind == "signup") & (F.col("value") > 100)).alias("complete"), F.count_if(F.col("value") > 100).alias("_n")).where("_n > 2")
    gone = revisions.where("value between 100 and 110").select("run", F.concat(F.lit("gone"), "revision_id").alias("revision_id"))
    return C.propose_render(revisions.select("run", "revision_id").unionByName(gone), revisions, reports)
