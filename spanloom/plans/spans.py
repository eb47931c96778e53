"""Queries over spans: joins, set algebra, clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.functions import intervals as I
from spanloom.operators import spans as S
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def pairs(spark, d):
    a = T.candidates(spark, d, "click").select("media_id", F.col("candidate_id").alias("a_id"), F.col("in_ms").alias("a_in"), F.col("out_ms").alias("a_out"), F.col("rank").alias("a_rank"))
    b = T.candidates(spark, d, "view").select("media_id", F.col("candidate_id").alias("b_id"), F.col("in_ms").alias("b_in"), F.col("out_ms").alias("b_out"), F.col("rank").alias("b_rank"))
    return S.overlap_join(a, b, "media_id", ("a_in", "a_out"), ("b_in", "b_out"))


PAIRS = """, p as (select a.media_id, a.candidate_id as a_id, b.candidate_id as b_id, a.in_ms as a_in, a.out_ms as a_out, b.in_ms as b_in, b.out_ms as b_out, a.rank as a_rank, b.rank as b_rank,
 least(a.out_ms, b.out_ms) - greatest(a.in_ms, b.in_ms) as both_ms
 from verbal a join visual b on a.media_id = b.media_id and a.in_ms < b.out_ms and b.in_ms < a.out_ms)"""


@query("q3_1_temporal_iou", with_tables("verbal visual", PAIRS + " select media_id, a_id, b_id, round(both_ms / cast(a_out - a_in + b_out - b_in - both_ms as double), 6) as iou from p"))
def temporal_iou(spark, d):
    return pairs(spark, d).select("media_id", "a_id", "b_id", F.round(I.iou("a_in", "a_out", "b_in", "b_out"), 6).alias("iou"))


@query("q3_9_overlaps", with_tables("verbal visual", PAIRS + " select media_id, a_id, count(*) as n_overlapping, cast(sum(both_ms) as bigint) as shared_ms from p group by media_id, a_id"))
def overlapping(spark, d):
    return pairs(spark, d).groupBy("media_id", "a_id").agg(F.count("*").alias("n_overlapping"), F.sum(I.shared_ms("a_in", "a_out", "b_in", "b_out")).alias("shared_ms"))


def kind(spark, d, event_type):
    return T.spans(spark, d).where(F.col("event_type") == event_type).select("media_id", "event_id", F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"))


MERGED = """, m0 as (select *, max(out_ms) over (partition by media_id, event_type order by in_ms, out_ms rows between unbounded preceding and 1 preceding) as before from spans),
 m1 as (select *, sum(case when before is null or in_ms > before then 1 else 0 end) over (partition by media_id, event_type order by in_ms, out_ms rows unbounded preceding) as isl from m0),
 merged as (select media_id, event_type, min(in_ms) as start_ms, max(out_ms) as end_ms from m1 group by media_id, event_type, isl)"""


@query("q5_6_merge_intervals", with_tables("spans", MERGED + " select media_id, event_type, start_ms, end_ms from merged"))
def merge_intervals(spark, d):
    own = T.spans(spark, d).select("media_id", "event_type", F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"))
    return S.merge(own, ["media_id", "event_type"])


@query(
    "q5_7_subtract_intervals",
    with_tables(
        "spans",
        MERGED
        + """, b as (select * from merged where event_type = 'click'), s as (select * from merged where event_type = 'signup'),
 edge as (select b.media_id, b.start_ms as bs, b.end_ms as be, greatest(s.start_ms, b.start_ms) as cs, least(s.end_ms, b.end_ms) as ce from b join s on b.media_id = s.media_id and b.start_ms < s.end_ms and s.start_ms < b.end_ms),
 marks as (select media_id, bs, be, bs as z, bs as cs from edge union all select media_id, bs, be, ce as z, cs from edge union all select media_id, start_ms, end_ms, start_ms, start_ms from b),
 cuts as (select distinct media_id, bs, be, z from marks),
 gaps as (select c.media_id, c.z as a, coalesce(min(e.cs), c.be) as e from cuts c left join edge e on e.media_id = c.media_id and e.bs = c.bs and e.cs >= c.z
   where not exists (select 1 from edge x where x.media_id = c.media_id and x.bs = c.bs and x.cs <= c.z and c.z < x.ce) group by c.media_id, c.bs, c.be, c.z),
 kept as (select media_id, a, e from gaps where e - a >= 50),
 k0 as (select *, lag(e) over (partition by media_id order by a) as pe from kept),
 k1 as (select *, sum(case when pe is null or a > pe then 1 else 0 end) over (partition by media_id order by a rows unbounded preceding) as isl from k0)
 select media_id, min(a) as start_ms, max(e) as end_ms from k1 group by media_id, isl""",
    ),
)
def subtract_intervals(spark, d):
    return S.subtract(kind(spark, d, "click"), kind(spark, d, "signup"), "media_id")


@query(
    "q5_34_unseen_intervals",
    with_tables(
        "spans",
        MERGED
        + """, l as (select media_id, max(out_ms) as hi from spans group by media_id),
 x as (select * from merged where event_type = 'view'),
 e as (select media_id, start_ms, end_ms from x union all select media_id, 0, 0 from l),
 n as (select e.media_id, e.end_ms as start_ms, coalesce(lead(e.start_ms) over (partition by e.media_id order by e.start_ms, e.end_ms), l.hi) as end_ms from e join l on l.media_id = e.media_id)
 select media_id, start_ms, end_ms from n where end_ms > start_ms""",
    ),
)
def unseen(spark, d):
    bounds = T.spans(spark, d).groupBy("media_id").agg(F.max("out_ms").alias("hi_ms")).withColumn("lo_ms", F.lit(0).cast("long"))
    return S.complement(kind(spark, d, "view").drop("event_id"), bounds, "media_id")


RETAINED = MERGED + """, r0 as (select media_id, start_ms, end_ms, coalesce(sum(end_ms - start_ms) over (partition by media_id order by start_ms rows between unbounded preceding and 1 preceding), 0) as out_at from merged where event_type = 'view'),
 pts as (select event_id, media_id, in_ms as at_ms from spans where event_type = 'click'),
 lastr as (select p.event_id, p.media_id, p.at_ms, r.start_ms, r.end_ms, r.out_at, row_number() over (partition by p.event_id order by r.start_ms desc nulls last) as k
   from pts p left join r0 r on r.media_id = p.media_id and r.start_ms <= p.at_ms)"""


def _points(spark, d):
    return kind(spark, d, "click").select("event_id", "media_id", F.col("start_ms").alias("at_ms"))


def _retained(spark, d):
    return S.merge(kind(spark, d, "view"), ["media_id"])


@query("q5_12_remap_timestamp", with_tables("spans", RETAINED + " select event_id, media_id, at_ms, cast(case when start_ms is null then 0 else out_at + least(at_ms, end_ms) - start_ms end as bigint) as output_ms from lastr where k = 1"))
def remap(spark, d):
    return S.to_output(_points(spark, d), _retained(spark, d), "media_id", "at_ms").select("event_id", "media_id", "at_ms", "output_ms")


@query("q5_16_source_to_output", with_tables("spans", RETAINED + " select event_id, media_id, at_ms, cast(case when at_ms < end_ms then out_at + at_ms - start_ms end as bigint) as output_ms from lastr where k = 1"))
def source_to_output(spark, d):
    return S.to_output(_points(spark, d), _retained(spark, d), "media_id", "at_ms", clamp=False).select("event_id", "media_id", "at_ms", "output_ms")


@query(
    "q5_17_output_to_source",
    with_tables(
        "spans",
        RETAINED
        + """, o as (select event_id, p.media_id, at_ms, r.start_ms, r.end_ms, r.out_at, row_number() over (partition by event_id order by r.out_at desc nulls last) as k from pts p left join r0 r on r.media_id = p.media_id and r.out_at <= p.at_ms)
 select event_id, media_id, at_ms, cast(least(start_ms + at_ms - out_at, end_ms) as bigint) as source_ms from o where k = 1""",
    ),
)
def output_to_source(spark, d):
    return S.to_source(_points(spark, d), _retained(spark, d), "media_id", "at_ms").select("event_id", "media_id", "at_ms", "source_ms")


@query("q5_20_assemble_spans", with_tables("spans", ", g as (select *, row_number() over (partition by media_id order by in_ms, event_id) as k from spans) select event_id, media_id, cast(coalesce(sum(out_ms - in_ms) over (partition by media_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ms from g"))
def assemble(spark, d):
    return S.end_to_end(T.spans(spark, d), "media_id", "in_ms", "out_ms", "event_id").select("event_id", "media_id", "offset_ms")


@query(
    "q3_13_boundary_reconciliation",
    with_tables(
        "spans",
        """, b as (select media_id, event_id, in_ms as at_ms from spans where event_type = 'view' union all select media_id, event_id, out_ms from spans where event_type = 'view'),
 w as (select media_id, in_ms as m from spans where event_type = 'click' union all select media_id, out_ms from spans where event_type = 'click'),
 dd as (select b.media_id, b.event_id, b.at_ms, min(abs(b.at_ms - w.m)) as dist from b join w on b.media_id = w.media_id group by 1, 2, 3)
 select media_id, count(*) as n, round(avg(dist), 6) as mae_ms, round(avg(case when dist <= 120 then 1.0 else 0.0 end), 6) as share_within from dd group by media_id""",
    ),
)
def boundary_reconciliation(spark, d):
    ends = lambda df: df.select("media_id", "event_id", F.explode(F.array("start_ms", "end_ms")).alias("at_ms"))
    got = S.nearest(ends(kind(spark, d, "view")), ends(kind(spark, d, "click")).withColumnRenamed("at_ms", "mark_ms"), "media_id", "at_ms", "mark_ms")
    got = got.where("distance_ms is not null")
    return got.groupBy("media_id").agg(F.count("*").alias("n"), F.round(F.avg("distance_ms"), 6).alias("mae_ms"), F.round(F.avg((F.col("distance_ms") <= 120).cast("double")), 6).alias("share_within"))


@query("q3_10_shot_at", with_tables("spans", MERGED + " select c.event_id, c.media_id, m.start_ms as shot_start_ms, m.end_ms as shot_end_ms from spans c left join merged m on m.event_type = 'view' and m.media_id = c.media_id and m.start_ms <= c.in_ms and c.in_ms < m.end_ms where c.event_type = 'click'"))
def shot_at(spark, d):
    points = _points(spark, d)
    found = S.point_join(points, _retained(spark, d), "media_id", "at_ms", ("start_ms", "end_ms"))
    return points.select("event_id", "media_id").join(found.select("event_id", F.col("start_ms").alias("shot_start_ms"), F.col("end_ms").alias("shot_end_ms")), "event_id", "left")


@query(
    "q3_4_turn_bounds",
    with_tables(
        "spans",
        """ select c.event_id, c.media_id, (select min(v.in_ms) from spans v where v.event_type = 'view' and v.media_id = c.media_id and v.in_ms <= c.in_ms and c.in_ms < v.out_ms) as turn_start_ms,
 (select max(v.out_ms) from spans v where v.event_type = 'view' and v.media_id = c.media_id and v.in_ms < c.out_ms and c.out_ms <= v.out_ms) as turn_end_ms from spans c where c.event_type = 'click'""",
    ),
)
def turn_bounds(spark, d):
    anchors, views = kind(spark, d, "click").select("event_id", "media_id", F.col("start_ms").alias("a_in"), F.col("end_ms").alias("a_out")), kind(spark, d, "view").drop("event_id")
    first = S.point_join(anchors, views, "media_id", "a_in", ("start_ms", "end_ms")).groupBy("event_id").agg(F.min("start_ms").alias("turn_start_ms"))
    last = S.point_join(anchors, views, "media_id", "a_out", ("start_ms", "end_ms"), closed_end=True).groupBy("event_id").agg(F.max("end_ms").alias("turn_end_ms"))
    return anchors.select("event_id", "media_id").join(first, "event_id", "left").join(last, "event_id", "left")


@query(
    "q3_5_vad_onset",
    with_tables(
        "spans",
        """ select c.event_id, coalesce(max(case when v.in_ms <= c.in_ms and c.in_ms < v.out_ms then v.in_ms end), min(v.in_ms)) as onset_ms
 from spans c left join spans v on v.event_type = 'view' and v.media_id = c.media_id and v.in_ms < c.out_ms and c.in_ms < v.out_ms where c.event_type = 'click' group by c.event_id""",
    ),
)
def vad_onset(spark, d):
    anchors = kind(spark, d, "click").select("event_id", "media_id", F.col("start_ms").alias("a_in"), F.col("end_ms").alias("a_out"))
    met = S.overlap_join(anchors, kind(spark, d, "view").drop("event_id"), "media_id", ("a_in", "a_out"), ("start_ms", "end_ms"))
    onset = met.groupBy("event_id").agg(F.coalesce(F.max(F.when(F.col("start_ms") <= F.col("a_in"), F.col("start_ms"))), F.min("start_ms")).alias("onset_ms"))
    return anchors.select("event_id").join(onset, "event_id", "left")


@query(
    "q3_7_interval_for_fusion",
    with_tables(
        "spans",
        """, r as (select c.event_id, v.event_id as interval_id, v.out_ms as interval_end_ms, row_number() over (partition by c.event_id order by v.out_ms desc, v.in_ms, v.event_id) as k
 from spans c join spans v on v.event_type = 'view' and v.media_id = c.media_id and v.in_ms < c.out_ms and c.in_ms < v.out_ms and v.out_ms > c.out_ms where c.event_type = 'click')
 select event_id, interval_id, interval_end_ms from r where k = 1""",
    ),
)
def interval_for_fusion(spark, d):
    anchors = kind(spark, d, "click").select("event_id", "media_id", F.col("start_ms").alias("a_in"), F.col("end_ms").alias("a_out"))
    views = kind(spark, d, "view").withColumnRenamed("event_id", "interval_id")
    met = S.overlap_join(anchors, views, "media_id", ("a_in", "a_out"), ("start_ms", "end_ms")).where("end_ms > a_out")
    best = F.min_by(F.struct("interval_id", "end_ms"), F.struct(-F.col("end_ms"), F.col("start_ms"), F.col("interval_id")))
    return met.groupBy("event_id").agg(best.alias("b")).select("event_id", "b.interval_id", F.col("b.end_ms").alias("interval_end_ms"))


@query("q3_25_uncovered_intervals", with_tables("spans", " select media_id, event_id from spans s where event_type = 'signup' and not exists (select 1 from spans c where c.event_type = 'click' and c.media_id = s.media_id and c.in_ms < s.out_ms and s.in_ms < c.out_ms)"))
def uncovered(spark, d):
    own, cover = kind(spark, d, "signup"), kind(spark, d, "click").select("media_id", F.col("start_ms").alias("c_in"), F.col("end_ms").alias("c_out"))
    met = S.overlap_join(own, cover, "media_id", ("start_ms", "end_ms"), ("c_in", "c_out")).select("event_id").distinct()
    return own.join(met, "event_id", "left_anti").select("media_id", "event_id")


@query("q3_11_covered_events", with_tables("spans", " select distinct media_id, event_id from spans s where event_type = 'click' and exists (select 1 from spans e where e.event_type = 'error' and e.media_id = s.media_id and e.in_ms between s.in_ms and s.out_ms)"))
def covered(spark, d):
    cuts = kind(spark, d, "error").select("media_id", F.col("start_ms").alias("at_ms"))
    closed = kind(spark, d, "click").withColumn("end_ms", F.col("end_ms") + 1)
    return S.point_join(cuts, closed, "media_id", "at_ms", ("start_ms", "end_ms")).select("media_id", "event_id").distinct()


@query("q4_45_visual_variety", with_tables("spans", " select c.event_id, round(count(e.event_id) * 1000.0 / (c.out_ms - c.in_ms), 9) as cuts_per_second from spans c left join spans e on e.event_type = 'error' and e.media_id = c.media_id and e.in_ms > c.in_ms and e.in_ms < c.out_ms where c.event_type = 'click' group by c.event_id, c.in_ms, c.out_ms"))
def visual_variety(spark, d):
    own = kind(spark, d, "click")
    cuts = kind(spark, d, "error").select("media_id", F.col("start_ms").alias("at_ms"))
    n = S.point_join(cuts, own, "media_id", "at_ms", ("start_ms", "end_ms")).where("at_ms > start_ms").groupBy("event_id").agg(F.count("*").alias("n"))
    return own.join(n, "event_id", "left").select("event_id", F.round(F.coalesce("n", F.lit(0)) * 1000.0 / (F.col("end_ms") - F.col("start_ms")), 9).alias("cuts_per_second"))


@query("q7_1_effective_cuts", with_tables("spans", " select distinct media_id, in_ms as cut_ms from spans where event_type in ('error', 'view') union select media_id, out_ms from spans where event_type = 'error'"))
def effective_cuts(spark, d):
    a, b = kind(spark, d, "error"), kind(spark, d, "view")
    return S.all_cuts("media_id", a.withColumnRenamed("start_ms", "cut_ms"), b.withColumnRenamed("start_ms", "cut_ms"), a.withColumnRenamed("end_ms", "cut_ms"))


@query("q5_25_pauses_between", with_tables("spans", MERGED + " select * from (select media_id, end_ms as pause_start_ms, lead(start_ms) over (partition by media_id order by start_ms) as pause_end_ms from merged where event_type = 'view') where pause_end_ms is not null"))
def pauses_between(spark, d):
    return S.between(_retained(spark, d), "media_id")


@query("q2_26_clip_to_media", with_tables("spans", " select event_id, greatest(in_ms, 100000) as start_ms, least(out_ms, 2000000) as end_ms from spans where least(out_ms, 2000000) > greatest(in_ms, 100000)"))
def clip_to_media(spark, d):
    own = T.spans(spark, d).select("event_id", F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"))
    return S.within_media(own, "start_ms", "end_ms", 100000, 2000000)


@query("q5_5_assert_exclusive", with_tables("spans", " select media_id, event_id, before as overlaps_end_ms from (select *, max(out_ms) over (partition by media_id order by in_ms, event_id rows between unbounded preceding and 1 preceding) as before from spans) where before > in_ms"))
def exclusive(spark, d):
    return S.not_exclusive(T.spans(spark, d), "media_id", "in_ms", "out_ms", "event_id").select("media_id", "event_id", "overlaps_end_ms")


@query("q5_10_cut_points", with_tables("spans", MERGED + " select media_id, cut_ms from (select media_id, cast(sum(end_ms - start_ms) over (partition by media_id order by start_ms rows unbounded preceding) as bigint) as cut_ms, row_number() over (partition by media_id order by start_ms desc) as k from merged where event_type = 'view') where k > 1"))
def cut_points(spark, d):
    return S.clock(_retained(spark, d), "media_id").where("out_ms > 0").select("media_id", F.col("out_ms").alias("cut_ms"))


@query("q5_11_effective_duration", with_tables("spans", MERGED + ", r as (select media_id, sum(end_ms - start_ms) as removed from merged where event_type = 'signup' group by media_id) select l.media_id, cast(l.hi - l.lo - coalesce(r.removed, 0) as bigint) as effective_ms from (select media_id, min(in_ms) as lo, max(out_ms) as hi from spans group by media_id) l left join r on r.media_id = l.media_id"))
def effective_duration(spark, d):
    whole = T.spans(spark, d).groupBy("media_id").agg(F.min("in_ms").alias("lo"), F.max("out_ms").alias("hi"))
    removed = S.merge(kind(spark, d, "signup"), ["media_id"]).groupBy("media_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("removed"))
    return whole.join(removed, "media_id", "left").select("media_id", (F.col("hi") - F.col("lo") - F.coalesce("removed", F.lit(0))).alias("effective_ms"))
