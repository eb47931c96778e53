"""Queries over time lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.operators import scorecards as Y
from spanloom.operators import sentences as S
from spanloom.operators import spans as P
from spanloom.operators import timeline as L
from spanloom.plans.text import SENTENCES, sentences
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def media(spark, d):
    return T.spans(spark, d).groupBy("media_id").agg(F.max("out_ms").alias("duration_ms"))


def cuts(spark, d):
    return T.spans(spark, d).where("event_type = 'error'").select("media_id", F.col("in_ms").alias("cut_ms"))


def kind(spark, d, name):
    return T.spans(spark, d).where(F.col("event_type") == name).select("media_id", F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"))


MEDIA = ", media as (select media_id, max(out_ms) as duration_ms from spans group by 1), cuts as (select media_id, in_ms as cut_ms from spans where event_type = 'error')"
BOUNDARY = MEDIA + """, sig as (select c.event_id, c.media_id, c.in_ms as a_in, c.out_ms as a_out, m.duration_ms,
  (select max(v.in_ms) from spans v where v.event_type = 'view' and v.media_id = c.media_id and v.in_ms <= c.in_ms and c.in_ms < v.out_ms) as vad,
  (select max(v.out_ms) from spans v where v.event_type = 'view' and v.media_id = c.media_id and v.in_ms <= c.out_ms and c.out_ms < v.out_ms) as silence,
  (select min(k.cut_ms) from cuts k where k.media_id = c.media_id and k.cut_ms <= c.in_ms and c.in_ms - k.cut_ms <= 400) as cb,
  (select max(k.cut_ms) from cuts k where k.media_id = c.media_id and k.cut_ms >= c.out_ms and k.cut_ms - c.out_ms <= 400) as ca
  from spans c join media m on m.media_id = c.media_id where c.event_type = 'click'),
 fused as (select *, greatest(0, least(a_in, vad - 120, cb)) as final_in, least(duration_ms, greatest(a_out + 200, silence, ca)) as final_out,
  case when a_in <= coalesce(vad - 120, a_in) and a_in <= coalesce(cb, a_in) then null when vad - 120 <= coalesce(cb, vad) then 'vad_onset' else 'shot_cut' end as in_by,
  case when a_out + 200 >= coalesce(silence, a_out) and a_out + 200 >= coalesce(ca, a_out) then 'tail' when silence >= coalesce(ca, silence) then 'natural_silence' else 'shot_cut' end as out_by from sig)"""


def boundaries(spark, d):
    a = T.spans(spark, d).where("event_type = 'click'").select("event_id", "media_id", F.col("in_ms").alias("a_in"), F.col("out_ms").alias("a_out"))
    v = kind(spark, d, "view")
    vad = P.point_join(a, v, "media_id", "a_in", ("start_ms", "end_ms")).groupBy("event_id").agg(F.max("start_ms").alias("vad"))
    silence = P.point_join(a, v, "media_id", "a_out", ("start_ms", "end_ms")).groupBy("event_id").agg(F.max("end_ms").alias("silence"))
    near = a.withColumn("lo", F.col("a_in") - L.CUT_REACH).withColumn("hi", F.col("a_in") + 1).withColumn("lo2", F.col("a_out")).withColumn("hi2", F.col("a_out") + L.CUT_REACH + 1)
    before = P.point_join(cuts(spark, d), near, "media_id", "cut_ms", ("lo", "hi")).groupBy("event_id").agg(F.min("cut_ms").alias("cb"))
    after = P.point_join(cuts(spark, d), near, "media_id", "cut_ms", ("lo2", "hi2")).groupBy("event_id").agg(F.max("cut_ms").alias("ca"))
    rows = a.join(media(spark, d), "media_id")
    for x in (vad, silence, before, after):
        rows = rows.join(x, "event_id", "left")
    return rows.withColumn("b", L.fuse_boundary("a_in", "a_out", "duration_ms", vad="vad", cut_before="cb", silence="silence", cut_after="ca"))


@query("q5_22_fuse_boundary", with_tables("spans", BOUNDARY + " select event_id, final_in, in_by, final_out, out_by from fused"))
def fuse_boundary(spark, d):
    return boundaries(spark, d).select("event_id", "b.*")


@query("q5_23_boundary_invariant", with_tables("spans", BOUNDARY + " select event_id, final_in <= a_in and final_out >= a_out as holds from fused"))
def invariant(spark, d):
    return boundaries(spark, d).select("event_id", ((F.col("b.final_in") <= F.col("a_in")) & (F.col("b.final_out") >= F.col("a_out"))).alias("holds"))


SCENES = MEDIA + """, e as (select media_id, 0 as start_ms from media union select c.media_id, cut_ms from cuts c join media m on m.media_id = c.media_id where cut_ms > 0 and cut_ms < duration_ms),
 sc as (select e.media_id, row_number() over (partition by e.media_id order by start_ms) - 1 as scene, start_ms, coalesce(lead(start_ms) over (partition by e.media_id order by start_ms), duration_ms) as end_ms from e join media m on m.media_id = e.media_id),
 pt as (select *, cast(ceil((end_ms - start_ms) / 64000.0) as bigint) as parts from sc), w0 as (select *, unnest(range(parts)) as win, (end_ms - start_ms) // parts as base, (end_ms - start_ms) % parts as extra from pt),
 win as (select media_id, scene, win as "window", start_ms + win * base + least(win, extra) as in_ms, start_ms + win * base + least(win, extra) + base + case when win < extra then 1 else 0 end as out_ms from w0)"""


@query("q5_29_scene_windows", with_tables("spans", SCENES + ' select media_id, scene, "window", in_ms, out_ms, cast(ceil((out_ms - in_ms) / 1000.0) as bigint) as frames from win'))
def scene_windows(spark, d):
    return L.scene_windows(L.scenes(cuts(spark, d), media(spark, d)))


@query("q5_30_window_coverage", with_tables("spans", SCENES + " select m.media_id, count(*) as n, min(in_ms) = 0 and max(out_ms) = max(duration_ms) and sum(out_ms - in_ms) = max(duration_ms) as tiles from win join media m on m.media_id = win.media_id group by 1"))
def window_coverage(spark, d):
    w = L.scene_windows(L.scenes(cuts(spark, d), media(spark, d))).withColumn("b", F.lag("out_ms").over(Window.partitionBy("media_id").orderBy("in_ms")))
    got = w.join(media(spark, d), "media_id").groupBy("media_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("b"), F.lit(0)) == F.col("in_ms")).alias("c"), F.max("out_ms").alias("hi"), F.max("duration_ms").alias("dur"))
    return got.select("media_id", "n", (F.col("c") & (F.col("hi") == F.col("dur"))).alias("tiles"))


@query("q2_6_scene_window_contract", with_tables("spans", SCENES + " select count(*) as n, count(*) filter (where cast(ceil((out_ms - in_ms) / 1000.0) as bigint) > 64) as n_bad from win"))
def window_contract(spark, d):
    return L.scene_windows(L.scenes(cuts(spark, d), media(spark, d))).agg(F.count("*").alias("n"), F.count_if(F.col("frames") > L.FRAMES_IN_WINDOW).alias("n_bad"))


@query("q5_31_critique_windows", with_tables("spans", MEDIA + """, k as (select media_id, 0 as place, 'opening_hook' as kind, 0 as s, least(duration_ms, 3000) as e, duration_ms as d from media
 union all select media_id, 1, 'hook_dense_start', 0, 1500, duration_ms from media where duration_ms > 1500 union all select media_id, 2, 'hook_dense_mid', 1200, least(duration_ms, 3000), duration_ms from media where duration_ms > 1500
 union all select c.media_id, 3, 'transition', greatest(0, cut_ms - 500), cut_ms + 500, duration_ms from cuts c join media m on m.media_id = c.media_id where cut_ms > 0 and cut_ms < duration_ms
 union all select media_id, 4, 'landing_beat', greatest(0, duration_ms - 3000), duration_ms, duration_ms from media union all select media_id, 5, 'landing_beat_dense', duration_ms - 1500, duration_ms, duration_ms from media where duration_ms > 3000
 union all select media_id, 6, 'body', pt, pt + 2000, duration_ms from (select media_id, duration_ms, unnest(range(cast(greatest(0, ceil((duration_ms - 2000) / 1500.0)) as bigint) + 1)) * 1500 as pt from media)),
 f as (select media_id, place, kind, greatest(0, least(s, d - 1)) as start_ms, greatest(greatest(0, least(s, d - 1)) + 100, least(e, d)) as end_ms from k)
 select media_id, start_ms, end_ms, arg_min(kind, place) as kind from f group by 1, 2, 3"""))
def critique(spark, d):
    return L.critique_windows(media(spark, d), cuts(spark, d))


WORDMEDIA = ", wm as (select media_id, max(end_ms) as duration_ms from words group by 1), rem as (select media_id, b + 150 as start_ms, start_ms as end_ms from (select media_id, start_ms, lag(end_ms) over (partition by media_id order by pos) as b from words) where start_ms - b > 600)"


def word_media(spark, d):
    return T.words(spark, d).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms"))


@query("q5_9_silence_plan", with_tables("words", WORDMEDIA + " select m.media_id, count(r.start_ms) as n_removed, cast(coalesce(sum(r.end_ms - r.start_ms), 0) as bigint) as removed_ms, max(duration_ms) - cast(coalesce(sum(r.end_ms - r.start_ms), 0) as bigint) as retained_ms from wm m left join rem r on r.media_id = m.media_id group by 1"))
def silence_plan(spark, d):
    return L.silence_totals(T.words(spark, d))


REMAP = WORDMEDIA + ", mv as (select w.media_id, w.pos, w.start_ms - coalesce((select sum(r.end_ms - r.start_ms) from rem r where r.media_id = w.media_id and r.end_ms <= w.start_ms), 0) as s, w.end_ms - w.start_ms as ms from words w)"


@query("q5_13_tighten_silence", with_tables("words", WORDMEDIA + ", r1 as (select w.media_id, w.pos, w.start_ms - coalesce(sum(case when b is not null and start_ms - b > 600 then start_ms - b - 150 else 0 end) over (partition by media_id order by pos rows unbounded preceding), 0) as new_start_ms, end_ms - start_ms as ms from (select *, lag(end_ms) over (partition by media_id order by pos) as b from words) w) select media_id, pos, cast(new_start_ms as bigint) as new_start_ms, cast(new_start_ms + ms as bigint) as new_end_ms from r1"))
def tighten(spark, d):
    return L.tightened(T.words(spark, d)).select("media_id", "pos", "new_start_ms", "new_end_ms")


@query("q5_14_tighten_sentences", with_tables("words", SENTENCES + """, g as (select *, lag(end_ms) over (partition by media_id order by pos) as b from w2), sh as (select media_id, sid, sum(case when b is not null and start_ms - b > 600 then start_ms - b - 150 else 0 end) over (partition by media_id order by pos rows unbounded preceding) as cut, start_ms, end_ms, pos from g)
 select media_id, cast(sid as bigint) as sent_id, cast(min(start_ms - cut) as bigint) as start_ms, cast(max(end_ms - cut) as bigint) as end_ms from sh group by 1, 2"""))
def tighten_sentences(spark, d):
    moved = L.tightened(S.numbered(T.words(spark, d)))
    return moved.groupBy("media_id", "sent_id").agg(F.min("new_start_ms").alias("start_ms"), F.max("new_end_ms").alias("end_ms"))


@query("q5_8_filler_words")
def fillers(spark, d):
    got = L.fillers_of(T.transcripts(spark, d), ("um", "uh", "the", "of the"))
    return got.select("media_id", F.size(F.filter("fillers", lambda x: x)).cast("long").alias("n_fillers"), F.size("fillers").cast("long").alias("n_words"))


def _by_media(spark, d):
    pts = T.spans(spark, d).where("event_type = 'click'").groupBy("media_id").agg(F.collect_list("in_ms").alias("pts"))
    cs = cuts(spark, d).groupBy("media_id").agg(F.collect_list("cut_ms").alias("cs"))
    nul = F.array().cast("array<bigint>")
    return media(spark, d).join(pts, "media_id", "left").join(cs, "media_id", "left").withColumns({"pts": F.coalesce("pts", nul), "cs": F.coalesce("cs", nul)})


@query("q5_27_punch_in_schedule")
def punch_ins(spark, d):
    return _by_media(spark, d).select("media_id", F.explode(L.punch_ins(F.col("pts"), F.col("duration_ms"), F.col("cs"))).alias("p")).select("media_id", "p.at", "p.zoom")


@query("q5_28_shot_spans")
def shot_spans(spark, d):
    return _by_media(spark, d).select("media_id", F.explode(L.shots(F.col("pts"), F.col("duration_ms"), F.col("cs"))).alias("p")).select("media_id", F.col("p.start").alias("start_ms"), F.col("p.end").alias("end_ms"))


@query("q6_27_detect_shots")
def detect_shots(spark, d):
    """Cuts at most 400 ms after the last kept one are the same cut."""
    cs = cuts(spark, d).groupBy("media_id").agg(F.array_sort(F.collect_list("cut_ms")).alias("cs"))
    return cs.select("media_id", F.explode(P.thin(F.col("cs"), 401)).alias("cut_ms"))


def _sentence_words(spark, d):
    words = F.array_sort(F.collect_list(F.struct("pos", "w", "start_ms", "end_ms")))
    return S.numbered(T.words(spark, d)).groupBy("media_id", "sent_id").agg(words.alias("ws"))


@query("q5_37_caption_chunks")
def caption_chunks(spark, d):
    rows = _sentence_words(spark, d).withColumn("chunk", L.caption_chunks(F.col("ws")))
    return rows.select("media_id", "sent_id", F.size("ws").alias("n_words"), (F.array_max("chunk") + 1).alias("n_chunks"))


@query("q5_38_wrap_caption_lines")
def wrap_lines(spark, d):
    rows = _sentence_words(spark, d).withColumn("lines", L.wrap_lines(F.transform("ws", lambda x: x["w"]), 32))
    return rows.select("media_id", "sent_id", F.size("lines").alias("n_lines"), F.array_max(F.transform("lines", F.length)).alias("longest"))


@query("q5_33_observation_inventory")
def inventory(spark, d):
    m = media(spark, d).withColumn("scan_in", F.lit(0).cast("long")).withColumn("scan_out", F.floor(F.col("duration_ms") * 3 / 4).cast("long"))
    frames = T.spans(spark, d).where("event_type = 'purchase'").select("media_id", F.col("in_ms").alias("at_ms"))
    return L.observation_inventory(m, cuts(spark, d), kind(spark, d, "view"), kind(spark, d, "signup"), frames)


@query("q4_44_coverage_summary")
def coverage_summary(spark, d):
    return Y.level_shares(inventory(spark, d), "media_id", "level", "has_speech").withColumn("share", F.round("share", 6))


MARKS = (("What", "Why"), ("no,", "rather"), ("but ", "except"), ("first", "once"), ("so ", "finally"))


@query("q5_49_story_relations", with_tables("words", SENTENCES + """, n as (select media_id, sent_id, start_ms, trim(text) as own, trim(lead(text) over o) as nx, lead(sent_id) over o as core_id, lead(end_ms) over o as next_end from sent window o as (partition by media_id order by sent_id)),
 k as (select *, case when regexp_matches(own, '[?؟]$') or starts_with(own, 'What') or starts_with(own, 'Why') then 'question_answer' when contains(nx, 'no,') or contains(nx, 'rather') then 'correction' when contains(nx, 'but ') or contains(nx, 'except') then 'qualification'
   when contains(own, 'first') or contains(own, 'once') or contains(nx, 'so ') or contains(nx, 'finally') then 'setup_payoff' end as kind from n where core_id is not null),
 f as (select media_id, kind, sent_id as context_id, core_id, start_ms as in_ms, next_end as out_ms from k where kind is not null),
 w as (select media_id, 'setup_payoff', min(sent_id), max(sent_id), arg_min(start_ms, sent_id), arg_max(end_ms, sent_id) from sent group by media_id having count(*) > 1 and media_id not in (select media_id from f))
 select * from f union all select * from w"""))
def story(spark, d):
    return L.relations(sentences(spark, d), *MARKS)


@query("q5_53_collapse_path", with_tables("spans", ", f as (select media_id, event_id, event_type, lag(event_type) over (partition by media_id order by in_ms, event_id) as b from spans) select media_id, event_id, event_type from f where (b is null or b <> event_type) and event_type <> 'error'"))
def collapse(spark, d):
    rows = T.spans(spark, d).select("media_id", "event_id", "event_type", F.struct("in_ms", "event_id").alias("at"))
    return L.collapse_path(rows, "media_id", "at", "event_type", "error").select("media_id", "event_id", "event_type")


@query("q5_42_rapid_exchange", with_tables("turns", """, a as (select *, end_ms - start_ms <= 4000 as short, lag(end_ms - start_ms <= 4000) over o as ps, lag(speaker) over o as pk from turns window o as (partition by media_id order by start_ms, turn)),
 r as (select *, sum(case when short and coalesce(ps, false) and pk <> speaker then 0 else 1 end) over (partition by media_id order by start_ms, turn rows unbounded preceding) as run from a)
 select media_id, min(start_ms) as run_start, max(end_ms) as run_end, count(*) as n_turns from r where short group by media_id, run having count(*) >= 3 and count(distinct speaker) >= 2"""))
def rapid(spark, d):
    return L.rapid_exchange(T.turns(spark, d))


@query("q5_43_longest_run", with_tables("words", SENTENCES + """, r as (select *, sent_id - row_number() over (partition by media_id order by sent_id) as run from sent where complete), a as (select media_id, run, min(sent_id) as first_sent, max(sent_id) as last_sent, max(end_ms) - min(start_ms) as ms from r group by 1, 2),
 k as (select *, row_number() over (partition by media_id order by ms desc, first_sent) as k from a) select media_id, first_sent, last_sent, ms from k where k = 1"""))
def longest_run(spark, d):
    a = P.runs(sentences(spark, d).where("complete"), ["media_id"], "sent_id").groupBy("media_id", "run").agg(F.min("sent_id").alias("first_sent"), F.max("sent_id").alias("last_sent"), (F.max("end_ms") - F.min("start_ms")).alias("ms"))
    best = F.min_by(F.struct("first_sent", "last_sent", "ms"), F.struct(-F.col("ms"), F.col("first_sent")))
    return a.groupBy("media_id").agg(best.alias("b")).select("media_id", "b.*")


@query("q5_44_contiguous_spans", with_tables("words", SENTENCES + ", r as (select *, sent_id - row_number() over (partition by media_id order by sent_id) as run from sent where complete) select media_id, min(sent_id) as first_sent, count(*) as n from r group by media_id, run"))
def contiguous(spark, d):
    return P.runs(sentences(spark, d).where("complete"), ["media_id"], "sent_id").groupBy("media_id", "run").agg(F.min("sent_id").alias("first_sent"), F.count("*").alias("n")).drop("run")


@query("q5_47_assert_contiguous", with_tables("words", SENTENCES + " select media_id, max(sent_id) - min(sent_id) + 1 = count(distinct sent_id) and count(*) = count(distinct sent_id) as contiguous from sent where complete group by 1"))
def assert_contiguous(spark, d):
    return Y.without_gaps(sentences(spark, d).where("complete"), "media_id", "sent_id")


@query("q1_29_build_edl", with_tables("words", WORDMEDIA + """, e as (select media_id, 0 as s, 0 as z from wm union all select media_id, start_ms, end_ms from rem), g as (select e.media_id, z as a, coalesce(lead(s) over (partition by e.media_id order by s, z), duration_ms) as b from e join wm on wm.media_id = e.media_id),
 k as (select *, row_number() over (partition by media_id order by a) as n, cast(coalesce(sum(b - a) over (partition by media_id order by a rows between unbounded preceding and 1 preceding), 0) as bigint) as rec from g where b > a)
 select media_id, cast(n * 2 - 1 as bigint) as event_no, 'V' as track, a as source_in, b as source_out, rec as record_in from k union all select media_id, n * 2, 'A', a, b, rec from k"""))
def edl(spark, d):
    _, retained = L.silence_plan(T.words(spark, d), word_media(spark, d))
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms"))
    rows = P.clock(retained, "media_id").withColumn("n", n)
    both = rows.select("media_id", F.explode(F.array(F.struct((F.col("n") * 2 - 1).cast("long").alias("event_no"), F.lit("V").alias("track")), F.struct((F.col("n") * 2).cast("long").alias("event_no"), F.lit("A").alias("track")))).alias("e"), "start_ms", "end_ms", "out_ms")
    return both.select("media_id", "e.event_no", "e.track", F.col("start_ms").alias("source_in"), F.col("end_ms").alias("source_out"), F.col("out_ms").alias("record_in"))
