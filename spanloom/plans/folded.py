"""Queries over serial folds, hooks and nested documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.functions import numbers as N
from spanloom.operators import contracts as K
from spanloom.operators import diarization as D
from spanloom.operators import folds as O
from spanloom.operators import hooks as H
from spanloom.operators import reports as Q
from spanloom.operators import retrieval as R
from spanloom.operators import rules as U
from spanloom.operators import scorecards as Y
from spanloom.operators import sentences as E
from spanloom.operators import spans as P
from spanloom.operators import timeline as L
from spanloom.plans.evaluation import ITEMS, items
from spanloom.plans.selection import merged
from spanloom.plans.text import SENTENCES, TOKENS, sentences
from spanloom.plans.timeline import MARKS, cuts, media
from spanloom.sources import documents as J
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def clicks(spark, d):
    return T.candidates(spark, d, "click").select("candidate_id", "media_id", "in_ms", "out_ms")


@query("q5_35_targeted_observation", with_tables("spans", """, e as (select media_id, event_id, case when event_type = 'error' then 0 else least(4, greatest(1, (out_ms - in_ms) // 20000)) end as want, row_number() over (partition by media_id order by value desc, in_ms, out_ms, event_id) as k, event_type from spans),
 r as (select *, coalesce(sum(want) over (partition by media_id order by k rows between unbounded preceding and 1 preceding), 0) as b from e)
 select media_id, event_id, cast(least(want, greatest(40 - b, 0)) as bigint) as frames, case when event_type = 'error' then 'covered' when least(want, greatest(40 - b, 0)) > 0 then 'scheduled' else 'budget exhausted' end as outcome from r"""))
def targeted(spark, d):
    e = T.spans(spark, d).withColumn("priority", F.col("value")).withColumn("covered", F.col("event_type") == "error")
    return O.allot_frames(e, 40, 4, 20_000).select("media_id", "event_id", "frames", "outcome")


@query("q5_36_apply_observation")
def apply_targeted(spark, d):
    got = O.allot_frames(T.spans(spark, d).withColumn("priority", F.col("value")).withColumn("covered", F.col("event_type") == "error"), 40, 4, 20_000)
    frames = got.select("media_id", F.explode(O.frame_times(F.col("in_ms"), F.col("out_ms"), F.col("frames").cast("int"))).alias("at_ms"))
    m = media(spark, d).withColumn("scan_in", F.lit(0).cast("long")).withColumn("scan_out", F.col("duration_ms"))
    own = lambda k: T.spans(spark, d).where(F.col("event_type") == k).select("media_id", F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"))
    return L.observation_inventory(m, cuts(spark, d), own("view"), own("signup"), frames)


@query("q5_46_grown_runs")
def grown(spark, d):
    s = sentences(spark, d, clicks(spark, d), text=False)
    met = P.overlap_join(clicks(spark, d), s.where("complete"), "media_id", ("in_ms", "out_ms"), ("start_ms", "end_ms"))
    seeds = met.groupBy("candidate_id", "media_id").agg(F.min("sent_id").alias("first_sent")).withColumn("last_sent", F.col("first_sent"))
    return O.grown_runs(seeds, s, 30_000)


@query("q5_50_resolve_candidates")
def resolve(spark, d):
    s = sentences(spark, d, clicks(spark, d))
    return O.expand_candidates(clicks(spark, d), L.relations(s, *MARKS), s).select("candidate_id", "in_ms", "out_ms", "new_in_ms", "new_out_ms", "n_relations", "reason")


@query("q5_51_eligible_candidates")
def eligible(spark, d):
    return resolve(spark, d).where("reason is null").select("candidate_id", "new_in_ms", "new_out_ms")


@query("q5_41_choose_face")
def choose_face(spark, d):
    """Boxes made from spans: each rounded to a frame of 100 seconds."""
    boxes = T.spans(spark, d).select("media_id", F.expr("in_ms div 100000 * 100000").alias("at_ms"), (F.floor("value") % 997).cast("long").alias("x"), (F.col("event_id") % 90 + 20).alias("width"), (F.col("event_id") % 70 + 20).alias("height"))
    return O.follow_faces(boxes, 900, 400)


@query("q5_40_stabilize")
def stabilize(spark, d):
    points = T.spans(spark, d).groupBy("media_id", F.col("in_ms").alias("at_ms")).agg(F.max(F.floor("value")).alias("x"))
    return O.steady(points, cuts(spark, d), 40, 60_000, 20_000, 300)


@query("q4_62_face_track_stats", with_tables("spans", " select media_id, count(*) as n_samples, count(*) filter (where value > 30) as n_detected, round(count(*) filter (where value > 30) / cast(count(*) as double), 9) as share from spans group by 1"))
def track_stats(spark, d):
    got = Y.share(T.spans(spark, d), "media_id", F.col("value") > 30, n="n_samples", hits="n_detected")
    return got.withColumn("share", F.round("share", 9))


FILLERS = ("the", "um")


def _importance(spark, d):
    return E.importance(sentences(spark, d), FILLERS).withColumn("importance", F.round("importance", 6)).withColumn("worth", F.round("worth", 6))


@query("q6_25_condense_story")
def condense(spark, d):
    kept = O.fill_story(_importance(spark, d)).where("kept")
    return kept.groupBy("media_id", "span").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_sentences"))


@query("q6_26_condense_arcs")
def arcs(spark, d):
    """Windows of 80 seconds of speech, each condensed, the three best."""
    return O.story_arcs_of(T.transcripts(spark, d), FILLERS)


def _read(pdf):
    return pdf[["media_id", "window_id"]].assign(score=(pdf["in_ms"] % 97).astype(float), refused=pdf["in_ms"] % 5 == 0)


@query("q6_8_discover_visual")
def discover_visual(spark, d):
    w = L.scene_windows(L.scenes(cuts(spark, d), media(spark, d)))
    w = w.select("media_id", F.concat_ws(":", F.col("media_id").cast("string"), F.concat(F.lit("s"), F.col("scene").cast("string")), F.concat(F.lit("w"), F.col("window").cast("string"))).alias("window_id"), "in_ms", "frames")
    good, bad = O.read_in_batches(w, _read)
    return good.select("media_id", "window_id", "score", "rank", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("media_id", "window_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), "reason"))


@query("q6_9_path_candidates", with_tables("spans", " select event_id, media_id, row_number() over (partition by media_id order by value desc, in_ms, event_id) as rank from spans where value > 1 and out_ms - in_ms between 20000 and 120000"))
def path_candidates(spark, d):
    ok = T.spans(spark, d).where((F.col("value") > 1) & (F.col("out_ms") - F.col("in_ms")).between(20000, 120000))
    return U.placed(ok, "media_id", F.desc("value"), "in_ms", "event_id", name="rank").select("event_id", "media_id", "rank")


@query("q6_3_bm25_from_media", "with" + TOKENS + ", t as (select doc_id, term, count(*) as tf from tok group by 1, 2) select doc_id, count(*) as n_terms, cast(sum(tf) as bigint) as length, max(tf) as most from t group by 1")
def media_docs(spark, d):
    p = R.postings(R.words_field(T.read(spark, d, "documents")))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("length"), F.max("tf").alias("most"))


@query("q6_14_automatic_selection")
def automatic(spark, d):
    rows = merged(spark, d).withColumn("cid", F.concat_ws("+", F.col("sources").cast("array<string>")))
    return rows.groupBy("media_id").agg(F.min_by(F.struct("cid", "in_ms", "out_ms"), F.struct(*Y.candidate_order("cid"))).alias("b")).select("media_id", "b.*")


@query("q4_23_overlap_aware_error")
def overlap_aware(spark, d):
    own = T.spans(spark, d).select("media_id", F.col("event_type").alias("speaker"), F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"))
    other = own.select("media_id", F.when(F.col("speaker") == "view", "click").otherwise(F.col("speaker")).alias("speaker"), F.col("start_ms") + 500, "end_ms").toDF("media_id", "speaker", "start_ms", "end_ms")
    return D.error(own, other).withColumn("der", F.round("der", 9))


@query("q4_24_pooled_error")
def pooled(spark, d):
    return Y.pooled_error(overlap_aware(spark, d)).withColumn("der", F.round("der", 9))


@query("q4_26_item_metrics", with_tables("turns", ", p as (select media_id, coalesce(turn % 3 = 0 and lag(speaker) over (partition by media_id order by turn) <> speaker, false) as wrong, (end_ms - start_ms) / 100.0 as err, start_ms - lag(start_ms) over (partition by media_id order by turn) as step from turns) select media_id, round(avg(cast(wrong as double)), 9) as error_rate, round(avg(cast(err as double)), 9) as mae, round(avg(cast(step as double)), 9) as mean_step from p group by 1"))
def item_metrics(spark, d):
    """A run that keeps the last speaker at every third turn and comes later the longer a turn is."""
    before = F.lag("speaker").over(Window.partitionBy("media_id").orderBy("turn"))
    pairs = T.turns(spark, d).withColumn("run_speaker", F.when(F.col("turn") % 3 == 0, F.coalesce(before, "speaker")).otherwise(F.col("speaker"))).withColumn("at_ms", F.col("start_ms"))
    got = Q.track_metrics(pairs, "media_id", "turn", F.col("run_speaker") != F.col("speaker"), (F.col("end_ms") - F.col("start_ms")) / 100.0)
    return got.select("media_id", *[F.round(c, 9).alias(c) for c in ("error_rate", "mae", "mean_step")])


@query("q4_15_run_benchmark", f"with {ITEMS} select model, count(*) as n, count(*) filter (where cer is null) as n_failed, round(sum(cer * n_chars) / nullif(sum(n_chars) filter (where cer is not null), 0), 9) as micro_cer, round(avg(wall_s / nullif(duration_s, 0)), 9) as mean_rtf, round(max(wall_s / nullif(duration_s, 0)), 9) as worst_rtf from items group by model")
def benchmark(spark, d):
    got = Q.benchmark(items(spark, d))
    return got.select("model", "n", "n_failed", *[F.round(c, 9).alias(c) for c in ("micro_cer", "mean_rtf", "worst_rtf")])


@query("q4_16_score_items", f"with {ITEMS} select item_id, model, round(cer, 9) as cer, round(wall_s / nullif(duration_s, 0), 9) as rtf, round(entity_error, 9) as entity_error, cer is not null as measured from items")
def score_items(spark, d):
    return items(spark, d).select("item_id", "model", F.round("cer", 9).alias("cer"), F.round(Q.real_time_factor("wall_s", "duration_s"), 9).alias("rtf"), F.round("entity_error", 9).alias("entity_error"), F.col("cer").isNotNull().alias("measured"))


@query("q4_41_visual_scorecard", "with c as (select lang, source, cast(count(quality) as double) as n, cast(count(*) filter (where quality = 1) as double) as a from documents left join labels using (doc_id) group by 1, 2), t as (select lang, sum(n) as n, sum(a) / nullif(sum(n), 0) as p, cast(count(*) as double) as k from c group by 1), v as (select c.lang, min(k) / nullif(min(k) - 1, 0) * sum((a - p * c.n) * (a - p * c.n)) / (min(t.n) * min(t.n)) as var from c join t on t.lang = c.lang group by 1), z as (select 1.959963984540054 as z) select t.lang, round(p, 9) as rate, round(greatest(0.0, least(p - z * sqrt(var), (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n))), 9) as low from t join v on v.lang = t.lang, z")
def scorecard(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "lang", "source").join(T.read(spark, d, "labels"), "doc_id", "left")
    return Y.clustered_rate(j, "lang", "source", F.col("quality").isNotNull(), F.col("quality") == 1).select("lang", F.round("rate", 9).alias("rate"), F.round("low", 9).alias("low"))


@query("q4_56_inspect_run", with_tables("spans", " select media_id, count(*) as n_events, count(distinct event_type) as n_stages, max(in_ms) as last_ms from spans group by 1"))
def inspect_run(spark, d):
    return Q.run_summary(T.spans(spark, d), "media_id", "event_type", "in_ms")


@query("q4_57_inspect_project", "select source, count(*) as n_decisions, count(*) filter (where quality = 0) as n_revisions from documents left join labels using (doc_id) group by 1")
def inspect_project(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels"), "doc_id", "left")
    return Q.project_summary(j, "source", F.col("quality") == 0)


@query("q5_18_output_sentences", with_tables("words", SENTENCES + """, g as (select *, lag(end_ms) over (partition by media_id order by pos) as b from w2), sh as (select media_id, sid, w, pos, start_ms - sum(case when b is not null and start_ms - b > 600 then start_ms - b - 150 else 0 end) over (partition by media_id order by pos rows unbounded preceding) as s, end_ms - start_ms as ms from g)
 select media_id, cast(sid as bigint) as sent_id, cast(min(s) as bigint) as start_ms, cast(max(s + ms) as bigint) as end_ms, count(*) as n_words from sh group by 1, 2"""))
def output_sentences(spark, d):
    moved = L.tightened(E.numbered(T.words(spark, d)))
    return moved.groupBy("media_id", "sent_id").agg(F.min("new_start_ms").alias("start_ms"), F.max("new_end_ms").alias("end_ms"), F.count("*").alias("n_words"))


@query("q5_39_captions_within", with_tables("words", SENTENCES + " select media_id, bool_or(start_ms < 60000 and end_ms > 0) as has_cue, count(*) filter (where start_ms >= 60000) as n_outside from sent group by 1"))
def captions_within(spark, d):
    return Y.cues_within(sentences(spark, d), "media_id", 60_000)


@query("q5_52_order_moments", with_tables("words", SENTENCES + ", o as (select media_id, sent_id, case when sent_id = (max(sent_id) over (partition by media_id)) then -1 else sent_id end as k from sent) select media_id, sent_id, row_number() over (partition by media_id order by k) as place from o"))
def order_moments(spark, d):
    """Every story played with its last moment first: setup after payoff is put in order by a key, not by moving rows."""
    rows = Y.last_first(sentences(spark, d), "media_id", "sent_id")
    return rows.select("media_id", "sent_id", F.row_number().over(Window.partitionBy("media_id").orderBy("_play")).alias("place"))


@query("q5_56_run_timeline", with_tables("spans", " select media_id as run_id, event_id, event_type as stage, row_number() over (partition by media_id order by in_ms, event_id) as place from spans"))
def run_timeline(spark, d):
    return U.placed(T.spans(spark, d), "media_id", "in_ms", "event_id").select(F.col("media_id").alias("run_id"), "event_id", F.col("event_type").alias("stage"), "place")


@query("q8_12_alignment_coverage", with_tables("words", " select media_id, round(count(*) filter (where conf >= 0.6) / cast(nullif(count(*), 0) as double), 9) as coverage from words group by 1"))
def alignment_coverage(spark, d):
    return Y.share(T.words(spark, d), "media_id", F.col("conf") >= 0.6).select("media_id", F.round("share", 9).alias("coverage"))


@query("q8_17_cosine", "with v as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings) select a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double))) / (a.n * b.n), 6) as cosine from v a join v b on b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    v = T.read(spark, d, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")), "vec_id").select("vec_id", F.round(N.cosine("embedding", "o"), 6).alias("cosine"))


@query("q2_21_times_within_window", with_tables("spans", " select event_id, 'l' || k as label, 1 as cited, (in_ms // 1000 + 15 * k) * 1000 between in_ms and out_ms as grounded from spans, (select unnest(range(6)) as k)"))
def times_within(spark, d):
    """Six labels a span, each citing a time 15 seconds after the one before."""
    labels = {f"l{k}": F.concat(F.lit("seen at "), F.expr(f"cast(in_ms div 1000 + {15 * k} as string)"), F.lit("s")) for k in range(6)}
    return U.labels_within(T.spans(spark, d), labels, "in_ms", "out_ms").select("event_id", "label", "cited", "grounded")


@query("q2_29_boundary_revision", with_tables("spans", " select event_id, concat_ws(';', case when in_ms + 1000 > in_ms + cast(floor(value * 100) as bigint) then 'starts after the anchor' end, case when out_ms - 5000 < in_ms + 20000 then 'ends before the anchor' end) as reasons from spans where event_type = 'click'"))
def boundary_revision(spark, d):
    rules = {"starts after the anchor": F.col("in_ms") + 1000 > F.col("in_ms") + F.floor(F.col("value") * 100), "ends before the anchor": F.col("out_ms") - 5000 < F.col("in_ms") + 20000}
    return K.with_reasons(T.spans(spark, d).where("event_type = 'click'"), rules).select("event_id", F.array_join("reasons", ";").alias("reasons"))


@query("q2_31_inspect_artifact", "select d.doc_id, 'original' as version, n_chars as span, lang as style from documents d union all select l.doc_id, 'revision', case when quality = 0 then 1 else d.n_chars end, case when toxic = 1 then 'flagged' else d.lang end from labels l join documents d using (doc_id)")
def inspect_artifact(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("span"), F.col("lang").alias("style"))
    revisions = T.read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, 1).alias("new_span"), F.when(F.col("toxic") == 1, "flagged").alias("new_style"))
    return U.effective(docs, revisions, "doc_id", {"span": "new_span", "style": "new_style"})


def _transcripts(spark, d):
    """A nested transcript document for each recording, written from its words."""
    w = T.transcripts(spark, d)
    doc = F.to_json(F.struct(F.col("media_id").cast("string").alias("media_id"), F.lit("t").alias("text"), "words", F.array().cast("array<string>").alias("unaligned"), F.when(F.col("media_id") % 7 == 0, F.lit("x")).alias("note")))
    return w.select("media_id", doc.alias("json"))


@query("q1_7_read_transcripts", with_tables("words", " select media_id, case when media_id % 7 = 0 then 'extra keys' else '' end as reasons, count(*) as n_words from words group by 1, 2"))
def read_transcripts(spark, d):
    docs = J.parsed(_transcripts(spark, d), "json", J.TRANSCRIPT, ["media_id", "text", "words"], ["unaligned", "segment_confidence", "rejected"])
    return docs.select("media_id", F.array_join("reasons", ";").alias("reasons"), F.size("doc.words").cast("long").alias("n_words"))


@query("q1_6_transcript_tables", with_tables("words", " select cast(media_id as varchar) as media_id, count(*) as n, cast(sum(start_ms) as bigint) as s, cast(sum(end_ms) as bigint) as e, max(pos) as last_pos from words where media_id % 7 <> 0 group by 1"))
def transcript_tables(spark, d):
    docs, _ = K.split(J.parsed(_transcripts(spark, d), "json", J.TRANSCRIPT, ["media_id", "text", "words"], ["unaligned"]))
    return J.transcript_tables(docs)["words"].groupBy("media_id").agg(F.count("*").alias("n"), F.sum("start_ms").alias("s"), F.sum("end_ms").alias("e"), F.max("pos").cast("long").alias("last_pos"))


@query("q1_9_ingest_tables", with_tables("spans", " select cast(media_id as varchar) as media_id, max(out_ms) as duration_ms, count(*) filter (where event_type = 'error') as n_cuts, count(*) filter (where event_type = 'view') as n_speech from spans group by 1"))
def ingest_tables(spark, d):
    s = T.spans(spark, d)
    one = s.groupBy("media_id").agg(F.max("out_ms").alias("duration_ms"), F.collect_list(F.when(F.col("event_type") == "error", F.col("in_ms"))).alias("shot_cuts_ms"), F.collect_list(F.when(F.col("event_type") == "view", F.struct(F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms")))).alias("speech"))
    docs = one.select(F.from_json(F.to_json(F.struct(F.col("media_id").cast("string").alias("media_id"), "duration_ms", "shot_cuts_ms", "speech")), J.INGEST).alias("doc"))
    t = J.ingest_tables(docs)
    n = lambda df, name: df.groupBy("media_id").agg(F.count("*").alias(name))
    return t["media"].join(n(t["cuts"], "n_cuts"), "media_id", "left").join(n(t["speech"], "n_speech"), "media_id", "left").select("media_id", "duration_ms", F.coalesce("n_cuts", F.lit(0)).alias("n_cuts"), F.coalesce("n_speech", F.lit(0)).alias("n_speech"))


@query("q1_3_import_review_export", "select cast(doc_id as varchar) as item_id, md5(text) as reference_md5, n_chars / cast(1000 as double) as duration_s from documents left join labels using (doc_id) where coalesce(quality = 1, false)")
def review_export(spark, d):
    j = T.read(spark, d, "documents").join(T.read(spark, d, "labels"), "doc_id", "left")
    rows = j.select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("verified"), F.col("text").alias("rawTranscript"), F.col("n_chars").cast("double").alias("durationMs"))
    return J.review_export(rows).select("item_id", F.md5(F.col("reference").cast("binary")).alias("reference_md5"), "duration_s")


@query("q1_33_timeline_json")
def timeline_json(spark, d):
    clips = clicks(spark, d).select("media_id", F.col("candidate_id").cast("string").alias("clip_id"), "in_ms", "out_ms", F.lit(2).alias("n_markers"))
    return J.timeline_json(clips, "media_id", "reel")


def _shout(pdf):
    if (pdf["doc_id"] % 50 == 0).any():
        raise ValueError("no speech")
    got = pdf[pdf["doc_id"] % 7 != 0]
    return got[["doc_id"]].assign(n=got["text"].str.len())


@query("q10_1_model_hook", "select doc_id, case when doc_id % 50 = 0 or doc_id % 7 = 0 then null else length(text) end as n, case when doc_id % 50 = 0 then 'ValueError: no speech' when doc_id % 7 = 0 then 'no answer' end as error from documents")
def model_hook(spark, d):
    return H.map_rows(T.read(spark, d, "documents").select("doc_id", "text"), _shout, "n long", "doc_id")


@query("q10_8_first_passing", with_tables("spans", " select media_id, min(case when value > 40 then in_ms end) as in_ms from spans group by 1"))
def first_passing(spark, d):
    return H.first_passing(T.spans(spark, d).withColumn("ok", F.col("value") > 40), "media_id", "in_ms", "ok")


@query("q10_10_rule_counts", "select 'blank' as rule, count(*) filter (where trim(text) = '') as n from documents union all select 'marks', count(*) filter (where contains(text, '###')) from documents union all select 'long', count(*) filter (where n_chars > 5000) from documents")
def rule_counts(spark, d):
    rules = {"blank": F.trim("text") == "", "marks": F.contains("text", F.lit("###")), "long": F.col("n_chars") > 5000}
    return H.counts_by_rule(T.read(spark, d, "documents"), rules)
