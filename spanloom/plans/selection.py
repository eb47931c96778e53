"""Queries over candidates: fusion, votes, selection, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.functions import intervals as I
from spanloom.operators import scorecards as Y
from spanloom.operators import rules as U
from spanloom.operators import selection as S
from spanloom.operators import spans as P
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def merged(spark, d):
    return S.merge_candidates(T.candidates(spark, d, "click"), T.candidates(spark, d, "view"))


@query("q3_2_merge_candidates")
def merge(spark, d):
    return merged(spark, d).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), "+"))


@query("q3_26_inventory_independence", with_tables("verbal visual", " select path, count(*) as n_ids, 1 as times from (select 'verbal' as path, candidate_id from verbal union all select 'visual', candidate_id from visual) group by path"))
def independence(spark, d):
    """Every input id appears once among the sources of the merged rows."""
    ids = T.candidates(spark, d, "click").select(F.lit("verbal").alias("path"), "candidate_id").unionByName(T.candidates(spark, d, "view").select(F.lit("visual").alias("path"), "candidate_id"))
    return Y.uses(ids, merged(spark, d).select(F.explode("sources").alias("candidate_id")), "path", "candidate_id")


@query("q6_11_to_retrieved")
def to_retrieved(spark, d):
    return merged(spark, d).select("media_id", "path", "in_ms", "out_ms", F.least("verbal_rank", "visual_rank").alias("rank"))


@query("q6_12_candidate_priority")
def priority(spark, d):
    order = Window.partitionBy("media_id").orderBy(*Y.candidate_order(F.element_at("sources", 1)))
    return merged(spark, d).select("media_id", "path", "in_ms", "out_ms", F.row_number().over(order).alias("priority"))


@query("q6_10_vote_candidate_spans")
def vote(spark, d):
    runs = T.spans(spark, d).select(F.col("event_id").alias("candidate_id"), "media_id", F.col("event_type").alias("run"), "in_ms", "out_ms", F.col("value").alias("score"))
    return S.vote(runs, 0.6, 2).withColumn("mean_score", F.round("mean_score", 6))


def _with_words(spark, d):
    """Every span with all the words of the document whose id is its own."""
    ws = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("candidate_id"), ws.alias("words"))
    own = T.spans(spark, d).select(F.col("event_id").alias("candidate_id"), "media_id", "in_ms", "out_ms", F.col("value").alias("score"))
    # The spans are the table that is held, or all words would be sorted.
    return own.hint("shuffle_hash").join(docs, "candidate_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


@query("q6_19_plan_episode")
def plan_episode(spark, d):
    return S.diverse(_with_words(spark, d), quota=8).select("media_id", "candidate_id", "place", "selected", "reason")


@query("q6_20_select_episode")
def select_episode(spark, d):
    return S.diverse(_with_words(spark, d), quota=8).where("selected").select("media_id", "candidate_id", "place")


@query("q6_23_select_for_validation", with_tables("words", """, s as (select media_id, pos // 20 as seg, avg(ln(greatest(conf - 0.1, 1e-12))) as lp, min(w) as a, max(w) as b from words group by 1, 2),
 r as (select *, row_number() over (partition by media_id order by round(lp, 9), seg) as k, count(*) over (partition by media_id) as n from s)
 select media_id, seg, k <= n // 4 as low, a = b as same, case when k <= n // 4 and a <> b then 'both' when k <= n // 4 then 'quartile' when a <> b then 'disagreement' else 'none' end as trigger from r"""))
def validation(spark, d):
    s = T.words(spark, d).groupBy("media_id", F.expr("pos div 20").alias("seg")).agg(F.round(F.avg(F.log(F.greatest(F.col("conf") - 0.1, F.lit(1e-12)))), 9).alias("lp"), F.min("w").alias("a"), F.max("w").alias("b"))
    r = S.lowest_quarter(s, ["media_id"], "lp", "seg").withColumn("same", F.col("a") == F.col("b"))
    trigger = F.when(F.col("low") & ~F.col("same"), "both").when(F.col("low"), "quartile").when(~F.col("same"), "disagreement").otherwise("none")
    return r.select("media_id", "seg", "low", "same", trigger.alias("trigger"))


VERDICT = "verdicts as (select event_id, media_id, event_type, value % 1.0 as hook, (value * 7) % 1.0 as fidelity, (value * 3) % 1.0 as cultural, (value * 11) % 0.3 as risk, case when event_id % 3 = 0 then null else (value * 5) % 1.0 end as payoff, event_id % 2 = 0 as has_beat from spans)"


def verdicts(spark, d):
    v = F.col("value")
    return T.spans(spark, d).select("event_id", "media_id", "event_type", (v % 1.0).alias("hook"), (v * 7 % 1.0).alias("fidelity"), (v * 3 % 1.0).alias("cultural"), (v * 11 % 0.3).alias("risk"), F.when(F.col("event_id") % 3 != 0, v * 5 % 1.0).alias("payoff"), (F.col("event_id") % 2 == 0).alias("has_beat"))


def tournament_score(hook="hook", payoff="payoff", fidelity="fidelity", cultural="cultural", risk="risk", beat="has_beat"):
    """Weighted verdict; an unmeasured payoff counts as 0.5."""
    return 0.4 * F.col(hook) + 0.3 * F.coalesce(F.col(payoff), F.lit(0.5)) + 0.2 * F.col(fidelity) + 0.1 * F.col(cultural) - 0.2 * F.col(risk) + F.when(F.col(beat), 0.05).otherwise(0.0)


SCORE = "0.4 * hook + 0.3 * coalesce(payoff, 0.5) + 0.2 * fidelity + 0.1 * cultural - 0.2 * risk + case when has_beat then 0.05 else 0.0 end"


@query("q6_15_tournament_score", with_tables("spans", f", {VERDICT} select event_id, round(cast({SCORE} as double), 5) as score from verdicts"))
def score(spark, d):
    return verdicts(spark, d).select("event_id", F.round(tournament_score(), 5).alias("score"))


@query("q6_16_tournament_rank", with_tables("spans", f", {VERDICT}, r as (select event_id, media_id, row_number() over (partition by media_id order by round(cast({SCORE} as double), 6) desc, event_type, event_id) as place from verdicts where risk <= 0.1) select * from r"))
def tournament_rank(spark, d):
    fit = verdicts(spark, d).where("risk <= 0.1")
    return U.placed(fit, "media_id", F.round(tournament_score(), 6).desc(), "event_type", "event_id").select("event_id", "media_id", "place")


@query("q2_27_verdict_shippable", with_tables("spans", f", {VERDICT} select event_id, hook >= 0.75 and risk <= 0.10 and fidelity >= 0.70 and cultural >= 0.70 as shippable from verdicts"))
def shippable(spark, d):
    return verdicts(spark, d).select("event_id", U.meets({"hook": 0.75, "fidelity": 0.70, "cultural": 0.70}, {"risk": 0.10}).alias("shippable"))


@query("q6_18_rank_editorial", with_tables("spans", f", {VERDICT} select event_id, media_id, row_number() over (partition by media_id order by round(cast(0.5 * hook + 0.5 * fidelity as double), 6) desc, event_id) as place from verdicts"))
def rank_editorial(spark, d):
    score = F.round(0.5 * F.col("hook") + 0.5 * F.col("fidelity"), 6)
    return U.placed(verdicts(spark, d), "media_id", score.desc(), "event_id").select("event_id", "media_id", "place")


@query("q3_35_candidate_for_judging", with_tables("verbal visual", """, m as (select a.candidate_id, v.candidate_id as chosen_id, row_number() over (partition by a.candidate_id order by v.out_ms - v.in_ms, v.rank, v.candidate_id) as k
 from verbal a join visual v on v.media_id = a.media_id and v.in_ms <= a.in_ms and a.out_ms <= v.out_ms) select candidate_id, chosen_id from m where k = 1"""))
def for_judging(spark, d):
    a = T.candidates(spark, d, "click").select("candidate_id", "media_id", F.col("in_ms").alias("a_in"), F.col("out_ms").alias("a_out"))
    v = T.candidates(spark, d, "view").select("media_id", F.col("candidate_id").alias("chosen_id"), "in_ms", "out_ms", "rank")
    met = P.overlap_join(a, v, "media_id", ("a_in", "a_out"), ("in_ms", "out_ms")).where(I.contains("in_ms", "out_ms", "a_in", "a_out"))
    return met.groupBy("candidate_id").agg(F.min_by("chosen_id", F.struct(F.col("out_ms") - F.col("in_ms"), F.col("rank"), F.col("chosen_id"))).alias("chosen_id"))


@query("q3_34_rejected_candidates", with_tables("verbal winners", """, x as (select v.*, exists (select 1 from winners w where w.media_id = v.media_id and w.in_ms < v.out_ms and v.in_ms < w.out_ms) as near from verbal v)
 select candidate_id, case when out_ms - in_ms < 30000 then 'too short' when out_ms - in_ms > 90000 then 'too long' when near then 'overlaps the selected span' else 'ranked lower' end as reason from x where rank > 1"""))
def rejected(spark, d):
    v = T.candidates(spark, d, "click").where("rank > 1")
    w = T.candidates(spark, d, "purchase").select("media_id", F.col("in_ms").alias("w_in"), F.col("out_ms").alias("w_out"))
    near = P.overlap_join(v, w, "media_id", ("in_ms", "out_ms"), ("w_in", "w_out")).select("candidate_id").distinct().withColumn("near", F.lit(True))
    ms = F.col("out_ms") - F.col("in_ms")
    reason = F.when(ms < 30000, "too short").when(ms > 90000, "too long").when(F.col("near"), "overlaps the selected span").otherwise("ranked lower")
    return v.join(near, "candidate_id", "left").select("candidate_id", reason.alias("reason"))


@query("q2_40_list_candidates", with_tables("spans", " select * from (select media_id, event_id, event_type, row_number() over (partition by media_id order by nullif(event_id % 7, 0) nulls last, event_id) as place, count(*) over (partition by media_id) as total from spans) where place <= 10"))
def list_candidates(spark, d):
    return U.page(T.spans(spark, d), "media_id", F.col("event_id") % 7, "event_id").select("media_id", "event_id", "event_type", "place", "total")
