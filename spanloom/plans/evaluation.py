"""Queries that evaluate: recall, rates, intervals, decisions, error totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.functions import intervals as I
from spanloom.functions import numbers as N
from spanloom.functions import text as X
from spanloom.operators import reports as R
from spanloom.operators import scorecards as Y
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


def retrieved(spark, d):
    """Both paths; every third candidate counts as found by both."""
    one = lambda kind, path: T.candidates(spark, d, kind).select("media_id", F.col("candidate_id").alias("r_id"), F.col("in_ms").alias("r_in"), F.col("out_ms").alias("r_out"), F.when(F.col("candidate_id") % 3 == 0, "both").otherwise(path).alias("path"), "rank")
    return one("click", "verbal").unionByName(one("view", "visual"))


def hits(spark, d, k=20, least=0.3):
    """(winner, path) of the gold spans that a candidate of the first k matches."""
    w = T.candidates(spark, d, "purchase").select("media_id", F.col("candidate_id").alias("winner_id"), "in_ms", "out_ms")
    met = P.overlap_join(w, retrieved(spark, d).where(F.col("rank") <= k), "media_id", ("in_ms", "out_ms"), ("r_in", "r_out"))
    return met.where(I.iou("in_ms", "out_ms", "r_in", "r_out") >= least).select("media_id", "winner_id", "path").distinct()


HITS = """, ret as (select media_id, candidate_id as r_id, in_ms as r_in, out_ms as r_out, case when candidate_id % 3 = 0 then 'both' else 'verbal' end as path, rank from verbal union all select media_id, candidate_id, in_ms, out_ms, case when candidate_id % 3 = 0 then 'both' else 'visual' end, rank from visual),
 hit as (select distinct w.media_id, w.candidate_id as winner_id, r.path from winners w join ret r on r.media_id = w.media_id and r.rank <= 20 and r.r_in < w.out_ms and w.in_ms < r.r_out
  where (least(w.out_ms, r.r_out) - greatest(w.in_ms, r.r_in)) / cast(w.out_ms - w.in_ms + r.r_out - r.r_in - (least(w.out_ms, r.r_out) - greatest(w.in_ms, r.r_in)) as double) >= 0.3),
 paths as (select unnest(['verbal', 'visual', 'both']) as p), byp as (select distinct p, media_id, winner_id from hit join paths on hit.path = p or (hit.path = 'both'))"""


@query("q3_3_found_winners", with_tables("verbal visual winners", HITS + " select distinct media_id, winner_id from hit"))
def found(spark, d):
    return hits(spark, d).select("media_id", "winner_id").distinct()


@query("q4_31_recall_at_k", with_tables("verbal visual winners", HITS + ", n as (select media_id, count(*) as n from winners group by 1), f as (select media_id, count(distinct winner_id) as f from hit group by 1) select n.media_id, round(coalesce(f, 0) / cast(n as double), 9) as recall from n left join f on f.media_id = n.media_id"))
def recall(spark, d):
    return Y.recall(T.candidates(spark, d, "purchase"), hits(spark, d), "media_id", "winner_id").select("media_id", F.round("recall", 9).alias("recall"))


def by_path(spark, d):
    return Y.on_each_path(hits(spark, d).select("path", "media_id", "winner_id"), "path", ("verbal", "visual"))


@query("q4_32_recall_by_path", with_tables("verbal visual winners", HITS + " select p as path, round(count(*) / (select cast(count(*) as double) from winners), 9) as recall from byp group by p"))
def recall_by_path(spark, d):
    return Y.recall_by_path(T.candidates(spark, d, "purchase"), by_path(spark, d), "path").select("path", F.round("recall", 9).alias("recall"))


@query("q4_33_path_unique_wins", with_tables("verbal visual winners", HITS + ", c as (select winner_id, count(*) as k, min(p) as p from byp where p <> 'both' group by 1) select p as path, count(*) as n from c where k = 1 group by 1"))
def unique_wins(spark, d):
    return Y.unique_wins(by_path(spark, d), "path", "winner_id")


@query("q4_35_misleading_rate", "select source, round(avg(cast(toxic as double)), 9) as rate, count(toxic) as n from documents d left join labels l on l.doc_id = d.doc_id group by source")
def misleading(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels"), "doc_id", "left")
    return R.flag_rate(j, "source", "toxic").withColumn("rate", F.round("rate", 9))


@query("q4_36_completeness_rate", "select lang, round(avg(cast(quality as double)), 9) as rate from documents d left join labels l on l.doc_id = d.doc_id group by lang")
def completeness(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "lang").join(T.read(spark, d, "labels"), "doc_id", "left")
    return R.flag_rate(j, "lang", "quality").select("lang", F.round("rate", 9).alias("rate"))


@query("q8_19_wilson_interval", "with a as (select source, avg(cast(quality as double)) as p, cast(count(quality) as double) as n from documents d join labels l on l.doc_id = d.doc_id group by source), z as (select 1.959963984540054 as z) select source, round(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0.0), 9) as low, round(least((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 1.0), 9) as high from a, z")
def wilson(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels"), "doc_id")
    a = j.groupBy("source").agg(F.avg(F.col("quality").cast("double")).alias("p"), F.count("quality").alias("n"))
    return a.withColumn("ci", N.wilson("p", "n")).select("source", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"))


@query("q4_34_pairwise_preference", "with c as (select doc_id, 'a' || (doc_id % 3) as x, 'b' || (doc_id % 2) as y, case when quality is null then 0.5 when quality = 1 then 1.0 else 0.0 end as s from documents d left join labels l using (doc_id)), e as (select x as system, s from c union all select y, 1.0 - s from c) select system, round(avg(cast(s as double)), 9) as win_rate, count(*) as n from e group by system")
def preference(spark, d):
    j = T.read(spark, d, "documents").select("doc_id").join(T.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = F.when(F.col("quality").isNull(), 0.5).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    c = j.select(F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")).alias("x"), F.concat(F.lit("b"), (F.col("doc_id") % 2).cast("string")).alias("y"), s.alias("s"))
    return R.win_rates(c, "x", "y", "s").withColumn("win_rate", F.round("win_rate", 9))


ITEMS = f"""it as (select conv_id || '/' || turn as item_id, role as dialect, text as ref, conv_id % 9 = 4 as failed, 'm' || (conv_id % 4) as model, turn, cast(length(text) as bigint) as n_chars,
   case conv_id % 4 when 0 then replace(text, 'th', 't') when 1 then replace(text, 'on', 'om') when 2 then replace(text, 'e', '') else replace(text, 'le ', 'la ') end as hyp from conversations),
 items as (select item_id, dialect, model, n_chars, n_chars / 15.0 as duration_s, n_chars / 15.0 * (0.2 + turn % 5 * 0.25) as wall_s,
   case when not failed then levenshtein(translate(ref, '{T.LETTERS}', {T.ONE_BYTE}), translate(hyp, '{T.LETTERS}', {T.ONE_BYTE})) / cast(nullif(n_chars, 0) as double) end as cer,
   case when not failed then len(list_filter(names, lambda n: not contains(hyp, n))) / cast(nullif(len(names), 0) as double) end as entity_error
   from (select *, list_filter(string_split_regex(ref, '\\s+'), lambda x: regexp_matches(x, '^\\p{{Lu}}')) as names from it))"""


def items(spark, d):
    """Each turn is an item of one model, whose hypothesis is the turn misheard in the model's way; some runs failed."""
    c = T.read(spark, d, "conversations")
    failed, way = F.col("conv_id") % 9 == 4, F.col("conv_id") % 4
    misheard = [("th", "t"), ("on", "om"), ("e", ""), ("le ", "la ")]
    hyp = F.coalesce(*[F.when(way == k, F.replace("text", F.lit(a), F.lit(b))) for k, (a, b) in enumerate(misheard)])
    names = F.filter(F.split("text", r"\s+"), lambda x: x.rlike(r"^\p{Lu}"))
    rows = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), F.col("role").alias("dialect"), F.concat(F.lit("m"), way.cast("string")).alias("model"), F.col("text").alias("ref"), F.when(~failed, hyp).alias("hyp"), names.alias("names"), F.length("text").cast("long").alias("n_chars"), "turn")
    rows = rows.withColumn("duration_s", F.col("n_chars") / 15.0).withColumn("wall_s", F.col("duration_s") * (0.2 + F.col("turn") % 5 * 0.25))
    return rows.select("item_id", "dialect", "model", "n_chars", "duration_s", "wall_s", X.cer("ref", "hyp").alias("cer"), X.missing_share("hyp", "names").alias("entity_error"))


@query("q4_7_micro_cer", f"with {ITEMS} select model, round(sum(cer * n_chars) / nullif(sum(n_chars) filter (where cer is not null), 0), 9) as micro_cer from items group by model")
def micro_cer(spark, d):
    return R.micro_rate(items(spark, d), ["model"]).withColumn("micro_cer", F.round("micro_cer", 9))


@query("q4_8_cer_by_dialect", f"with {ITEMS} select model, dialect, round(sum(cer * n_chars) / nullif(sum(n_chars) filter (where cer is not null), 0), 9) as micro_cer from items group by model, dialect")
def cer_by_dialect(spark, d):
    return R.micro_rate(items(spark, d), ["model", "dialect"]).withColumn("micro_cer", F.round("micro_cer", 9))


@query("q4_9_entity_error", f"with {ITEMS} select model, round(avg(entity_error), 9) as error, count(entity_error) as n from items group by model")
def entity_error(spark, d):
    return R.measured_mean(items(spark, d), "model", "entity_error").withColumn("error", F.round("error", 9))


@query("q4_10_code_switch_error", r"with s as (select b.item_id, b.text as ref, replace(replace(b.text, 'th', 't'), 'on', 'om') as hyp, list_filter(string_split_regex(b.text, '\s+'), lambda x: regexp_matches(x, '[A-Z]|[^\x00-\x7F]')) as spans from benchmark b), e as (select item_id % 4 as model, len(list_filter(spans, lambda x: not contains(hyp, x))) / cast(nullif(len(spans), 0) as double) as e from s) select model, round(avg(e), 9) as error, count(e) as n from e group by model")
def code_switch_error(spark, d):
    """Exact containment of switched words in the misheard text, by model."""
    b = T.read(spark, d, "benchmark")
    spans = F.filter(F.split("text", r"\s+"), lambda x: x.rlike(r"[A-Z]|[^\x00-\x7F]"))
    hyp = F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("on"), F.lit("om"))
    scored = b.select("item_id", spans.alias("spans"), hyp.alias("hyp")).select((F.col("item_id") % 4).alias("model"), X.missing_share("hyp", "spans").alias("error"))
    return R.measured_mean(scored, "model", "error").withColumn("error", F.round("error", 9))


@query("q4_11_mean_worst_rtf", f"with {ITEMS} select model, round(avg(wall_s / nullif(duration_s, 0)), 9) as mean_rtf, round(max(wall_s / nullif(duration_s, 0)), 9) as worst_rtf from items group by model")
def rtf(spark, d):
    return R.speed(items(spark, d), "model").select("model", F.round("mean_rtf", 9).alias("mean_rtf"), F.round("worst_rtf", 9).alias("worst_rtf"))


@query("q4_12_worst_rtf", f"with {ITEMS} select dialect, round(max(wall_s / nullif(duration_s, 0)), 9) as worst_rtf from items group by dialect")
def worst_rtf(spark, d):
    return R.speed(items(spark, d), "dialect").select("dialect", F.round("worst_rtf", 9).alias("worst_rtf"))


@query("q4_13_item_rtf", f"with {ITEMS} select item_id, round(wall_s / nullif(duration_s, 0), 9) as rtf from items")
def item_rtf(spark, d):
    return items(spark, d).select("item_id", F.round(R.real_time_factor("wall_s", "duration_s"), 9).alias("rtf"))


@query("q4_17_decide_canonical", f"""with {ITEMS}, bd as (select model, dialect, sum(cer * n_chars) / nullif(sum(n_chars) filter (where cer is not null), 0) as c from items group by 1, 2),
 w as (select model, sum(cer * n_chars) / nullif(sum(n_chars) filter (where cer is not null), 0) as c, max(wall_s / nullif(duration_s, 0)) as worst from items group by 1), b as (select c as base from w where model = 'm0'),
 g as (select bd.model, bool_or(bd.c > z.c) as regress from bd join bd z on z.dialect = bd.dialect and z.model = 'm0' group by 1)
 select w.model, round((base - c) / base, 9) as gain, regress, (base - c) / base >= 0.1 and not regress and worst <= 1.0 as promoted,
  concat_ws(';', case when (base - c) / base < 0.1 then 'gain' end, case when regress then 'regression' end, case when worst > 1.0 then 'speed' end) as reasons from w join g on g.model = w.model, b where w.model <> 'm0'""")
def decide(spark, d):
    return R.choose_model(items(spark, d), "m0").withColumn("gain", F.round("gain", 9))


@query("q4_18_long_audio_failures", f"with {ITEMS} select dialect, round(count(*) filter (where duration_s > 30 and cer is null) / cast(nullif(count(*) filter (where duration_s > 30), 0) as double), 9) as rate from items group by dialect")
def long_failures(spark, d):
    return R.failure_rate(items(spark, d), "dialect", F.col("duration_s") > 30, F.col("cer").isNull()).withColumn("rate", F.round("rate", 9))


@query("q4_20_mean_aligned_logprob", with_tables("words", " select media_id, round(sum((end_ms - start_ms) * ln(greatest(conf, 1e-12))) / sum(end_ms - start_ms), 9) as mean_logprob from words group by media_id"))
def logprob(spark, d):
    return R.mean_log_probability(T.words(spark, d), "media_id").withColumn("mean_logprob", F.round("mean_logprob", 9))


@query("q4_4_coverage", "select dialect, condition, coalesce(n, 0) as n_items, round(coalesce(h, 0), 9) as hours from (select * from (select distinct lang as dialect from documents) cross join (select distinct source as condition from documents)) g left join (select lang, source, count(*) as n, sum(n_chars) / cast(54000000 as double) as h from documents group by 1, 2) c on c.lang = g.dialect and c.source = g.condition")
def coverage(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("lang").alias("dialect"), F.col("source").alias("condition"), "n_chars")
    return R.coverage(docs, "dialect", "condition", F.col("n_chars") / 54000000).withColumn("hours", F.round("hours", 9))


@query("q4_5_missing_cells", "select dialect, condition from (select distinct lang as dialect from documents) cross join (select distinct source as condition from documents) where (dialect, condition) not in (select lang, source from documents where n_chars > 2000)")
def missing_cells(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("lang").alias("dialect"), F.col("source").alias("condition"), "n_chars")
    return R.missing_cells(docs, "dialect", "condition", F.col("n_chars") > 2000)


@query("q4_29_decide_judge", "with w as (select d.source, count(*) filter (where quality = 0) as shadow, count(*) filter (where quality = 1 and toxic = 0) as incumbent, count(*) as n from documents d join labels l using (doc_id) group by 1) select source, n, incumbent, shadow, case when n < 20 then 'too few' when shadow > incumbent then 'switch' else 'keep' end as decision from w")
def decide_judge(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels"), "doc_id")
    return R.switch_decision(j, "source", (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 0)


@query("q4_30_repeat_agreement", with_tables("spans", ", u as (select media_id, 'value' as metric, value as v from spans union all select media_id, 'length', (out_ms - in_ms) / 1000.0 from spans) select media_id, metric, round(avg(v), 8) as mean, round(stddev_pop(v), 8) as std, round(max(v) - min(v), 8) as spread from u group by 1, 2"))
def repeat_agreement(spark, d):
    got = R.repeat_agreement(T.spans(spark, d), "media_id", {"value": F.col("value"), "length": (F.col("out_ms") - F.col("in_ms")) / 1000.0})
    return got.select("media_id", "metric", *[F.round(c, 8).alias(c) for c in ("mean", "std", "spread")])


@query("q4_40_cluster_variance", "with c as (select source, lang, cast(count(*) as double) as n, cast(count(*) filter (where quality = 1) as double) as a from documents d join labels l using (doc_id) group by 1, 2), t as (select lang, sum(n) as tn, sum(a) / sum(n) as p, cast(count(*) as double) as k from c group by 1) select c.lang, round(min(k) / nullif(min(k) - 1, 0) * sum((a - p * n) * (a - p * n)) / (min(tn) * min(tn)), 12) as variance from c join t on t.lang = c.lang group by c.lang")
def cluster_variance(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "source", "lang").join(T.read(spark, d, "labels"), "doc_id")
    return R.cluster_variance(j, "lang", "source", F.col("quality") == 1).withColumn("variance", F.round("variance", 12))


@query("q4_42_acceptance_scorecard", "with a as (select lang, count(*) as n, count(*) filter (where l.doc_id is null) as refused, count(*) filter (where quality = 1) as accepted from documents d left join labels l using (doc_id) group by 1) select lang, n, round(refused / cast(n as double), 9) as refusal_rate, round(accepted / cast(n as double), 9) as first_pass_rate, round(1.96 * sqrt((accepted / cast(n as double)) * (1 - accepted / cast(n as double)) / n), 9) as margin from a")
def acceptance(spark, d):
    l = T.read(spark, d, "labels").withColumn("seen", F.lit(1))  # noqa: E741
    rows = T.read(spark, d, "documents").select("doc_id", "lang").join(l, "doc_id", "left")
    got = Y.acceptance(rows, "lang", F.col("seen").isNull(), F.col("quality") == 1)
    return got.withColumns({c: F.round(c, 9) for c in ("refusal_rate", "first_pass_rate", "margin")})


@query("q4_48_discovery_counts", with_tables("spans", " select event_type as path, count(*) as n, count(*) filter (where out_ms - in_ms between 30000 and 90000) as compliant from spans group by 1"))
def discovery_counts(spark, d):
    return R.span_compliance(T.spans(spark, d).withColumnRenamed("event_type", "path"), "path", "in_ms", "out_ms")


@query("q4_50_speaker_counts", with_tables("turns", " select media_id, count(*) as n_turns, count(distinct speaker) as n_speakers, cast(sum(end_ms - start_ms) as bigint) as speech_ms from turns group by 1"))
def speakers(spark, d):
    return R.speaker_counts(T.turns(spark, d), "media_id")


@query("q4_60_crop_jitter", with_tables("spans", ", s as (select media_id, event_id, in_ms, value - lag(value) over (partition by media_id order by in_ms, event_id) as step, value from spans), r as (select *, lag(step) over (partition by media_id order by in_ms, event_id) as prev from s) select media_id, count(*) filter (where step * prev < 0) as reversals, round(max(abs(step)), 6) as max_step, round(avg(abs(step)), 6) as mean_step, round(sum(abs(step)) - abs(sum(step)), 4) as oscillation from r group by 1"))
def jitter(spark, d):
    got = R.jitter(T.spans(spark, d), "media_id", ["in_ms", "event_id"], "value")
    return got.select("media_id", "reversals", F.round("max_step", 6).alias("max_step"), F.round("mean_step", 6).alias("mean_step"), F.round("oscillation", 4).alias("oscillation"))


@query("q4_61_upper_median", with_tables("spans", " select media_id, list_sort(list(value))[len(list(value)) // 2 + 1] as median_value from spans group by 1"))
def median(spark, d):
    return R.upper_median(T.spans(spark, d), "media_id", "value").withColumnRenamed("median", "median_value")


@query("q4_53_publishable_rate", "select source, round(coalesce(count(*) filter (where quality = 1) / cast(nullif(count(l.doc_id), 0) as double), 0.0), 9) as rate from documents d left join labels l using (doc_id) group by 1")
def publishable(spark, d):
    j = T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels"), "doc_id", "left")
    got = Y.share(j, "source", F.col("quality") == 1, F.col("quality").isNotNull())
    return got.select("source", F.round(F.coalesce("share", F.lit(0.0)), 9).alias("rate"))


@query("q8_20_cost", "select conv_id, turn, round(length(text) / 1e6 * 2 * case when turn % 2 = 0 then 0.1 else 1.0 end * case when turn % 3 = 0 then 0.5 else 1.0 end, 12) as usd, cast(length(text) * 300 as bigint) as video_tokens from conversations")
def cost(spark, d):
    c = T.read(spark, d, "conversations").withColumn("n", F.length("text"))
    return c.select("conv_id", "turn", F.round(N.token_cost("n", F.col("turn") % 3 == 0, F.col("turn") % 2 == 0), 12).alias("usd"), N.video_tokens("n").alias("video_tokens"))


@query("q4_37_cost_per_source_hour", with_tables("turns", ", c as (select conv_id as media_id, sum(length(text)) / 1e6 * 2 as usd from conversations group by 1), h as (select media_id, sum(end_ms - start_ms) / 3600000.0 as hours from turns group by 1) select h.media_id, round(usd / cast(hours as double), 9) as usd_per_hour from h join c on c.media_id = h.media_id"))
def cost_per_hour(spark, d):
    costs = T.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("media_id")).agg(N.token_cost(F.sum(F.length("text"))).alias("usd"))
    return Y.per_source_hour(costs, T.turns(spark, d), "media_id", "usd").select("media_id", F.round("per_hour", 9).alias("usd_per_hour"))