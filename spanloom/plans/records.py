"""Queries over contracts, curation, ledgers and record files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.functions import numbers as N
from spanloom.functions import text as X
from spanloom.operators import contracts as K
from spanloom.operators import reports as R
from spanloom.operators import rules as W
from spanloom.operators import scorecards as Y
from spanloom.operators import curation as U
from spanloom.operators import diarization as D
from spanloom.plans.text import SENTENCES, sentences
from spanloom.scratch import Scratch
from spanloom.sources import files as I
from spanloom.streaming import ledgers as L
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def joined(col="reasons"):
    return F.array_join(col, ";").alias(col)


@query("q2_2_word_contract", with_tables("words", " select media_id, pos, concat_ws(';', case when length(w) > 12 then 'long' end, case when end_ms <= start_ms then 'ends before it starts' end, case when conf < 0.6 then 'low confidence' end, case when regexp_matches(w, '[#|*]') then 'symbols' end) as reasons from words"))
def word_contract(spark, d):
    rules = {"long": F.length("w") > 12, "ends before it starts": F.col("end_ms") <= F.col("start_ms"), "low confidence": F.col("conf") < 0.6, "symbols": F.col("w").rlike("[#|*]")}
    return K.with_reasons(T.words(spark, d), rules).select("media_id", "pos", joined())


@query("q2_3_words_in_order", with_tables("words", " select media_id, count(*) filter (where b > start_ms) as n_overlapping, count(*) as n from (select *, lag(end_ms) over (partition by media_id order by start_ms, end_ms) as b from words) group by 1"))
def words_in_order(spark, d):
    w = T.words(spark, d).withColumn("bad", K.overlap_rule("media_id", "start_ms", "end_ms"))
    return w.groupBy("media_id").agg(F.count_if("bad").alias("n_overlapping"), F.count("*").alias("n"))


@query("q2_4_turn_contract", with_tables("turns", " select media_id, turn, concat_ws(';', case when not regexp_matches(speaker, '^[a-r]+$') then 'bad label' end, case when end_ms <= start_ms then 'ends before it starts' end) as reasons from turns"))
def turn_contract(spark, d):
    rules = {"bad label": ~F.col("speaker").rlike("^[a-r]+$"), "ends before it starts": F.col("end_ms") <= F.col("start_ms")}
    return K.with_reasons(T.turns(spark, d), rules).select("media_id", "turn", joined())


@query("q2_5_segment_contract", with_tables("words", ", s as (select media_id, pos // 20 as seg, avg(ln(conf)) as lp from words group by 1, 2) select media_id, seg, lp <= 0 and not isnan(lp) as valid from s"))
def segment_contract(spark, d):
    s = R.segment_scores(T.words(spark, d), "media_id", F.expr("pos div 20"))
    return s.select("media_id", "seg", W.is_log_probability("lp").alias("valid"))


@query("q2_15_run_event_contract", with_tables("spans", " select event_id, concat_ws(';', case when event_type = 'purchase' and value < 10 then 'billed without cost' end, case when event_type = 'error' and value > 100 then 'skipped without reason' end, case when event_type not in ('purchase', 'error', 'click', 'view') then 'unknown state' end) as reasons from spans"))
def run_event_contract(spark, d):
    e, v = F.col("event_type"), F.col("value")
    return K.with_reasons(T.spans(spark, d), {"billed without cost": (e == "purchase") & (v < 10), "skipped without reason": (e == "error") & (v > 100), "unknown state": ~e.isin("purchase", "error", "click", "view")}).select("event_id", joined())


@query("q2_1_corpus_item_contract", "select doc_id, concat_ws(';', case when lang = 'en' and source = 'src0' then 'dialect needs conditions' end, case when n_chars < 200 then 'too short' end, case when toxic = 1 and quality = 0 then 'labels disagree' end) as reasons from documents left join labels using (doc_id)")
def item_contract(spark, d):
    j = T.read(spark, d, "documents").join(T.read(spark, d, "labels"), "doc_id", "left")
    return K.with_reasons(j, {"dialect needs conditions": (F.col("lang") == "en") & (F.col("source") == "src0"), "too short": F.col("n_chars") < 200, "labels disagree": (F.col("toxic") == 1) & (F.col("quality") == 0)}).select("doc_id", joined())


@query("q2_19_rejected_rows", with_tables("spans", ", r as (select event_id, event_type, concat_ws(';', case when out_ms - in_ms < 30000 then 'too short' end, case when out_ms - in_ms > 90000 then 'too long' end, case when in_ms < 60000 then 'too early' end) as reasons from spans) select event_type, reasons, count(*) as n from r where reasons <> '' group by 1, 2"))
def rejected_rows(spark, d):
    ms = F.col("out_ms") - F.col("in_ms")
    _, bad = K.split(K.with_reasons(T.spans(spark, d), {"too short": ms < 30000, "too long": ms > 90000, "too early": F.col("in_ms") < 60000}))
    return bad.groupBy("event_type", joined()).agg(F.count("*").alias("n"))


@query("q2_20_cited_times", r"with t as (select event_id, format('at {:d}:{:02d} and {}s, then {}ms', event_id // 60 % 50, event_id % 60, event_id % 1000, event_id % 777) as label from events) select event_id, concat_ws(',', (event_id // 60 % 50 * 60 + event_id % 60) * 1000, event_id % 777, event_id % 1000 * 1000) as times from t")
def cited_times(spark, d):
    e = T.read(spark, d, "events").select("event_id", F.format_string("at %d:%02d and %ds, then %dms", F.expr("event_id div 60 % 50"), F.col("event_id") % 60, F.col("event_id") % 1000, F.col("event_id") % 777).alias("label"))
    return e.select("event_id", F.array_join(X.cited_times("label").cast("array<string>"), ",").alias("times"))


@query("q2_22_json_fields", "select event_id, case when json_keys(props)[1] = 'k' and len(json_keys(props)) = 1 then '' else 'k' end as missing, array_to_string(list_filter(json_keys(props), lambda x: x <> 'k'), ',') as extra from events")
def json_fields(spark, d):
    missing, extra = K.json_keys("props", ["k"])
    return T.read(spark, d, "events").select("event_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


@query("q2_25_asr_ceiling", with_tables("spans", " select media_id, count(*) as n_long, max(out_ms - in_ms) as longest_ms from spans where out_ms - in_ms > 40000 group by 1"))
def ceiling(spark, d):
    return W.over_ceiling(T.spans(spark, d), "media_id", "in_ms", "out_ms", 40000)


@query("q2_33_media_id", "select page_id, regexp_matches(url, '^https?://[a-z0-9.]+/[a-z]{2}/[0-9]+$') as safe from pages")
def media_id(spark, d):
    return T.read(spark, d, "pages").select("page_id", W.safe_key("url", "https?://[a-z0-9.]+/[a-z]{2}/[0-9]+").alias("safe"))


@query("q2_43_resolve_role", "with reg as (select * from (values ('src0', 'asr'), ('src1', 'judge'), ('src2', 'embed')) t(name, role)), den as (select * from (values ('src3'), ('src4')) t(name)) select doc_id, case when den.name is not null then 'denied' when reg.name is null then 'unknown' else role end as status from documents d left join reg on reg.name = d.source left join den on den.name = d.source")
def resolve_role(spark, d):
    allowed = spark.createDataFrame([("src0", "asr"), ("src1", "judge"), ("src2", "embed")], "name string, role string")
    denied = spark.createDataFrame([("src3",), ("src4",)], "name string")
    return K.resolve(T.read(spark, d, "documents").select("doc_id", "source"), "source", allowed, denied).select("doc_id", "status")


@query("q2_48_effective_configuration", "select doc_id, coalesce(case when doc_id % 7 = 0 then 11 end, case when source = 'src1' then 22 end, case lang when 'en' then 33 when 'de' then 44 end, 55) as min_clip, case when doc_id % 7 = 0 then 'explicit' when source = 'src1' then 'preset' when lang in ('en', 'de') then 'type' else 'default' end as provenance from documents")
def configuration(spark, d):
    by_type = F.when(F.col("lang") == "en", 33).when(F.col("lang") == "de", 44)
    value, source = K.precedence(("explicit", F.when(F.col("doc_id") % 7 == 0, 11)), ("preset", F.when(F.col("source") == "src1", 22)), ("type", by_type), ("default", F.lit(55)))
    return T.read(spark, d, "documents").select("doc_id", value.alias("min_clip"), source.alias("provenance"))


@query("q2_47_content_profile", "select doc_id, coalesce(p.least, 30000) as least_ms from documents d left join (values ('en', 20000), ('fr', 25000), ('de', 30000), ('es', 35000)) p(lang, least) on p.lang = d.lang")
def profile(spark, d):
    least = {"en": 20000, "fr": 25000, "de": 30000, "es": 35000}
    return W.profile(T.read(spark, d, "documents"), "lang", least, 30000, "least_ms").select("doc_id", "least_ms")


@query("q2_49_validate_ratings", "with e as (select doc_id from documents), r as (select doc_id, quality + toxic as score from labels) select coalesce(e.doc_id, r.doc_id) as doc_id, case when e.doc_id is null then 'unexpected' when r.doc_id is null then 'missing' when score not between 1 and 5 then 'out of range' else 'ok' end as outcome from e full outer join r on e.doc_id = r.doc_id")
def ratings(spark, d):
    rated = T.read(spark, d, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("score"))
    return W.rating_outcomes(T.read(spark, d, "documents"), rated, "doc_id", "score")


DIGEST = "sha256('sample' || chr(0) || cast(doc_id as varchar))"


@query("q7_3_rank_digest", f"select doc_id, {DIGEST} as digest from documents")
def rank_digest(spark, d):
    return T.read(spark, d, "documents").select("doc_id", U.rank_digest("sample", "doc_id").alias("digest"))


@query("q7_2_stratified_sample", f"select lang, doc_id, place from (select lang, doc_id, row_number() over (partition by lang order by {DIGEST}, doc_id) as place from documents) where place <= 20")
def sample(spark, d):
    return U.stratified_sample(T.read(spark, d, "documents"), "lang", "doc_id", 20, "sample").select("lang", "doc_id", "place")


@query("q7_4_freeze_study", "with h as (select doc_id, lang, sha256('s' || chr(0) || cast(doc_id as varchar)) as x, sha256('s-split' || chr(0) || cast(doc_id as varchar)) as y, sha256('s-review' || chr(0) || cast(doc_id as varchar)) as z from documents) select doc_id, case when row_number() over (partition by lang order by y, doc_id) <= greatest(1, cast(floor(count(*) over (partition by lang) * cast(0.2 as double)) as bigint)) then 'holdout' else 'training' end as split, case when strpos('02468ace', right(x, 1)) > 0 then 'first' else 'second' end as option_a, left(z, 16) as review_id from h")
def freeze(spark, d):
    return U.freeze_study(T.read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", "s").select("doc_id", "split", "option_a", "review_id")


def _graph(spark, d):
    s = T.spans(spark, d)
    speaker = F.expr("media_id div 3") + F.when(F.col("value") > 200, 1).otherwise(0)
    return s.select("event_id", F.col("media_id").alias("episode"), speaker.alias("speaker"))


@query("q7_5_partition_disjoint")
def disjoint(spark, d):
    return U.disjoint_split(_graph(spark, d), "episode", "speaker").select("event_id", "episode", "speaker", "split")


@query("q3_28_acceptance_split", "select 0 as n_shared")
def acceptance_split(spark, d):
    rows = Scratch(spark, "split").save(disjoint(spark, d))
    return U.leaks(rows.where("split = 'training'"), rows.where("split = 'holdout'"), ["episode", "speaker"]).agg(F.count("*").cast("int").alias("n_shared"))


@query("q3_27_holdout_leakage", "select 'source' as key, source as value from (select source from documents where lang = 'en' intersect select source from documents where lang = 'es') union all select 'n_chars', cast(n_chars as varchar) from (select n_chars from documents where lang = 'en' intersect select n_chars from documents where lang = 'es')")
def leakage(spark, d):
    docs = T.read(spark, d, "documents")
    return U.leaks(docs.where("lang = 'en'"), docs.where("lang = 'es'"), ["source", "n_chars"])


@query("q4_22_diarization_error")
def der(spark, d):
    ref = T.turns(spark, d).select("media_id", "speaker", "start_ms", "end_ms")
    hyp = T.turns(spark, d).where("turn % 5 <> 4").select("media_id", F.when(F.col("turn") % 3 == 0, "s1").otherwise(F.concat(F.lit("x"), "speaker")).alias("speaker"), (F.col("start_ms") + 300).alias("start_ms"), (F.col("end_ms") + 200).alias("end_ms"))
    return D.error(ref, hyp).withColumn("der", F.round("der", 9))


LEDGER = ", led as (select media_id as run_id, event_id, event_type as stage, value, row_number() over (partition by media_id order by in_ms, event_id) as sequence from spans)"


def ledger(spark, d):
    s = T.spans(spark, d).select(F.col("media_id").alias("run_id"), "event_id", F.col("event_type").alias("stage"), "value", "in_ms")
    return L.stamp(s, "run_id", ["in_ms", "event_id"])


@query("q1_11_read_events_prefix", with_tables("spans", LEDGER + ", b as (select run_id, min(sequence) as bad from led where value > 300 group by 1) select l.run_id, count(*) as n_read, max(sequence) as last_sequence from led l left join b on b.run_id = l.run_id where bad is null or sequence < bad group by 1"))
def prefix(spark, d):
    """Ledger files, torn where the value is over 300, read up to the first torn line of each."""
    got = read_ledgers(spark, d, F.col("value") > 300, "event_id long, stage string, value double, sequence long")
    return got.groupBy("run_id").agg(F.count("*").alias("n_read"), F.max("sequence").alias("last_sequence"))


def read_ledgers(spark, d, torn, schema):
    """The ledger of each run written to a file of JSON lines, torn where `torn` holds, and read from there: run_id and the records of its good prefix."""
    text = F.to_json(F.struct("event_id", "stage", "value", "sequence"))
    lines = ledger(spark, d).select("run_id", "sequence", F.when(torn, F.substring(text, 1, 15)).otherwise(text).alias("value"))
    root = f"{Scratch(spark, 'ledgers').root}/files"
    lines.repartition("run_id").sortWithinPartitions("run_id", "sequence").select("run_id", "value").write.partitionBy("run_id").text(root)
    got = I.good_prefix(I.numbered_lines(spark, root), schema)
    return got.withColumn("run_id", F.regexp_extract("file", "run_id=(-?[0-9]+)", 1).cast("long"))


@query("q5_57_current_judge", with_tables("spans", LEDGER + " select run_id, arg_max(stage, sequence) as stage from led group by 1"))
def current(spark, d):
    return L.current(ledger(spark, d), "run_id", "stage", "none")


@query("q5_58_rollback_judge", with_tables("spans", LEDGER + ", r as (select *, lag(stage) over (partition by run_id order by sequence) as v from led) select run_id, max(sequence) + 1 as sequence, arg_max(v, sequence) as stage from r group by 1 having arg_max(v, sequence) is not null"))
def rollback(spark, d):
    return L.rollback(ledger(spark, d), "run_id", "stage")


@query("q5_60_record_delta", with_tables("spans", LEDGER + ", o as (select * from led where stage <> 'click'), n as (select run_id, event_id, sequence as s from led where stage = 'click'), l as (select run_id, max(sequence) as m from o group by 1) select n.run_id, n.event_id, coalesce(m, 0) + row_number() over (partition by n.run_id order by s) as sequence from n left join l on l.run_id = n.run_id"))
def record_delta(spark, d):
    rows = ledger(spark, d)
    fresh = rows.where("stage = 'click'").withColumnRenamed("sequence", "s")
    return L.stamp(fresh, "run_id", ["s"], rows.where("stage <> 'click'")).select("run_id", "event_id", "sequence")


@query("q4_46_run_costs", with_tables("spans", LEDGER + " select run_id, stage, cast(sum(cast(floor(value) as bigint)) as bigint) as tokens, round(sum(floor(value)) / 1e6 * 2, 9) as usd, count(*) as n from led where stage in ('purchase', 'click') group by 1, 2"))
def run_costs(spark, d):
    billed = ledger(spark, d).where("stage in ('purchase', 'click')")
    return Y.stage_costs(billed, "run_id", "stage", F.floor("value")).withColumn("usd", F.round("usd", 9))


@query("q5_55_explain_run_state", with_tables("spans", LEDGER + " select run_id, arg_min('v' || cast(event_id as varchar), sequence) as reason, 'error' as stage from led where stage = 'error' group by 1"))
def explain_state(spark, d):
    s = ledger(spark, d).select("run_id", "stage", "sequence", F.when(F.col("stage") == "error", "skipped").otherwise("done").alias("state"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("reason"))
    return L.first_skipped(s, "run_id", "sequence")


@query("q4_52_run_complete", with_tables("spans", LEDGER + " select run_id, count(distinct stage) = 5 as complete, count(*) filter (where stage = 'error') as n_skipped from led group by 1"))
def complete(spark, d):
    return Y.run_complete(ledger(spark, d), "run_id", "stage", 5, F.col("stage") == "error")


@query("q4_47_rejected_by_path", with_tables("spans", ", p as (select distinct media_id, event_type as path from spans), r as (select media_id, event_type as path, count(*) as n from spans where value > 60 group by 1, 2) select p.media_id, p.path, coalesce(n, 0) as n_rejected from p left join r on r.media_id = p.media_id and r.path = p.path"))
def rejected_by_path(spark, d):
    s = T.spans(spark, d).withColumnRenamed("event_type", "path")
    return R.rejected_by_path(s, s.where("value > 60"), ["media_id", "path"])


@query("q9_10_streamed_windows", "select cast(date_trunc('day', ts) as timestamp) as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def streamed(spark, d):
    """Daily counts of the event stream, run as a stream over what is there, then read from its sink."""
    scratch = Scratch(spark, "stream")
    source = T.read(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))
    counts = L.windowed_counts(stream, "at", "1 day", "event_type", late="40 days")
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{scratch.root}/out")).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{scratch.root}/out")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("q1_18_parse_srt", with_tables("words", SENTENCES + " select media_id, row_number() over (partition by media_id order by start_ms, sent_id) as cue, start_ms, end_ms from sent where complete"))
def parse_srt(spark, d):
    """Subtitles written from the sentences, and read again."""
    n = sentences(spark, d).where("complete").withColumn("k", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "sent_id")))
    cue = F.concat(F.col("k").cast("string"), F.lit("\n"), N.srt_time("start_ms"), F.lit(" --> "), N.srt_time("end_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    files = n.select("media_id", F.struct("k", cue.alias("cue")).alias("c")).groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cue"]), "\n").alias("srt"))
    return I.srt_cues(files, "media_id", "srt").where(F.size("reasons") == 0).select("media_id", F.col("cue").cast("long").alias("cue"), "start_ms", "end_ms")


@query("q1_19_parse_dialogue", with_tables("spans", " select event_id, in_ms // 10 * 10 as start_ms, out_ms // 10 * 10 as end_ms from spans"))
def parse_dialogue(spark, d):
    clock = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(F.col(c) / 3600000), F.floor(F.col(c) / 60000) % 60, F.floor(F.col(c) / 1000) % 60, F.floor(F.col(c) / 10) % 100)
    lines = T.spans(spark, d).select("event_id", F.concat(F.lit("Dialogue: 0,"), clock("in_ms"), F.lit(","), clock("out_ms"), F.lit(",Main,,0,0,0,,"), F.col("event_type")).alias("line"))
    return I.dialogue_times(lines).select("event_id", "start_ms", "end_ms")


@query("q1_21_parse_loudness", with_tables("spans", " select event_id, round(-value, 2) as integrated, -value between -24 and -15 as ok from spans"))
def parse_loudness(spark, d):
    log = F.concat(F.lit("  I: -70.0 LUFS\n  I: "), (-F.round("value", 2)).cast("string"), F.lit(" LUFS\n  Peak: -1.5 dBFS"))
    got = I.loudness(F.col("log"))
    return T.spans(spark, d).select("event_id", log.alias("log")).select("event_id", got["integrated"].alias("integrated"), got["ok"].alias("ok"))


@query("q1_22_silence_intervals", with_tables("spans", " select media_id, in_ms as start_ms, out_ms as end_ms from spans where event_type = 'view'"))
def silence_intervals(spark, d):
    s = T.spans(spark, d).where("event_type = 'view'")
    sec = lambda c: F.format_string("%.3f", F.col(c) / 1000)
    two = s.select("media_id", F.explode(F.array(F.struct((F.col("event_id") * 2).alias("pos"), F.concat(F.lit("[x] silence_start: "), sec("in_ms")).alias("line")), F.struct((F.col("event_id") * 2 + 1).alias("pos"), F.concat(F.lit("[x] silence_end: "), sec("out_ms"), F.lit(" | silence_duration: 1")).alias("line")))).alias("l")).select("media_id", "l.*")
    return I.silence_intervals(two, "media_id")


@query("q1_4_human_confirmed", "select doc_id, coalesce(case when doc_id % 4 = 0 then false when doc_id % 4 = 1 then true end, true) and (coalesce(quality = 1, false) or coalesce(toxic = 1, false) or (n_chars > 1000 and (doc_id % 4 = 1 or coalesce(doc_id % 5 = 0, false)))) as confirmed from documents left join labels using (doc_id)")
def confirmed(spark, d):
    j = T.read(spark, d, "documents").join(T.read(spark, d, "labels"), "doc_id", "left")
    exported = F.when(F.col("doc_id") % 4 == 0, False).when(F.col("doc_id") % 4 == 1, True)
    return j.select("doc_id", I.human_confirmed(exported, F.col("quality") == 1, F.col("toxic") == 1, F.when(F.col("n_chars") > 1000, F.lit("x")), F.col("doc_id") % 5 == 0).alias("confirmed"))


@query("q1_2_read_durations", with_tables("spans", " select cast(media_id as varchar) as clip, round(arg_max(out_ms - in_ms, event_id) / 1000.0, 3) as seconds from spans group by 1"))
def read_durations(spark, d):
    rows = T.spans(spark, d).select(F.col("media_id").cast("string").alias("clip"), (F.col("out_ms") - F.col("in_ms")).cast("string").alias("duration[ms]"), "event_id")
    return I.durations(rows, "event_id").select("clip", F.round("seconds", 3).alias("seconds"))


@query("q1_1_import_voice_corpus", "with x as (select doc_id, lang, text, (doc_id % 11 = 0) as no_dur from documents), r as (select case when trim(text) = '' then 'no text or path' when lang not in ('en') then 'other locale' || case when no_dur then ';no duration' else '' end when no_dur then 'no duration' else '' end as reasons from x) select reasons, count(*) as n from r group by 1")
def import_corpus(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("sentence"), F.col("lang").alias("locale"), "doc_id")
    seconds = docs.where("doc_id % 11 <> 0").select(F.col("path").alias("clip"), (F.length("sentence") / 15).alias("seconds"))
    good, bad = I.voice_corpus(docs, seconds, "en")
    return good.select(F.lit("").alias("reasons")).unionByName(bad.select(joined())).groupBy("reasons").agg(F.count("*").alias("n"))


@query("q8_24_srt_time", with_tables("spans", " select event_id, format('{:02d}:{:02d}:{:02d},{:03d}', out_ms // 3600000, out_ms // 60000 % 60, out_ms // 1000 % 60, out_ms % 1000) as t from spans"))
def srt_time(spark, d):
    return T.spans(spark, d).select("event_id", N.srt_time("out_ms").alias("t"))


@query("q8_25_timecode", with_tables("spans", ", f as (select event_id, cast(round_even(out_ms * 25.0 / 1000, 0) as bigint) as n from spans) select event_id, format('{:02d}:{:02d}:{:02d}:{:02d}', n // 90000, n // 1500 % 60, n // 25 % 60, n % 25) as tc from f"))
def timecode(spark, d):
    return T.spans(spark, d).select("event_id", N.timecode("out_ms", 25.0).alias("tc"))


@query("q8_26_ms_to_frames", with_tables("spans", " select event_id, cast(round_even(out_ms * 30.0 / 1000, 0) as bigint) as frames from spans"))
def frames(spark, d):
    return T.spans(spark, d).select("event_id", N.frames("out_ms", 30.0).alias("frames"))
