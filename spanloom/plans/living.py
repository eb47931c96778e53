"""Queries over streams that keep state, sinks that may be repeated, and runs that redo only what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.operators import rules as U
from spanloom.operators import selection as S
from spanloom.plans.records import LEDGER, ledger
from spanloom.plans.serial import LATE_SPANS
from spanloom.scratch import Scratch
from spanloom.streaming import incremental as N
from spanloom.streaming import runs as R
from spanloom.streaming import sinks as K
from spanloom.tables import with_tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Event time as milliseconds, whatever zone the session is in.
AT_MS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
SLICES, IDLE_MS, LATE, LATE_MS = 3, 86_400_000, "10 minutes", 600_000


def in_slices(spark, d, scratch, start, twice="false"):
    """Run a stream over the events, slice after slice of their time, stopped and started again in between.

    start: the query over a stream of the slices' folder, with the events' columns and `at`. twice: rows that arrive
    two times.
    """
    events = T.read(spark, d, "events").withColumn("at", F.expr(f"timestamp_millis({AT_MS})"))
    lo, hi = events.agg(F.min("at"), F.max("at")).first()
    if lo is None:
        lo = hi = 0
    place = F.when(F.lit(lo) == F.lit(hi), 0).otherwise(F.floor((F.col("at").cast("double") - F.lit(lo).cast("double")) / (F.lit(hi).cast("double") - F.lit(lo).cast("double")) * SLICES))
    folder = f"{scratch.root}/in"
    for k in range(SLICES):
        part = events.where(F.least(place, F.lit(SLICES - 1)) == k)
        part.unionByName(part.where(twice)).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        start(stream).trigger(availableNow=True).option("checkpointLocation", f"{scratch.root}/state").start().awaitTermination()


@query("q9_1_run_event_log", f"""with e as (select user_id as run_id, event_id, epoch_us(ts) // 1000 as at_ms, 's' || event_id % 2 as stage, case event_type when 'view' then 'started' when 'click' then 'completed' when 'error' then 'skipped' else 'billed' end as state from events),
 q as (select *, row_number() over (partition by run_id order by at_ms, event_id) as sequence from e),
 o as (select *, lag(at_ms) over w as a0, lag(state) over w as s0, lead(at_ms) over w as a1 from q where state <> 'billed' window w as (partition by run_id, stage order by at_ms, event_id)),
 p as (select *, coalesce(s0 = 'started' and at_ms - a0 <= {IDLE_MS}, false) as open from o)
 select run_id, event_id, sequence, at_ms, stage, state, case when open and state <> 'started' then at_ms - a0 end as elapsed_ms,
   case when state = 'started' and open then 'reopened' when state <> 'started' and not open then 'not open' end as note from p
 union all select run_id, event_id, sequence, at_ms, stage, state, null, null from q where state = 'billed'
 union all select run_id, null, sequence, at_ms + {IDLE_MS}, stage, 'lost', {IDLE_MS}, 'never ended' from p
   where state = 'started' and coalesce(a1 - at_ms > {IDLE_MS}, at_ms + {IDLE_MS} < (select max(at_ms) - {LATE_MS} from e))""")
def run_event_log(spark, d):
    """The log of every run, kept by a stream in three slices of time with restarts, read from its committed batches."""
    scratch = Scratch(spark, "run_log")
    state = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "skipped").otherwise("billed")
    sink = K.Delivery(f"{scratch.root}/out", {"log": lambda b: b})

    def start(stream):
        events = stream.select(F.col("user_id").alias("run_id"), "event_id", "at", F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("stage"), state.alias("state"))
        return R.run_log(events, IDLE_MS, LATE).writeStream.foreachBatch(sink)

    with R.keyed_state(spark):
        in_slices(spark, d, scratch, start)
    return K.delivered(spark, f"{scratch.root}/out", "log", R.OUTPUT)


@query("q10_9_event_stream", "select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids, count(*) as n_counted from events group by 1")
def event_stream(spark, d):
    """The event stream, a tenth of it arriving twice, delivered once each to two tables: the events, and counts of each batch."""
    scratch = Scratch(spark, "events")
    sink = K.Delivery(f"{scratch.root}/out", {"events": lambda b: b.select("event_id", "event_type", "value"), "counts": lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"))})
    in_slices(spark, d, scratch, lambda s: s.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["event_id"]).writeStream.foreachBatch(sink), "event_id % 10 = 0")
    events = K.delivered(spark, f"{scratch.root}/out", "events", "event_id long, event_type string, value double")
    counts = K.delivered(spark, f"{scratch.root}/out", "counts", "event_type string, n long")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).join(counts.groupBy("event_type").agg(F.sum("n").alias("n_counted")), "event_type")


@query("q1_10_event_sink", with_tables("spans", LEDGER + " select run_id, stage, count(*) as n, max(sequence) as last_sequence from led group by 1, 2"))
def event_sink(spark, d):
    """Events appended as JSON lines in two batches, the second of them twice, and read again from what was committed."""
    rows, scratch = ledger(spark, d), Scratch(spark, "sink")
    sink = K.Delivery(f"{scratch.root}/out", {"events": lambda b: b}, "json")
    for part in (0, 1, 1):
        sink(rows.where(F.col("event_id") % 2 == part), part)
    back = K.delivered(spark, f"{scratch.root}/out", "events", rows.schema, "json")
    return back.groupBy("run_id", "stage").agg(F.count("*").alias("n"), F.max("sequence").alias("last_sequence"))


# Runs that redo what changed: a first run sees the tables as they were, a second one as they are.


@query("q9_2_embedding_cache", "select case when label = 0 then 'miss' when label = 1 then 'stale' else 'hit' end as outcome, count(*) as n, cast(sum(len(list_filter(embedding, lambda x: x > 0))) as bigint) as positive from embeddings group by 1")
def embedding_cache(spark, d):
    """Features of vectors by content; a first run had no vectors of one label, and other values for another."""
    cache = N.Cache(spark, f"{Scratch(spark, 'vectors').root}/cache", ["vec_id"], "digest", "positive long")

    def want(vectors):
        content = F.concat_ws(",", F.lit("model r1"), F.col("label").cast("string"), F.col("embedding").cast("array<string>"))
        return vectors.withColumn("digest", F.sha2(content, 256))

    def compute(vectors):
        return vectors.withColumn("positive", F.size(F.filter("embedding", lambda x: x > 0)).cast("long"))

    now = T.read(spark, d, "embeddings")
    then = now.where("label <> 0").withColumn("embedding", F.when(F.col("label") == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    cache.fill(want(then), compute)
    return cache.fill(want(now), compute).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("positive").alias("positive"))


@query("q9_5_extract_once", r"select page_id, case when contains(url, '?') then 'miss' when contains(html, '&amp;') then 'stale' else 'hit' end as outcome, length(regexp_replace(html, '<[^>]*>', '', 'g')) as text_chars from pages")
def extract_once(spark, d):
    """Text lengths of pages, made again where source, command or size differ; a first crawl had no pages with a query, and no entities."""
    cache = N.Cache(spark, f"{Scratch(spark, 'extract').root}/cache", ["page_id"], "digest", "text_chars long")

    def want(pages):
        return pages.withColumn("digest", F.sha2(F.concat_ws("|", F.sha2("html", 256), F.lit("extract --text"), F.length("html").cast("string")), 256))

    def compute(pages):
        return pages.withColumn("text_chars", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long"))

    now = T.read(spark, d, "pages").select("page_id", "url", "html")
    then = now.where(~F.contains("url", F.lit("?"))).withColumn("html", F.replace("html", F.lit("&amp;"), F.lit("&")))
    cache.fill(want(then), compute)
    return cache.fill(want(now), compute).select("page_id", "outcome", "text_chars")


@query("q9_6_reusable_raw", "select doc_id, case when n_chars < 400 then 'miss' when contains(text, '|') then 'stale' else 'hit' end as outcome, n_chars >= 400 and not contains(text, '|') and source <> 'src0' as reusable from documents")
def reusable_raw(spark, d):
    """A stored transcript is used again if source and producer are the same and what is stored is intact.

    Short texts were not there, some had no bars yet, and what one source stored has been damaged since.
    """
    cache = N.Cache(spark, f"{Scratch(spark, 'raw').root}/cache", ["doc_id", "source"], "digest", "held string")
    now = T.read(spark, d, "documents").select("doc_id", "source", "text", "n_chars")
    then = now.where("n_chars >= 400").withColumn("text", F.replace("text", F.lit("|"), F.lit("/")))
    want = lambda docs: docs.withColumn("digest", F.sha2("text", 256))
    damaged = F.when(F.col("source") == "src0", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    cache.fill(want(then), lambda docs: docs.withColumn("held", damaged))
    out = cache.fill(want(now), lambda docs: docs.withColumn("held", F.col("text")))
    good = U.intact(out.select("doc_id", "held"), out.select("doc_id", "digest"), "doc_id", "held")
    return out.join(good, "doc_id", "left").select("doc_id", "outcome", ((F.col("outcome") == "hit") & F.coalesce("intact", F.lit(False))).alias("reusable"))


@query("q9_3_stage_complete", with_tables("spans", ", s as (select media_id as run, event_type as stage, count(*) as n, max(value) as m from spans group by 1, 2) select run, stage, m <= 60 as complete from s"))
def stage_complete(spark, d):
    """Which stages of which runs are done: all that was read then is what there is now, under the same producer. A first run saw no event over 60."""
    events = T.spans(spark, d).withColumn("part", F.concat_ws("/", F.col("media_id").cast("string"), "event_type")).select("part", "event_id", "value", "in_ms")
    stage = N.Stage(spark, f"{Scratch(spark, 'stages').root}/stages", "part", "part string", "producer v1")
    stage.run(events.where("value <= 60"), lambda rows: rows.select("part").limit(0))
    part = F.split("part", "/")
    return stage.outcomes(events).select(part[0].cast("long").alias("run"), part[1].alias("stage"), (F.col("outcome") == "hit").alias("complete"))


_DAY = "strftime(ts, '%Y-%m-%d')"
_NEW = "(day(ts) % 2 = 1 and event_type = 'purchase')"


@query("q9_4_save_checkpoint", f"with e as (select *, {_DAY} as day, {_DAY} = (select max({_DAY}) from events) as last from events) select day, case when bool_or(last) then 'miss' when bool_or({_NEW}) then 'stale' else 'hit' end as outcome, count(*) as n, cast(sum(event_id) as bigint) as ids, case when bool_or(last or {_NEW}) then 2 else 1 end as run from e group by day")
def save_checkpoint(spark, d):
    """Daily counts under a manifest: the second run has one more day, and purchases that came late to odd days; it makes these days only."""
    stage = N.Stage(spark, f"{Scratch(spark, 'days').root}/days", "day", "day string, n long, ids long", "counts v1")
    events = T.read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last = events.agg(F.max("day").alias("_last"))
    then = events.join(F.broadcast(last), F.col("day") < F.col("_last")).drop("_last").where(~((F.dayofmonth("ts") % 2 == 1) & (F.col("event_type") == "purchase")))
    compute = lambda rows: rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    stage.run(then, compute)
    state = stage.run(events, compute)
    return stage.table().join(state.select("day", "outcome"), "day").join(stage.manifest().select("day", F.col("run").cast("int").alias("run")), "day")


@query("q9_7_cached_votes")
def cached_votes(spark, d):
    """Votes kept by bucket of recordings; the second run votes only where spans came since, and reads the others as the first run wrote them."""
    runs = T.spans(spark, d).select(F.col("event_id").alias("candidate_id"), "media_id", F.col("event_type").alias("run"), "in_ms", "out_ms", F.col("value").alias("score"), (F.col("media_id") % 16).alias("bucket"))
    stage = N.Stage(spark, f"{Scratch(spark, 'votes').root}/votes", "bucket", "bucket long, media_id long, leader_id long, votes long, mean_score double, rank int", "iou 0.6, 2 votes")

    def compute(rows):
        return S.vote(rows.drop("bucket"), 0.6, 2).withColumn("bucket", F.col("media_id") % 16)

    stage.run(runs.where(F.expr("not (" + LATE_SPANS.replace("value", "score") + ")")), compute)
    state = stage.run(runs, compute)
    return stage.table().join(state.select("bucket", "outcome"), "bucket").select("media_id", "outcome", "leader_id", "votes", F.round("mean_score", 6).alias("mean_score"), "rank")
