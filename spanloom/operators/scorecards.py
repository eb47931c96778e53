"""Rules of scorecards: collisions, recall, acceptance, shares and what a set of rows has to be. Each is an aggregation or two by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers as N
from spanloom.operators.reports import col


def share(rows: DataFrame, key: str, hit, of=None, n: str = "n", hits: str = "hits") -> DataFrame:
    """key, n, hits, share: how many rows there are, for how many a condition holds, and its share (of: a condition that rows count by)."""
    total, found = F.count("*") if of is None else F.count_if(col(of)), F.count_if(col(hit))
    return rows.groupBy(key).agg(total.alias(n), found.alias(hits), N.rate(found, total).alias("share"))


def collisions(rows: DataFrame, raw: str, normal, *keys: str) -> DataFrame:
    """keys, n_items, n_changed, n_raw, n_norm, changed_rate, collision_rate: what a normalisation changes, and how many distinct texts it makes one."""
    r, n = F.col(raw), col(normal)
    got = rows.groupBy(*keys).agg(F.count("*").alias("n_items"), F.count_if(r != n).alias("n_changed"), F.countDistinct(r).alias("n_raw"), F.countDistinct(n).alias("n_norm"))
    return got.withColumns({"changed_rate": N.rate("n_changed", "n_items"), "collision_rate": N.rate(F.col("n_raw") - F.col("n_norm"), "n_raw")})


BOTH = "both"


def on_each_path(hits: DataFrame, path: str, paths: tuple[str, ...]) -> DataFrame:
    """hits once for each path they count for: what both found counts for each of the paths, and for both."""
    every = F.array(*[F.lit(p) for p in (*paths, BOTH)])
    return hits.withColumn(path, F.explode(F.when(F.col(path) == BOTH, every).otherwise(F.array(path)))).distinct()


def recall(winners: DataFrame, hits: DataFrame, key: str, winner: str) -> DataFrame:
    """key, n, found, recall: gold rows of each key and how many distinct ones were hit; keys without hits have 0."""
    n = winners.groupBy(key).agg(F.count("*").alias("n"))
    found = hits.groupBy(key).agg(F.countDistinct(winner).alias("found"))
    met = n.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return met.withColumn("recall", N.rate("found", "n"))


def recall_by_path(winners: DataFrame, hits: DataFrame, path: str) -> DataFrame:
    """path, found, recall of all gold rows; hits: a row for each gold row and path that found it."""
    total = winners.agg(F.count("*").alias("_n"))
    met = hits.groupBy(path).agg(F.count("*").alias("found")).join(F.broadcast(total))
    return met.select(path, "found", N.rate("found", "_n").alias("recall"))


def unique_wins(hits: DataFrame, path: str, winner: str) -> DataFrame:
    """path, n: gold rows that one path alone found."""
    alone = hits.where(F.col(path) != BOTH).groupBy(winner).agg(F.count("*").alias("_k"), F.min(path).alias(path))
    return alone.where("_k = 1").groupBy(path).agg(F.count("*").alias("n"))


def per_source_hour(costs: DataFrame, spans: DataFrame, key: str, amount: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """key, hours, per_hour: an amount of each key over the hours of its spans; keys without spans are left out."""
    hours = spans.groupBy(key).agg((F.sum(F.col(end) - F.col(start)) / 3_600_000.0).alias("hours"))
    return hours.join(costs, key).select(key, "hours", N.rate(amount, "hours").alias("per_hour"))


def study(rows: DataFrame, key: str, worth, misleading) -> DataFrame:
    """key, n, win_rate (mean worth: 1 won, 0.5 tied), misleading (share), low (Wilson's lower limit of the win rate)."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(col(worth)).alias("win_rate"), F.avg(col(misleading).cast("double")).alias("misleading"))
    return got.withColumn("low", N.wilson("win_rate", "n")["low"])


def clustered_rate(rows: DataFrame, key: str, cluster: str, counted, hit) -> DataFrame:
    """key, rate, low: a rate and its lower limit, the smaller of Wilson's and of what the spread between clusters gives.

    Rows are summed by cluster first; a key's clusters are few numbers.
    """
    c = rows.groupBy(key, cluster).agg(F.count_if(col(counted)).alias("n"), F.count_if(col(hit)).alias("a"))
    totals = c.groupBy(key).agg(F.sum("n").alias("tn"), (F.sum("a") / F.nullif(F.sum("n"), F.lit(0))).alias("p"), F.count("*").alias("k"))
    gap = F.col("a") - F.col("p") * F.col("n")
    met = c.join(totals, key).groupBy(key).agg(F.first("p").alias("p"), F.first("tn").alias("tn"), F.first("k").alias("k"), F.sum(gap * gap).alias("gaps"))
    spread = F.sqrt(F.col("k") / F.nullif(F.col("k") - 1, F.lit(0)) * F.col("gaps") / (F.col("tn") * F.col("tn")))
    low = F.greatest(F.lit(0.0), F.least(F.col("p") - N.Z95 * spread, N.wilson("p", "tn")["low"]))
    return met.select(key, F.col("p").alias("rate"), low.alias("low"))


def acceptance(rows: DataFrame, key: str, refused, accepted) -> DataFrame:
    """key, n, refusal_rate, first_pass_rate, margin (of the first-pass rate)."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(col(refused)).alias("_r"), F.count_if(col(accepted)).alias("_a"))
    p = F.col("_a") / F.col("n")
    return got.select(key, "n", (F.col("_r") / F.col("n")).alias("refusal_rate"), p.alias("first_pass_rate"), N.margin(p, F.col("n")).alias("margin"))


def level_shares(spans: DataFrame, key: str, level: str, speech: str, start: str = "in_ms", end: str = "out_ms") -> DataFrame:
    """key, level, ms, speech_ms, share: how long each level of a key lasts, with speech, and its share of the key's whole."""
    ms = F.col(end) - F.col(start)
    rows = spans.groupBy(key, level).agg(F.sum(ms).alias("ms"), F.sum(F.when(F.col(speech), ms).otherwise(0)).alias("speech_ms"))
    return rows.withColumn("share", F.col("ms") / F.sum("ms").over(Window.partitionBy(key)))


def stage_costs(events: DataFrame, run: str, stage: str, tokens) -> DataFrame:
    """run, stage, tokens, usd, n of billed events."""
    total = F.sum(col(tokens))
    return events.groupBy(run, stage).agg(total.alias("tokens"), N.token_cost(total).alias("usd"), F.count("*").alias("n"))


def run_complete(events: DataFrame, run: str, stage: str, n_stages: int, skipped) -> DataFrame:
    """run, complete (every stage was seen), n_skipped."""
    return events.groupBy(run).agg((F.countDistinct(stage) == n_stages).alias("complete"), F.count_if(col(skipped)).alias("n_skipped"))


def pooled_error(rows: DataFrame) -> DataFrame:
    """One row: the summed parts of diarization errors, and the error rate over all speech."""
    parts = ("speech_ms", "missed_ms", "false_alarm_ms", "confusion_ms")
    wrong = F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confusion_ms")
    return rows.agg(*[F.sum(c).alias(c) for c in parts]).withColumn("der", wrong / F.nullif(F.col("speech_ms"), F.lit(0)))


# What a set of rows has to be


def without_gaps(rows: DataFrame, key: str, place: str) -> DataFrame:
    """key, contiguous: do the places of each key follow each other, each once?"""
    n = F.countDistinct(place)
    return rows.groupBy(key).agg(((F.max(place) - F.min(place) + 1 == n) & (F.count("*") == n)).alias("contiguous"))


def none_with(rows: DataFrame, key: str, reason: str, reasons: str = "reasons") -> DataFrame:
    """key, valid: does no row of the key have the reason?"""
    return rows.groupBy(key).agg(F.bool_and(~F.array_contains(reasons, reason)).alias("valid"))


def foreign_inside(rows: DataFrame, key: str, own, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The rows that are not `own` and lie over the stretch from the first to the last own row of their key."""
    bounds = rows.where(col(own)).groupBy(key).agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    return rows.where(~col(own)).join(bounds, key).where((F.col(start) < F.col("_hi")) & (F.col("_lo") < F.col(end))).drop("_lo", "_hi")


def tiled(rows: DataFrame, key: str, *order: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """key, in_order (no row begins before the one before it ends), from_zero, n."""
    before = F.coalesce(F.lag(end).over(Window.partitionBy(key).orderBy(*order)), F.lit(0))
    return rows.withColumn("_b", before).groupBy(key).agg(F.bool_and(F.col("_b") <= F.col(start)).alias("in_order"), (F.min(start) == 0).alias("from_zero"), F.count("*").alias("n"))


def cues_within(rows: DataFrame, key: str, end_ms: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """key, has_cue (some cue is on screen before end_ms), n_outside (cues that begin later)."""
    return rows.groupBy(key).agg(F.bool_or((F.col(start) < end_ms) & (F.col(end) > 0)).alias("has_cue"), F.count_if(F.col(start) >= end_ms).alias("n_outside"))


def with_following(rows: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """rows with an array: the item and, where there is one, the next item of its key, which it cannot be shown without."""
    following = F.lead(item).over(Window.partitionBy(key).orderBy(item))
    return rows.withColumn(name, F.array_distinct(F.array_compact(F.array(item, following))))


def last_first(rows: DataFrame, key: str, place: str, name: str = "_play") -> DataFrame:
    """rows with the order in which they are played when the last of each key opens it."""
    last = rows.groupBy(key).agg(F.max(place).alias("_m"))
    met = rows.join(last, key)
    return met.withColumn(name, F.when(F.col(place) == F.col("_m"), -1).otherwise(F.col(place))).drop("_m")


def offsets(rows: DataFrame, key: str, order: str, ms: Column, name: str = "offset_ms") -> DataFrame:
    """rows with the place on the clock where each begins when they are played in order."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(ms).over(before), F.lit(0)))


def uses(ids: DataFrame, used: DataFrame, key: str, item: str) -> DataFrame:
    """key, n_ids, times: the items of each key and how often the most used of them is used; used: a row for each use."""
    counts = used.groupBy(item).agg(F.count("*").alias("_t"))
    return ids.join(counts, item, "left").groupBy(key).agg(F.count("*").alias("n_ids"), F.max(F.coalesce("_t", F.lit(0))).cast("int").alias("times"))


def candidate_order(*ties: Column | str) -> list[Column]:
    """Best rank of either path first; of equal ranks what both paths found, then the earlier one."""
    return [F.least("verbal_rank", "visual_rank"), F.when(F.col("path") == BOTH, 0).otherwise(1), F.col("in_ms"), *[col(t) for t in ties]]
