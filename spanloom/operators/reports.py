"""Reports: rates, totals, agreements and decisions over grouped rows. Every report is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers as N


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Most values of the second side of a grid: they travel as one array.
GRID_VALUES = 10_000


def grid(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Every combination of the values of two columns, nulls not counted as values of the second.

    A report of all combinations makes sense for a few kinds of things. The second column has GRID_VALUES
    values at most, else this is an error: their number is asked for first.
    """
    seconds = [r[0] for r in rows.select(b).where(F.col(b).isNotNull()).distinct().limit(GRID_VALUES + 1).collect()]
    if len(seconds) > GRID_VALUES:
        raise ValueError(f"{b} has more than {GRID_VALUES} values: no grid is made of them")
    values = F.array(*[F.lit(v) for v in sorted(seconds)]) if seconds else F.array().cast(f"array<{rows.schema[b].dataType.simpleString()}>")
    return rows.select(a).distinct().select(a, F.explode(values).alias(b))


def coverage(items: DataFrame, a: str, b: str, hours) -> DataFrame:
    """a, b, n_items, hours for every combination, also the empty ones."""
    cells = items.groupBy(a, b).agg(F.count("*").alias("n"), F.sum(col(hours)).alias("h"))
    filled = grid(cells, a, b).join(cells, [a, b], "left")
    return filled.select(a, b, F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("h", F.lit(0.0)).alias("hours"))


def missing_cells(items: DataFrame, a: str, b: str, good) -> DataFrame:
    """Combinations for which no item is good."""
    cells = items.groupBy(a, b).agg(F.bool_or(col(good)).alias("_good"))
    return grid(cells, a, b).join(cells.where("_good"), [a, b], "left_anti")


def sizes(items: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """How many items each key has, and how much of an amount."""
    return items.groupBy(key).agg(F.count("*").alias("n"), F.sum(amount).alias(name))


def micro(value: str, weight: str) -> Column:
    """Mean of a rate weighted by its base, over the rows that have one."""
    return N.rate(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def micro_rate(items: DataFrame, keys: list[str], value: str = "cer", weight: str = "n_chars") -> DataFrame:
    return items.groupBy(*keys).agg(micro(value, weight).alias("micro_cer"))


def measured_mean(items: DataFrame, key: str, value: str) -> DataFrame:
    """key, error, n: unweighted mean over the items that were measured; null where none was."""
    return items.groupBy(key).agg(F.avg(value).alias("error"), F.count(value).alias("n"))


def real_time_factor(wall_s, duration_s) -> Column:
    return col(wall_s) / F.nullif(col(duration_s), F.lit(0))


def speed(items: DataFrame, key: str, wall: str = "wall_s", duration: str = "duration_s") -> DataFrame:
    """key, mean_rtf, worst_rtf."""
    rtf = real_time_factor(wall, duration)
    return items.groupBy(key).agg(F.avg(rtf).alias("mean_rtf"), F.max(rtf).alias("worst_rtf"))


def benchmark(items: DataFrame, key: str = "model") -> DataFrame:
    """key, n, n_failed, micro_cer, mean_rtf, worst_rtf; an item without cer failed."""
    counts = items.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("cer").isNull()).alias("n_failed"), micro("cer", "n_chars").alias("micro_cer"))
    return counts.join(speed(items, key), key)


def choose_model(items: DataFrame, baseline: str, least_gain: float = 0.1, most_rtf: float = 1.0) -> DataFrame:
    """model, gain, regress, promoted, reasons of every model but the baseline: it must gain enough, be worse for no dialect, and keep up."""
    whole = items.groupBy("model").agg(micro("cer", "n_chars").alias("c"), F.max(real_time_factor("wall_s", "duration_s")).alias("worst"))
    part = items.groupBy("model", "dialect").agg(micro("cer", "n_chars").alias("c"))
    mine = part.where(F.col("model") == baseline).select("dialect", F.col("c").alias("base_c"))
    regress = part.join(mine, "dialect").groupBy("model").agg(F.bool_or(F.col("c") > F.col("base_c")).alias("regress"))
    base = whole.where(F.col("model") == baseline).select(F.col("c").alias("base"))
    rows = whole.where(F.col("model") != baseline).join(F.broadcast(base)).join(regress, "model").withColumn("gain", (F.col("base") - F.col("c")) / F.col("base"))
    rules = {"gain": F.col("gain") < least_gain, "regression": F.col("regress"), "speed": F.col("worst") > most_rtf}
    reasons = F.concat_ws(";", *[F.when(bad, F.lit(why)) for why, bad in rules.items()])
    return rows.select("model", "gain", "regress", (reasons == "").alias("promoted"), reasons.alias("reasons"))


def failure_rate(items: DataFrame, key: str, counted, failed) -> DataFrame:
    """key and rate: the share of the counted items that failed; null without any."""
    return items.groupBy(key).agg(N.rate(F.count_if(col(counted) & col(failed)), F.count_if(col(counted))).alias("rate"))


def mean_log_probability(words: DataFrame, key: str) -> DataFrame:
    """Mean of ln(conf), weighted by the words' lengths; conf is taken as 1e-12 at least."""
    ms = F.col("end_ms") - F.col("start_ms")
    return words.groupBy(key).agg((F.sum(ms * F.log(F.greatest("conf", F.lit(1e-12)))) / F.sum(ms)).alias("mean_logprob"))


def assembled(relative: DataFrame, segments: DataFrame, key: str, segment: str) -> DataFrame:
    """Words with times relative to their segment (rel_ms), on the recording's clock (at_ms). segments: key, segment, start_ms."""
    return relative.join(segments.select(key, segment, F.col("start_ms").alias("_s")), [key, segment]).withColumn("at_ms", F.col("_s") + F.col("rel_ms")).drop("_s")


def track_metrics(pairs: DataFrame, key: str, order: str, wrong, error) -> DataFrame:
    """key, error_rate, mae, mean_step of paired tracks: wrong associations, mean error, and mean step of the reference in order."""
    step = F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy(key).orderBy(order))
    rows = pairs.select(key, col(wrong).cast("double").alias("_w"), F.abs(col(error)).alias("_e"), step.alias("_s"))
    return rows.groupBy(key).agg(F.avg("_w").alias("error_rate"), F.avg("_e").alias("mae"), F.avg("_s").alias("mean_step"))


def uniform(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """key, n_kinds, uniform: were all measurements of a key made on one kind of machine?"""
    n = F.countDistinct(kind)
    return rows.groupBy(key).agg(n.alias("n_kinds"), (n == 1).alias("uniform"))


def preferences(rows: DataFrame, key: str, won, least: int = 20) -> DataFrame:
    """key, wins, losses, ties (null), and whether there are enough."""
    w = col(won)
    return rows.groupBy(key).agg(F.count_if(w).alias("wins"), F.count_if(~w).alias("losses"), F.count_if(w.isNull()).alias("ties"), (F.count("*") >= least).alias("enough"))


def real_groups(rows: DataFrame, key: str, row_id: str, least: int = 5) -> DataFrame:
    """key, n, unique_ids of the groups that have enough rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.countDistinct(row_id) == F.count("*")).alias("unique_ids")).where(F.col("n") >= least)


def switch_decision(rows: DataFrame, key: str, incumbent, shadow, least: int = 20) -> DataFrame:
    """key, n, incumbent, shadow, decision: the shadow takes over if it wins more often, over enough items."""
    w = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(col(incumbent)).alias("incumbent"), F.count_if(col(shadow)).alias("shadow"))
    return w.withColumn("decision", F.when(F.col("n") < least, "too few").when(F.col("shadow") > F.col("incumbent"), "switch").otherwise("keep"))


def repeat_agreement(rows: DataFrame, key: str, metrics: dict[str, Column]) -> DataFrame:
    """key, metric, mean, std (population), spread over the repeats of a key."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("v")) for n, v in metrics.items()])).alias("u")
    u = rows.select(key, each).select(key, "u.*")
    return u.groupBy(key, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("spread"))


def win_rates(comparisons: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """system, win_rate, n of comparisons (a, b, score of a: 1, 0, or 0.5 for a tie)."""
    sides = F.array(F.struct(F.col(a).alias("system"), F.col(score).alias("s")), F.struct(F.col(b).alias("system"), (1.0 - F.col(score)).alias("s")))
    return comparisons.select(F.explode(sides).alias("e")).select("e.*").groupBy("system").agg(F.avg("s").alias("win_rate"), F.count("*").alias("n"))


def flag_rate(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """key, rate, n: share of the rows with a flag that is not null; null without any."""
    return rows.groupBy(key).agg(F.avg(F.col(flag).cast("double")).alias("rate"), F.count(flag).alias("n"))


def cluster_variance(rows: DataFrame, key: str, cluster: str, hit) -> DataFrame:
    """key and variance of the share of hits, with clusters as the units: c / (c - 1) * sum (a - p n)^2 / N^2."""
    c = rows.groupBy(key, cluster).agg(F.count("*").alias("n"), F.count_if(col(hit)).alias("a"))
    own = Window.partitionBy(key)
    c = c.withColumns({"_n": F.sum("n").over(own), "_p": F.sum("a").over(own) / F.sum("n").over(own), "_k": F.count("*").over(own)})
    gap = F.col("a") - F.col("_p") * F.col("n")
    return c.groupBy(key).agg((F.min("_k") / F.nullif(F.min("_k") - 1, F.lit(0)) * F.sum(gap * gap) / (F.min("_n") * F.min("_n"))).alias("variance"))


def rejected_by_path(candidates: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n_rejected, 0 where a path has candidates but no rejection."""
    n = rejected.groupBy(*keys).agg(F.count("*").alias("n"))
    return candidates.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_rejected"))


def span_compliance(spans: DataFrame, key: str, start: str, end: str, least_ms: int = 30_000, most_ms: int = 90_000) -> DataFrame:
    """key, n, compliant: how many spans were asked for, and how many have an allowed length."""
    return spans.groupBy(key).agg(F.count("*").alias("n"), F.count_if((F.col(end) - F.col(start)).between(least_ms, most_ms)).alias("compliant"))


def speaker_counts(turns: DataFrame, key: str) -> DataFrame:
    return turns.groupBy(key).agg(F.count("*").alias("n_turns"), F.countDistinct("speaker").alias("n_speakers"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))


def per_hour(amount, source_ms) -> Column:
    """An amount for each hour of source; null for none."""
    return col(amount) / F.nullif(col(source_ms) / 3_600_000.0, F.lit(0.0))


def manifest_outcome(rows: DataFrame, key: str, failed, published) -> DataFrame:
    """key, partial_failure (some failed, some were published), no_clip (nothing was)."""
    bad, good = F.count_if(col(failed)), F.count_if(col(published))
    return rows.groupBy(key).agg(((bad > 0) & (good > 0)).alias("partial_failure"), (good == 0).alias("no_clip"))


def release_eligible(rows: DataFrame, key: str, critical, accounted, least: int) -> DataFrame:
    """key and eligible: no critical defect, and enough proposals that are accounted for."""
    return rows.groupBy(key).agg(((F.count_if(col(critical)) == 0) & (F.count_if(col(accounted)) > least)).alias("eligible"))


def run_summary(events: DataFrame, run: str, stage: str, at: str) -> DataFrame:
    """run, n_events, n_stages, last_ms."""
    return events.groupBy(run).agg(F.count("*").alias("n_events"), F.countDistinct(stage).alias("n_stages"), F.max(at).alias("last_ms"))


def project_summary(decisions: DataFrame, project: str, revised) -> DataFrame:
    """project, n_decisions, n_revisions."""
    return decisions.groupBy(project).agg(F.count("*").alias("n_decisions"), F.count_if(col(revised)).alias("n_revisions"))


def named_checks(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, check_name, passed, all_passed: named conditions over a key's rows (aggregates), one row each."""
    got = rows.groupBy(key).agg(*[c.alias(f"_{n}") for n, c in checks.items()])
    every = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"_{n}").alias("passed")) for n in checks])
    return got.select(key, F.explode(every).alias("_c"), F.forall(every, lambda c: c["passed"]).alias("all_passed")).select(key, "_c.check_name", "_c.passed", "all_passed")


def side_by_side(**tables: DataFrame) -> DataFrame:
    """Tables under one another with their names as `kind`; a column that one lacks is null there."""
    out = None
    for kind, table in tables.items():
        part = table.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def jitter(track: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, reversals, max_step, mean_step, oscillation (path less net displacement) of a track in order."""
    line = Window.partitionBy(key).orderBy(*order)
    s = track.withColumn("_step", F.col(value) - F.lag(value).over(line))
    s = s.withColumn("_before", F.lag("_step").over(line))
    size = F.abs("_step")
    return s.groupBy(key).agg(F.count_if(F.col("_step") * F.col("_before") < 0).alias("reversals"), F.max(size).alias("max_step"), F.avg(size).alias("mean_step"), (F.sum(size) - F.abs(F.sum("_step"))).alias("oscillation"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and median: the middle value, of two the upper one. Counted values, not lists, are kept."""
    return rows.groupBy(key).agg((-F.expr(f"percentile_disc(0.5) within group (order by -`{value}`)")).alias("median"))


def study(first: DataFrame, second: DataFrame, rulings: DataFrame, item: str, split: str) -> DataFrame:
    """split, n, disagreement, accepted: two reviewers' scores (item, score), and rulings (item, ruling) where they differ."""
    j = first.select(item, split, F.col("score").alias("_a")).join(second.select(item, F.col("score").alias("_b")), item).join(rulings, item, "left")
    final = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.coalesce("ruling", "_a"))
    return j.groupBy(split).agg(F.count("*").alias("n"), F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("disagreement"), F.avg(final.cast("double")).alias("accepted"))


def index_report(rows: DataFrame, key: str, row_id: str, vector: str) -> DataFrame:
    """key, n, n_sizes, n_duplicates: an index must hold vectors of one size, each id once."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(F.size(vector)).alias("n_sizes"), (F.count("*") - F.countDistinct(row_id)).alias("n_duplicates"))


def segment_scores(words: DataFrame, key: str, segment) -> DataFrame:
    """key, seg, lp, start_ms, end_ms: mean log probability and extent of each segment of words."""
    return words.groupBy(key, col(segment).alias("seg")).agg(F.avg(F.log("conf")).alias("lp"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
