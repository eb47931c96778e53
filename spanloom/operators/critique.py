"""What a rendered sequence was seen to be: depth of coverage, defects, grounded all-clear claims; what may be rendered next.

Coverage is a sweep over edges: a span begins with +1 and ends with -1, and the running sum is the number of spans
at a place. Sums are taken in two steps, inside buckets of time and over the buckets' totals, so a recording with very many
spans is swept by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 600_000
#: The least share of a sequence that has to be seen, and the frames that show motion.
LEAST_COVERAGE, LEAST_FRAMES = 0.95, 2


def depth(spans: DataFrame, key: str, start: str, end: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """key, in_ms, out_ms, depth: the stretches between consecutive edges of a key's spans, and how many spans lie over each.

    Stretches that no span covers have depth 0 between others. Empty, reversed and null spans count nothing.
    """
    good = spans.where(F.col(end) > F.col(start))
    edge = lambda at, d: F.struct(F.col(at).cast("long").alias("at"), F.lit(d).alias("d"))
    edges = good.select(F.col(key).alias("_key"), F.explode(F.array(edge(start, 1), edge(end, -1))).alias("e")).groupBy("_key", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    edges = edges.withColumn("b", F.floor(F.col("at") / bucket_ms))
    totals = edges.groupBy("_key", "b").agg(F.sum("d").alias("t"), F.min("at").alias("first"))
    over = Window.partitionBy("_key").orderBy("b")
    base = totals.select("_key", "b", F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("first").over(over).alias("next"))
    own = Window.partitionBy("_key", "b").orderBy("at")
    inside = edges.withColumn("own", F.sum("d").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(own))
    met = inside.alias("x").join(base.alias("y"), F.col("x._key").eqNullSafe(F.col("y._key")) & (F.col("x.b") == F.col("y.b")))
    out = met.select(F.col("x._key").alias(key), F.col("x.at").alias("in_ms"), F.coalesce("x.to", "y.next").alias("out_ms"), (F.col("x.own") + F.col("y.base")).alias("depth"))
    return out.where("out_ms is not null")


def covered(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, once_ms, more_ms: how long exactly one span, and several, lie over a place."""
    ms = F.col("out_ms") - F.col("in_ms")
    of = lambda what: F.coalesce(F.sum(F.when(what, ms)), F.lit(0))
    return depth(spans, key, start, end).groupBy(key).agg(of(F.col("depth") == 1).alias("once_ms"), of(F.col("depth") > 1).alias("more_ms"))


def inspect_sequences(sequences: DataFrame, windows: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """sequences with coverage, defects and whether an all-clear holds.

    sequences: key, duration_ms, has_context, claim. windows: key, start_ms, end_ms, observed, frames, motion. observations:
    key, severity (`warning`, else critical). A window that judges motion without motion or frames is a critical
    defect, as is a missing context. An all-clear needs LEAST_COVERAGE seen in observed windows, a context and no defect;
    `refused` says that it was claimed without, `reasons` why: they name critical defects, or else warnings.
    """
    seen = covered(windows.where("observed"), key, "start_ms", "end_ms")
    still = ~F.coalesce(F.col("motion"), F.lit(False)) | (F.coalesce(F.col("frames"), F.lit(0)) < LEAST_FRAMES)
    judged = windows.groupBy(key).agg(F.count("*").alias("n_windows"), F.count_if("observed").alias("n_observed"), F.count_if(still).alias("_still"))
    told = observations.groupBy(key).agg(F.count_if(F.col("severity") == "warning").alias("_warnings"), F.count_if(~F.coalesce(F.col("severity") == "warning", F.lit(False))).alias("_critical"))
    out = sequences
    for part in (seen, judged, told):
        part = part.withColumnRenamed(key, "_k")
        out = out.join(part, out[key].eqNullSafe(part["_k"]), "left").drop("_k")
    out = out.fillna(0, ["once_ms", "more_ms", "n_windows", "n_observed", "_still", "_warnings", "_critical"])
    context = F.coalesce(F.col("has_context"), F.lit(False))
    out = out.withColumn("coverage", F.least(F.lit(1.0), (F.col("once_ms") + F.col("more_ms")) / F.greatest(F.col("duration_ms"), F.lit(1))))
    out = out.withColumn("n_critical", F.col("_still") + F.col("_critical") + F.when(context, 0).otherwise(1)).withColumnRenamed("_warnings", "n_warning")
    said = lambda n, what: F.concat_ws(" ", F.col(n).cast("string"), F.lit(what))
    defects = F.when(F.col("n_critical") > 0, said("n_critical", "critical defect(s)")).when(F.col("n_warning") > 0, said("n_warning", "warning defect(s)"))
    short = F.when(F.col("coverage") < LEAST_COVERAGE, F.concat(F.lit("incomplete temporal coverage ("), F.round(F.col("coverage") * 100, 1).cast("string"), F.lit("%)")))
    reasons = F.array_compact(F.array(defects, short, F.when(~context, F.lit("missing aligned source context"))))
    claimed = F.coalesce(F.col("claim"), F.lit(False))
    out = out.withColumn("all_clear", F.size(reasons) == 0).withColumn("refused", claimed & (F.size(reasons) > 0))
    return out.withColumn("reasons", F.when(F.col("refused"), reasons).otherwise(F.array().cast("array<string>"))).drop("_still", "_critical")


#: What a file name may be made of: no separators, and not a parent's name.
SAFE = r"^(?!\.{1,2}$)[A-Za-z0-9._-]+$"
APPROVED, KINDS = "approved_pending_render", ("boundary", "caption")


def propose_render(asked: DataFrame, revisions: DataFrame, reports: DataFrame) -> DataFrame:
    """run, revision_id, kind, valid, violation: whether each revision asked for is ready to render, else the first reason why not.

    asked: run, revision_id. revisions: run, revision_id, kind (null: boundary), status, in_ms, out_ms. reports: run,
    has_clip, n_sentences, has_output, anchor_in, anchor_out, complete. A kind that is given but empty is unknown. Nothing is
    written. One row for each row asked for; a revision or report that is there twice is a mistake of the store and gives two.
    """
    rev = revisions.select(F.col("run").alias("_run"), F.col("revision_id").alias("_id"), F.col("kind").alias("_kind"), "status", "in_ms", "out_ms", F.lit(True).alias("_rev"))
    rep = reports.select(F.col("run").alias("_run2"), "has_clip", "n_sentences", "has_output", "anchor_in", "anchor_out", "complete", F.lit(True).alias("_rep"))
    met = asked.select("run", "revision_id").join(rev, (F.col("run") == F.col("_run")) & (F.col("revision_id") == F.col("_id")), "left").join(rep, F.col("run") == F.col("_run2"), "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    kind = F.when(F.col("_rev"), F.coalesce("_kind", F.lit("boundary")))
    boundary, caption = kind == "boundary", kind == "caption"
    rules: list[tuple[Column, str]] = [
        (no(F.col("revision_id").rlike(SAFE)), "unsafe revision id"),
        (no(F.col("_rev")), "no revision record"),
        (no(kind.isin(*KINDS)), "unknown revision kind"),
        (no(F.col("status") == APPROVED), "not approved, or rendered already"),
        (no(F.col("_rep")), "no report"),
        (no(F.col("has_clip")), "no clip"),
        (no(F.col("n_sentences") > 0), "no selected sentences"),
        (caption & no(F.col("has_output")), "no output block"),
        (boundary & no(F.col("in_ms").isNotNull() & F.col("out_ms").isNotNull()), "no proposed boundary"),
        (boundary & no(F.col("complete")), "sentence not complete"),
        (boundary & (F.col("in_ms") > F.col("anchor_in")), "starts mid-sentence"),
        (boundary & (F.col("out_ms") < F.col("anchor_out")), "ends mid-sentence"),
    ]
    first = F.get(F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in rules])), F.lit(0))
    shown = F.when(no(F.col("revision_id").rlike(SAFE)), F.lit(None).cast("string")).otherwise(kind)
    return met.select("run", "revision_id", shown.alias("kind"), first.isNull().alias("valid"), first.alias("violation"))
