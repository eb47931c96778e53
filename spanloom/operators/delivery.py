"""Declared against measured: clips, episode manifests, subtitle files, audits, editorial proposals, diarization studies.

Each check gives a row for everything it was asked about, with the names of the rules it breaks; nothing is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import intervals as I
from spanloom.operators import contracts as K
from spanloom.operators import diarization as D
from spanloom.operators import rules as U
from spanloom.operators import spans as P

#: The picture and the loudness that are delivered, their tolerances, and the shares that must be seen.
WIDTH, HEIGHT, LOUDNESS, MOST_PEAK = 1080, 1920, -14.0, -1.0
LOUDNESS_BY_LENGTH = ((10_000, 0.5), (3_000, 2.5), (0, 5.0))
LEAST_INK, LEAST_FACE, LEAST_FACE_SHORT, SHORT_MS = 0.95, 0.90, 0.50, 3_000
CUT_GUARD_MS = 250
#: Subtitle style: least font size, bottom margin and outline, and longest line.
LEAST_FONT, LEAST_MARGIN, LEAST_OUTLINE, MOST_CHARS, BOXED = 100, 240, 3.0, 20, 3
SUSTAINED_DAYS = 30


def near(points: DataFrame, others: DataFrame, key: str, at: str, other_at: str, reach) -> DataFrame:
    """points that have another point of their key at most `reach` away (a number, or a column of points)."""
    reach = U.col(reach) if isinstance(reach, str) else F.lit(reach)
    windows = points.select("*", (F.col(at) - reach).alias("_lo"), (F.col(at) + reach + 1).alias("_hi"))
    met = P.point_join(others.select(key, F.col(other_at).alias("_at")), windows, key, "_at", ("_lo", "_hi"))
    return met.select(*points.columns).distinct()


def cut_findings(planned: DataFrame, found: DataFrame, source: DataFrame, clips: DataFrame, key: str, tolerance_ms: int, guard_ms: int = CUT_GUARD_MS) -> DataFrame:
    """key, missing, rogue: planned cuts (key, at_ms) that nobody found, and found ones (key, at_ms) near neither a plan nor a cut of the source.

    clips: key, removed_ms; what was cut from a clip widens the guard around its source cuts.
    """
    met = near(planned, found, key, "at_ms", "at_ms", tolerance_ms)
    missing = planned.join(met, planned.columns, "left_anti").groupBy(key).agg(F.count("*").alias("missing"))
    guarded = found.join(clips.select(key, (F.lit(guard_ms) + F.col("removed_ms")).alias("_guard")), key)
    known = near(found, planned, key, "at_ms", "at_ms", tolerance_ms).unionByName(near(guarded, source, key, "at_ms", "at_ms", "_guard").select(*found.columns)).distinct()
    rogue = found.join(known, found.columns, "left_anti").groupBy(key).agg(F.count("*").alias("rogue"))
    return clips.select(key).join(missing, key, "left").join(rogue, key, "left").na.fill(0, ["missing", "rogue"])


def reconcile(clips: DataFrame, measured: DataFrame, cuts: DataFrame, key: str, frame_ms: int = 40) -> DataFrame:
    """clips with reasons. clips: key, span_ms, removed_ms, captions, face_tracked; measured: key, video_ms, audio_ms, width, height, loudness, peak, ink, face; cuts: cut_findings."""
    rows = clips.join(measured, key, "left").join(cuts, key, "left")
    loud = F.coalesce(*[F.when(F.col("audio_ms") >= ms, tolerance) for ms, tolerance in LOUDNESS_BY_LENGTH])
    least_face = F.when(F.col("video_ms") >= SHORT_MS, LEAST_FACE).otherwise(LEAST_FACE_SHORT)
    rules = {
        "not measured": F.col("video_ms").isNull(),
        "duration": ~U.within_tolerance("video_ms", F.col("span_ms") - F.col("removed_ms"), frame_ms),
        "picture size": (F.col("width") != WIDTH) | (F.col("height") != HEIGHT),
        "loudness": ~U.within_tolerance("loudness", F.lit(LOUDNESS), loud),
        "peak": F.col("peak") > MOST_PEAK,
        "removed silence": ~U.within_tolerance(F.col("span_ms") - F.col("audio_ms"), "removed_ms", frame_ms),
        "missing cut": F.col("missing") > 0,
        "rogue cut": F.col("rogue") > 0,
        "captions": F.when(F.col("captions"), F.col("ink") < LEAST_INK).otherwise(F.col("ink") > 0),
        "face": F.col("face_tracked") & (F.round("face", 2) < least_face),
    }
    return K.with_reasons(rows, rules)


def reconcile_manifest(manifests: DataFrame, clips: DataFrame, files: DataFrame, required: tuple[str, ...], tolerance_ms: int = 60) -> DataFrame:
    """episode, reasons. manifests: episode, n_clips, total_ms; clips: episode, clip, in_ms, out_ms, duration_ms, measured_ms; files: episode, clip, suffix, bytes."""
    there = files.where("bytes > 0").groupBy("episode", "clip").agg(F.collect_set("suffix").alias("_f"))
    before = F.lag("out_ms").over(Window.partitionBy("episode").orderBy("in_ms", "clip"))
    rows = clips.withColumn("_b", before).join(there, ["episode", "clip"], "left")
    lacks = F.size(F.array_except(F.array(*[F.lit(s) for s in required]), F.coalesce("_f", F.array().cast("array<string>")))) > 0
    n = lambda bad: F.count_if(F.coalesce(bad, F.lit(False)))
    by = rows.groupBy("episode").agg(F.count("*").alias("_n"), F.sum("duration_ms").alias("_ms"), n(lacks).alias("_files"), n(~U.within_tolerance("duration_ms", "measured_ms", tolerance_ms)).alias("_long"), n(F.col("_b") > F.col("in_ms")).alias("_over"))
    all_of = manifests.join(by, "episode", "left").na.fill(0, ["_n", "_ms", "_files", "_long", "_over"])
    rules = {"count": F.col("n_clips") != F.col("_n"), "total": F.col("total_ms") != F.col("_ms"), "files": F.col("_files") > 0, "duration": F.col("_long") > 0, "overlap": F.col("_over") > 0}
    return K.with_reasons(all_of, rules).select("episode", "reasons")


def check_subtitles(lines: DataFrame, key: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """key, font_size, margin, border, outline, longest, reasons of subtitle files given by their lines: the first style, and the longest line shown."""
    style = F.split(F.regexp_replace(line, "^Style:", ""), ",")
    field = lambda k, kind: F.trim(F.get(style, F.lit(k))).try_cast(kind)
    values = F.struct(field(2, "int").alias("font_size"), field(21, "int").alias("margin"), field(15, "int").alias("border"), field(16, "double").alias("outline"))
    said = F.regexp_replace(F.regexp_extract(line, r"^Dialogue:(?:[^,]*,){9}(.*)$", 1), r"\{[^}]*\}", "")
    longest = F.array_max(F.transform(F.split(said, r"\\N"), lambda s: F.length(F.trim(s))))
    is_style = F.col(line).startswith("Style:")
    got = lines.groupBy(key).agg(F.min_by(F.when(is_style, values), F.when(is_style, F.col(pos))).alias("s"), F.coalesce(F.max(F.when(F.col(line).startswith("Dialogue:"), longest)), F.lit(0)).alias("longest"))
    rows = got.select(key, F.coalesce("s.font_size", F.lit(0)).alias("font_size"), F.coalesce("s.margin", F.lit(0)).alias("margin"), F.coalesce("s.border", F.lit(1)).alias("border"), F.coalesce("s.outline", F.lit(0.0)).alias("outline"), "longest")
    rules = {"font": F.col("font_size") < LEAST_FONT, "margin": F.col("margin") < LEAST_MARGIN, "outline": (F.col("border") != BOXED) & (F.col("outline") < LEAST_OUTLINE), "line": F.col("longest") > MOST_CHARS}
    return K.with_reasons(rows, rules)


def full_audit(key: str, **checks: DataFrame) -> DataFrame:
    """key, passed, defects over named check tables (key, reasons); a key that a table lacks passed that check."""
    every = None
    for name, table in checks.items():
        prefix = F.lit(name + ": ")
        part = table.select(key, F.transform("reasons", lambda r: F.concat(prefix, r)).alias("r"))  # noqa: B023
        every = part if every is None else every.unionByName(part)
    defects = F.array_sort(F.flatten(F.collect_list("r")))
    return every.groupBy(key).agg(defects.alias("defects")).withColumn("passed", F.size("defects") == 0)


def validate_proposals(proposals: DataFrame, cited: DataFrame, sentences: DataFrame, least_fidelity: float, most_ms: int, least_ms: int = 0) -> DataFrame:
    """proposals with `reason`, the first rule broken, or null.

    proposals: proposal_id, media_id, in_ms, out_ms, reverses_negation, reverses_attribution, fidelity;
    cited: proposal_id, sent_id; sentences: media_id, sent_id, start_ms, end_ms, complete.
    """
    asked = cited.join(proposals.select("proposal_id", "media_id"), "proposal_id")
    known = asked.join(sentences.select("media_id", "sent_id", "start_ms", "end_ms", "complete"), ["media_id", "sent_id"], "left")
    by = known.groupBy("proposal_id").agg(F.count("*").alias("_n"), F.count_if(F.col("start_ms").isNull()).alias("_lost"), F.min("start_ms").alias("_a"), F.max("end_ms").alias("_z"), F.count_if(~F.col("complete")).alias("_open"))
    ms = F.col("out_ms") - F.col("in_ms")
    rules = {
        "bad times": (F.col("in_ms") < 0) | (ms <= 0),
        "cites nothing": F.coalesce("_n", F.lit(0)) == 0,
        "cites what is not there": F.col("_lost") > 0,
        "invents timing": (F.col("in_ms") < F.col("_a")) | (F.col("out_ms") > F.col("_z")),
        "reverses a negation": F.col("reverses_negation"),
        "reverses an attribution": F.col("reverses_attribution"),
        "fidelity": F.col("fidelity") < least_fidelity,
        "open sentence": F.col("_open") > 0,
        "length": (ms > most_ms) | (ms < least_ms),
    }
    checked = K.with_reasons(proposals.join(by, "proposal_id", "left"), rules)
    return checked.withColumn("reason", F.get("reasons", F.lit(0))).select(*proposals.columns, "reason")


def attach_turns(media: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media with turns, an array in order; refused turns with reasons): turns must be inside their recording, and not overlap an earlier one. One recording's turns are one array."""
    before = F.max("end_ms").over(Window.partitionBy("media_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("_b", before).join(media.select("media_id", "duration_ms"), "media_id", "left")
    rules = {"no recording": F.col("duration_ms").isNull(), "empty": F.col("end_ms") <= F.col("start_ms"), "outside": (F.col("start_ms") < 0) | (F.col("end_ms") > F.col("duration_ms")), "overlaps": F.col("_b") > F.col("start_ms")}
    good, bad = K.split(K.with_reasons(rows, rules))
    held = good.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "speaker"))).alias("turns"))
    return media.join(held, "media_id", "left"), bad.select("media_id", "start_ms", "end_ms", "speaker", "reasons")


def shot_plan_findings(shots: DataFrame, key: str) -> DataFrame:
    """shots (key, out_in_ms, out_out_ms, src_in_ms, src_out_ms, mode, regions) with reasons: they follow one another from 0, keep their length, and put a graphic before a face only where one is."""
    before = F.coalesce(F.lag("out_out_ms").over(Window.partitionBy(key).orderBy("out_in_ms")), F.lit(0))
    rows = shots.withColumn("_b", before)
    rules = {
        "gap": F.col("out_in_ms") != F.col("_b"),
        "length": F.col("out_out_ms") - F.col("out_in_ms") != F.col("src_out_ms") - F.col("src_in_ms"),
        "no region": (F.col("mode") == "priority_over_face") & ~F.exists("regions", lambda r: r.isin("demonstration", "graphic")),
    }
    return K.with_reasons(rows, rules).drop("_b")


def sustained_acceptance(reports: DataFrame, least_sample: int = 20, least_days: int = SUSTAINED_DAYS) -> DataFrame:
    """reports (scoped, fresh_n, fresh_verified, days, editor, owner) with status and deficiencies."""
    few = F.col("fresh_n") < least_sample
    rules = {"scoped": F.col("scoped") != "accepted", "sample": few, "unverified": ~F.col("fresh_verified"), "window": F.col("days") < least_days, "editor": ~F.col("editor"), "owner": ~F.col("owner")}
    rows = K.with_reasons(reports, rules, "deficiencies")
    return rows.withColumn("status", F.when(few, "insufficient").when(F.size("deficiencies") > 0, "deficient").otherwise("accepted"))


def diarization_study(reference: DataFrame, **systems: DataFrame) -> DataFrame:
    """system, media_id, der and the four times of several systems against one reference, and a pooled row (null media_id) for each."""
    out = None
    for name, turns in systems.items():
        part = D.error(reference, turns).select(F.lit(name).alias("system"), "*")
        out = part if out is None else out.unionByName(part)
    times = [F.sum(c).alias(c) for c in ("speech_ms", "missed_ms", "false_alarm_ms", "confusion_ms")]
    pooled = out.groupBy("system").agg(*times).select("system", F.lit(None).cast("long").alias("media_id"), "speech_ms", "missed_ms", "false_alarm_ms", "confusion_ms")
    wrong = F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confusion_ms")
    return out.unionByName(pooled.withColumn("der", wrong / F.nullif(F.col("speech_ms"), F.lit(0))))


def slice_report(items: DataFrame, split: str) -> DataFrame:
    """split, wins, losses, ties, n_winners, mean_iou, complete_rate, misleading_rate of study items: preference, is_winner, spans of clip and gold, complete, misleading."""
    won = F.when(F.col("is_winner"), I.iou("in_ms", "out_ms", "gold_in_ms", "gold_out_ms"))
    return items.groupBy(split).agg(
        F.count_if(F.col("preference") == "incumbent").alias("wins"),
        F.count_if(F.col("preference") == "shadow").alias("losses"),
        F.count_if(F.col("preference").isNull()).alias("ties"),
        F.count_if(F.col("is_winner")).alias("n_winners"),
        F.avg(won).alias("mean_iou"),
        F.avg(F.when(F.col("is_winner"), F.col("complete").cast("double"))).alias("complete_rate"),
        F.avg(F.when(F.col("is_winner"), F.col("misleading").cast("double"))).alias("misleading_rate"),
    )


def promotion(decisions: DataFrame, key: str, ledger: DataFrame) -> DataFrame:
    """key, sequence, value of the records that promotions append: for decisions (key, decision, challenger, approved_by) that switch and that somebody approved."""
    last = ledger.groupBy(key).agg(F.max("sequence").alias("_last"))
    go = decisions.where((F.col("decision") == "switch") & F.col("approved_by").isNotNull())
    return go.join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).alias("sequence"), F.col("challenger").alias("value"))
