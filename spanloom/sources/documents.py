"""Typed readers of nested JSON documents: manifests, transcripts, ingest results, review exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers as N
from spanloom.operators.contracts import json_keys, with_reasons
from spanloom.sources.files import human_confirmed

WORD = "struct<w:string,start_ms:bigint,end_ms:bigint,conf:double>"
TRANSCRIPT = f"media_id string, text string, words array<{WORD}>, unaligned array<string>, segment_confidence array<struct<start_ms:bigint,end_ms:bigint,mean_logprob:double,llm_text:string,ctc_text:string>>, rejected array<string>"
INGEST = "media_id string, duration_ms bigint, shot_cuts_ms array<bigint>, speech array<struct<start_ms:bigint,end_ms:bigint>>, diarization array<struct<start_ms:bigint,end_ms:bigint,speaker:string>>"
ITEM = "item_id string, reference string, dialect string, conditions array<string>, duration_s double, named_entities array<string>, code_switch_spans array<string>, speaker_count int"


REGRESSION_SET = "items array<struct<item_id:string,dialect:string,preference:string>>"
DERIVED = "media_id string, text_norm string, source_sha256 string"


def manifest(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """Items of manifests {provenance, items: [...]}; one row each, with the provenance. many: a file has a manifest on each line."""
    return spark.read.schema(f"provenance string, items array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ITEM.split(', '))}>>").json(path, multiLine=not many).select("provenance", F.inline("items"))


def parsed(rows: DataFrame, column: str, schema: str, required: list[str], optional: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with `doc` (typed) and reasons: no JSON, missing or extra keys."""
    missing, extra = json_keys(column, required, optional)
    typed = rows.withColumn("doc", F.from_json(column, schema))
    return with_reasons(typed, {"no JSON object": F.json_object_keys(column).isNull(), "missing keys": F.size(missing) > 0, "extra keys": F.size(extra) > 0})


def transcript_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """words, segments, unaligned and rejected of transcripts (`doc` column), one table each."""
    d = docs.select("doc.*")
    return {
        "words": d.select("media_id", F.posexplode("words").alias("pos", "x")).select("media_id", "pos", "x.*"),
        "segments": d.select("media_id", F.posexplode("segment_confidence").alias("seg", "x")).select("media_id", "seg", "x.*"),
        "unaligned": d.select("media_id", F.explode("unaligned").alias("w")),
        "rejected": d.select("media_id", F.explode("rejected").alias("text")),
    }


def ingest_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """media, cuts, speech and turns; a recording without diarization has no turns and `diarized` false."""
    d = docs.select("doc.*")
    return {
        "media": d.select("media_id", "duration_ms", F.col("diarization").isNotNull().alias("diarized")),
        "cuts": d.select("media_id", F.explode("shot_cuts_ms").alias("cut_ms")),
        "speech": d.select("media_id", F.inline("speech")),
        "turns": d.select("media_id", F.inline("diarization")),
    }


def review_export(rows: DataFrame) -> DataFrame:
    """Confirmed items of a review export; names that exporters spell in two ways are taken from either."""
    r = rows
    for name, kind in (("exported", "boolean"), ("verified", "boolean"), ("isGold", "boolean"), ("chosen_text", "string"), ("verdicts", "int"), ("rawTranscript", "string"), ("durationMs", "double"), ("duration_ms", "double"), ("audioPath", "string"), ("id", "string")):
        if name not in r.columns:
            r = r.withColumn(name, F.lit(None).cast(kind))
    ok = human_confirmed(F.col("exported"), F.col("verified"), F.col("isGold"), F.col("chosen_text"), F.col("verdicts") > 0)
    return r.where(ok).select(F.col("id").alias("item_id"), F.coalesce("chosen_text", "rawTranscript").alias("reference"), (F.coalesce("durationMs", "duration_ms") / 1000).alias("duration_s"), F.col("audioPath").alias("audio_path"))


def derived(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Derived transcripts (`doc`) with current: were they made from the source (media_id, digest) as it is now?"""
    d = docs.select("doc.*")
    return d.join(sources.select("media_id", "digest"), "media_id", "left").withColumn("current", F.coalesce(F.col("source_sha256") == F.col("digest"), F.lit(False))).drop("digest")


def srt(cues: DataFrame, key: str, tie: str) -> DataFrame:
    """key, srt, n_cues: a subtitle text of cues (start_ms, end_ms, text) in order. One key is one text."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", tie))
    n = cues.withColumn("k", place)
    cue = F.concat(F.col("k").cast("string"), F.lit("\n"), N.srt_time("start_ms"), F.lit(" --> "), N.srt_time("end_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = n.select(key, F.struct("k", cue.alias("cue")).alias("c")).groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cs"), F.count("*").alias("n_cues"))
    return rows.select(key, F.array_join(F.transform("cs", lambda c: c["cue"]), "\n").alias("srt"), "n_cues")


def timeline_json(clips: DataFrame, key: str, name: str, tie: str = "clip_id") -> DataFrame:
    """key and a nested JSON time line: one track of clips in order, each with source range and markers count."""
    clip = F.struct(F.col("clip_id").alias("name"), F.struct("in_ms", "out_ms").alias("source_range"), F.col("n_markers").alias("markers"))
    rows = clips.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("in_ms", F.col(tie).alias("tie"), clip.alias("c")))).alias("cs"))
    tracks = F.array(F.struct(F.lit("video").alias("kind"), F.transform("cs", lambda x: x["c"]).alias("children")))
    return rows.select(key, F.to_json(F.struct(F.lit(name).alias("name"), tracks.alias("tracks"))).alias("timeline"))
