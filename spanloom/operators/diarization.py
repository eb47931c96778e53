"""Diarization error: missed speech, false alarms and confusion under the best mapping of speakers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.spans import overlap_join


def greatest_matching(value: np.ndarray) -> int:
    """The greatest sum over one-to-one pairs of rows and columns, by shortest augmenting paths: exact for any number of speakers."""
    n, far = max(value.shape), np.iinfo(np.int64).max // 4
    cost = np.zeros((n, n), np.int64)
    cost[: value.shape[0], : value.shape[1]] = value.max() - value
    cost[value.shape[0] :], cost[:, value.shape[1] :] = value.max(), value.max()
    row_price, col_price, taken_by = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    for row in range(n):
        reach, before, done = np.full(n, far), np.full(n, -1), np.zeros(n, bool)
        at, came, base, settled_rows = row, -1, 0, []
        while at >= 0:
            settled_rows.append((at, base))
            nearer = ~done & (base + cost[at] - row_price[at] - col_price < reach)
            reach[nearer], before[nearer] = (base + cost[at] - row_price[at] - col_price)[nearer], came
            came = int(np.where(done, far, reach).argmin())
            base, done[came], at = int(reach[came]), True, int(taken_by[came])
        for i, when in settled_rows:
            row_price[i] += base - when
        col_price[done] -= base - reach[done]
        while came >= 0:
            previous = int(before[came])
            taken_by[came] = taken_by[previous] if previous >= 0 else row
            came = previous
    pairs = [(taken_by[c], c) for c in range(value.shape[1]) if taken_by[c] < value.shape[0]]
    return int(sum(value[r, c] for r, c in pairs))


def slices(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """media_id, start_ms, end_ms, ref, hyp: the line cut at every boundary, with the set of speakers on each side."""
    marks = reference.unionByName(hypothesis).select("media_id", F.explode(F.array("start_ms", "end_ms")).alias("s")).distinct()
    order = Window.partitionBy("media_id").orderBy("s")
    cut = marks.withColumn("e", F.lead("s").over(order)).where("e is not null")

    def side(turns: DataFrame, name: str) -> DataFrame:
        met = overlap_join(cut, turns.select("media_id", "speaker", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te")), "media_id", ("s", "e"), ("ts", "te"))
        return met.groupBy("media_id", "s").agg(F.sort_array(F.collect_set("speaker")).alias(name))

    empty = F.array().cast("array<string>")
    both = cut.join(side(reference, "ref"), ["media_id", "s"], "left").join(side(hypothesis, "hyp"), ["media_id", "s"], "left")
    return both.select("media_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), F.coalesce("ref", empty).alias("ref"), F.coalesce("hyp", empty).alias("hyp"))


def error(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """media_id, speech_ms, missed_ms, false_alarm_ms, confusion_ms, der; overlapping speech counts once for each speaker.

    Confusion is what the best one-to-one mapping of speakers leaves of the time both sides speak: the least
    confusion is the greatest matched overlap. The matrix of overlaps of one recording (speakers by speakers)
    is solved in its group, for any number of speakers.
    """
    rows = slices(reference, hypothesis).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    r, h = F.size("ref"), F.size("hyp")
    totals = rows.groupBy("media_id").agg(
        F.sum(F.col("ms") * r).alias("speech_ms"),
        F.sum(F.col("ms") * F.greatest(r - h, F.lit(0))).alias("missed_ms"),
        F.sum(F.col("ms") * F.greatest(h - r, F.lit(0))).alias("false_alarm_ms"),
        F.sum(F.col("ms") * F.least(r, h)).alias("both_ms"),
    )
    matrix = rows.select("media_id", "ms", F.explode("ref").alias("a"), "hyp").select("media_id", "ms", "a", F.explode("hyp").alias("b")).groupBy("media_id", "a", "b").agg(F.sum("ms").alias("ms"))

    def best(pdf):
        table = pdf.pivot(index="a", columns="b", values="ms").fillna(0).to_numpy(np.int64)
        return pd.DataFrame({"media_id": pdf["media_id"].iloc[:1], "matched_ms": [greatest_matching(table)]})

    matched = matrix.groupBy("media_id").applyInPandas(best, "media_id long, matched_ms long")
    out = totals.join(matched, "media_id", "left").withColumn("confusion_ms", F.when(F.col("both_ms") == 0, 0).otherwise(F.col("both_ms") - F.col("matched_ms")))
    wrong = F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confusion_ms")
    return out.select("media_id", "speech_ms", "missed_ms", "false_alarm_ms", "confusion_ms", (wrong / F.nullif(F.col("speech_ms"), F.lit(0))).alias("der"))
