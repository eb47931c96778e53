"""How well a hypothesis times the words that it shares with a reference."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as X

TOLERANCE_MS = 50


def gathered(reference: DataFrame, hypothesis: DataFrame, how: str = "left") -> DataFrame:
    """media_id, ref and hyp: the words of a recording in one row, arrays of what both tables have of pos, w, start_ms and end_ms."""
    sides = []
    for table, name in ((reference, "ref"), (hypothesis, "hyp")):
        columns = [c for c in ("pos", "w", "start_ms", "end_ms") if c in table.columns]
        sides.append(table.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)))
    return sides[0].join(sides[1], "media_id", how).withColumn("hyp", F.coalesce("hyp", F.array()))


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """For each row with normalised words k and h_k: its place, where its words begin on both sides, and what matches there."""
    a, b = batch.column("k"), batch.column("h_k")
    ends = [np.cumsum(np.diff(c.offsets.to_numpy())).tolist() for c in (a, b)]
    n, codes = len(a.flatten()), pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_pylist()
    x = y = 0
    for k, (p, q) in enumerate(zip(*ends)):
        found = SequenceMatcher(None, codes[x:p], codes[n + y : n + q], autojunk=False).get_matching_blocks()
        yield k, x, y, np.array([m.a + i for m in found for i in range(m.size)], np.int64), np.array([m.b + i for m in found for i in range(m.size)], np.int64)
        x, y = p, q


def _normalised(side: str) -> Column:
    return F.transform(F.col(f"{side}.w"), X.normalize)


def matched_words(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """media_id, pos, h_pos of the words that both have, by the longest blocks of equal normalised words.

    Both: media_id, pos, w. The longest block is matched first, then what lies before and behind it. One row is
    one recording, whose words must fit a task.
    """
    rows = gathered(reference.select("media_id", "pos", "w"), hypothesis.select("media_id", "pos", "w"), "inner")
    rows = rows.select("media_id", _normalised("ref").alias("k"), _normalised("hyp").alias("h_k"), F.col("ref.pos").alias("pos"), F.col("hyp.pos").alias("h_pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [(np.full(len(i), k), x + i, y + j) for k, x, y, i, j in _pairs(batch)]
            if met:
                of, i, j = (pa.array(np.concatenate(c)) for c in zip(*met))
                yield pa.RecordBatch.from_arrays([batch.column("media_id").take(of), batch.column("pos").flatten().take(i), batch.column("h_pos").flatten().take(j)], ["media_id", "pos", "h_pos"])

    return rows.mapInArrow(run, f"media_id {reference.schema['media_id'].dataType.simpleString()}, pos long, h_pos long")


def alignment_report(pairs: DataFrame, keys: list[str], tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """keys, matched, onset_ms, offset_ms, within of timed pairs (start_ms, end_ms, h_start_ms, h_end_ms): mean errors, and the share of all boundaries within the tolerance."""
    onset, offset = F.abs(F.col("start_ms") - F.col("h_start_ms")), F.abs(F.col("end_ms") - F.col("h_end_ms"))
    near = F.count_if(onset <= tolerance_ms) + F.count_if(offset <= tolerance_ms)
    return pairs.groupBy(*keys).agg(F.count("*").alias("matched"), F.avg(onset).alias("onset_ms"), F.avg(offset).alias("offset_ms"), (near / (2 * F.count("*"))).alias("within"))


def score_alignment(reference: DataFrame, hypothesis: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """media_id, words, matched, coverage, onset_ms, offset_ms, within for each recording of the reference; errors are null where nothing matched."""
    return score_rows(gathered(reference, hypothesis), tolerance_ms)


def score_rows(rows: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """`score_alignment` of recordings that have their words in one row: media_id, ref and hyp, arrays of (w, start_ms, end_ms) in order.

    No word is shuffled; a task matches the recordings of a batch one after another.
    """
    times = [F.col(f"{side}.{c}").alias(f"{name}{c}") for side, name in (("ref", ""), ("hyp", "h_")) for c in ("start_ms", "end_ms")]
    told = rows.select("media_id", _normalised("ref").alias("k"), _normalised("hyp").alias("h_k"), *times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, end, h_start, h_end = (batch.column(c).flatten().to_numpy() for c in ("start_ms", "end_ms", "h_start_ms", "h_end_ms"))
            got = []
            for _, x, y, i, j in _pairs(batch):
                onset, offset = np.abs(start[x + i] - h_start[y + j]), np.abs(end[x + i] - h_end[y + j])
                got.append((len(i), onset.sum(), offset.sum(), (onset <= tolerance_ms).sum() + (offset <= tolerance_ms).sum()))
            sums = np.array(got, np.int64).reshape(-1, 4)
            sizes = np.diff(batch.column("k").offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(sizes), *map(pa.array, sums.T)], ["media_id", "words", "matched", "onset", "offset", "near"])

    sums = told.mapInArrow(run, f"media_id {rows.schema['media_id'].dataType.simpleString()}, words long, matched long, onset long, offset long, near long")
    each = lambda c: F.col(c) / F.nullif(F.col("matched"), F.lit(0))
    return sums.select("media_id", "words", "matched", (F.col("matched") / F.col("words")).alias("coverage"), each("onset").alias("onset_ms"), each("offset").alias("offset_ms"), (each("near") / 2).alias("within"))
