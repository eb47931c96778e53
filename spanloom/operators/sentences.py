"""Sentences from timed words, and what is read off them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.spans import overlap_join

#: Marks that end a sentence, and words that leave one open at its end.
FINAL_MARKS = ".!?؟۔"
OPEN_WORDS = ("and", "or", "but", "because", "und", "oder", "et", "ou", "y", "و")
PAUSE_MS = 500


def numbered(words: DataFrame, pauses: DataFrame | None = None, pause_ms: int = PAUSE_MS) -> DataFrame:
    """words with sent_id, final (it bears a final mark) and next_ms (start of the next word).

    A sentence ends after a final mark, before a gap of pause_ms or more, or where a silence of that length
    (pauses: media_id, pause_start_ms, pause_end_ms) lies inside the gap. One window pass by recording.
    """
    order = Window.partitionBy("media_id").orderBy("pos")
    rows = words.withColumn("next_ms", F.lead("start_ms").over(order)).withColumn("final", F.col("w").rlike(f"[{FINAL_MARKS}]$"))
    ends = F.col("final") | (F.col("next_ms") - F.col("end_ms") >= pause_ms)
    if pauses is not None:
        long = pauses.where(F.col("pause_end_ms") - F.col("pause_start_ms") >= pause_ms)
        gaps = rows.where("next_ms > end_ms").select("media_id", "pos", F.col("end_ms").alias("g0"), F.col("next_ms").alias("g1"))
        held = overlap_join(gaps, long, "media_id", ("g0", "g1"), ("pause_start_ms", "pause_end_ms")).where("g0 <= pause_start_ms and pause_end_ms <= g1").select("media_id", "pos").distinct().withColumn("_silent", F.lit(True))
        rows = rows.join(held, ["media_id", "pos"], "left")
        ends = ends | F.coalesce("_silent", F.lit(False))
    number = F.coalesce(F.sum(F.col("_ends").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return rows.withColumn("_ends", ends).withColumn("sent_id", number).drop("_ends", "_silent")


def segment(words: DataFrame, pauses: DataFrame | None = None, pause_ms: int = PAUSE_MS, open_words: tuple[str, ...] = OPEN_WORDS) -> DataFrame:
    """media_id, sent_id, start_ms, end_ms, text, complete, n_words of the numbered words.

    A sentence is complete unless its last word is open; the last one of a recording only with a final mark.
    """
    grouped = numbered(words, pauses, pause_ms).groupBy("media_id", "sent_id").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("text"),
        F.count("*").alias("n_words"),
        F.max_by(F.struct("w", "final", "next_ms"), "pos").alias("_last"),
    )
    return grouped.select("media_id", "sent_id", "start_ms", "end_ms", "text", _complete(open_words).alias("complete"), "n_words")


def _complete(open_words: tuple[str, ...]) -> Column:
    dangling = F.lower(F.regexp_replace(F.col("_last.w"), r"\p{P}", "")).isin(*open_words)
    return ~dangling & (F.col("_last.final") | F.col("_last.next_ms").isNotNull())


#: A final mark at a word's end; as in the JVM, one separator of lines may follow.
FINAL = re.compile(f"[{FINAL_MARKS}][\x85\u2028\u2029]?\\Z")


def cut(w: pa.Array, start: np.ndarray, end: np.ndarray, sizes: np.ndarray, pause_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first words of sentences, and for each word whether it bears a final mark. sizes: words of each recording."""
    coded = w.dictionary_encode()
    final = np.array([FINAL.search(x) is not None for x in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy(zero_copy_only=False)]
    fresh = np.concatenate(([True], final[:-1] | (start[1:] - end[:-1] >= pause_ms)))
    fresh[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return np.flatnonzero(fresh), final


def segment_rows(transcripts: DataFrame, pause_ms: int = PAUSE_MS, open_words: tuple[str, ...] = OPEN_WORDS, text: bool = True) -> DataFrame:
    """`segment` of recordings that have all their words, in order, in one row (media_id, words); text: false leaves that column out.

    No word is shuffled, sorted or made a row of its own: a task finds the ends of the sentences of a batch of recordings as arrays.
    """
    rows = transcripts.select("media_id", "words.w", "words.start_ms", "words.end_ms")
    kind = rows.schema["media_id"].dataType.simpleString()
    last = pa.struct([("w", pa.string()), ("final", pa.bool_()), ("next_ms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, w, start, end = batch.columns
            sizes, w, start, end = np.diff(w.offsets.to_numpy()).astype(np.int64), w.flatten(), start.flatten().to_numpy(), end.flatten().to_numpy()
            if not len(w):
                continue
            first, final = cut(w, start, end, sizes, pause_ms)
            begun = np.cumsum(sizes) - sizes
            bounds = np.concatenate((first, [len(w)]))
            at = np.repeat(np.arange(len(sizes)), sizes)[first]
            ends = bounds[1:] - 1
            later = np.concatenate((start[1:], [0]))[ends]
            lasting = pa.StructArray.from_arrays([w.take(pa.array(ends)), pa.array(final[ends]), pa.array(later, mask=ends == (begun + sizes - 1)[at])], fields=list(last))
            columns = {"media_id": ids.take(pa.array(at)), "sent_id": pa.array(np.arange(len(first)) - np.searchsorted(first, begun)[at])}
            columns |= {"start_ms": pa.array(np.minimum.reduceat(start, first)), "end_ms": pa.array(np.maximum.reduceat(end, first)), "n_words": pa.array(np.diff(bounds)), "_last": lasting}
            if text:
                columns["text"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), w), " ")
            yield pa.RecordBatch.from_pydict(columns)

    made = f"media_id {kind}, sent_id long, start_ms long, end_ms long, n_words long, _last struct<w: string, final: boolean, next_ms: long>" + ", text string" * text
    return rows.mapInArrow(run, made).select("media_id", "sent_id", "start_ms", "end_ms", *["text"] * text, _complete(open_words).alias("complete"), "n_words")


#: What a sentence is worth at first, and what is added or taken away.
WORTH, AS_FIRST, AS_LAST, MANY_FILLERS, LEFT_OPEN, BRISK, SLOW = 0.5, 0.45, 0.40, -0.4, -0.35, 0.1, -0.15


def worth(fillers: tuple[str, ...], open_words: tuple[str, ...] = OPEN_WORDS) -> Column:
    """What a sentence (text, n_words, start_ms, end_ms) is worth without regard to its place: fewer than a third of fillers, a closed end, pace."""
    words = F.split("text", " ")
    share = F.size(F.filter(words, lambda w: w.isin(*fillers))) / F.nullif(F.size(words), F.lit(0))
    pace = F.col("n_words") / F.greatest(F.lit(0.5), (F.col("end_ms") - F.col("start_ms")) / 1000.0)
    filled = F.when(share > 0.3, MANY_FILLERS).otherwise(0.0)
    left_open = F.when(F.element_at(words, -1).isin(*open_words), LEFT_OPEN).otherwise(0.0)
    return WORTH + filled + left_open + F.when(pace >= 2, BRISK).when(pace < 1, SLOW).otherwise(0.0)


def worth_of(w: pa.Array, first: np.ndarray, start: np.ndarray, end: np.ndarray, fillers: tuple[str, ...], open_words: tuple[str, ...] = OPEN_WORDS) -> np.ndarray:
    """`worth` of sentences given by the places of their first words among all words, and by their start and end."""
    among = lambda words, of: pc.is_in(words, value_set=pa.array(of, pa.string())).to_numpy(zero_copy_only=False)
    n_words = np.diff(first, append=len(w))
    share = np.add.reduceat(among(w, fillers).astype(np.int64), first) / n_words
    pace = n_words / np.maximum(0.5, (end - start) / 1000.0)
    filled = np.where(share > 0.3, MANY_FILLERS, 0.0)
    left_open = np.where(among(w.take(pa.array(first + n_words - 1)), open_words), LEFT_OPEN, 0.0)
    return WORTH + filled + left_open + np.where(pace >= 2, BRISK, np.where(pace < 1, SLOW, 0.0))


def importance(sentences: DataFrame, fillers: tuple[str, ...], open_words: tuple[str, ...] = OPEN_WORDS) -> DataFrame:
    """sentences with worth and importance (0 to 1): the first and the last of a recording count for more."""
    own = Window.partitionBy("media_id")
    place = F.when(F.col("sent_id") == F.min("sent_id").over(own), AS_FIRST).when(F.col("sent_id") == F.max("sent_id").over(own), AS_LAST).otherwise(0.0)
    rows = sentences.withColumn("worth", worth(fillers, open_words))
    return rows.withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("worth") + place)))


def anchors(sentences: DataFrame) -> DataFrame:
    """Start of the first complete sentence and end of the last, by recording; none without a complete one."""
    return sentences.where("complete").groupBy("media_id").agg(F.min("start_ms").alias("anchor_in_ms"), F.max("end_ms").alias("anchor_out_ms"))


def out_of_order(sentences: DataFrame) -> DataFrame:
    """Sentences that begin before the one before them has ended."""
    before = F.lag("end_ms").over(Window.partitionBy("media_id").orderBy("start_ms", "sent_id"))
    return sentences.withColumn("before_ms", before).where("before_ms > start_ms")


def gaps(spans: DataFrame, key: str, least_ms: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Pauses longer than least_ms between consecutive spans of a key."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start))
    return spans.withColumn("gap_start_ms", before).withColumn("gap_ms", F.col(start) - before).where(F.col("gap_ms") > least_ms)
