"""Append-only ledgers as batch and streaming jobs: sequences, open stages, costs, reuse by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stamp(events: DataFrame, run: str, order: list[str], last: DataFrame | None = None) -> DataFrame:
    """events with `sequence`: after the last one of each run (run, sequence), from 1."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long")
    if last is None:
        return events.withColumn("sequence", n)
    have = last.groupBy(run).agg(F.max("sequence").alias("_last"))
    return events.join(have, run, "left").withColumn("sequence", n + F.coalesce("_last", F.lit(0))).drop("_last")


def current(ledger: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """The value of the last record of each key; `default` where it is null."""
    return ledger.groupBy(key).agg(F.coalesce(F.max_by(value, "sequence"), F.lit(default)).alias(value))


def rollback(ledger: DataFrame, key: str, value: str) -> DataFrame:
    """The record that would point back at the last value but one: key, sequence, value."""
    order = Window.partitionBy(key).orderBy("sequence")
    rows = ledger.withColumn("_v", F.lag(value).over(order))
    return rows.groupBy(key).agg((F.max("sequence") + 1).alias("sequence"), F.max_by("_v", "sequence").alias(value)).where(F.col(value).isNotNull())


def reuse(wanted: DataFrame, cache: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """wanted with outcome: hit (key and digest recorded), stale (key with another digest), miss."""
    have = cache.select(*keys, F.col(digest).alias("_d")).groupBy(*keys).agg(F.collect_set("_d").alias("_ds"))
    out = wanted.join(have, keys, "left")
    return out.withColumn("outcome", F.when(F.col("_ds").isNull(), "miss").when(F.array_contains("_ds", F.col(digest)), "hit").otherwise("stale")).drop("_ds")


def first_skipped(stages: DataFrame, run: str, place: str) -> DataFrame:
    """The first skipped stage of each run with its reason; none when all ran."""
    return stages.where("state = 'skipped'").groupBy(run).agg(F.min_by(F.struct("stage", "reason"), place).alias("s")).select(run, "s.stage", "s.reason")


def windowed_counts(stream: DataFrame, at: str, size: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream (or table) in event-time windows; rows later than `late` are left out of a stream."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; what is there stays as it is."""
    rows.write.mode("append").json(path)


def append_once(stream: DataFrame, key: list[str], at: str, path: str, checkpoint: str, late: str = "10 minutes"):
    """Write a stream to a table, each key once within the watermark; runs over what is there, then ends."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
