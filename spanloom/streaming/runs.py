"""A run's event log as a stream that keeps state: sequence numbers, open stages, and timers for stages that never end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States of an event that open and that close a stage; others leave it as it is.
STARTED, ENDED = "started", ("completed", "skipped")
OUTPUT = "run_id long, event_id long, sequence long, at_ms long, stage string, state string, elapsed_ms long, note string"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State processors need the RocksDB store; a query keeps what is set where it starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class StageLog(StatefulProcessor):
    """State of a run: its last sequence and, of each open stage, when and with which sequence it began."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, stages array<string>, since array<long>, opened array<long>")

    def _load(self) -> tuple[int, dict[str, tuple[int, int]]]:
        if not self.run.exists():
            return 0, {}
        last, stages, since, opened = self.run.get()
        return int(last), {s: (int(a), int(n)) for s, a, n in zip(stages, since, opened)}

    def _save(self, last: int, held: dict[str, tuple[int, int]]) -> None:
        self.run.update((last, list(held), [a for a, _ in held.values()], [n for _, n in held.values()]))

    def _lost(self, run: int, stage: str, since: int, opened: int) -> tuple:
        return run, None, opened, since + self.idle_ms, stage, "lost", self.idle_ms, "never ended"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, held = self._load()
        out, new = [], set()
        # A run's events of one batch are put in order; how many files a batch takes bounds them.
        frame = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        for event_id, at, stage, state in frame[["event_id", "at_ms", "stage", "state"]].itertuples(index=False):
            last += 1
            if stage in held and at - held[stage][0] > self.idle_ms:
                out.append(self._lost(key[0], stage, *held.pop(stage)))
            since, note = held.get(stage, (None, None))[0], None
            if state == STARTED:
                note = None if since is None else "reopened"
                held[stage] = (int(at), last)
                new.add(stage)
            elif state in ENDED:
                note = "not open" if held.pop(stage, None) is None else None
            out.append((key[0], event_id, last, at, stage, state, at - since if since is not None and state in ENDED else None, note))
        self._save(last, held)
        for stage in new & set(held):
            self.handle.registerTimer(held[stage][0] + self.idle_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer of a stage that ended or began anew finds nothing due.
        last, held = self._load()
        due = {s: x for s, x in held.items() if x[0] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs()}
        if due:
            self._save(last, {s: x for s, x in held.items() if s not in due})
            yield _frame([self._lost(key[0], s, *x) for s, x in sorted(due.items())])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    return out.astype({"event_id": "Int64", "elapsed_ms": "Int64", "sequence": "int64", "at_ms": "int64"})


def run_log(events: DataFrame, idle_ms: int, late: str) -> DataFrame:
    """The log of a stream of (run_id, event_id, at, stage, state), by run.

    Every event gets the next sequence of its run, by time and id within a batch. The end of an open stage tells how long
    it took (`elapsed_ms`); an end of a stage that is not open, and a start of one that is, are noted. A stage that is open for
    more than idle_ms ends as `lost`, with the sequence of its start: at once where the run's next event shows
    it, else by a timer when the watermark (`late` behind the newest event) has passed. State is restored after a restart.
    """
    timed = events.withWatermark("at", late)
    rows = timed.select("run_id", "event_id", "at", F.expr("unix_millis(at)").alias("at_ms"), "stage", "state")
    return rows.groupBy("run_id").transformWithStateInPandas(StageLog(idle_ms), OUTPUT, "Append", "EventTime")
