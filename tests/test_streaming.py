import random

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import ledgers as L
from spanloom.streaming import runs as R
from spanloom.streaming import sinks as K

EVENTS = "run_id long, event_id long, at timestamp, stage string, state string"
IDLE, LATE = 60_000, "10 seconds"


def rows(n, seed=1):
    rng, t = random.Random(seed), 1_700_000_000_000
    out = []
    for i in range(n):
        t += rng.choice([5, 900, 4_000, 45_000])
        out.append((rng.randint(1, 4), i, t, rng.choice("ab"), rng.choice(["started", "started", "completed", "skipped", "billed"])))
    return out


def brute(events):
    """One event at a time, and at the end whatever the watermark has passed."""
    last, held, out = {}, {}, []
    lost = lambda run, stage: out.append((run, None, held[run, stage][1], held[run, stage][0] + IDLE, stage, "lost", IDLE, "never ended"))
    for run, event, at, stage, state in sorted(events, key=lambda r: (r[2], r[1])):
        n = last[run] = last.get(run, 0) + 1
        if (run, stage) in held and at - held[run, stage][0] > IDLE:
            lost(run, stage)
            del held[run, stage]
        since = held.get((run, stage))
        if state == "started":
            held[run, stage] = (at, n)
            out.append((run, event, n, at, stage, state, None, "reopened" if since else None))
        elif state in R.ENDED:
            held.pop((run, stage), None)
            out.append((run, event, n, at, stage, state, at - since[0] if since else None, None if since else "not open"))
        else:
            out.append((run, event, n, at, stage, state, None, None))
    mark = max(r[2] for r in events) - 10_000
    for run, stage in [k for k, (at, _) in held.items() if at + IDLE < mark]:
        lost(run, stage)
    return sorted(out, key=str)


def table(spark, part):
    return spark.createDataFrame(part, "run_id long, event_id long, ms long, stage string, state string").selectExpr("run_id", "event_id", "timestamp_millis(ms) as at", "stage", "state")


def test_run_log_in_batches_with_restarts(spark, tmp_path):
    """Three slices of time, the stream stopped and started between them: state goes on, and repeated writing changes nothing."""
    events = rows(240)
    events.append((9, 1000, events[-1][2] + 500_000, "z", "billed"))  # moves the watermark
    for lo, hi in ((0, 90), (90, 91), (91, 241)):
        table(spark, events[lo:hi]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        sink = K.Delivery(f"{tmp_path}/out", {"log": lambda b: b})
        with R.keyed_state(spark):
            run = R.run_log(stream, IDLE, LATE).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    got = K.delivered(spark, f"{tmp_path}/out", "log", R.OUTPUT)
    assert sorted(map(tuple, got.collect()), key=str) == brute(events)
    batch = L.stamp(table(spark, events), "run_id", ["at", "event_id"])
    assert {(r.event_id, r.sequence) for r in batch.collect()} == {(r.event_id, r.sequence) for r in got.where("event_id is not null").collect()}
    assert got.where("state = 'lost'").count() > 3 and {"reopened", "not open"} <= {r.note for r in got.collect()}


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    fail = [True]

    def billed(b):
        if fail[0]:
            raise RuntimeError("the second table's writer dies")
        return b.where("state = 'billed'").groupBy("run_id").agg(F.count("*").alias("n"))

    sink = K.Delivery(root, {"events": lambda b: b, "billed": billed}, "json")
    first, second = table(spark, rows(40)), table(spark, rows(30, 2))
    with pytest.raises(RuntimeError):
        sink(first, 0)
    (tmp_path / "out" / K.COMMITS).mkdir()
    assert K.delivered(spark, root, "events", EVENTS, "json").count() == 0  # written in part, but not committed
    fail[0] = False
    sink(first, 0)
    sink(second, 1)
    read = lambda: (sorted(map(tuple, K.delivered(spark, root, "events", EVENTS, "json").collect()), key=str), sorted(map(tuple, K.delivered(spark, root, "billed", "run_id long, n long", "json").collect())))
    before, files = read(), sorted(str(p) for p in tmp_path.rglob("part-*"))
    assert len(before[0]) == 70 and sum(n for _, n in before[1]) == sum(r[4] == "billed" for r in rows(40) + rows(30, 2))
    sink(second, 1)
    sink(rows and first.limit(3), 0)  # whatever a repeated batch holds
    assert read() == before and sorted(str(p) for p in tmp_path.rglob("part-*")) == files
    assert {(r.name, r.batch, r.n) for r in K.committed(spark, root).where("name = 'events'").collect()} == {("events", 0, 40), ("events", 1, 30)}
