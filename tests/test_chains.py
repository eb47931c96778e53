import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chains as C
from spanloom.operators import folds as O
from spanloom.operators import timeline as L


def serial_thin(points, least):
    out = []
    for p in sorted(points):
        if not out or p - out[-1] >= least:
            out.append(p)
    return out


def serial_batches(sizes, most):
    out, batch, total = [], -1, 0
    for n in sizes:
        if batch < 0 or total + n > most:
            batch, total = batch + 1, 0
        total += n
        out.append(batch)
    return out


def serial_windows(sizes, most):
    total = [0]
    for n in sizes:
        total.append(total[-1] + n)
    out, first = [], 0
    while first < len(sizes):
        end = next((k for k in range(len(total)) if total[k] >= total[first] + most and k > first), len(sizes))
        out.append((first, end, total[end] - total[first]))
        first += max(1, (end - first) // 2)
    return out


def lines(seed):
    rng = random.Random(seed)
    return {k: [rng.choice([0, 0, 1, 3, 8, 40]) for _ in range(n)] for k, n in {1: 150, 2: 1, 3: 40, 4: 2}.items()}


@pytest.mark.parametrize("piece", [1 << 16, 16])
def test_walks_equal_the_serial_rules(spark, piece):
    data = lines(3)
    df = spark.createDataFrame([(k, i, n, "x") for k, v in data.items() for i, n in enumerate(v)] + [(None, 0, 1, "x")], "k long, at long, n long, next string")
    got = C.batched(df, "k", ["at"], "n", 10, piece).collect()
    assert got and all(r.next == "x" for r in got)
    for k, v in data.items():
        assert [r.batch for r in sorted((r for r in got if r.k == k), key=lambda r: r.at)] == serial_batches(v, 10)
    sums = {k: [sum(v[: i + 1]) for i in range(len(v))] for k, v in data.items()}
    points = spark.createDataFrame([(k, p, j) for k, v in sums.items() for j, p in enumerate(v)] + [(1, None, 0)], "k long, p long, j long")
    kept = C.thinned(points, "k", "p", 9, ["j"], piece).collect()
    for k, v in sums.items():
        assert sorted(r.p for r in kept if r.k == k) == serial_thin(v, 9)
    windows = C.half_windows(df, "k", ["at"], "n", 30, piece).collect()
    for k, v in data.items():
        want = sorted((first, i, total) for first, end, total in serial_windows(v, 30) for i in range(first, end))
        assert sorted((r.window, r.at, r.total) for r in windows if r.k == k) == want


def test_nothing_to_walk(spark):
    df = spark.createDataFrame([], "k long, at long, n long")
    assert C.batched(df, "k", ["at"], "n", 10).count() == 0 and C.thinned(df, "k", "at", 5).count() == 0 and C.half_windows(df, "k", ["at"], "n", 5).count() == 0


def test_numbers_and_sums_of_one_long_key(spark):
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("k"), (F.col("id") * 7919 % 20_011).alias("at")).unionByName(spark.createDataFrame([(None, 3), (None, 1)], "k long, at long"))
    got = C.numbered(df, "k", ["at"], F.col("at")).collect()
    own = sorted((r.at, r.i, r.before) for r in got if r.k == 7)
    total = 0
    for place, (at, i, before) in enumerate(own):
        assert (i, before) == (place, total)
        total += at
    assert sorted((r.at, r.i, r.before) for r in got if r.k is None) == [(1, 0, 0), (3, 1, 1)]


def test_one_recording_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("at"), (F.col("id") * 2_654_435_761 % 97).alias("n"))
    got = C.batched(df, "k", ["at"], "n", 5_000).select("at", "batch").toPandas().sort_values("at")
    assert got["batch"].tolist() == serial_batches([i * 2_654_435_761 % 97 for i in range(n)], 5_000)


def test_large_recordings_give_what_small_ones_give(spark, monkeypatch):
    """The operators with a bound on a group, once as groups and once as chains."""
    rng = random.Random(9)
    t, sentences = 0, []
    for m in (1, 2):
        for i in range(120):
            t += rng.randint(500, 9000)
            sentences.append((m, i, t - 400, t, rng.random()))
    s = spark.createDataFrame(sentences, "media_id long, sent_id long, start_ms long, end_ms long, worth double").withColumn("start_ms", F.col("end_ms") - F.col("sent_id") * 100 - 300)
    windows = spark.createDataFrame([(m, f"w{i}", i * 10, rng.choice([1, 50, 300])) for m in (1, 2) for i in range(60)], "media_id long, window_id string, in_ms long, frames int")
    starts = spark.createDataFrame([(m, i) for m in (1, 2) for i in rng.sample(range(300), 120)], "media_id long, i long")

    def read(pdf):
        return pdf[["media_id", "window_id"]].assign(score=float(len(pdf)) + pdf["batch"] / 100, refused=False)

    def results():
        return [sorted(map(tuple, df.collect())) for df in (O.story_windows(s, 9_000, 2_000), O.read_in_batches(windows, read, 256)[0], L.chosen_starts(starts, 4))]

    small = results()
    monkeypatch.setattr(O, "GROUP", 20)
    monkeypatch.setattr(L, "GROUP", 20)
    assert results() == small and all(small)
