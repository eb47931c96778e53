import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import carried as K
from spanloom.operators import folds as O


def track(rng, n):
    at, x, out = 0, 500, []
    for _ in range(n):
        at += rng.choice([40, 40, 200])
        x = rng.randint(0, 1900) if rng.random() < 0.08 else x + rng.randint(-12, 12)
        out.append((at, x))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_a_track_cut_anywhere_gives_the_same_path(seed):
    rng = random.Random(seed)
    points = np.array(track(rng, 300))
    cuts = np.array(sorted(rng.sample(range(points[-1, 0] + 500), 12)))
    limits = (60, 300, 250, (None, 700, 700, None)[seed], seed == 2)
    whole = O.camera_path(points[:, 0], points[:, 1], cuts, *limits)
    inner = cuts[(cuts >= points[0, 0]) & (cuts <= points[-1, 0])]
    for size in (1, 2, 7, 50, 299):
        keys, carry = [], None
        for lo in range(0, len(points), size):
            part = points[lo : lo + size]
            got, carry = O.camera_keys(part[:, 0], part[:, 1], inner, *limits, carry, lo + size >= len(points))
            keys += got
        assert keys == whole, size


def test_long_tracks_give_what_short_ones_give(spark, monkeypatch):
    rng = random.Random(5)
    points = [(m, a, x) for m in (1, 2) for a, x in track(rng, 400)] + [(3, 10, 5)]
    p = spark.createDataFrame(points, "media_id long, at_ms long, x long")
    c = spark.createDataFrame([(1, rng.randint(0, 40_000)) for _ in range(15)] + [(3, 99)], "media_id long, cut_ms long")
    boxes = spark.createDataFrame([(m, a, x + rng.choice([0, 0, 900]), rng.randint(50, 90), 80) for m, a, x in points for _ in range(2)], "media_id long, at_ms long, x long, width long, height long")

    def results():
        return [sorted(map(tuple, df.collect())) for df in (O.steady(p, c, 60, 300, 250), O.follow_faces(boxes, 0, 400))]

    short = results()
    monkeypatch.setattr(O, "GROUP", 70)
    assert results() == short and len(short[0]) > 50


def test_a_rule_that_never_forgets(spark):
    """Running sums: every split depends on all before it, and only the rounds tell."""
    df = spark.range(200).select(F.lit("a").alias("k"), F.col("id").alias("at")).unionByName(spark.range(3).select(F.lit("b").alias("k"), F.col("id").alias("at")))

    def step(key, rows, others, state, last):
        total = int(state or 0) + rows["at"].cumsum()
        return rows.assign(total=total)[["k", "at", "total"]], str(int(total.iloc[-1]))

    got = K.carried(df, df.select("k").limit(0), "k", ["at"], [], step, "k string, at long, total long", 40)
    assert {(r.k, r.at): r.total for r in got.collect()} == {(k, i): i * (i + 1) // 2 for k, n in (("a", 200), ("b", 3)) for i in range(n)}
