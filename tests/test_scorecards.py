"""Small hand-made tables for rules whose queries have outcomes that follow from the tables' ids, and for scorecards."""

from pyspark.sql import functions as F

from spanloom.operators import contracts as K
from spanloom.operators import delivery as D
from spanloom.operators import reports as R
from spanloom.operators import rules as U
from spanloom.operators import scorecards as Y


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_intact_and_stale(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k long, text string")
    record = held.where("k < 3").withColumn("digest", F.sha2(F.when(F.col("k") == 2, "changed").otherwise(F.col("text")), 256))
    assert rows(U.intact(held, record, "k", "text"), "k", "intact") == [(1, True), (2, False), (3, False), (4, False)]
    derived = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, None)], "k long, source_digest string")
    sources = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k long, digest string")
    assert rows(U.stale(derived, sources, "k"), "k") == [(2,), (3,), (4,)]


def test_resolve(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "model string")
    allowed, denied = spark.createDataFrame([("a", "judge"), ("c", "asr")], "name string, role string"), spark.createDataFrame([("c",)], "name string")
    assert rows(K.resolve(asked, "model", allowed, denied), "model", "status") == [("a", "judge"), ("b", "unknown"), ("c", "denied"), (None, "unknown")]


def test_sustained_acceptance(spark):
    good = ("accepted", 20, True, D.SUSTAINED_DAYS, True, True)
    cases = [good, ("deficient", *good[1:]), ("accepted", 19, *good[2:]), (*good[:2], False, *good[3:]), (*good[:3], D.SUSTAINED_DAYS - 1, True, True), (*good[:4], False, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, scoped string, fresh_n int, fresh_verified boolean, days int, editor boolean, owner boolean")
    got = {r.i: (r.status, list(r.deficiencies)) for r in D.sustained_acceptance(df).collect()}
    assert got == {0: ("accepted", []), 1: ("deficient", ["scoped"]), 2: ("insufficient", ["sample"]), 3: ("deficient", ["unverified"]), 4: ("deficient", ["window"]), 5: ("deficient", ["editor", "owner"])}


def test_reconcile_manifest(spark):
    manifests = spark.createDataFrame([(1, 2, 300), (2, 1, 100), (3, 1, 100), (4, 0, 0)], "episode long, n_clips long, total_ms long")
    clips = spark.createDataFrame([(1, "a", 0, 100, 100, 100), (1, "b", 100, 300, 200, 250), (2, "a", 0, 100, 100, 161), (3, "a", 0, 100, 100, 100), (3, "b", 99, 100, 1, 1)], "episode long, clip string, in_ms long, out_ms long, duration_ms long, measured_ms long")
    files = spark.createDataFrame([(1, "a", "mp4", 5), (1, "b", "mp4", 5), (2, "a", "mp4", 0), (3, "a", "mp4", 1), (3, "b", "mp4", 1)], "episode long, clip string, suffix string, bytes long")
    got = {r.episode: list(r.reasons) for r in D.reconcile_manifest(manifests, clips, files, ("mp4",)).collect()}
    assert got == {1: [], 2: ["files", "duration"], 3: ["count", "total", "overlap"], 4: []}


def test_shot_plans(spark):
    shots = [(1, 0, 10, 50, 60, "crop", []), (1, 10, 30, 0, 20, "priority_over_face", ["graphic"]), (2, 5, 10, 0, 5, "crop", []), (2, 10, 20, 0, 9, "priority_over_face", ["face"])]
    df = spark.createDataFrame(shots, "k long, out_in_ms long, out_out_ms long, src_in_ms long, src_out_ms long, mode string, regions array<string>")
    found = D.shot_plan_findings(df, "k")
    assert {(r.k, r.out_in_ms): list(r.reasons) for r in found.collect()} == {(1, 0): [], (1, 10): [], (2, 5): ["gap"], (2, 10): ["length", "no region"]}
    assert rows(Y.none_with(found, "k", "no region"), "k", "valid") == [(1, True), (2, False)]


def test_shares_collisions_and_recall(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "x"), ("a", "y"), ("b", "z"), ("b", None)], "k string, t string")
    got = {r.k: r for r in Y.collisions(df, "t", F.lower("t"), "k").collect()}
    assert (got["a"].n_items, got["a"].n_changed, got["a"].n_raw, got["a"].n_norm) == (3, 1, 3, 2) and abs(got["a"].collision_rate - 1 / 3) < 1e-12
    assert (got["b"].n_items, got["b"].changed_rate) == (2, 0.0)
    assert rows(Y.share(df, "k", F.col("t") == "z", F.col("t").isNotNull()), "k", "n", "hits", "share") == [("a", 3, 0, 0.0), ("b", 1, 1, 1.0)]
    winners = spark.createDataFrame([(1, "w1"), (1, "w2"), (2, "w3")], "m long, w string")
    hits = spark.createDataFrame([(1, "w1", "verbal"), (1, "w1", "both"), (2, "w3", "visual")], "m long, w string, path string")
    assert rows(Y.recall(winners, hits.where("m = 1"), "m", "w"), "m", "recall") == [(1, 0.5), (2, 0.0)]
    each = Y.on_each_path(hits, "path", ("verbal", "visual"))
    assert rows(Y.recall_by_path(winners, each, "path"), "path", "found") == [("both", 1), ("verbal", 1), ("visual", 2)]
    assert rows(Y.unique_wins(each, "path", "w"), "path", "n") == [("visual", 1)]


def test_order_and_place(spark):
    s = spark.createDataFrame([(1, 0, 0, 10, True), (1, 1, 10, 30, False), (1, 2, 35, 40, True), (2, 5, 1, 2, True), (2, 5, 2, 3, True)], "k long, i long, start_ms long, end_ms long, ok boolean")
    assert rows(Y.without_gaps(s.where("ok"), "k", "i"), "k", "contiguous") == [(1, False), (2, False)]
    assert rows(Y.without_gaps(s.where("k = 1"), "k", "i"), "k", "contiguous") == [(1, True)]
    assert rows(Y.foreign_inside(s, "k", F.col("ok")), "k", "i") == [(1, 1)]
    assert rows(Y.tiled(s, "k", "start_ms"), "k", "in_order", "from_zero", "n") == [(1, True, True, 3), (2, True, False, 2)]
    assert rows(Y.cues_within(s, "k", 35), "k", "has_cue", "n_outside") == [(1, True, 1), (2, True, 0)]
    played = Y.offsets(Y.last_first(s.where("k = 1"), "k", "i"), "k", "_play", F.col("end_ms") - F.col("start_ms"))
    assert rows(played, "i", "offset_ms") == [(0, 5), (1, 15), (2, 0)]
    assert rows(Y.with_following(s.where("k = 1"), "k", "i", "need"), "i", "need") == [(0, [0, 1]), (1, [1, 2]), (2, [2])]
    error = spark.createDataFrame([(10, 1, 1, 0), (30, 0, 0, 6)], "speech_ms long, missed_ms long, false_alarm_ms long, confusion_ms long")
    assert Y.pooled_error(error).first().der == 0.2


def test_grids_are_for_few_values(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", None)], "x string, y long")
    assert rows(R.grid(df, "x", "y"), "x", "y") == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    monkeypatch.setattr(R, "GRID_VALUES", 1)
    try:
        R.grid(df, "x", "y")
        raise AssertionError("not refused")
    except ValueError:
        pass
