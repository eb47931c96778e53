import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import critique as C


def test_depth_equals_counting(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), a := rng.randint(0, 3000), a + rng.randint(-5, 400)) for _ in range(300)] + [(7, i, 5000) for i in range(200)] + [(8, None, 5), (8, 5, None)]
    df = spark.createDataFrame(rows, "k long, a long, z long")
    for bucket in (50, 100_000):
        got = C.depth(df, "k", "a", "z", bucket).collect()
        for key in (1, 2, None, 7, 8):
            own = sorted((r.in_ms, r.out_ms, r.depth) for r in got if r.k == key)
            spans = [(a, z) for k, a, z in rows if k == key and a is not None and z is not None and z > a]
            edges = sorted({t for s in spans for t in s})
            assert own == [(x, y, sum(a <= x and y <= z for a, z in spans)) for x, y in zip(edges, edges[1:])]


def test_a_crowded_recording_is_swept_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 1000).alias("a"), (F.col("id") * 1000 + 1500).alias("z"))
    swept = C.depth(df, "k", "a", "z").withColumn("b", F.floor(F.col("in_ms") / C.BUCKET_MS))
    assert swept.select("b").distinct().count() > 30  # windows are over (recording, bucket)
    assert {r.depth for r in swept.collect()} == {1, 2}


def test_all_clear_is_grounded(spark):
    seqs = spark.createDataFrame([(1, 1000, True, True), (2, 1000, True, True), (3, 1000, False, True), (4, 1000, True, False), (5, 1000, True, True), (6, 1000, True, True)], "k long, duration_ms long, has_context boolean, claim boolean")
    windows = [(k, a, a + 600, True, 5, True) for k in (1, 3, 4, 5) for a in (0, 400)] + [(2, 0, 600, True, 5, True), (2, 400, 1000, False, 5, True)] + [(4, 0, 10, True, 1, True), (4, 0, 10, True, 9, False)]
    w = spark.createDataFrame(windows, "k long, start_ms long, end_ms long, observed boolean, frames int, motion boolean")
    obs = spark.createDataFrame([(5, "warning"), (4, None)], "k long, severity string")
    got = {r.k: r for r in C.inspect_sequences(seqs, w, obs, "k").collect()}
    assert got[1].all_clear and not got[1].refused and (got[1].once_ms, got[1].more_ms, got[1].coverage) == (800, 200, 1.0)
    assert got[2].refused and list(got[2].reasons) == ["incomplete temporal coverage (60.0%)"] and got[2].n_observed == 1
    assert got[3].refused and list(got[3].reasons) == ["1 critical defect(s)", "missing aligned source context"]
    assert not got[4].refused and not got[4].all_clear and got[4].n_critical == 3 and list(got[4].reasons) == []
    assert list(got[5].reasons) == ["1 warning defect(s)"]
    assert list(got[6].reasons) == ["incomplete temporal coverage (0.0%)"] and got[6].n_windows == 0


CASES = {
    "ok-1": (("boundary", C.APPROVED, 90, 210), None),
    "ok-2": ((None, C.APPROVED, 100, 200), None),
    "cap": (("caption", C.APPROVED, None, None), None),
    "../up": (("boundary", C.APPROVED, 90, 210), "unsafe revision id"),
    "..": (("boundary", C.APPROVED, 90, 210), "unsafe revision id"),
    "empty-kind": (("", C.APPROVED, 90, 210), "unknown revision kind"),
    "other": (("colour", C.APPROVED, 90, 210), "unknown revision kind"),
    "done": (("boundary", "rendered", 90, 210), "not approved, or rendered already"),
    "no-status": (("boundary", None, 90, 210), "not approved, or rendered already"),
    "late": (("boundary", C.APPROVED, 101, 210), "starts mid-sentence"),
    "early": (("boundary", C.APPROVED, 100, 199), "ends mid-sentence"),
    "none": (("boundary", C.APPROVED, None, 210), "no proposed boundary"),
}


@pytest.mark.parametrize("report,violation", [(("r", True, 2, True, 100, 200, True), None), (("r", False, 2, True, 100, 200, True), "no clip"), (("r", True, 0, True, 100, 200, True), "no selected sentences"), (("r", True, None, True, 100, 200, True), "no selected sentences"), (("x", True, 2, True, 100, 200, True), "no report"), (("r", True, 2, True, 100, 200, False), "sentence not complete")])
def test_propose_render(spark, report, violation):
    revisions = spark.createDataFrame([("r", k, *v) for k, (v, _) in CASES.items()], "run string, revision_id string, kind string, status string, in_ms long, out_ms long")
    reports = spark.createDataFrame([report], "run string, has_clip boolean, n_sentences int, has_output boolean, anchor_in long, anchor_out long, complete boolean")
    asked = revisions.select("run", "revision_id").unionByName(spark.createDataFrame([("r", "missing"), ("r", None)], "run string, revision_id string"))
    got = {r.revision_id: r for r in C.propose_render(asked, revisions, reports).collect()}
    assert got["missing"].violation == "no revision record" and got[None].violation == "unsafe revision id"
    before = {"unsafe revision id", "unknown revision kind", "not approved, or rendered already"}
    for name, (_, own) in CASES.items():
        want = own if own in before or violation is None else violation
        if violation == "sentence not complete":
            want = None if name == "cap" else own if own in before | {"no proposed boundary"} else violation
        assert (got[name].violation, got[name].valid) == (want, want is None), name
    assert got["ok-2"].kind == "boundary" and got["../up"].kind is None
