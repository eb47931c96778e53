"""Word alignment, delivery and promotion on small tables with known answers."""

import random

from pyspark.sql import functions as F

from spanloom.operators import alignment as A
from spanloom.operators import delivery as D
from spanloom.operators.skew import spread_join


def blocks(a, b):
    """Pairs of equal words: the longest common run first (the earliest of these), then both sides of it."""
    best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=None)
    if best is None:
        return []
    n, i, j = best[0], -best[1], -best[2]
    after = [(x + i + n, y + j + n) for x, y in blocks(a[i + n :], b[j + n :])]
    return blocks(a[:i], b[:j]) + [(i + k, j + k) for k in range(n)] + after


def test_words_are_matched_by_longest_blocks(spark):
    rng = random.Random(2)
    refs = {m: [rng.choice("abcd") for _ in range(rng.randint(0, 14))] for m in range(40)}
    hyps = {m: [rng.choice("abcd") for _ in range(rng.randint(0, 14))] for m in range(40)}
    table = lambda t: spark.createDataFrame([(m, i, w, i * 100, i * 100 + 80) for m, ws in t.items() for i, w in enumerate(ws)], "media_id long, pos long, w string, start_ms long, end_ms long")
    got = sorted(tuple(r) for r in A.matched_words(table(refs), table(hyps)).collect())
    assert got == sorted((m, i, j) for m in refs for i, j in blocks(refs[m], hyps[m]))
    for r in A.score_alignment(table(refs), table(hyps)).collect():
        pairs = blocks(refs[r.media_id], hyps[r.media_id])
        assert (r.words, r.matched) == (len(refs[r.media_id]), len(pairs))
        off = [abs(i - j) * 100 for i, j in pairs]
        assert (r.onset_ms, r.within) == ((sum(off) / len(off), sum(x <= 50 for x in off) / len(off)) if off else (None, None))


def test_a_clean_clip_has_no_reasons(spark):
    clips = spark.createDataFrame([(1, 20_000, 0, True, True), (2, 20_000, 0, True, True)], "clip long, span_ms long, removed_ms long, captions boolean, face_tracked boolean")
    measured = spark.createDataFrame([(1, 20_010, 20_010, 1080, 1920, -14.2, -1.5, 1.0, 0.95)], "clip long, video_ms long, audio_ms long, width int, height int, loudness double, peak double, ink double, face double")
    marks = lambda *rows: spark.createDataFrame(list(rows), "clip long, at_ms long")
    cuts = D.cut_findings(marks((1, 1000)), marks((1, 1030), (1, 5200)), marks((1, 5000)), clips, "clip", 40)
    assert {r.clip: (r.missing, r.rogue) for r in cuts.collect()} == {1: (0, 0), 2: (0, 0)}
    assert {r.clip: r.reasons for r in D.reconcile(clips, measured, cuts, "clip").collect()} == {1: [], 2: ["not measured"]}
    far = D.cut_findings(marks((1, 1000)), marks((1, 9000)), marks((1, 5000)), clips, "clip", 40)
    assert {r.clip: (r.missing, r.rogue) for r in far.collect()}[1] == (1, 1)


def test_promotion_needs_a_switch_and_a_name(spark):
    decisions = spark.createDataFrame([("a", "switch", "x", "me"), ("b", "switch", "x", None), ("c", "keep", "x", "me"), ("d", "switch", "y", "me")], "k string, decision string, challenger string, approved_by string")
    ledger = spark.createDataFrame([("a", 3), ("a", 4)], "k string, sequence long")
    assert {tuple(r) for r in D.promotion(decisions, "k", ledger).collect()} == {("a", 5, "x"), ("d", 1, "y")}


def test_a_heavy_key_joins_like_any_other(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k % 5 <> 4")
    got = spread_join(rows, table, ["k"], "n", 3000)
    want = rows.join(table, "k")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
