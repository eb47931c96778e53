"""Operators held against small serial models and hand values."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spanloom.functions import numbers as N
from spanloom.functions import text as X
from spanloom.operators import contracts as K
from spanloom.operators import curation as U
from spanloom.operators import diarization as D
from spanloom.operators import retrieval as R
from spanloom.operators import selection as S
from spanloom.operators import sentences as Z
from spanloom.operators import spans as P
from spanloom.operators import timeline as L

SPAN = "media_id long, start_ms long, end_ms long"


def cells(rows):
    """The milliseconds that spans cover."""
    return {t for s, e in rows for t in range(s, e)}


def random_spans(rng, n, top=300):
    out = []
    for _ in range(n):
        s = rng.randrange(top)
        out.append((s, s + rng.randint(1, 60)))
    return out


def test_merge_subtract_complement_cover_the_right_instants(spark):
    rng = random.Random(1)
    a = {m: random_spans(rng, rng.randint(1, 8)) for m in range(40)}
    b = {m: random_spans(rng, rng.randint(0, 8)) for m in range(40)}
    table = lambda x: spark.createDataFrame([(m, s, e) for m, v in x.items() for s, e in v], SPAN)
    group = lambda df: {m: sorted((r.start_ms, r.end_ms) for r in rows) for m in a for rows in [[r for r in df if r.media_id == m]]}
    merged = group(P.merge(table(a), ["media_id"]).collect())
    left = group(P.subtract(table(a), table(b), "media_id", least_ms=1).collect())
    bounds = spark.createDataFrame([(m, 0, 400) for m in a], "media_id long, lo_ms long, hi_ms long")
    free = group(P.complement(table(a), bounds, "media_id").collect())
    for m in a:
        assert cells(merged[m]) == cells(a[m]) and all(x[1] < y[0] for x, y in zip(merged[m], merged[m][1:]))
        assert cells(left[m]) == cells(a[m]) - cells(b[m])
        assert cells(free[m]) == set(range(400)) - cells(a[m])
    short = group(P.subtract(table({0: [(0, 100)]}), table({0: [(10, 95)]}), "media_id", least_ms=50).collect())
    assert short[0] == []


def test_clock_round_trip(spark):
    retained = spark.createDataFrame([(1, 100, 200), (1, 300, 350), (1, 500, 700)], SPAN)
    points = spark.createDataFrame([(1, t) for t in (0, 100, 150, 199, 200, 250, 300, 349, 400, 500, 699, 700, 900)], "media_id long, t long")
    out = {r.t: r.output_ms for r in P.to_output(points, retained, "media_id", "t").collect()}
    assert [out[t] for t in (0, 100, 150, 200, 250, 300, 400, 500, 699, 700, 900)] == [0, 0, 50, 100, 100, 100, 150, 150, 349, 350, 350]
    none = {r.t: r.output_ms for r in P.to_output(points, retained, "media_id", "t", clamp=False).collect()}
    assert none[250] is None and none[0] is None and none[150] == 50
    inside = spark.createDataFrame([(1, v) for t, v in none.items() if v is not None], "media_id long, o long").distinct()
    back = {r.o: r.source_ms for r in P.to_source(inside, retained, "media_id", "o").collect()}
    assert all(none[s] == o for o, s in back.items())


def iou(a, b):
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    return both / (a[1] - a[0] + b[1] - b[0] - both)


CAND = "candidate_id long, media_id long, in_ms long, out_ms long, rank long"


def test_one_to_one_merge_equals_the_serial_rule(spark):
    rng = random.Random(20260807)
    a, b = [], []
    for m in range(60):
        for rows, base in ((a, 0), (b, 10_000)):
            for k in range(rng.randint(0, 6)):
                s = rng.randrange(0, 200)
                rows.append((base + m * 10 + k, m, s, s + rng.randint(20, 200), k // 2 + 1))
    rng.shuffle(a)
    got = {tuple(r.sources) for r in S.merge_candidates(spark.createDataFrame(a, CAND), spark.createDataFrame(b, CAND)).collect()}
    want, used = set(), set()
    for x in sorted(a, key=lambda x: (x[4], x[0])):
        free = [y for y in b if y[1] == x[1] and y[0] not in used and iou(x[2:4], y[2:4]) >= 0.5]
        if free:
            y = min(free, key=lambda y: (y[4], y[0]))
            used.add(y[0])
            want.add((x[0], y[0]))
        else:
            want.add((x[0],))
    assert got == want | {(y[0],) for y in b if y[0] not in used}


def test_vote_equals_the_serial_rule(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        s = rng.randrange(0, 400)
        rows.append((k, k % 12, rng.choice("abc"), s, s + rng.randint(40, 90), rng.randint(0, 9) / 10))
    got = {(r.media_id, r.leader_id): (r.votes, round(r.mean_score, 6), r.rank) for r in S.vote(spark.createDataFrame(rows, "candidate_id long, media_id long, run string, in_ms long, out_ms long, score double")).collect()}
    want = {}
    for m in range(12):
        leaders = []
        for x in sorted((r for r in rows if r[1] == m), key=lambda r: (-r[5], r[3], r[0])):
            home = next((c for c in leaders if iou(c[0][3:5], x[3:5]) >= 0.6), None)
            if home:
                home.append(x)
            else:
                leaders.append([x])
        kept = [c for c in leaders if len({x[2] for x in c}) >= 2]
        kept.sort(key=lambda c: (-len({x[2] for x in c}), -round(sum(x[5] for x in c) / len(c), 9), c[0][3], c[0][0]))
        for place, c in enumerate(kept, 1):
            want[m, c[0][0]] = (len({x[2] for x in c}), round(sum(x[5] for x in c) / len(c), 6), place)
    assert got == want


def test_diverse_selection_equals_the_serial_rule(spark):
    rng = random.Random(4)
    words = list("abcdefghij")
    rows = [(k % 9, k, s, s + rng.randint(20, 60), float(rng.randint(0, 5)), rng.sample(words, rng.randint(0, 6))) for k in range(220) for s in [rng.randrange(0, 1500)]]
    table = spark.createDataFrame(rows, "media_id long, candidate_id long, in_ms long, out_ms long, score double, words array<string>")
    got = {r.candidate_id: r.reason for r in S.diverse(table, quota=5, separation_ms=30).collect()}
    want = {}
    for m in range(9):
        taken = []
        for x in sorted((r for r in rows if r[0] == m), key=lambda r: (-r[4], r[1])):
            reason = None
            if len(taken) >= 5:
                reason = "quota"
            elif any(x[2] < y[3] and y[2] < x[3] for y in taken):
                reason = "overlap"
            elif any(max(y[2] - x[3], x[2] - y[3]) < 30 for y in taken):
                reason = "separation"
            elif any(x[5] and y[5] and len(set(x[5]) & set(y[5])) / len(set(x[5]) | set(y[5])) > 0.5 for y in taken):
                reason = "similar"
            if reason is None:
                taken.append(x)
            want[x[1]] = reason
    assert got == want


def test_thinning_and_shots(spark):
    rng = random.Random(5)
    rows = [(i, sorted(rng.sample(range(1, 200), rng.randint(0, 20))), sorted(rng.sample(range(1, 250), rng.randint(0, 4)))) for i in range(50)]
    table = spark.createDataFrame(rows, "i long, pts array<bigint>, cuts array<bigint>").withColumn("d", F.lit(200).cast("long"))
    got = table.select("i", L.punch_ins(F.col("pts"), F.col("d"), F.col("cuts"), 30, 5).alias("p"), L.shots(F.col("pts"), F.col("d"), F.col("cuts"), 30, 5, 10).alias("s")).collect()
    for r, (_, pts, cuts) in zip(sorted(got, key=lambda r: r.i), rows):
        kept = []
        for t in pts:
            if not any(abs(t - c) < 5 for c in cuts) and t - (kept[-1] if kept else 0) >= 30:
                kept.append(t)
        assert [(x["at"], x["zoom"]) for x in r.p] == [(t, L.TIGHT if k % 2 == 0 else 1.0) for k, t in enumerate(kept)]
        own = [c for c in cuts if 0 < c < 200]
        marks = [0]
        for t in sorted({*own, *(t for t in pts if not any(abs(t - c) < 5 for c in own))}):
            if t - marks[-1] >= 30 and 200 - t >= 10:
                marks.append(t)
        assert [tuple(x) for x in r.s] == list(zip(marks, [*marks[1:], 200]))


def test_captions_and_lines(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        t, ws = 0, []
        for _ in range(rng.randint(1, 15)):
            e = t + rng.randint(50, 900)
            ws.append(("x" * rng.randint(1, 14), t, e))
            t = e + rng.choice([0, 100, 500])
        rows.append((i, ws))
    table = spark.createDataFrame(rows, "i long, ws array<struct<w:string,start_ms:bigint,end_ms:bigint>>")
    got = table.select("i", L.caption_chunks(F.col("ws")).alias("c"), L.wrap_lines(F.transform("ws", lambda x: x["w"]), 20).alias("lines")).collect()
    for r, (_, ws) in zip(sorted(got, key=lambda r: r.i), rows):
        chunks, now = [], []
        for w in ws:
            text = " ".join(x[0] for x in [*now, w])
            if now and (len(now) >= 3 or len(text) > 22 or w[2] - now[0][1] > 2000 or w[1] - now[-1][2] > 400):
                chunks.append(now)
                now = []
            now.append(w)
        chunks.append(now)
        assert list(r.c) == [k for k, c in enumerate(chunks) for _ in c]
        lines = []
        for w, _, _ in ws:
            if lines and len(lines[-1]) + 1 + len(w) <= 20:
                lines[-1] += " " + w
            else:
                lines.append(w)
        assert list(r.lines) == lines



def test_fillers(spark):
    def flags(text, gap=10):
        rows = [(1, i, w, i * 200, i * 200 + 200 - gap) for i, w in enumerate(text.split())]
        table = spark.createDataFrame(rows, "media_id long, pos long, w string, start_ms long, end_ms long")
        return [r.w for r in L.filler_flags(table, ("um", "you know")).orderBy("pos").collect() if r.filler]

    assert flags("um, I want want to go") == ["um,", "want"]
    assert flags("so you know it was was it was fine") == ["you", "know", "was"]
    assert flags("the cand candidate won") == ["cand"]
    assert flags("um um") == []


def test_diarization_error(spark):
    rng = random.Random(7)
    ref, hyp = [], []
    for m in range(15):
        for rows, names in ((ref, "ABC"), (hyp, "xyz")):
            t = 0
            for _ in range(rng.randint(1, 6)):
                t += rng.randint(0, 20)
                e = t + rng.randint(1, 40)
                rows.append((m, rng.choice(names), t, e))
                t = e
    schema = "media_id long, speaker string, start_ms long, end_ms long"
    got = {r.media_id: r for r in D.error(spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema)).collect()}
    for m in range(15):
        at = lambda rows, t: next((s for k, s, a, z in rows if k == m and a <= t < z), None)
        line = [(at(ref, t), at(hyp, t)) for t in range(400)]
        names = "xyz"
        confusion = min(sum(bool(r and h and dict(zip(names, p)).get(h) != r) for r, h in line) for p in permutations("ABC"))
        r = got[m]
        assert (r.missed_ms, r.false_alarm_ms, r.confusion_ms, r.speech_ms) == (sum(bool(a and not b) for a, b in line), sum(bool(b and not a) for a, b in line), confusion, sum(bool(a) for a, _ in line))


def test_disjoint_split_leaks_nothing(spark):
    rng = random.Random(8)
    rows = [(i, f"e{rng.randrange(60)}", f"s{rng.randrange(80)}" if rng.random() < 0.8 else None) for i in range(300)]
    out = U.disjoint_split(spark.createDataFrame(rows, "i long, episode string, speaker string"), "episode", "speaker")
    assert out.count() == 300
    assert U.leaks(out.where("split = 'training'"), out.where("split = 'holdout'"), ["episode", "speaker"]).count() == 0
    assert out.where("split = 'holdout'").count() > 0


def test_sentences_by_hand(spark):
    rows = [(1, 0, "We", 0, 100), (1, 1, "go.", 120, 300), (1, 2, "Then", 320, 400), (1, 3, "and", 420, 500), (1, 4, "stop", 1100, 1300)]
    words = spark.createDataFrame(rows, "media_id long, pos long, w string, start_ms long, end_ms long")
    got = [(r.text, r.complete) for r in Z.segment(words).orderBy("sent_id").collect()]
    assert got == [("We go.", True), ("Then and", False), ("stop", False)]
    pauses = spark.createDataFrame([(1, 100, 120)], "media_id long, pause_start_ms long, pause_end_ms long")
    assert [r.text for r in Z.segment(words, pauses, pause_ms=20).orderBy("sent_id").collect()] == ["We", "go.", "Then", "and", "stop"]
    assert tuple(Z.anchors(Z.segment(words)).first())[1:] == (0, 300)


def test_bm25_properties(spark):
    docs = spark.createDataFrame([(1, "red fox, runs"), (2, "red red fox"), (3, "blue sky"), (4, "foxes")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox"), (2, "nothing")], "query_id long, query string")
    rows = R.search(docs, asked).orderBy("rank").collect()
    assert {r.doc_id for r in rows} == {1, 2, 4} and all(r.query_id == 1 for r in rows)
    assert next(r for r in rows if r.doc_id == 4).word_score == 0


def test_text_expressions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert pick(X.substring_distance(lit("abc"), lit("xxabdxx"))) == 1
    assert pick(X.substring_distance(lit("abc"), lit(""))) == 3
    assert pick(X.cer(lit("é"), lit("e"))) == 1.0 and pick(X.cer(lit(""), lit("a"))) is None
    assert list(pick(X.character_ngrams(lit("ab")))) == ["\u0002ab", "ab\u0003"]
    assert pick(X.normalize(lit("  كي ٣۵ "))) == "کی 35"
    assert list(pick(X.cited_times(lit("1:02:03 then 12s, 300ms and 4:05")))) == [3723000, 245000, 300, 12000]
    assert pick(N.upper_median(F.array(lit(3), lit(None).cast("int"), lit(1), lit(2), lit(4)))) == 3
    assert pick(N.timecode(lit(60_000), 29.97)) == "00:00:59;28" and pick(N.timecode(lit(61_000), 25.0)) == "00:01:01:00"
    assert pick(N.wilson(lit(0.5), lit(0))).low is None
    assert pick(N.similarity01(F.array(lit(1.0)), F.array(lit(1.0), lit(2.0)))) == 0.0


def test_contracts_refuse(spark):
    rows = spark.createDataFrame([(5, 3), (-1, 4), (1, 2)], "s long, e long")
    checked = K.with_reasons(rows, K.span_rules("s", "e"))
    good, bad = K.split(checked)
    assert good.count() == 1 and {tuple(r.reasons) for r in bad.collect()} == {("ends before it starts",), ("negative start",)}
    with pytest.raises(Exception, match="negative start"):
        K.strict(checked.where("s < 0")).collect()
