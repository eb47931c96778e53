"""Registered queries do the whole job: small tables on which a prefix or a filter of rows would change the result."""

import datetime
import math
import random
from collections import Counter

import duckdb
import pytest

from spanloom.plans.all import ORACLES, QUERIES
from spanloom.tables import LETTERS


def test_similar_texts_are_judged_by_all_their_words(spark, tmp_path):
    head, rest = [f"h{i}" for i in range(60)], [f"r{i}" for i in range(200)]
    texts = {
        0: [*head, *rest],
        1: [*head, *[f"x{i}" for i in range(200)]],  # the same head, another rest: not similar
        2: [*[f"y{i}" for i in range(60)], *rest],  # another head, the same rest: similar
    }
    spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = datetime.datetime(2024, 1, 1)
    events = [(k, 7, "click", 9.0 - k, start + datetime.timedelta(days=k)) for k in texts]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.candidate_id: r.reason for r in QUERIES["q6_19_plan_episode"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: None, 2: "similar"}
    assert {r.candidate_id for r in QUERIES["q6_20_select_episode"](spark, str(tmp_path)).collect()} == {0, 1}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


RATES = {
    "q8_5_edit_distance": lambda a, b: edits(a, b),
    "q8_7_cer": lambda a, b: round(edits(a, b) / len(a), 9),
    "q8_8_normalized_cer": lambda a, b: round(edits(a.strip(), b.strip()) / len(a.strip()), 9),
    "q8_9_spacing_free_cer": lambda a, b: round(edits("".join(a.split()), "".join(b.split())) / len("".join(a.split())), 9),
    "q8_18_materially_disagree": lambda a, b: edits(a, b) / len(a) >= 0.15,
}


@pytest.mark.parametrize("name", RATES)
def test_error_rates_cover_rows_beyond_ascii(spark, tmp_path, name):
    texts = ["the month on loan", " thé móvil con théatre ", "on on ünon", "straße thon 😀 on", "on دەنگ th", "plain"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {k: RATES[name](t, t.replace("th", "t").replace("on", "om")) for k, t in rows}
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    plain = dict(con.execute(ORACLES[name]).fetchall())
    same = [k for k, t in rows if all(c.isascii() or c in LETTERS for c in t)]
    assert len(same) > 3 and {k: plain[k] for k in same} == {k: got[k] for k in same}


def bm25(docs, asked):
    """(query, document) to score, term by term; docs and asked: id to a list of terms."""
    tf = {k: Counter(ts) for k, ts in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, terms in asked.items():
        for k, c in tf.items():
            parts = [n * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean)) for t, n in Counter(terms).items() if t in c]
            if parts:
                out[q, k] = sum(parts)
    return out


def test_the_whole_benchmark_text_is_the_query(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 6))) for _ in range(120)]
    docs = {k: rng.choices(words, k=rng.randint(5, 40)) for k in range(30)}
    asked = {k: [f"zz{k}{i}" for i in range(5)] + rng.choices(words, k=20) for k in range(4)}  # no document has the first five words
    spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in asked.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    by_word = bm25(docs, asked)
    got = {(r.query_id, r.doc_id): r.score for r in QUERIES["q6_4_field_score"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(by_word, abs=1e-6)

    def grams(ws):
        return [p[i : i + 3] for w in ws for p in ["\x02" + w + "\x03"] for i in range(max(1, len(p) - 2))]

    by_gram = bm25({k: grams(w) for k, w in docs.items()}, {k: grams(w) for k, w in asked.items()})
    want = {}
    for q in asked:
        score = {k: by_word.get((q, k), 0.0) + 0.5 * by_gram.get((q, k), 0.0) for k in docs if (q, k) in by_word or (q, k) in by_gram}
        for rank, k in enumerate(sorted(score, key=lambda k: (-round(score[k], 9), k))[:10], 1):
            want[q, rank] = (k, score[k])
    found = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in QUERIES["q6_5_bm25_search"](spark, str(tmp_path)).collect()}
    assert {x: v[0] for x, v in found.items()} == {x: v[0] for x, v in want.items()}
    assert {x: v[1] for x, v in found.items()} == pytest.approx({x: v[1] for x, v in want.items()}, abs=1e-6)
