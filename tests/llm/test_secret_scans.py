import hashlib
import random
import re

from pyspark.sql import functions as F

from spanloom.llm import secret_scans as S

ODD = [None, "", "password = hunter2x and Token:abc", 'API_KEY="AKIA' + "Z9" * 9 + '"', "AKIA123", "deadbeef" * 3 + "x" + "0" * 23, "é password : token=abcdef", "ſecret=abcdefgh apiKey='x.y-z_/+='", "token = pass", "password=abc secret=abcdefg", "AKIA" * 6]


def brute(text):
    """By the wording of the contract: find, then drop."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in S.ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], S.KINDS.index(x[0])))]


def test_base_spans_and_ownership(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"
    copied, live = ("".join(rng.choice(alphabet) for _ in range(32)) for _ in range(2))
    rows = [(i, t, "r0", "o") for i, t in enumerate(ODD)]
    rows += [(100 + i, f"see {copied} in the guide", f"r{i}", "o") for i in range(5)]
    rows += [(200, f"my key {live} here", "r1", None), (200, f"my key {live} here", "r1", None), (201, f"again {live}", "r1", None), (None, f"{live}", "r1", None), (300, f"x {copied}", None, None)]
    rows += [(1000 + i, "".join(rng.choice(["token", "=", ":", " ", "'", "abcdef", "12", "AKIA", "Z", "0f"]) for _ in range(30)), "r2", None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, hash string")
    out = S.judge(docs).select("doc_id", F.col("n_assign") + F.col("n_access") + F.col("n_hex"), S.span_text("base").alias("base"), S.span_text("all").alias("all")).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in out:
        assert r.base == ",".join(brute(text[r.doc_id]))
        assert set(r.base.split(",")) - {""} <= set(r["all"].split(","))
    every = {r.doc_id: r["all"] for r in out}
    assert all(every[100 + i] == "" for i in range(5)) and every[300] == ""
    assert every[200] == f"owned:7:{7 + len(live)}" and every[201] and every[None]
    assert {(r.verdict, r.n_owners, r.n_uses) for r in S.find_table(S.scan(docs)).collect() if r.doc_id in (100, 200)} == {("copied", 6, 6), ("live", 1, 4)}
    docs = docs.withColumns({"row": F.lit(1), "spans": F.lit("s"), "_key": F.lit("k"), "row_key": F.lit("rk"), "n_chars": F.length("text")})
    clean = S.redact(docs)
    assert {(r.row, r.spans, r._key, r.row_key) for r in clean.collect()} == {(1, "s", "k", "rk")}
    assert all(r.text is None or r.n_chars == len(r.text) for r in clean.collect())
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where(F.contains("text", F.lit(live))).count() == 0
    assert {r.text for r in clean.where("doc_id = 200").collect()} == {"my key [REDACTED] here"}
    assert clean.where("text is null").count() == 1
    assert S.judge(docs.limit(0)).count() == 0


def test_digest_of_spans(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert S.judge(docs).select(F.sha2(S.span_text("base"), 256).alias("h")).first().h == hashlib.sha256(b"").hexdigest()


def test_one_owner_in_many_repositories_is_no_secret(spark):
    key = "Zx9" * 3 + "Qw7rT2yU5iO1pLk3Jh"
    rows = [(i, f"use {key} here", f"repo{i % n}", "owner", n) for n in (2, 3) for i in range(6)]
    for n, verdict in ((2, "live"), (3, "copied")):
        docs = spark.createDataFrame([r for r in rows if r[4] == n], "doc_id long, text string, repo string, owner string, n int")
        got = S.find_table(S.scan(docs, "repo", "owner")).collect()
        assert {(r.verdict, r.n_repos, r.n_owners) for r in got} == {(verdict, n, 1)} and len(got) == 6
        assert {r["all"] is not None and len(r["all"]) for r in S.judge(docs, "repo", "owner").collect()} == {int(verdict == "live")}


def test_a_text_full_of_secrets(spark):
    docs = spark.createDataFrame([(1, "password=abcdef123 x " * 20_000, "s")], "doc_id long, text string, source string")
    assert S.redact(docs).first().text == "[REDACTED] x " * 20_000


def test_strings_inside_base_spans_count(spark):
    """Fifty owners hold the key as an assignment, one holds it bare: a copied example. One owner's own key is live."""
    key, own, hexed = "Ab3xK9pQ7zLmN4vR2tYw8", "Zx8wQ2rT5yU7iO9pA1sDf", "0123456789abcdef" * 2
    rows = [(i, f"token={key} and {hexed}", f"owner{i}") for i in range(50)] + [(100, f"bare {key}", "owner100"), (101, f"bare {own} then token={own}", "owner101"), (102, f"secret: {own}", "owner101")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.spans, r.verdicts) for r in S.judge(docs).select("doc_id", S.span_text("all").alias("spans"), S.verdict_text("all").alias("verdicts")).collect()}
    assert got[100] == ("", "")
    assert all(got[i] == ("assign:0:27,hex:32:64", "copied,copied") for i in range(50))
    assert got[101] == ("owned:5:26,assign:32:59", "live,live") and got[102] == ("assign:0:29", "live")
    assert {r.n_owners for r in S.find_table(S.scan(docs)).collect() if r.doc_id == 100} == {51}
