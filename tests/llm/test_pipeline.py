import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P
from spanloom.llm import quality_rules, secret_scans
from tests.llm import test_near_dedup, test_packing, test_substring_dedup


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_one_by_one(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    names = docs.columns
    out = []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
        docs = out[-1]
        assert k == len(P.STAGES) - 1 or docs.columns == names
    first = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert {i for i, _ in rows(out[0])} == first
    groups = test_near_dedup.brute(rows(out[0]), 5, 80)
    assert {i for i, _ in rows(out[1])} == {i for i, (_, c) in groups.items() if i == c}
    want = {i: " ".join(kept) for i, _, _, kept in test_substring_dedup.brute(rows(out[1]))}
    assert {i: " ".join(test_substring_dedup.WORD.findall(t)) for i, t in rows(out[2])} == want
    before = dict(rows(out[2]))
    for i, t in rows(out[3]):
        assert not secret_scans.base_spans(t.replace("[REDACTED]", "\n"))
        assert t == before[i] or "[REDACTED]" in t
        assert re.sub(r"\s+", "", t.split("[REDACTED]")[0]) == re.sub(r"\s+", "", before[i])[: len(re.sub(r"\s+", "", t.split("[REDACTED]")[0]))]
    test_packing.check(out[4].collect(), rows(out[3]), 4096)


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").where("doc_id is not null").count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, and no rows at all."""
    sf, word = "/root/testdata/sf0.001", "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()
    prose = " ".join(word)
    texts = [(1, prose + ". One two three."), (1, prose + ". One two three."), (2, None), (3, ""), (None, prose), (None, prose), (None, None), (4, "other " + prose + " end"), (5, "password=abcdef123 " + prose), (6, "Long words in a row, all of them. " * 6000), (4, "short")]
    columns = "doc_id long, text string, row int, spans string, doc long, t string, row_key binary, found int, kept boolean, _gone long, _salt int, length int, source string, lang string"
    docs = spark.createDataFrame([(i, t, 1, "s", 2, "t", b"k", 3, True, 4, 5, 6, "w", None) for i, t in texts], columns)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema and stage(spark, docs.limit(0), sf).count() == 0
        rows = out.collect()
        assert all(tuple(r)[2:] == (1, "s", 2, "t", b"k", 3, True, 4, 5, 6, "w", None) for r in rows)
        if name == "quality rules":
            assert not any(r.text in (None, "", "short") for r in rows)
        elif name == "near duplicates":
            assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "1", "2", "3", "None", "None", "None", "4", "4", "6"])  # 5 is a near copy of 4
        else:
            assert len(rows) == len(texts) and sum(r.text is None for r in rows) == 2
    assert P.STAGES[-1][1](spark, docs, sf).agg({"length": "sum"}).first()[0] > 36_000
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
