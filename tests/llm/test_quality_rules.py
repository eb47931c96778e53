import re

import numpy as np
import pytest

from spanloom.llm import common as C
from spanloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "a", "a b c d e a b c d e", "one two\none two\n\n\nx", "é ü # $ é\n é ü", "x " * 50, "\n\n", "a a a a a a", "tail\n", "A#B\r\nA#B\nA#B", "w" * 5000 + " 12 !!"]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), dup, len(hit)]


def test_statistics_equal_brute_force(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(rng.choice(list("ab #\n\té"), int(rng.integers(0, 80)))) for _ in range(300)]
    got = np.concatenate([Q.statistics(d, at) for _, _, d, at in C.chunks(pa.array(texts, pa.string()), 200)])
    assert got[:, :5].tolist() == [brute(t) for t in texts]


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(2000) < 0.05)).astype(float)
    model = Q.fit_trees(x, y, {0: -1})
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4)], 1)
    assert (np.diff(model.logit(grid)) <= 1e-12).all()
    assert ((model.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.98


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (3, "a", "z")], "doc_id long, text string, score string")


def test_odd_rows_and_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.judge(docs, labels).collect()
    assert len(out) == len(TEXTS) + 2
    assert not any(r.kept for r in out if r.n_words < 10)
    kept = Q.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert Q.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_verdict_equals_a_walk_down_each_tree(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdeAB#!1"), 4)) for _ in range(int(rng.integers(8, 60)))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t.count("#") < 8), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)

    def kept(row):
        words = max(row["n_words"], 1)
        if row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]:
            return False
        chars, lines = max(row["word_chars"], 1), max(row["n_lines"], 1)
        x = [row["n_symbols"] / words, row["n_repeat_words"] / words, row["n_dup_lines"] / lines, row["n_upper"] / chars, row["n_bang"] / words, row["n_digits"] / chars, row["word_chars"] / words, row["n_words"] / lines, np.log1p(row["n_words"])]
        total = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
            total += value[node]
        return total >= 0

    out = Q.judge(docs, labels).collect()
    assert all(r.kept == kept(r.asDict()) for r in out) and 20 < sum(r.kept for r in out) < 180
    long = spark.createDataFrame([(1, "word other " * 200_000)], "doc_id long, text string")
    assert Q.judge(long, labels).first().n_words == 400_000
