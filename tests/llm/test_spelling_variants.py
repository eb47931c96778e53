import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from spanloom.llm import spelling_variants as V


def brute_words(rows):
    """By the wording of the contract."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    of = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if near(a, b):
            of[a].append(b)
            of[b].append(a)
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(of[w]), form[w], form[w] and words[form[w]], root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def texts():
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    pool += [w[:i] + rng.choice("abÀ") + w[i + rng.randint(0, 1) :] for w in pool for i in (0, 2, len(w) - 1)] + ["aaaaa", "aaaaaa", "aaaaaaaa", "ababab", "bababa", "ÀÀÀÀÀ", "àÀÀÀÀ"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(60)).replace("a b", "a\x00b").title()) for i in range(120)]
    rows += [(None, None), (None, ""), (5, "1234 ☃ x×y÷z×××× x×y÷z×××× x×y÷z××××"), (6, "Fünf-Wörter, FÜNF wörter WÖRTER wörter"), (None, "nullid " * 4), (7, "zu kurz ab")]
    return rows + rows[:20]


def test_words_and_variants_equal_brute_force(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute_words(rows)
    monkeypatch.setattr(V, "HELD", 50)
    words = V.count_words(docs)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 100
    for crowded in (400, 3, 0):
        monkeypatch.setattr(V, "CROWDED", crowded)
        assert got(V.group(words)) == brute(want)
    assert V.group(V.count_words(docs.limit(0))).count() == 0


def test_a_long_text_is_cut_between_words_only(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcÀ") for _ in range(rng.randint(1, 12))) for _ in range(4000)) + "x" * 5000
    monkeypatch.setattr(V, "SLICE", 1000)
    docs = spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id long, text string")
    assert {r.word: r.n for r in V.count_words(docs).collect()} == brute_words([(i, text) for i in (1, 2, 3)])


def test_one_crowded_beginning(spark):
    rng = random.Random(4)
    words = {"interna" + "".join(rng.choice("abcdefgh") for _ in range(3)): rng.randint(3, 90) for _ in range(300)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(V.group(table)) == brute(words)


def test_a_chain_of_forms(spark):
    words = {"aaaaa" + "b" * i: 3 * 2**i for i in range(20)}
    out = {r.word: r.root for r in V.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(out.values()) == {"aaaaa" + "b" * 19}


@pytest.mark.parametrize("seed", range(3))
def test_pivots_are_the_cheapest_disjoint_pair(seed):
    rng = random.Random(seed)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        costs = [rng.randint(1, 9) for _ in places]
        at = dict(zip(places, costs))
        pair = V.pivots(places, costs)
        assert pair[1] - pair[0] >= V.GRAM
        assert sum(at[p] for p in pair) == min(at[a] + at[b] for a, b in combinations(places, 2) if b - a >= V.GRAM)
