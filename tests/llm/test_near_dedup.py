import random
import re
from itertools import combinations

import numpy as np

from spanloom.llm import near_dedup as N


def brute(docs, size, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: (len(s), find(i)) for i, s in sets.items()}


def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)] + ["É", "ABC"]
    out = [None, "", "one", "One", "one two", "ONE TWO", "x y z", "x  y\nz", " \n"]
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 120, 400]))]
        out += [" ".join(base)] * 3 + [" ".join(base).upper()]
        for _ in range(60):  # copies with more and more changes, near the threshold and beyond
            w = list(base)
            for _ in range(rng.randint(1, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return list(enumerate(out))


def test_groups_equal_brute_force(spark, monkeypatch):
    docs = rows()
    table = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, "one two", 1), (None, None, 1)], "doc_id long, text string, rep int")
    for size, percent, blocks in ((3, 85, 1024), (5, 80, 8)):
        monkeypatch.setattr(N, "SKETCH_BLOCK", blocks)
        monkeypatch.setattr(N, "TEXT_BLOCK", blocks)
        want = brute(docs, size, percent)
        got = N.groups(table, size, percent).collect()
        assert len(got) == len(docs) + 2
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = N.keep_one(table, 5, 80)
    assert kept.columns == table.columns and kept.count() == 2 + sum(i == c for i, (_, c) in want.items())
    assert N.groups(table.limit(0)).count() == 0


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    for share in (0.85, 0.95):
        got = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, int(1000 * share)).astype(np.uint64)
            own = rng.integers(0, 1 << 63, (2, (1000 - len(both)) // 2)).astype(np.uint64)
            values = np.concatenate([both, own[0], both, own[1]])
            n = len(both) + own.shape[1]
            _, _, sketch = N.signatures(values, np.array([0, n, 2 * n]), N.bands_for(0.85))
            got.append(N.similarity(np.bitwise_count(sketch[0] ^ sketch[1]).sum(), N.bands_for(0.85) * N.ROWS))
        assert abs(np.mean(got) - share) < 0.03 and min(got) > share - N.SLACK


def test_forest_joins_what_is_linked():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        linked[a, b] = linked[b, a] = True
    tree = N.forest(linked)
    assert len(tree) == 3 and {frozenset(e) for e in tree} <= {frozenset(e) for e in ((0, 1), (1, 2), (0, 2), (4, 5))}



def test_cells_meet_what_is_apart_and_no_more(spark):
    n, block = 200, 16
    members = spark.createDataFrame([(1, i, n) for i in range(n)], "k long, node long, n_members long")

    def cells(df):
        out = {}
        for r in df.select("node", "cells").collect():
            assert len(set(r.cells)) == len(r.cells)
            for c in r.cells:
                out.setdefault((c.p, c.q), set()).add(r.node)
        return out

    first = cells(N.first_cells(members, "k", "node", block))
    assert set().union(*first.values()) == set(range(n)) and sum(map(len, first.values())) < n * 3
    linked = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
    assert cells(N.other_cells(members, linked, "k", "node", block)) == {}
    rest = cells(N.other_cells(members, linked.where("node < 150"), "k", "node", block))
    met = {frozenset(x) for c in rest.values() for x in combinations(c, 2)}
    assert all(frozenset((a, b)) in met for a in range(150, n) for b in range(n) if a != b)
