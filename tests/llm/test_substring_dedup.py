import hashlib
import random
import re

from pyspark.sql import functions as F

from spanloom.llm import substring_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=D.WINDOW):
    words = [WORD.findall(t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        i = D.LAST_ID if i is None else i
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(i, least.get(g, i))
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (D.LAST_ID if i is None else i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def documents():
    rng = random.Random(4)
    vocabulary = [chr(97 + i) + "é" * (i % 2) for i in range(26)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 13, 14, 30, 80)]
    docs = [(0, None), (1, ""), (2, "a b c"), (3, "x " * 60), (4, "x " * 30 + "y " * 30)]
    for i in range(5, 160):
        w = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            w += p[a : len(p) - rng.randint(0, 3)] if rng.random() < 0.6 else [rng.choice(vocabulary[:3] if rng.random() < 0.3 else vocabulary) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.2:
                w[rng.randrange(len(w))] = "zz"
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(w) + rng.choice(["", "\n"])))
    docs += [(7, docs[20][1]), (7, "q " + docs[30][1]), (None, docs[40][1]), (None, docs[40][1]), (None, " ".join(passages[4]) + " new")]
    rng.shuffle(docs)
    return docs


def test_removals_equal_brute_force(spark, monkeypatch):
    docs = documents()
    table = spark.createDataFrame([(i, t, 0, 5) for i, t in docs], "doc_id long, text string, spans int, n_chars int")
    table = table.withColumns({"row": F.lit(1), "doc": F.lit("d"), "t": F.lit("t"), "_salt": F.lit(0), "text_": F.col("text")})
    want = sorted((str(i), n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, gone, kept in brute(docs))
    for shard, chars, block in ((2000, 4_000_000, 50_000), (3, 100, 30)):
        monkeypatch.setattr(D, "SHARD_SNIPPETS", shard)
        monkeypatch.setattr(D, "SHARD_CHARS", chars)
        monkeypatch.setattr(D, "BLOCK", block)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in D.digests(table).collect())
        assert got == want
    left = D.remove(table)
    assert left.columns == table.columns
    rows = left.collect()
    assert sorted((str(r.doc_id), " ".join(WORD.findall(r.text or ""))) for r in rows) == sorted((str(i), " ".join(kept)) for i, _, _, kept in brute(docs))
    whole = {(i, t) for i, t in docs}
    assert all((r.doc_id, r.text) in whole and r.n_chars == 5 or r.n_chars == len(r.text) for r in rows)
    assert sum(r.text is None for r in rows) == 1
    assert {(r.row, r.doc, r.t, r._salt) for r in rows} == {(1, "d", "t", 0)}
    assert D.digests(table.limit(0)).count() == 0


def test_automaton_finds_every_window():
    rng = random.Random(9)
    for _ in range(200):
        refs = [([rng.choice("ab") for _ in range(rng.randint(0, 12))], i) for i in range(5)]
        rng.shuffle(refs)
        machine = D.SuffixAutomaton()
        for words, doc in refs:
            machine.add(words, doc)
        machine.settle()
        for size in (2, 4):
            query = [rng.choice("abc") for _ in range(15)]
            want = []
            for k in range(len(query) - size + 1):
                owners = [d for w, d in refs if any(w[j : j + size] == query[k : k + size] for j in range(len(w)))]
                if owners:
                    want.append((k, min(owners)))
            assert machine.matches(query, size) == want
