import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from spanloom.llm import packing as P


def test_closest_fill_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        capacity = rng.randint(1, 40)
        got = P.closest_fill(counts, capacity)
        assert all(0 < k <= counts[n] for n, k in got.items())
        best = max(s for ks in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(k * n for k, n in zip(ks, counts))) <= capacity)
        assert sum(k * n for n, k in got.items()) == best


def test_plan_places_every_token_once():
    rng = random.Random(2)
    for case in range(60):
        counts = {rng.randint(1, 63): rng.choice([1, 2, 50, 1000]) for _ in range(rng.choice([1, 2, 20]))}
        slots, sequences, _ = P.plan(counts, 64)
        cover = {}
        rows = {}
        for source, lo, hi, start, length, first, items, seq, at in slots:
            for r in range(lo, hi):
                i = first + r - lo
                cover.setdefault((source, r), []).append((start, length))
                rows.setdefault(seq + i // items, []).append((at + i % items * length, length))
        assert {k for k in cover} == {(n, r) for n, c in counts.items() for r in range(c)}
        for (n, _), parts in cover.items():
            parts.sort()
            assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) == n
        assert sorted(rows) == list(range(sequences))
        for parts in rows.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:]))
        assert sum(sum(x[-1]) < 64 for x in rows.values()) <= 1


def check(rows, docs, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary())
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [P.END_ID])
    seqs, by_doc = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= window
    assert sum(sum(p[-1]) < window for p in seqs.values()) <= 1
    assert sorted(seqs) == list(range(len(seqs)))
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        if len(ids) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids[0])
                assert r.ids_crc32 == zlib.crc32(np.array(ids[0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids[0])
        else:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, ids))


def test_pack(spark):
    rng = random.Random(3)
    texts = [None, "", "A<|endoftext|>b<|ENDOFTEXT|> <|startoftext|><|endoftext|> it's ÉCOLE é x y 😀 1234"] + [" ".join("".join(rng.choice("abcdeft'É1") for _ in range(rng.randint(1, 12))) for _ in range(rng.choice([3, 30, 300]))) for _ in range(60)] + ["same text of a few words"] * 40
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "again five")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")
    for window in (64, 1000):
        check(P.pack(table, P.vocabulary(), window).collect(), docs, window)
    assert P.pack(table.limit(0), P.vocabulary()).count() == 0


def test_plain_words_keep_the_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from spanloom.llm import common as C

    t = Tokenizer.from_file(P.vocabulary())
    rng = random.Random(5)
    parts = ["a", "Z", "'s", "'", ".", ",", "#", "##", "&", "1", " ", "\n", "É", "é", "e\u0301", "H\u0331", "İ", "ß", "日", "😀", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "-", "_", "Σ", "\u00a0", "\x00"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)] + ["ΟΔΟΣ. T\u0308x", "don't.stop"]
    ids = P.WordIds(P.vocabulary())
    for limit in (300, 1 << 20):
        got = []
        for _, _, data, at in C.chunks(pa.array(rows), limit):
            raw, edges = P.plain_words(data, at)
            got += [np.frombuffer(ids.packed(raw[s:e]), "<u4").tolist() for s, e in zip(edges, edges[1:])]
        for text, own in zip(rows, got):
            assert own == t.encode(text, add_special_tokens=False).ids + [P.END_ID], repr(text)


def test_a_very_long_text_and_clashing_columns(spark):
    docs = [(1, "some words of a long text " * 30_000), (2, "short")]
    table = spark.createDataFrame([(*d, 0, 0, 0) for d in docs], "doc_id long, text string, length int, rank int, sequence_id int")
    check(P.pack(table, P.vocabulary()).collect(), docs, P.WINDOW)
