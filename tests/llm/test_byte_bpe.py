import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

public_tokenizers = pytest.importorskip("public_tokenizers")

from spanloom.llm import byte_bpe as B
from spanloom.llm import common as C

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  ", "\n", " \n ", "a", "it's we're I'll 'sx ''s 's's a'd' 'll", " 's", "  's", "\n's", "\n\n's", "x  \n y", "\t\tx", "é's", "1's22 '2", " 　x  y", "😀 😀'm 𝒜𝒷 ١٢", "áb", "don't!!! '' 've", "tail  ", "tail\n\n", " x\u0085", "'", "''", " '", "'re've'm", "'r", "'l", "'v e", "x'", "\x00\x1f", "﷐"]


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(["a", "s", "t", "re", "ll", "'", "'", " ", " ", "\n", "\t", "1", "!", "é", "日", " ", "😀"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_boundaries_equal_the_pattern():
    pattern, rows = regex.compile(public_tokenizers.PATTERN), texts()
    for lo, hi, data, at in C.chunks(pa.array(rows, pa.string()), 500):
        starts = B.token_starts(data, at)
        for i in range(lo, hi):
            a, b = at[i - lo], at[i - lo + 1]
            own = starts[(starts >= a) & (starts < b)] - a
            text = rows[i] or ""
            want = [len(text[: m.start()].encode()) for m in pattern.finditer(text)]
            assert own.tolist() == want, repr(text)


def test_ids_equal_the_library(spark):
    import tiktoken

    codec = B.load(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(6)
    rows = texts()[:1500] + ["a" * 3000, "ab" * 900 + "the" * 500, "".join(rng.choice("abcdeft") for _ in range(5000))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)] + [(None, "x", 2)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in B.digests(docs, PATH).collect()}
    assert len(got) == len(rows) + 1
    for i, t in enumerate(rows):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_and_offsets(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:300])], "doc_id long, text string")
    enc = B.encode(docs, PATH, offsets=True)
    for r in enc.collect():
        assert len(r.offsets) == len(r.ids) + 1 and r.offsets[-1] == len((texts()[r.doc_id] or "").encode())
    assert {r.doc_id: bytes(r.bytes) for r in B.decode(enc, PATH).collect()} == {i: (t or "").encode() for i, t in enumerate(texts()[:300])}
    assert B.digests(docs.limit(0), PATH).count() == 0
