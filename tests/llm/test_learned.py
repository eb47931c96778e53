import zlib

import numpy as np
import pyarrow as pa

from spanloom.llm import common as C
from spanloom.llm import language_id as L
from spanloom.llm import quality_classifier as Q


def test_chunks_cover_every_byte():
    sizes = np.array([0, 1, 255, 256, 257, 448, 449, 10_000])
    at = np.concatenate(([0], np.cumsum(sizes)))
    start, first = Q.cut(np.zeros(at[-1], np.uint8), at)
    for i, n in enumerate(sizes):
        seen = np.zeros(n, bool)
        for s in start[first[i] : first[i + 1]] - at[i]:
            assert s >= 0
            seen[s : s + Q.CHUNK] = True
        assert seen.all() and first[i + 1] > first[i]


def test_scores_do_not_depend_on_neighbours():
    texts = ["", "abc", "x" * 1000, "some words here " * 40]
    net = Q.Network()
    together = np.concatenate([net.scores(d, at) for _, _, d, at in C.chunks(pa.array(texts))])
    alone = [net.scores(d, at)[0] for t in texts for _, _, d, at in C.chunks(pa.array([t]))]
    assert np.allclose(together, alone)


def _table(spark, n=160):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(5, 200)))]
        good = i % 2
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w), "x"))
        labels.append((i, good, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = _table(spark)
    held = C.id_crc() % 5 == 0
    out = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, labels, held_out=held)).collect()}
    test = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 10 and np.mean([(out[i] >= 0.5) == (i % 2 == 1) for i in test]) > 0.95


def test_classifier_odd_rows(spark):
    docs, labels = _table(spark, 4)
    odd = docs.unionByName(spark.createDataFrame([(None, "null id", "x"), (9, None, "x"), (9, "", "x"), (1, "a" * 200_000, "x")], docs.schema))
    assert odd.count() == Q.score(odd, Q.fit(odd, labels.limit(0))).where("score between 0 and 1").count()
    assert Q.score(odd.limit(0), Q.fit(odd, labels.limit(0))).count() == 0


def test_language_filters(spark):
    rng = np.random.default_rng(4)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "éüopqr"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[g]), 4)) for _ in range(60)), g) for i, g in enumerate(list(letters) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = L.learn(docs.where("doc_id % 5 <> 1"))
    out = L.predict(docs, filters).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in out)
    odd = spark.createDataFrame([(1, None, "aa"), (2, "", None), (3, "12 -- ٣ ²", "aa"), (None, "ab", None), (4, "é", "aa")], docs.schema)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(odd, filters).collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3][1] != "und" and got[4][1] != "und"
    none = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.predict(odd, none).collect()} == {"und"}


def exact_shares(rows, text):
    """The share of the text's n-grams that belong to each language, by counting."""
    fold = lambda t: bytes(32 if c in L.C.SPACE_BYTES or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in t.encode())
    cut = lambda t: [fold(t)[i : i + 3] for i in range(len(t.encode()) - 2)]
    rate = {}
    for lang in {r[2] for r in rows}:
        grams = [g for _, t, x in rows if x == lang for g in cut(t)]
        rate[lang] = {g: grams.count(g) / len(grams) for g in set(grams)}
    best = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    own = {lang: {g for g, x in r.items() if x >= L.RATIO * best[g]} for lang, r in rate.items()}
    return {lang: sum(g in s for g in cut(text)) / max(1, len(cut(text))) for lang, s in own.items()}


def test_language_scores_equal_counting(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgé"[k : k + 6]), 4)) for _ in range(12)), f"l{k}") for i, k in enumerate([0, 1, 2] * 8)]
    learned = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learned).collect():
        want = exact_shares(rows, rows[r.doc_id][1])
        assert abs(r.score - max(want.values())) < 0.03 and want[r.lang_pred] > max(want.values()) - 0.03


def test_many_languages_and_a_long_text(spark):
    rows = [(i, "".join(chr(0x4E00 + 40 * i + j) for j in range(40)) * 3, f"l{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = L.learn(docs)
    assert len(learned.planes) == 3
    assert all(r.lang_pred == rows[r.doc_id][2] for r in L.predict(docs, learned).collect())
    long = spark.createDataFrame([(7, rows[7][1] * 20_000, "x")], docs.schema)
    assert L.predict(long, learned).first().lang_pred == "l007"


def test_filter_grows_with_its_ngrams():
    rng = np.random.default_rng(0)
    for n in (10, 5_000, 400_000):
        grams = rng.choice(L.GRAMS, n, replace=False).astype(np.uint32)
        bits = L.slot_bits(n)
        slots = np.zeros(1 << bits, np.uint8)
        for p in L.places(grams, bits):
            slots[p] |= 2
        f = L.Filters(["a", "b"], [slots], bits)
        assert ((f.masks(grams)[0] >> 1) & 1).all() and f.false_rate[0] == 0 and f.false_rate[1] <= 1.1 * L.FALSE_RATE
        others = np.setdiff1d(rng.choice(L.GRAMS, 100_000).astype(np.uint32), grams)
        assert (f.masks(others)[0] > 0).mean() <= 2 * L.FALSE_RATE


def test_network_equals_a_plain_convolution():
    net, rng = Q.Network(), np.random.default_rng(2)
    net.p["table"] = rng.normal(size=net.p["table"].shape).astype(np.float32)
    text = rng.integers(0, 256, 700).astype(np.uint8)
    best = []
    for s in (0, 192, 384, 444):
        chunk = text[s : s + Q.CHUNK]
        places = range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE)
        best.append([max(0.0, max(sum(net.p["table"][w, chunk[p + w], f] for w in range(Q.WIDTH)) for p in places)) for f in range(Q.FILTERS)])
    best = np.array(best)
    z = float(np.concatenate((best.mean(0), best.max(0))) @ net.p["out"] + net.p["level"][0])
    assert abs(net.scores(text, np.array([0, len(text)]))[0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 103, n).astype(np.uint8) for n in (0, 3, 300, 1500, 256)]
    data, at = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    start, first = Q.cut(data, at)
    where = start[:, None] + np.arange(Q.CHUNK)
    codes = np.concatenate((data.astype(np.uint16), np.full(Q.CHUNK, 256, np.uint16)))[where]
    codes[where >= np.repeat(at[1:], np.diff(first))[:, None]] = 256
    y, share = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 2, 0.5])
    net = Q.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["bias"] += 0.3

    def loss():
        p = net.score_codes(net.combine(np.concatenate([net.pooled(codes[k : k + 1])[0] for k in range(len(codes))]).astype(float), first))
        return float((share * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    for block in (2, 1024):
        grad = Q.gradients(net, codes, first, y, share, block)
        for name, g in grad.items():
            flat, own = net.p[name].reshape(-1), g.reshape(-1)
            for i in rng.choice(np.flatnonzero(own) if np.any(own) else np.arange(len(own)), 6):
                was, step = flat[i], 1e-3
                flat[i] = was + step
                up = loss()
                flat[i] = was - step
                down = loss()
                flat[i] = was
                assert abs((up - down) / (2 * step) - own[i]) < 2e-3 + 0.02 * abs(own[i]), (name, i)
