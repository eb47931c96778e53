import random
import re

from spanloom.operators import lexicon as L

WORD = re.compile(r"[^\W]+")


def is_word(token, words, suffixes):
    return token in words or any(token.endswith(s) and len(token) > len(s) and token[: -len(s)] in words for s in suffixes)


def brute(text, words, prefix, suffixes=()):
    """The refusal rule, token by token."""

    def split(m):
        token = m[0]
        if len(token) <= len(prefix) or not token.startswith(prefix) or is_word(token, words, suffixes) or not is_word(token[len(prefix) :], words, suffixes):
            return token
        return f"{prefix} {token[len(prefix) :]}"

    return WORD.sub(split, text)


def lexicon(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_split_only_if_the_rest_is_a_word_and_the_whole_is_none(spark):
    waw, words = "و", ["کتێب", "ژن", "وتار", "تار", "من", "تۆ"]
    suffixes = ("ان", "ەکان")
    texts = {
        1: "وکتێبەکان",  # the rest is a word with its ending, the whole is none
        2: "ئەم کتێبە وژنان",
        3: "وتار",  # a word that merely begins so
        4: "وتو وپپپپ",  # nothing to split to
        5: f"من {waw} تۆ",  # bare
        6: "«وکتێبەکان» وکتێبەکان.",
        7: "",
        8: "hello world",
        9: None,
    }
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    got = {r.k: (r.text, r.n_splits) for r in L.separate(df, "k", lexicon(spark, words), waw, suffixes).collect()}
    assert got[1] == (f"{waw} کتێبەکان", 1) and got[2] == (f"ئەم کتێبە {waw} ژنان", 1) and got[6] == (f"«{waw} کتێبەکان» {waw} کتێبەکان.", 2)
    assert all(got[k] == (texts[k], 0) for k in (3, 4, 5, 7, 8, 9))
    again = L.separate(spark.createDataFrame([(k, t) for k, (t, _) in got.items()], "k long, text string"), "k", lexicon(spark, words), waw, suffixes)
    assert {r.k: r.text for r in again.collect()} == {k: t for k, (t, _) in got.items()}


def test_no_word_of_the_lexicon_is_ever_split(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abn") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "k long, text string")
    assert L.separate(df, "k", lexicon(spark, words), "an").where("n_splits > 0").count() == 0


def test_texts_equal_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abné") for _ in range(rng.randint(1, 4))) for _ in range(60)}
    texts = [(rng.randint(0, 150) if i % 9 else None, "".join(rng.choice(["a", "b", "n", "an", "é", " ", ", ", "\n", "_", "1"]) for _ in range(40)), "w", 1) for i in range(300)]
    texts += [(k, "anab and others", "w", 1) for k in range(1000, 1200)]  # one word that very many texts hold
    df = spark.createDataFrame(texts, "k long, text string, word string, n int")
    out = L.separate(df, "k", lexicon(spark, words), "an", ("b", "én"))
    assert out.columns == ["k", "text", "word", "n", "n_splits"]
    want = sorted((str(k), brute(t, words, "an", ("b", "én"))) for k, t, _, _ in texts)
    assert sorted((str(r.k), r.text) for r in out.collect()) == want
    shares = {r.k: (r.n_tokens, r.n_words) for r in L.word_shares(df, "k", lexicon(spark, words), ("b", "én")).collect()}
    for key in {k for k, *_ in texts}:
        tokens = [w for k, t, _, _ in texts if k == key for w in WORD.findall(t)]
        assert shares[key] == (len(tokens), sum(is_word(w, words, ("b", "én")) for w in tokens))
    assert L.separate(df.limit(0), "k", lexicon(spark, words), "an").count() == 0
