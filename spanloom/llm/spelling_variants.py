"""Spelling variants: words one edit apart, found by pivotal grams, and the most used form of each.

A word's bigrams are ordered by how rare they are among all words. Its prefix is every bigram up to the third rarest
(ties included), and its pivots are two disjoint bigrams of the prefix, chosen by dynamic programming so that
their counts add up to the least. One edit destroys at most one of two disjoint pivots, and of two near words at least
one has a pivot that survives into the other's prefix. So pivots, as the index, are joined with prefixes only.

Position limits make the join exact in what it asks: a gram that survives one edit lies wholly left or wholly
right of it, hence the words agree from their start through the gram, or from the gram to their end. That text is
the key; its position, from the start or from the end, has to agree. What is left of both words is compared by edit
distance inside the join. Where a key is crowded (pivots times prefixes above CROWDED), its rows get the rest of the
word with one code point left out as a further part of the key: near words share one of these, and
few words can. No group is emitted as all its pairs, and none is left out.

The steps: words are counted inside each task first; the counts of bigrams, at most 90 * 90 as the alphabet is
fixed, go to the tasks; roots are found by pointer doubling, whose rounds are few as counts at least double on the way.

Defined cases: a null or empty text has no words; a null id counts as the empty text in the rule that damages
runs; repeated rows count each; a very long text is cut between words only; a tie between forms goes to the word
first in code-point order; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.scratch import Scratch

#: Fixed values of the query: every how many digests a run is damaged, least length and count of a word, how much commoner a form is.
DAMAGE, LEAST_LENGTH, LEAST_COUNT, COMMONER = 97, 5, 3, 2
#: Code points of a gram, disjoint pivots (one more than the edits), and grams of a prefix (so many hold that many disjoint ones).
GRAM, PIVOTS = 2, 2
PREFIX = GRAM * (PIVOTS - 1) + 1
#: Most pairs of one key that are compared as they are; bytes of a text split at a time; words a task holds before it emits.
CROWDED, SLICE, HELD = 400, 1 << 20, 200_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: U+00C0 to U+00FF are this byte and one more.
_LEAD = 0xC3


def letters(data: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Which bytes are part of a run, and the bytes with A-Z lower-cased and blanks for all others."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside, np.where(inside, _LOWER[data], 32).astype(np.uint8).tobytes()


def _cuts(inside: np.ndarray, start: int, end: int) -> list[int]:
    """Where to cut a long text, between runs."""
    cuts = [start]
    while end - cuts[-1] > SLICE:
        ahead, step = cuts[-1] + SLICE, SLICE
        while ahead < end:
            out = np.flatnonzero(~inside[ahead : min(ahead + step, end)])
            if len(out):
                ahead += int(out[0])
                break
            ahead += step
        cuts.append(min(ahead, end))
    return [*cuts, end]


def damaged(run: bytes, digest: int) -> bytes:
    text = run.decode()
    at = digest % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def long_enough(word: bytes) -> bool:
    return len(word) >= LEAST_LENGTH and len(word) - word.count(_LEAD) >= LEAST_LENGTH


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of all texts, damaged runs as damaged; words of LEAST_LENGTH code points and LEAST_COUNT uses."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def out():
            # The file of words is sorted in each task: equal words lie together where they are merged.
            names = sorted(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array([held[w] for w in names], pa.int64())], names=["word", "n"])

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, data, at in C.chunks(b.column("text")):
                inside, raw = letters(data)
                for doc_id, s, e in zip(ids[lo:hi], at[:-1].tolist(), at[1:].tolist()):
                    cuts, own = _cuts(inside, s, e), Counter()
                    for x, y in zip(cuts, cuts[1:]):
                        own.update(raw[x:y].split())
                    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in own.items():
                        digest = zlib.crc32(word, base)
                        if digest % DAMAGE == 0:
                            word = damaged(word, digest)
                        if long_enough(word):
                            held[word] += n
                    if len(held) > HELD:
                        yield from out()
                        held.clear()
        yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def count_grams(words: DataFrame) -> dict[str, int]:
    """How often each bigram stands in the words: at most the square of the alphabet."""

    def run(batches):
        held: Counter[str] = Counter()
        for b in batches:
            for w in b.column("word").to_pylist():
                held.update(map("".join, zip(w, w[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    return {r["gram"]: r["n"] for r in words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def pivots(places: list[int], costs: list[int]) -> list[int]:
    """PIVOTS of the places, ascending and GRAM apart at least, of least total cost; ties: the first found."""
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] * (len(places) + 1)]
    for k in range(PIVOTS):
        row: list[tuple[int, list[int]] | None] = [None]
        for j, (at, cost) in enumerate(zip(places, costs)):
            before = j
            while before and places[before - 1] > at - GRAM:
                before -= 1
            have, less = row[-1], best[k][before]
            if less is not None and (have is None or less[0] + cost < have[0]):
                have = (less[0] + cost, [*less[1], at])
            row.append(have)
        best.append(row)
    return best[PIVOTS][-1][1]


def signature(word: str, counts: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the prefix's bigrams and of the pivots."""
    grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
    order = sorted((counts[g], g) for g in grams)
    last = order[PREFIX - 1]
    prefix = [i for i, g in enumerate(grams) if (counts[g], g) <= last]
    return prefix, pivots(prefix, [counts[grams[i]] for i in prefix])


def index(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """key, rest, pivot, n: for each pivot and each bigram of a prefix the text through it (`<`) and the text from it (`>`)."""
    schema = pa.schema([("key", pa.string()), ("rest", pa.string()), ("pivot", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            keys, rests, pivot, ns = [], [], [], []
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                prefix, piv = signature(w, counts)
                for places, flag in ((piv, True), (prefix, False)):
                    for i in places:
                        keys += ["<" + w[: i + GRAM], ">" + w[i:]]
                        rests += [w[i + GRAM :], w[:i]]
                    pivot += [flag] * (2 * len(places))
                    ns += [n] * (2 * len(places))
            yield C.batch(schema, keys, rests, pivot, ns)

    return words.mapInArrow(run, "key string, rest string, pivot boolean, n long")


def near_pairs(rows: DataFrame) -> DataFrame:
    """word, other, n_other: both directions of every pair of words one edit apart, perhaps several times."""
    sizes = rows.groupBy("key").agg(F.sum(F.col("pivot").cast("long")).alias("index"), F.sum((~F.col("pivot")).cast("long")).alias("asked"))
    crowded = sizes.where(F.col("index") * F.col("asked") > CROWDED).select("key", F.lit(True).alias("crowded"))
    # A rest with one code point left out, or none (the last of the sequence).
    less = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("rest")), lambda p: F.concat(F.col("rest").substr(F.lit(1), p), F.col("rest").substr(p + 2, F.length("rest")))))
    part = F.explode(F.when(F.col("crowded"), less).otherwise(F.array(F.lit(""))))
    rows = rows.join(crowded, "key", "left").select("key", "rest", "pivot", "n", part.alias("part"))
    own = rows.where("pivot").select("key", "part", F.col("rest").alias("a"), F.col("n").alias("n_a"))
    others = rows.where("not pivot").select("key", "part", F.col("rest").alias("b"), F.col("n").alias("n_b"))
    one = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    found = own.join(others, ["key", "part"]).where(one)
    anchor, head = F.expr("substr(key, 2)"), F.col("key").startswith("<")
    word = lambda rest: F.when(head, F.concat(anchor, rest)).otherwise(F.concat(F.col(rest), anchor))
    pair = lambda x, y, n: F.struct(word(x).alias("word"), word(y).alias("other"), F.col(n).alias("n_other"))
    return found.select(F.explode(F.array(pair("a", "b", "n_b"), pair("b", "a", "n_a"))).alias("p")).select("p.*")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of every word with a form: pointers are doubled until none moves."""
    now, last = scratch.save(links.select("word", F.col("form").alias("root"))), None
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.save(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if last is not None:
            scratch.drop(last)
        last = scratch.n
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def group(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of a table of distinct words (word, n) of two bigrams' length at least."""
    scratch = Scratch(words.sparkSession, "spelling_variants")
    words = scratch.save(words.select("word", "n"), "words")
    rows = scratch.save(index(words, count_grams(words)), "index")
    # One exchange serves both: repeated pairs go, and a word's pairs meet.
    near = near_pairs(rows).repartition("word").distinct().groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form"))).alias("best"))
    common = -F.col("best.less") >= COMMONER * F.col("n")
    forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    forms = scratch.save(forms, "forms")
    scratch.drop("index")
    found = roots(forms.where("form is not null"), scratch)
    return forms.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12(spark, sf_dir: str) -> DataFrame:
    return group(count_words(C.read(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


def _crc_table() -> str:
    """The remainders of all bytes for the reflected polynomial of crc32."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return "[" + ", ".join(map(str, out)) + "]"


ORACLE = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM runs),
digests AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(code), 2), lambda i: ('0x' || substr(code, i, 2))::BIGINT)),
    lambda crc, b: xor(crc >> 8, {_crc_table()}[(xor(crc, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM coded),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM digests)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.part = b.part AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.most >= {COMMONER} * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.most) END AS form,
    CASE WHEN b.most >= {COMMONER} * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
