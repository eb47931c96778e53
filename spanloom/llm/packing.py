"""Packing by minimum bin slack.

Every document becomes ids, is cut into full windows and one remainder, and the remainders' lengths are counted
over the corpus: a table of at most `window` rows, whatever the input's size. On that table the driver picks
windows. Each starts with the longest remainder; a bitset subset-sum over the other lengths (with their
counts, by binary splitting) finds the multiset that comes closest to the capacity, and walking back through
the saved bitsets gives the counts. The choice is repeated as often as the counts allow. Where a window cannot
be filled exactly, one more remainder is cut to close it, so only the last window of all can have padding.

The plan is a table of slots: ranks of remainders of one length, to sequence and offset. Its size follows the
number of different lengths, not the documents (about window times the logarithm of the largest count), so it
is broadcast. A remainder's rank among those of its length comes from salted groups and running sums; no
length, however common, meets in one task.

Defined cases: a null or empty text is the end id alone; rows with equal or null ids are packed one by one;
pieces of one length are ranked by id, start and content, ties among equal rows falling either way; an empty
table gives no pieces; a very long text is encoded whole in one task and gives as many full windows as it has;
only id and text are read, so further columns of any name do no harm; a special token written in a text is that token,
as the library's plain call has it.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.scratch import Scratch

WINDOW, END_ID = 4096, 2
#: Most words in a worker's cache.
CACHE_WORDS = 800_000


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False  # an apostrophe may belong to what follows
#: The vocabulary's special tokens.
SPECIAL = re.compile(rb"(<\|startoftext\|>|<\|endoftext\|>)")
#: Lead bytes of combining marks, which may join a letter before it is lower-cased.
_COMBINING = (b"\xcc", b"\xcd")


def plain_words(data: np.ndarray, at: np.ndarray) -> tuple[bytes, list[int]]:
    """The texts with A-Z in lower case and a blank between a letter and the mark after it, and their row starts.

    The vocabulary lower-cases, splits there and drops blanks itself, so ids stay the same, but far fewer
    different words are left to encode. Special tokens stay as they are; in other case they are no tokens, and get a blank.
    """
    cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    if b"<|" in (whole := data.tobytes()):
        inside = [m.start() + m[0].rindex(b"|") for m in SPECIAL.finditer(whole)]  # the only such place in a special token
        cut = cut[~np.isin(cut, inside)]
    raw = np.insert(data, cut, 32).tobytes()
    edges = (at + np.searchsorted(cut, at)).tolist()
    return (raw if any(c in raw for c in _COMBINING) else raw.lower()), edges


class WordIds:
    """Packed ids of white-space separated words. The vocabulary drops white space and never joins across it, so words are encoded once and kept."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = {t.content.encode(): i.to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cache: dict[bytes, bytes] = {}

    def learn(self, new: list[bytes]) -> None:
        """Encode new words as one text with blanks between them; a token belongs to the word its offset lies in."""
        words = [w.decode() for w in new]
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            first = np.cumsum([0] + [len(w) + 1 for w in part])
            edge = (4 * np.searchsorted(np.array([o[0] for o in got.offsets]), first)).tolist()
            for word, s, e in zip(new[lo : lo + 4096], edge, edge[1:]):
                self.cache[word] = ids[s:e]

    def packed(self, text: bytes) -> bytes:
        """The ids of a text and the end's id. A special token is one id, and what stands on its sides is encoded apart."""
        if b"<|" in text:
            parts = SPECIAL.split(text)
            return b"".join(self.special[p] if k % 2 else self.ordinary(p) for k, p in enumerate(parts)) + END_ID.to_bytes(4, "little")
        return self.ordinary(text) + END_ID.to_bytes(4, "little")

    def ordinary(self, text: bytes) -> bytes:
        words = text.split()
        have = self.cache.get
        ids = list(map(have, words))
        if None in ids:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
                ids = [None] * len(words)
            self.learn(list(dict.fromkeys(w for w, i in zip(words, ids) if i is None)))
            ids = list(map(self.cache.__getitem__, words))
        return b"".join(ids)


@lru_cache(1)
def word_ids(vocabulary: str) -> WordIds:
    """Kept by the worker from task to task."""
    return WordIds(vocabulary)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_pieces(docs: DataFrame, vocabulary: str, window: int) -> DataFrame:
    """Each document's full windows and its remainder."""

    def run(batches):
        ids_of = word_ids(vocabulary)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, data, at in C.chunks(b.column("text")):
                (raw, edges), rows = plain_words(data, at), []
                for i, s, e in zip(ids[lo:hi], edges[:-1], edges[1:]):
                    packed = ids_of.packed(raw[s:e])
                    n = len(packed) // 4
                    rows += [(i, k, min(window, n - k), zlib.crc32(packed[4 * k : 4 * (k + window)]), n) for k in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, none more often than counts has it, whose sum comes closest to the capacity from below."""
    mask, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        before, left, part = reach, min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            reach |= reach << length * take & mask
            left, part = left - take, part * 2
        if reach != before:
            steps.append((length, before))
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        times = 0
        while not before >> (total - times * length) & 1:
            times += 1
        if times:
            chosen[length] = times
            total -= times * length
    return chosen


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple], int, int]:
    """(slots, sequences, cuts). A slot: source length, rank from, rank to, start in the remainder, length, first item, items a sequence, first sequence, offset.

    Item i (first item + rank - rank from) lies in sequence first + i // items, at offset + i % items * length.
    """
    stock = {n: [(n, 0, c, 0)] for n, c in counts.items() if c}
    have = {n: c for n, c in counts.items() if c}
    slots: list[tuple] = []
    sequences = cuts = 0

    def take(length: int, number: int) -> list[tuple[int, int, int, int]]:
        out = []
        have[length] -= number
        while number:
            source, lo, n, start = stock[length].pop()
            used = min(n, number)
            out.append((source, lo, used, start))
            if used < n:
                stock[length].append((source, lo + used, n - used, start))
            number -= used
        if not have[length]:
            del have[length], stock[length]
        return out

    while have:
        seed = max(have)
        rest = dict(have)
        rest[seed] -= 1
        chosen = closest_fill(rest, window - seed)
        chosen[seed] = chosen.get(seed, 0) + 1
        slack = window - sum(k * n for k, n in chosen.items())
        cut = 0
        if slack:
            cut = max((x for x, n in have.items() if n > chosen.get(x, 0)), default=0)
        need = dict(chosen)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        times = min(have[x] // k for x, k in need.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            first = 0
            for source, lo, n, start in take(length, chosen[length] * times):
                slots.append((source, lo, lo + n, start, length, first, chosen[length], sequences, offset))
                first += n
            offset += chosen[length] * length
        if cut:
            first = 0
            for source, lo, n, start in take(cut, times):
                slots.append((source, lo, lo + n, start, slack, first, 1, sequences, offset))
                stock.setdefault(cut - slack, []).append((source, lo, n, start + slack))
                have[cut - slack] = have.get(cut - slack, 0) + n
                first += n
            cuts += times
        sequences += times
    return slots, sequences, cuts


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`: the place of each among those of its length, from 0."""
    salts = max(16, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return salted.withColumn("_own", own).join(before, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_own", "_before", "_salt")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(first_pieces(docs, vocabulary, window), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.where(F.col("length") < window).groupBy("length").count().collect()}
    slots, sequences, cuts = plan(counts, window)
    names = "length long, lo long, hi long, cut_start long, cut_length long, first long, items long, sequence long, at long"
    table = spark.createDataFrame(slots, names)
    at = ranked(pieces)
    full = at.where(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(sequences) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = at.where(F.col("length") < window).join(F.broadcast(table), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    item = F.col("first") + F.col("rank") - F.col("lo")
    placed = placed.withColumns({"sequence_id": F.col("sequence") + F.floor(item / F.col("items")).cast("long"), "offset": F.col("at") + F.pmod(item, F.col("items")) * F.col("cut_length")})
    whole = placed.where(F.col("cut_length") == F.col("length")).select(*full.columns)
    out = full.unionByName(whole)
    if cuts:
        # Written, so that the planner knows how large the side is that texts are looked up for.
        parts = scratch.save(placed.where(F.col("cut_length") < F.col("length")), "parts")
        ids = parts.select("doc_id").distinct()
        again = remainders(docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["doc_id"]), "left_semi"), vocabulary, window).distinct()
        same = parts["doc_id"].eqNullSafe(again["r_id"]) & (parts["doc_tokens"] == again["r_tokens"]) & (parts["ids_crc32"] == again["r_crc"])
        piece = F.expr("substring(r_ids, cast(4 * cut_start + 1 as int), cast(4 * cut_length as int))")
        out = out.unionByName(parts.join(again, same).select("doc_id", (F.col("start") + F.col("cut_start")).alias("start"), F.col("cut_length").alias("length"), F.crc32(piece).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))
    return out


def remainders(docs: DataFrame, vocabulary: str, window: int) -> DataFrame:
    """The packed ids of each document's remainder, for those that are cut."""

    def run(batches):
        ids_of = word_ids(vocabulary)
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("text")):
                raw, edges = plain_words(data, at)
                packed = [ids_of.packed(raw[s:e]) for s, e in zip(edges[:-1], edges[1:])]
                rest = [p[len(p) // 4 // window * window * 4 :] for p in packed]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([zlib.crc32(r) for r in rest], pa.int64()), pa.array(rest, pa.binary())], names=["r_id", "r_tokens", "r_crc", "r_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "r_id long, r_tokens long, r_crc long, r_ids binary")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"), vocabulary())
