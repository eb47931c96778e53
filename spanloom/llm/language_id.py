"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, in each slot, one bit for each language; looking an n-gram up means to AND
the slots of its hashes, which answers for all languages at once. An n-gram (three bytes, A-Z folded) belongs
to a language in which it is, relative to the language's text, at least RATIO as frequent as where it is most
frequent. For a text the bits are counted by language over all its n-grams and corrected for the filter's
false positives; the highest share decides.

The n-gram counts cover all documents to learn from: they are summed inside each task first, into a table
bounded by the number of n-grams. Rates, the choice of n-grams and the slots are computed in the executors; the
driver gets one number a language and the finished slots. There are as many slots as the n-grams of the largest
language need for a false-positive rate of FALSE_RATE (12.4 for each, rounded up to a power of two), at any
size of the corpus; n-grams of three bytes bound them. Languages take one plane of slots for each 64.

Defined cases: null texts and texts without a letter are `und` with score 0, as are all texts when there is
nothing to learn from; ties go to the language that sorts first; a null id keeps its row (its crc is 0);
repeated rows are judged one by one; a very long text is judged whole; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.scratch import Scratch

#: Hashes of the filter, its false-positive rate, languages in a plane, slots in a segment; see above.
HASHES, FALSE_RATE, PLANE, SEGMENT, RATIO = 3, 0.01, 64, 1 << 16, 0.5
GRAMS = 1 << 24
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows, and where each row's begin. White space and digits count as one blank."""
    b = _FOLD[data]
    b[C.SPACE[data] | ((data >= 48) & (data <= 57))] = 32
    where = C.starts_in_rows(at, 3)
    bounds = np.concatenate(([0], np.cumsum(np.maximum(np.diff(at) - 2, 0))))
    if not len(where):
        return np.zeros(0, np.uint32), bounds
    grams = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return grams[where], bounds


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ASCII letters are seen in the bytes; only rows without one are decoded."""
    found = C.per_row(_ASCII_LETTER[data], at) > 0
    for i in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (text, lang)."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lo, hi, data, at in C.chunks(b.column("text")):
                grams, bounds = codes(data, at)
                name, which = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                of = np.repeat(which, np.diff(bounds))
                for k, lang in enumerate(name):
                    g, n = np.unique(grams[of == k], return_counts=True)
                    have = totals.get(lang)
                    if have is not None:
                        g, back = np.unique(np.concatenate((have[0], g)), return_inverse=True)
                        n = np.bincount(back, np.concatenate((have[1], n))).astype(np.int64)
                    totals[lang] = (g, n)
        for lang, (g, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slot_bits(n_grams: int) -> int:
    """Bits of a slot number, for so many n-grams of one language: (1 - exp(-HASHES * n / slots)) ** HASHES is FALSE_RATE at most."""
    need = -HASHES * n_grams / math.log(1 - FALSE_RATE ** (1 / HASHES))
    return max(16, math.ceil(math.log2(max(need, 1))))


def places(grams: np.ndarray, bits: int):
    """The slots of each n-gram, one array for each hash."""
    for k in range(HASHES):
        yield ((grams.astype(np.uint32) * np.uint32(2 * (0x5BD1E995 * (k + 1) % (1 << 30)) + 1)) >> np.uint32(32 - bits)).astype(np.int64)


class Filters:
    """planes: for each 64 languages the slots, whose bits say which of these have an n-gram."""

    def __init__(self, langs: list[str], planes: list[np.ndarray], bits: int) -> None:
        self.langs, self.planes, self.bits = langs, planes, bits
        fill = np.array([((planes[k // PLANE] >> planes[k // PLANE].dtype.type(k % PLANE)) & 1).mean() for k in range(len(langs))])
        self.false_rate = fill**HASHES

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        out = []
        for slots in self.planes:
            mask = None
            for p in places(grams, self.bits):
                mask = slots[p] if mask is None else mask & slots[p]
            out.append(mask)
        return out

    def shares(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text and language the share of its n-grams that the language has, less the false positives expected."""
        grams, bounds = codes(data, at)
        out = np.zeros((len(at) - 1, len(self.langs)))
        masks, n = self.masks(grams), np.maximum(np.diff(bounds), 1)
        for k, rate in enumerate(self.false_rate):
            mask = masks[k // PLANE]
            share = C.per_row((mask >> mask.dtype.type(k % PLANE)) & mask.dtype.type(1), bounds) / n
            out[:, k] = np.clip((share - rate) / max(1 - rate, 1e-9), 0, 1)
        return out


def owned_grams(docs: DataFrame) -> DataFrame:
    """lang, gram: the n-grams that belong to each language."""
    counts = Scratch(docs.sparkSession, "language_id").save(count_grams(docs.where(F.col("lang").isNotNull())), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    return rates.join(best, "gram").where(F.col("rate") >= RATIO * F.col("best")).select("lang", "gram")


def filled(owned: DataFrame, langs: list[str], bits: int) -> DataFrame:
    """plane, segment, slots: the words of a segment's slots as bytes, for segments that have any."""
    number = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))])[F.col("lang")]

    def spread(batches):
        for b in batches:
            grams, lang = b.column("gram").to_numpy(), b.column("lang").to_numpy()
            for p in places(grams, bits):
                word = np.uint64(1) << (lang % PLANE).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((lang // PLANE).astype(np.int32)), pa.array(p), pa.array(word.view(np.int64))], names=["plane", "slot", "word"])

    def gather(pdf):
        slots = np.zeros(SEGMENT, np.int64)
        slots[(pdf["slot"] % SEGMENT).to_numpy()] = pdf["word"].to_numpy()
        return pdf.iloc[:1][["plane", "segment"]].assign(slots=[slots.tobytes()])

    words = owned.select(number.alias("lang"), "gram").mapInArrow(spread, "plane int, slot long, word long")
    words = words.groupBy("plane", "slot").agg(F.bit_or("word").alias("word")).withColumn("segment", F.expr(f"slot div {SEGMENT}"))
    return words.groupBy("plane", "segment").applyInPandas(gather, "plane int, segment long, slots binary")


def learn(docs: DataFrame) -> Filters:
    """Filters from the rows of (text, lang) given."""
    owned = Scratch(docs.sparkSession, "language_id").save(owned_grams(docs), "owned")
    sizes = {r["lang"]: r["n"] for r in owned.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, bits = sorted(sizes), slot_bits(max(sizes.values(), default=0))
    planes = [np.zeros(1 << bits, np.uint64) for _ in range(-(-len(langs) // PLANE))]
    for row in filled(owned, langs, bits).toLocalIterator() if langs else ():
        planes[row["plane"]][row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["slots"], np.uint64)
    small = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(langs) <= 8 * t().itemsize or t is np.uint64)
    return Filters(langs, [x.astype(small) for x in planes], bits)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for every whole text."""
    names = np.array([*filters.langs, "und"], object)

    def run(batches):
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("text")):
                known = has_letter(data, at) & (len(filters.langs) > 0)
                share = filters.shares(data, at) if filters.langs else np.zeros((hi - lo, 1))
                best = np.where(known, share.argmax(1), len(filters.langs))
                top = np.where(known, share.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(names[best], pa.string()), pa.array(top, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    held_out = C.id_crc() % 3 == 1
    return predict(docs, learn(docs.where(~held_out))).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
