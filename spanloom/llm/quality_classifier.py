"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

A text is cut into overlapping chunks that cover all of it. Each learned filter looks at WIDTH consecutive
bytes, at every byte, through its own table of weights for each byte value; its largest response in a chunk is the chunk's
feature (max-pooling). A text's features are the mean and the maximum over its chunks, and a logistic layer
combines them into one probability. Training draws a bounded sample of labelled rows to the driver, and sees every
chunk of them, some at a time; scoring runs inside the tasks over whole texts.

Defined cases: a null or empty text is one chunk of padding and gets that chunk's score; a null id keeps its
row and counts as held out (its crc is 0); repeated rows are scored one by one; with no labels, or labels of one
kind, every score is the share of label 1 (0.5 without any); equal texts get equal scores; a very long text is
scored whole, some chunks at a time; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C

CHUNK, HOP, WIDTH, STRIDE, FILTERS = 256, 192, 6, 1, 12
#: The sample of labelled rows: most rows of each label, and bytes of its longest text (longer ones are not drawn, but scored).
FIT_ROWS, FIT_BYTES, EPOCHS, BATCH, BLOCK = 700, 1 << 17, 7, 50, 1024
PREDICT_FROM = 0.3
_PLACES = (CHUNK - WIDTH) // STRIDE + 1


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts in the bytes, and each text's first chunk (one more at the end). The last chunk of a text ends with it."""
    size = np.diff(at)
    count = np.maximum(1, -(-(size - CHUNK) // HOP) + 1)
    first = np.concatenate(([0], np.cumsum(count)))
    k = np.arange(first[-1]) - np.repeat(first[:-1], count)
    start = np.minimum(k * HOP, np.repeat(np.maximum(size - CHUNK, 0), count))
    return start + np.repeat(at[:-1], count), first


class Network:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "table": rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32),  # 256: padding
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            "level": np.zeros(1, np.float32),
        }
        self.p["table"][:, 256] = 0

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk (after a ramp at 0), and where it is."""
        total = np.zeros((len(codes), _PLACES, FILTERS), np.float32)
        for w in range(WIDTH):
            total += self.p["table"][w][codes[:, w : w + STRIDE * _PLACES : STRIDE][:, :_PLACES]]
        where = total.argmax(1)
        best = np.take_along_axis(total, where[:, None], 1)[:, 0] + self.p["bias"]
        return np.maximum(best, 0), where

    def combine(self, chunk_features: np.ndarray, first: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(chunk_features, first[:-1]) / np.diff(first)[:, None]
        return np.concatenate((mean, np.maximum.reduceat(chunk_features, first[:-1])), 1)

    def score_codes(self, text_features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(text_features.astype(float) @ self.p["out"] + self.p["level"], -30, 30)))

    def scores(self, data: np.ndarray, at: np.ndarray, block: int = BLOCK) -> np.ndarray:
        start, first = cut(data, at)
        ends = np.repeat(at[1:], np.diff(first))
        codes_of = np.concatenate((data.astype(np.uint16), np.full(CHUNK, 256, np.uint16)))
        out = np.empty((len(start), FILTERS), np.float32)
        for k in range(0, len(start), block):
            where = start[k : k + block, None] + np.arange(CHUNK)
            codes = codes_of[where]
            codes[where >= ends[k : k + block, None]] = 256
            out[k : k + block] = self.pooled(codes)[0]
        return self.score_codes(self.combine(out, first))


def gradients(net: Network, codes: np.ndarray, first: np.ndarray, y: np.ndarray, share: np.ndarray, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Of the mean weighted logistic loss over texts whose chunks are codes[first[i] : first[i + 1]], some chunks at a time."""
    feats, where = np.empty((len(codes), FILTERS), np.float32), np.empty((len(codes), FILTERS), np.int64)
    for k in range(0, len(codes), block):
        feats[k : k + block], where[k : k + block] = net.pooled(codes[k : k + block])
    text = net.combine(feats, first)
    err = ((net.score_codes(text) - y) * share / len(y)).astype(np.float32)
    count = np.diff(first)
    text_of = np.repeat(np.arange(len(y)), count)
    back = (err[text_of] / count[text_of])[:, None] * net.p["out"][:FILTERS]
    # A maximum that several chunks share is handed to each of them in equal parts.
    top = text[text_of, FILTERS:] == feats
    tied = np.add.reduceat(top.astype(np.float32), first[:-1])[text_of]
    back = (back + np.where(top, err[text_of, None] * net.p["out"][FILTERS:] / tied, 0)) * (feats > 0)
    table = np.zeros_like(net.p["table"])
    chunk = np.arange(len(codes))[:, None]
    for w in range(WIDTH):
        np.add.at(table[w], (codes[chunk, where * STRIDE + w], np.arange(FILTERS)), back)
    table[:, 256] = 0
    return {"out": err @ text, "level": np.array([err.sum()], np.float32), "bias": back.sum(0), "table": table}


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Adam on the logistic loss over whole texts."""
    net, rng = Network(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            size = np.array([len(texts[r]) for r in rows])
            data, at = np.frombuffer(b"".join(texts[r] for r in rows), np.uint8), np.concatenate(([0], np.cumsum(size)))
            start, first = cut(data, at)
            where = start[:, None] + np.arange(CHUNK)
            codes = np.concatenate((data.astype(np.uint16), np.full(CHUNK, 256, np.uint16)))[where]
            codes[where >= np.repeat(at[1:], np.diff(first))[:, None]] = 256
            step += 1
            for name, g in gradients(net, codes, first, y[rows], share[rows]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                net.p[name] -= 0.02 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, held_out=None):
    """A function from (bytes, row starts) to scores, learned from at most fit_rows texts of each label.

    held_out: a condition on doc_id; rows for which it holds are never learned from. The sample is the first
    rows of each label in the order of a hash of the id, less those with texts beyond FIT_BYTES.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if held_out is not None:
        marked = marked.where(~held_out)
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = None
    for q in (0, 1):
        part = marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        some = part if some is None else some.unionByName(part)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(some), "doc_id")
    rows = own.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * fit_rows).toPandas()
    y = rows["quality"].to_numpy(float)
    if len(set(y)) < 2:
        level = float(y.mean()) if len(y) else 0.5
        return lambda data, at: np.full(len(at) - 1, level)
    return train([bytes(t) for t in rows["text"]], y).scores


def score(docs: DataFrame, scores) -> DataFrame:
    """doc_id and the score of every whole text."""

    def run(batches):
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(scores(data, at), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    held_out = C.id_crc() % 5 == 0
    out = score(docs, fit(docs, C.read(spark, sf_dir, "labels"), held_out=held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
