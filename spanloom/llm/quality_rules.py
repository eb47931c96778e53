"""Quality rules: fixed document rules, then gradient-boosted trees over document statistics.

The statistics come from whole texts in one vectorised pass. The trees are fitted on a bounded sample of
labelled rows, flattened into numpy node arrays (one row of nodes for each tree) and applied to whole Arrow
batches level by level. Chosen features are monotone: more of them can only lower the score.

Defined cases: a null or empty text has no words and fails the rules; a null id keeps its row; repeated
rows are judged one by one, equal texts alike; without labelled rows of both kinds nothing but the fixed rules
rejects; a very long text is measured whole, as one array of its task; an empty table gives no rows; `judge` reads
id and text only, `keep` carries columns of any name along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Most labelled rows that the trees are fitted on.
FIT_ROWS = 6000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang", "n_lines", "n_digits"]
#: Shares that only ever lower the score.
FEATURES = ["symbols", "repeats", "dup_lines", "upper", "bangs", "digits", "word_len", "line_words", "log_words"]
MONOTONE = {"symbols": -1, "repeats": -1, "dup_lines": -1, "upper": -1, "bangs": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_LINE_KEYS = C.BYTE_KEYS.copy()
_LINE_KEYS[0x0A] = 0


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """STATS of each text, as rows of integers."""
    starts, _, bounds = C.words(data, at)
    n_words = np.diff(bounds)
    out = np.zeros((len(at) - 1, len(STATS)), np.int64)
    head = (data & 0xC0) != 0x80
    out[:, 0] = n_words
    out[:, 1] = C.per_row(~C.SPACE[data] & head, at)
    out[:, 2] = C.per_row(_SYMBOL[data], at)
    out[:, 5] = C.per_row((data >= 65) & (data <= 90), at)
    out[:, 6] = C.per_row(data == 33, at)
    out[:, 8] = C.per_row((data >= 48) & (data <= 57), at)

    breaks = np.flatnonzero(data == 0x0A) + 1
    full = at[:-1][at[:-1] < at[1:]]
    lines = np.unique(np.concatenate((full, breaks[breaks < len(data)]))).astype(np.int64)
    if len(lines):
        with_word = np.diff(np.searchsorted(starts, np.append(lines, len(data)))) > 0
        row = np.searchsorted(at, lines, "right") - 1
        keys = C.mix(C.span_hashes(data, lines, _LINE_KEYS) + row.astype(np.uint64) * C.GRAM_KEYS[63])[with_word]
        row = row[with_word]
        _, once = np.unique(keys, return_index=True)
        out[:, 7] = np.bincount(row, minlength=len(out))
        out[:, 3] = out[:, 7] - np.bincount(row[once], minlength=len(out))

    at_word = C.starts_in_rows(bounds, REPEAT_WINDOW)
    if len(at_word):
        row = np.searchsorted(bounds, at_word, "right") - 1
        keys = C.grams(C.span_hashes(data, starts, C.WORD_KEYS), REPEAT_WINDOW)[at_word]
        _, which, times = np.unique(C.mix(keys + row.astype(np.uint64) * C.GRAM_KEYS[63]), return_inverse=True, return_counts=True)
        again = at_word[times[which] > 1]
        edge = np.zeros(len(starts) + 1, np.int32)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + REPEAT_WINDOW, -1)
        out[:, 4] = C.per_row(np.cumsum(edge[:-1]) > 0, bounds)
    return out


def features(stats: np.ndarray) -> np.ndarray:
    s = stats.astype(float)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 7], 1)
    return np.stack([s[:, 2] / words, s[:, 4] / words, s[:, 3] / lines, s[:, 5] / chars, s[:, 6] / words, s[:, 8] / chars, s[:, 1] / words, s[:, 0] / lines, np.log1p(s[:, 0])], 1)


class Trees:
    """Boosted trees of one depth as flat arrays: the children of node k are 2k + 1 and 2k + 2."""

    def __init__(self, depth: int, base: float) -> None:
        self.depth, self.base = depth, base
        self.feature, self.cut, self.value = [], [], []

    def add(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.feature.append(feature)
        self.cut.append(cut)
        self.value.append(value)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, ridge: float = 2.0, least: int = 8) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins.

    monotone has +1 or -1 by feature. A split that breaks the order is refused, and the mean of its two
    values bounds everything below it, so that each tree, and their sum, is monotone.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(depth, float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1)
    inner, size = 2**depth - 1, 2 ** (depth + 1) - 1
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(size)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        node = np.zeros(len(y), np.int64)
        value[0] = g.sum() / (h.sum() + ridge)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best = (1e-6, None)
            if len(here) >= 2 * least:
                gs, hs = g[here].sum(), h[here].sum()
                for f, c in enumerate(cuts):
                    b = binned[here, f]
                    gl = np.cumsum(np.bincount(b, g[here], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[here], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    left = np.clip(gl / (hl + ridge), low[k], high[k])
                    right = np.clip((gs - gl) / (hs - hl + ridge), low[k], high[k])
                    gain = gl * left - 0.5 * (hl + ridge) * left**2 + (gs - gl) * right - 0.5 * (hs - hl + ridge) * right**2 - 0.5 * gs**2 / (hs + ridge)
                    ok = (nl >= least) & (len(here) - nl >= least) & ((right - left) * monotone.get(f, 0) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    if len(gain) and gain.max() > best[0]:
                        j = int(gain.argmax())
                        best = (gain[j], (f, j, left[j], right[j]))
            a, b = 2 * k + 1, 2 * k + 2
            if best[1] is None:  # all rows go left, and the value goes down with them
                value[a] = value[b] = value[k]
                low[[a, b]], high[[a, b]] = low[k], high[k]
                node[here] = a
                continue
            f, j, value[a], value[b] = best[1]
            feature[k], cut[k] = f, cuts[f][j]
            low[[a, b]], high[[a, b]] = low[k], high[k]
            middle = (value[a] + value[b]) / 2
            if monotone.get(f, 0) > 0:
                high[a], low[b] = middle, middle
            elif monotone.get(f, 0) < 0:
                low[a], high[b] = middle, middle
            node[here] = np.where(binned[here, f] <= j, a, b)
        model.add(feature, cut, rate * value)
        raw += rate * value[node]
    return model


STATS_SCHEMA = pa.schema([("doc_id", pa.int64())] + [(s, pa.int64()) for s in STATS])


def _measure(batches):
    for b in batches:
        ids = b.column("doc_id")
        for lo, hi, data, at in C.chunks(b.column("text")):
            yield C.batch(STATS_SCHEMA, ids[lo:hi], *statistics(data, at).T)


def measure(docs: DataFrame) -> DataFrame:
    """STATS of the whole text of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, ", ".join(f"{f.name} long" for f in STATS_SCHEMA))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees that tell quality 1 from 0, from at most fit_rows labelled documents in the order of a hash of the id; only their texts are measured."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    some = F.broadcast(marked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id", "left_semi")
    rows = measure(own).join(some, "doc_id").select("doc_id", "quality", *STATS).orderBy(F.xxhash64("doc_id"), *STATS).limit(fit_rows).toPandas()
    if rows["quality"].nunique() < 2:
        return None
    return fit_trees(features(rows[STATS].to_numpy()), rows["quality"].to_numpy(float), {FEATURES.index(k): v for k, v in MONOTONE.items()})


def verdicts(stats: np.ndarray, model: Trees | None, keep_from: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept) of rows of STATS; without a model every score is 1."""
    failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])
    score = np.ones(len(stats)) if model is None else model.score(features(stats))
    return failed, score, ~failed & (score >= keep_from)


def judge(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each document: STATS, base_failed, score, kept. Everything is computed in one pass over the texts."""
    model = fit(docs, labels, fit_rows)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, data, at in C.chunks(b.column("text")):
                s = statistics(data, at)
                failed, score, kept = verdicts(s, model, keep_from)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *(pa.array(c, pa.int64()) for c in s.T), pa.array(score), pa.array(failed), pa.array(kept)], names=["doc_id", *STATS, "score", "base_failed", "kept"])

    schema = ", ".join(f"{f.name} long" for f in STATS_SCHEMA) + ", score double, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """The documents that the rules and the trees let pass, with their columns.

    The verdict rides along in the pass that computes it: a row is judged by its own text, so repeated ids need no join.
    """
    model = fit(docs, labels)

    def flag(batches):
        for b in batches:
            kept = [verdicts(statistics(data, at), model, keep_from)[2] for _, _, data, at in C.chunks(b.column("text"))]
            yield b.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(flag, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    out = judge(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
