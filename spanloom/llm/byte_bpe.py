"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The texts of an Arrow batch become one array of code points, and a table turns each into a class (letter,
number, apostrophe, other mark, blank, other white space). What the pattern can see around a character (is it
the last of its white space, does a contraction begin here) is folded into a symbol. An automaton over the
symbols says where tokens begin. It runs as an associative scan: each symbol is a function from state to
state, the functions that arise by composition are few and tabled, and blocks of composed functions are
combined, so that no regular expression and no step-by-step loop over characters is needed.

The token slices are looked up in a cache of merged pieces; only pieces not seen before are merged pair by
pair. Byte offsets of tokens are kept (`offsets=True`), and decoding joins the bytes of the ids.

Defined cases: a null or empty text has no tokens; null ids and repeated rows keep their rows; characters that
Unicode has not assigned count as marks; of pairs with one rank the leftmost is merged first; a very long text
is cut in one piece, as one array of its task; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C

LETTER, NUMBER, QUOTE, MARK, BLANK, WHITE = range(6)
#: White space of the pattern beyond what is ASCII, and the contractions it splits off.
WHITE_POINTS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Most pieces that a worker's cache holds; it is emptied when full.
CACHE_PIECES = 400_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(sys.maxunicode + 1, MARK, np.uint8)
    for p in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(p))[0]
        if kind == "L":
            table[p] = LETTER
        elif kind == "N":
            table[p] = NUMBER
    table[list(WHITE_POINTS)] = WHITE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


# Symbols: what a character is, given its right-hand neighbours. "Last" white space is followed by something else.
SYM_LETTER, SYM_NUMBER, SYM_MARK, SYM_INNER_WHITE, SYM_LAST_BLANK, SYM_LAST_WHITE, SYM_SHORT, SYM_LONG, SYM_RESET = range(9)
# States: the kind of token that the last character belongs to, and how much of a contraction is still to come.
S_START, S_LETTERS, S_NUMBERS, S_MARKS, S_WHITE, S_PREFIX, S_TAKE_ONE, S_TAKE_TWO = range(8)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a token begin at this character)."""
    if symbol == SYM_RESET:  # between texts
        return S_START, True
    if state == S_TAKE_TWO:
        return S_TAKE_ONE, False
    if state == S_TAKE_ONE:
        return S_START, False
    if symbol == SYM_INNER_WHITE:
        return S_WHITE, state != S_WHITE
    if symbol == SYM_LAST_BLANK:
        return S_PREFIX, True
    if symbol == SYM_LAST_WHITE:
        return S_START, True
    if symbol in (SYM_SHORT, SYM_LONG):
        if state == S_PREFIX:
            return S_MARKS, False
        if state == S_MARKS:
            return S_MARKS, False
        return (S_TAKE_ONE if symbol == SYM_SHORT else S_TAKE_TWO), True
    own = {SYM_LETTER: S_LETTERS, SYM_NUMBER: S_NUMBERS, SYM_MARK: S_MARKS}[symbol]
    return own, state not in (own, S_PREFIX)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, value table, does a token begin) over all functions that arise."""
    first = [tuple(step(s, y)[0] for s in range(8)) for y in range(9)]
    index: dict[tuple, int] = {}
    for f in first:
        index.setdefault(f, len(index))
    todo = list(index)
    while todo:
        f = todo.pop()
        for g in first:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(index)
                todo.append(h)
    functions = list(index)
    compose = np.array([[index.get(tuple(g[x] for x in f), 0) for g in functions] for f in functions], np.int16)
    values = np.array(functions, np.int8)
    begins = np.array([[step(s, y)[1] for y in range(9)] for s in range(8)])
    return np.array([index[f] for f in first], np.int16), compose, values, begins


def scan(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each symbol, from S_START: compose inside blocks, across blocks by doubling, then apply."""
    of_symbol, compose, values, _ = monoid()
    n = len(symbols)
    rows = -(-n // width)
    padded = np.full(rows * width, SYM_RESET, np.uint8)
    padded[:n] = symbols
    f = of_symbol[padded].reshape(rows, width)
    f = np.ascontiguousarray(f.T)
    total = f[0].copy()
    for k in range(1, width):
        total = compose[total, f[k]]
    shift = 1
    while shift < rows:
        total[shift:] = compose[total[:-shift], total[shift:]]
        shift *= 2
    state = np.empty(rows, np.int8)
    state[0] = S_START
    state[1:] = values[total[:-1], S_START]
    out = np.empty((width, rows), np.int8)
    for k in range(width):
        out[k] = state
        state = values[f[k], state]
    return out.T.reshape(-1)[:n]


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions where the pattern's matches begin, over all texts; each text begins one."""
    if not len(data):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[heads].astype(np.uint32)
    points = lead.copy()
    for least, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        which = np.flatnonzero((lead >= least) & (lead < {0xC0: 0xE0, 0xE0: 0xF0, 0xF0: 0x100}[least]))
        if len(which):
            value = lead[which] & bits
            for k in range(1, more + 1):
                value = (value << 6) | (data[heads[which] + k] & 0x3F)
            points[which] = value
    kind = classes()[points]
    edge = np.searchsorted(heads, at)  # the first character of each text, and the end
    n = len(heads)
    ends = np.zeros(n + 1, bool)
    ends[edge] = True  # a text ends before this character
    white = kind >= BLANK
    next_white = np.append(white[1:], False)
    symbols = np.array([SYM_LETTER, SYM_NUMBER, SYM_MARK, SYM_MARK, SYM_INNER_WHITE, SYM_INNER_WHITE], np.uint8)[kind]
    last = white & ~next_white & ~ends[1:]  # at the end of a text all white space is one match
    symbols[last] = np.where(kind[last] == BLANK, SYM_LAST_BLANK, SYM_LAST_WHITE)
    quote = np.flatnonzero(kind == QUOTE)
    if len(quote):
        after = np.append(points, [0, 0])
        one = np.where(ends[quote + 1], 0, after[quote + 1])
        two = np.where(ends[quote + 1] | ends[np.minimum(quote + 2, n)], 0, after[quote + 2])
        for c in CONTRACTIONS:
            if len(c) == 1:
                symbols[quote[one == ord(c)]] = SYM_SHORT
            else:
                symbols[quote[(one == ord(c[0])) & (two == ord(c[1]))]] = SYM_LONG
    # A reset goes before each text, so that no state crosses from one text to the next.
    begin = np.unique(edge[:-1][at[:-1] < at[1:]])
    with_reset = np.insert(symbols, begin, SYM_RESET)
    states = scan(with_reset)
    keep = np.ones(len(with_reset), bool)
    keep[begin + np.arange(len(begin))] = False
    return heads[monoid()[3][states[keep], symbols]]


class Codec:
    """Ranks of a vocabulary file, with the cache of merged pieces of this worker."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of the lowest rank, the leftmost first, until none has a rank."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > 400:
            return self._merge_long(piece)
        ranks, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.pieces)
        pairs = [ranks(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and links, for pieces whose length would make repeated searches slow."""
        import heapq

        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def packed(self, piece: bytes) -> bytes:
        """Ids of a piece as little-endian 32-bit integers."""
        got = self.cache.get(piece)
        if got is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            got = np.array(self.merge(piece), "<u4").tobytes()
            if len(piece) <= 64:
                self.cache[piece] = got
        return got

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The packed ids of each text."""
        starts = token_starts(data, at)
        bounds = np.searchsorted(starts, at).tolist()
        raw, packed, have = data.tobytes(), self.packed, self.cache.get
        edges = np.append(starts, len(data)).tolist()
        ids = [have(p) or packed(p) for p in [raw[s:e] for s, e in zip(edges, edges[1:])]]
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, packed: bytes) -> np.ndarray:
        """Byte offset of each token in its text, and the end."""
        return np.concatenate(([0], np.cumsum([len(self.pieces[i]) for i in np.frombuffer(packed, "<u4").tolist()]))).astype(np.int64)


@lru_cache(2)
def load(path: str) -> Codec:
    """A codec of a rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def encode(docs: DataFrame, vocabulary: str, offsets: bool = False) -> DataFrame:
    """doc_id and ids (array), with offsets if asked. vocabulary: the rank file's place on every node."""

    def run(batches):
        codec = load(vocabulary)
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("text")):
                packed = codec.encode(data, at)
                cols = [b.column("doc_id")[lo:hi], pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))]
                if offsets:
                    cols.append(pa.array([codec.offsets(p) for p in packed], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "offsets"][: len(cols)])

    schema = "doc_id long, ids array<int>" + (", offsets array<long>" if offsets else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the bytes of the ids."""

    def run(batches):
        codec = load(vocabulary)
        for b in batches:
            texts = [codec.decode(np.array(ids or [], "<u4").tobytes()) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Counts and digests of each text's ids, and of the bytes that decoding them gives, in one pass."""

    def run(batches):
        codec = load(vocabulary)
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("text")):
                packed = codec.encode(data, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[lo:hi],
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                        pa.array([hashlib.sha256(codec.decode(p)).hexdigest() for p in packed]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
