"""Helpers shared by the corpus operators: Arrow text buffers, word boundaries, vectorised hashes, scratch tables.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), found on the UTF-8 bytes
of whole Arrow batches, so no Python string is made on the hot path. Batches are walked in chunks of about
``CHUNK_BYTES``: memory does not follow the size of a batch, only that of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: The bytes that separate words.
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
SPACE = np.zeros(256, bool)
SPACE[list(SPACE_BYTES)] = True

_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
GRAM_KEYS = _rng.integers(1, 1 << 64, 64, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)

#: Word keys with and without regard to the case of A-Z; white space counts as nothing.
WORD_KEYS = np.where(SPACE, np.uint64(0), BYTE_KEYS)
FOLDED_KEYS = WORD_KEYS.copy()
FOLDED_KEYS[65:91] = WORD_KEYS[97:123]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash base, kept between calls."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _BASE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row starts in these bytes) of runs of whole rows."""
    if not len(column):
        return
    data, at = flat(column)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = min(rows, max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    heads, tails = at[:-1][full], at[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to the next; bytes whose key is 0 do not count at its end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    body = data[starts[0] :]
    where = np.arange(len(body)) - np.repeat(starts - starts[0], lengths)
    return mix(np.add.reduceat(keys[body] * powers(int(lengths.max()) + 1)[where], starts - starts[0]))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive hashes (also of runs that cross rows: see starts_in_rows)."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * GRAM_KEYS[k % 64]
    return mix(total)


def starts_in_rows(bounds: np.ndarray, size: int) -> np.ndarray:
    """Indices of the windows of `size` words that lie in one row, in order."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    skip = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(int(counts.sum())) + skip


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive row starts."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def groups_of(batches, keys: list[str]):
    """Whole groups of a stream of batches that is sorted by keys: (batch, group starts)."""
    rest = None
    for b in batches:
        table = pa.Table.from_batches([b] if rest is None else [*rest, b]).combine_chunks()
        if not table.num_rows:
            continue
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last).combine_chunks(), starts
        rest = table.slice(last).to_batches()
    if rest is not None:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, np.array([0, table.num_rows])
