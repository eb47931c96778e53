"""Greedy walks along a line: from a start to the next one that is far enough, from there to the next, over any number of rows.

Such a rule looks serial, but every row's next start does not depend on where the walk began: rows are nodes of a
functional graph, and the starts are those that the first row of a key reaches. The line is numbered in two steps
(splits of a range exchange, then their running sums), next starts come from a range join, and the graph is cut into
pieces of PIECE rows. Inside a piece a walk is a loop over an array. Between pieces only rows that a pointer enters from before
matter; pointers among these are doubled, so the rounds are the logarithm of the number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.spans import point_join
from spanloom.scratch import Scratch

PIECE = 1 << 16


def numbered(df: DataFrame, key: str, order: list[str | Column], amount: Column | None = None) -> DataFrame:
    """df with `i`, the place of each row in its key from 0, and `before`, the sum of an amount (1) over the rows before.

    A key's rows may be any share of all: they are sorted by ranges, and numbered within each range. order should tell all
    rows of a key apart, else equal ones fall either way. Null keys are one key.
    """
    scratch = Scratch(df.sparkSession, "numbered")
    rows = df.withColumn("_a", (F.lit(1) if amount is None else amount).cast("long")).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kept = scratch.save(rows.select("*", F.spark_partition_id().alias("_split"), F.monotonically_increasing_id().alias("_id")))
    ahead = Window.partitionBy(key).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = kept.groupBy(key, "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.sum("_a").alias("_t"))
    splits = splits.select(F.col(key).alias("_key"), F.col("_split").alias("_of"), "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_t0"))
    own = Window.partitionBy(key, "_split").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    met = kept.withColumn("_own", F.coalesce(F.sum("_a").over(own), F.lit(0))).join(splits, kept[key].eqNullSafe(F.col("_key")) & (F.col("_split") == F.col("_of")))
    return met.select(*df.columns, (F.col("_n0") + F.col("_id") - F.col("_first")).alias("i"), (F.col("_t0") + F.col("_own")).alias("before"))


def first_from(rows: DataFrame, key: str, at: str, wanted: Column) -> DataFrame:
    """rows (key, i, at that grows with i) with `next`: the first later row of the key whose `at` is `wanted` or more; null if there is none."""
    line = rows.select(F.col(key).alias("_k"), F.col("i").alias("_j"), F.col(at).alias("_hi"))
    lows = line.select("_k", (F.col("_j") + 1).alias("_j"), F.col("_hi").alias("_lo"))
    steps = line.join(lows, ["_k", "_j"])  # each row with the one before it: what lies between them leads to it
    asked = rows.select(F.col(key).alias("_k"), "i", wanted.cast("long").alias("_v"))
    # A value that a row's own place reaches is met by the row after it.
    met = point_join(asked, steps, "_k", "_v", ("_lo", "_hi"), closed_end=True).where(F.col("_j") > F.col("i")).select("_k", "i", "_j")
    near = asked.join(line.select("_k", (F.col("_j") - 1).alias("i"), (F.col("_j")).alias("_after"), F.col("_hi").alias("_at1")), ["_k", "i"], "left").join(met, ["_k", "i"], "left")
    following = F.when(F.col("_at1") >= F.col("_v"), F.col("_after")).otherwise(F.col("_j"))
    found = near.select(F.col("_k").alias(key), "i", following.alias("next"))
    return rows.join(found, [key, "i"])


def _exits(nexts: np.ndarray, base: int, end: int) -> np.ndarray:
    """For each row of a piece the first place outside of it that its walk comes to (-1: none)."""
    out = nexts.tolist()
    for k in range(len(out) - 1, -1, -1):
        if base <= out[k] < end:
            out[k] = out[out[k] - base]
    return np.array(out, np.int64)


def _walked(nexts: np.ndarray, base: int, end: int, at: int) -> list[int]:
    got, step = [], nexts.tolist()
    while base <= at < end:
        got.append(at)
        at = step[at - base]
    return got


def _pieces(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, int, pd.DataFrame]]:
    """(key, piece, rows) of a stream that is sorted by key, piece and place."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b])
        if not len(b):
            continue
        fresh = (b[key].ne(b[key].shift()) | b["_piece"].ne(b["_piece"].shift())).to_numpy()
        starts = np.flatnonzero(fresh)
        for s, e in zip(starts, starts[1:]):
            part = b.iloc[s:e]
            yield part[key].iloc[0], int(part["_piece"].iloc[0]), part
        rest = b.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest[key].iloc[0], int(rest["_piece"].iloc[0]), rest


def walk(rows: DataFrame, key: str, piece: int = PIECE) -> DataFrame:
    """key, i of the starts: place 0 of each key and all that its pointers lead to. rows: key, i (without gaps from 0), next.

    Keys are not null. Keys of up to `piece` rows are walked in one pass.
    """
    scratch = Scratch(rows.sparkSession, "walk")
    kind = rows.schema[key].dataType.simpleString()
    nodes = scratch.save(rows.select(key, "i", F.coalesce("next", F.lit(-1)).cast("long").alias("next"), F.floor(F.col("i") / piece).cast("long").alias("_piece")), "nodes")
    crossing = nodes.where((F.col("next") >= 0) & (F.floor(F.col("next") / piece) > F.col("_piece"))).select(key, F.col("next").alias("i")).distinct()
    entries = scratch.save(crossing, "entries")

    def sorted_pieces(df: DataFrame) -> DataFrame:
        return df.repartition(key, "_piece").sortWithinPartitions(key, "_piece", "i")

    def exits(batches):
        for k, p, part in _pieces(batches, key):
            want = part["_entry"].to_numpy(bool)
            if p == 0:
                want = want | (part["i"].to_numpy() == 0)
            out = _exits(part["next"].to_numpy(np.int64), p * piece, (p + 1) * piece)
            yield pd.DataFrame({key: k, "i": part["i"].to_numpy()[want], "exit": out[want]})

    def starts(batches):
        keys, places = [], []
        for k, p, part in _pieces(batches, key):
            begin = part.loc[part["_entry"].to_numpy(bool), "i"]
            at = 0 if p == 0 else int(begin.iloc[0]) if len(begin) else -1
            got = _walked(part["next"].to_numpy(np.int64), p * piece, (p + 1) * piece, at)
            keys += [k] * len(got)
            places += got
            if len(places) > piece:
                yield pd.DataFrame({key: keys, "i": places})
                keys, places = [], []
        if places:
            yield pd.DataFrame({key: keys, "i": places})

    flag = F.lit(True).alias("_entry")
    if entries.isEmpty():
        reached = entries
    else:
        long = entries.select(key).distinct()
        marked = nodes.join(long, key, "left_semi").join(entries.select(key, "i", flag), [key, "i"], "left").fillna(False, ["_entry"])
        jump = scratch.save(sorted_pieces(marked).select(key, "i", "next", "_piece", "_entry").mapInPandas(exits, f"{key} {kind}, i long, exit long"), "jump0")
        reached = scratch.save(jump.where("i = 0").select(key, "i"), "reached0")
        n, k = -1, 0
        while True:  # what 2**k jumps reach, then pointers of twice the length
            k += 1
            ahead = reached.join(jump, [key, "i"]).where("exit >= 0").select(key, F.col("exit").alias("i"))
            reached = scratch.save(reached.unionByName(ahead).distinct(), f"reached{k}")
            far = jump.select(key, F.col("i").alias("exit"), F.col("exit").alias("_far"))
            jump = scratch.save(jump.where("exit >= 0").join(far, [key, "exit"]).select(key, "i", F.col("_far").alias("exit")), f"jump{k}")
            count = reached.count()
            if count == n or jump.where("exit >= 0").isEmpty():
                break
            n = count
    marked = nodes.join(reached.select(key, "i", flag), [key, "i"], "left").fillna(False, ["_entry"])
    return sorted_pieces(marked).select(key, "i", "next", "_piece", "_entry").mapInPandas(starts, f"{key} {kind}, i long")


def _bare(df: DataFrame, key: str, order: list[str], **named: str) -> tuple[DataFrame, list[str]]:
    """key as `k`, the order's columns, named ones, and the whole row beside them, so that no column can clash; null keys go."""
    names = [f"o{j}" for j in range(len(order))]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[F.col(c).alias(n) for c, n in zip(order, names)], *[F.col(c).alias(n) for n, c in named.items()], F.struct("*").alias("row"))
    return rows, names


def thinned(df: DataFrame, key: str, at: str, least: int, ties: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """df without rows that are less than `least` after the last kept one of their key; the first stays. Null keys and places go."""
    bare, order = _bare(df.where(F.col(at).isNotNull()), key, [at, *(ties or [])])
    rows = Scratch(df.sparkSession, "thinned").save(numbered(bare, "k", order))
    met = walk(first_from(rows.select("k", "i", "o0"), "k", "o0", F.col("o0") + least), "k", piece)
    return rows.join(met, ["k", "i"]).select("row.*")


def batched(df: DataFrame, key: str, order: list[str], size: str, most: int, piece: int = PIECE) -> DataFrame:
    """df with `batch`, from 0 by key: filled in order up to `most` in size; a larger row is alone. Sizes are not negative; null keys go."""
    bare, order = _bare(df, key, order, size=size)
    rows = Scratch(df.sparkSession, "batched").save(numbered(bare, "k", order, F.col("size")).withColumn("end", F.col("before") + F.col("size")))
    # A batch ends before the first row that would end beyond `most`; a row that is beyond it by itself ends before any other.
    wanted = F.when(F.col("size") > most, F.col("end")).otherwise(F.col("before") + most + 1)
    begun = walk(first_from(rows.select("k", "i", "end", "before", "size"), "k", "end", wanted), "k", piece)
    return point_join(rows, _spans_between(begun, rows, "k"), "k", "i", ("from_", "to_")).select("row.*", "batch")


def _spans_between(begun: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, batch, from_, to_: from each start to the next, or to the end of its key."""
    placed = Scratch(rows.sparkSession, "starts").save(numbered(begun.withColumnRenamed("i", "from_"), key, ["from_"]).select(key, "from_", F.col("i").alias("batch")))
    following = placed.select(key, (F.col("batch") - 1).alias("batch"), F.col("from_").alias("to_"))
    ends = rows.groupBy(key).agg((F.max("i") + 1).alias("_end_of_key"))
    return placed.join(following, [key, "batch"], "left").join(ends, key).select(key, "batch", "from_", F.coalesce("to_", "_end_of_key").alias("to_"))


def half_windows(df: DataFrame, key: str, order: list[str], size: str, most: int, piece: int = PIECE) -> DataFrame:
    """df in overlapping windows: each takes rows until their sizes reach `most`, the next begins half of its rows later.

    Adds `window`, the place of the window's first row in its key, and `total`, the window's size; a row is in each of its
    windows. Sizes are not negative; null keys go.
    """
    scratch = Scratch(df.sparkSession, "windows")
    bare, order = _bare(df, key, order, size=size)
    rows = scratch.save(numbered(bare, "k", order, F.col("size")).withColumn("end", F.col("before") + F.col("size")))
    line = first_from(rows.select("k", "i", "before", "end"), "k", "end", F.col("before") + most)
    whole = rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.sum("size").alias("all"))
    last = F.when(F.col("end") - F.col("before") >= most, F.col("i")).otherwise(F.col("next"))
    line = line.join(whole, "k").withColumn("to_", F.coalesce(last + 1, F.col("n_rows")))
    after = F.col("i") + F.greatest(F.lit(1), F.floor((F.col("to_") - F.col("i")) / 2))
    line = scratch.save(line.withColumn("next", F.when(after < F.col("n_rows"), after)).drop("end"))
    begun = walk(line.select("k", "i", "next"), "k", piece).join(line.select("k", "i", "before", "to_", "all"), ["k", "i"])
    ends = rows.select("k", F.col("i").alias("to_"), F.col("before").alias("stop"))
    spans = begun.join(ends, ["k", "to_"], "left").select("k", F.col("i").alias("window"), "to_", (F.coalesce("stop", "all") - F.col("before")).alias("total"))
    return point_join(rows, spans, "k", "i", ("window", "to_")).select("row.*", "window", "total")


def by_size(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that hold up to `most` rows, and of the others (None: there are none). df is written, as it is read several times."""
    scratch = Scratch(df.sparkSession, "sizes")
    df = scratch.save(df)
    long = scratch.save(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key))
    if long.isEmpty():
        return df, None
    return df.join(long, key, "left_anti"), df.join(long, key, "left_semi")
