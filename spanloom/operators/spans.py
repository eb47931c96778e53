"""Span algebra: range joins, merge, subtract, complement, clock mapping, nearest, thinning.

Spans are half-open and integer; every operator works inside a key (a recording).

Range joins go by dyadic cells. A span is cut into the largest aligned cells of 1, 2, 4, ... buckets that lie in it: about
two for each doubling of its length, be it a minute or a year. A point lies in one cell of each size, and meets a
span in the one cell of the span that holds it, so no pair is met twice. Spans overlap where one's start lies in the other. A
first pass finds the longest span and the largest key; only where a key is large are the rows of each cell counted, and
cells that are crowded are dealt over a grid of tasks, the rows of one side by rows, of the other by columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.intervals import overlaps

BUCKET_MS = 60_000
#: Rows of one side in one cell that a task takes, at least; where there are very many rows, a SHARE of all of them.
CROWD, SHARE = 20_000, 1024


def cell(at, bucket_ms: int) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / bucket_ms).cast("long")


def cells_spanned(start: str, end: str, bucket_ms: int) -> Column:
    """How many buckets a span touches; one where it is empty."""
    return F.greatest(F.lit(1), cell(F.col(end) - 1, bucket_ms) - cell(start, bucket_ms) + 1)


def cover(lo: str, cells: str, levels: int) -> Column:
    """The aligned cells of 2**level buckets that make up the `cells` buckets from lo: level, place."""
    out = []
    for k in range(levels):
        first, last = -F.shiftright(-F.col(lo), k), F.shiftright(F.col(lo) + F.col(cells), k)
        left, right = (F.struct(F.lit(k).alias("level"), x.alias("place")) for x in (first, last - 1))
        out += [F.when((first < last) & (first.bitwiseAND(1) == 1), left), F.when((first < last) & (last.bitwiseAND(1) == 1), right)]
    return F.array_compact(F.array(*out))


def around(at: str, levels: int) -> Column:
    """The cells of every size that a bucket lies in."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("place")) for k in range(levels)])


def _first_pass(key: str, *sides: tuple[DataFrame, Column]) -> tuple[list[int], int, int]:
    """Levels that each side's spans need, rows of the largest key on one side, rows of both sides."""
    every = None
    for k, (df, spanned) in enumerate(sides):
        own = df.select(F.lit(k).alias("side"), F.xxhash64(key).alias("key"), spanned.alias("cells"))
        every = own if every is None else every.unionByName(own)
    got = every.groupBy("side", "key").agg(F.count("*").alias("n"), F.max("cells").alias("cells")).groupBy("side").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.max("cells").alias("cells")).collect()
    levels = {r["side"]: int(r["cells"] or 1).bit_length() for r in got}
    return [levels.get(k, 1) for k in range(len(sides))], max((r["most"] for r in got), default=0), sum(r["n"] for r in got)


def _dealt(x: DataFrame, y: DataFrame, on: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_deal`. A cell of n and m rows becomes a grid of n / limit by m / limit tasks.

    Cells with more than limit rows on a side are few when limit is a share of all rows, so their list is broadcast.
    """
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    grid = count(x, "_n").where(F.col("_n") > limit).join(count(y, "_m").where(F.col("_m") > limit), on, "full")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(1)) / limit)).cast("int")
    grid = grid.select(*on, parts(F.col("_n")).alias("_rows"), parts(F.col("_m")).alias("_columns"))

    def deal(df: DataFrame, own: str, other: str, place) -> DataFrame:
        met = df.join(F.broadcast(grid), on, "left").withColumn("_own", F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(own), F.lit(1))).cast("int"))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return met.withColumn("_deal", F.explode(F.transform(copies, lambda k: place(F.col("_own"), k)))).drop("_own", "_rows", "_columns")

    width = F.coalesce("_columns", F.lit(1))
    return deal(x, "_rows", "_columns", lambda own, k: own * width + k), deal(y, "_columns", "_rows", lambda own, k: k * width + own)


def _meet(x: DataFrame, y: DataFrame, key: str, most: int, total: int, crowd: int) -> DataFrame:
    """Rows of both sides that share a key and a cell.

    Rows are placed in several cells, which the planner's estimates do not know, so neither side is left to be broadcast.
    """
    on = [key, "_way", "_level", "_place"]
    if most > crowd:
        x, y = _dealt(x, y, on, max(crowd, total // SHARE))
        on = [*on, "_deal"]
    return x.join(y.hint("merge"), on)


def _placed(df: DataFrame, *ways: tuple[int, Column]) -> DataFrame:
    """A row for each cell; ways: cells in which a row is a point or a span, on the first way the left one is the point."""

    def named(way: int, cells: Column) -> Column:
        return F.transform(cells, lambda s: F.struct(F.lit(way).alias("way"), s["level"].alias("level"), s["place"].alias("place")))

    cells = [named(*w) for w in ways]
    at = F.explode(F.concat(*cells)).alias("_c")
    return df.select("*", at).select(*[F.col(c) for c in df.columns], F.col("_c.way").alias("_way"), F.col("_c.level").alias("_level"), F.col("_c.place").alias("_place"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], bucket_ms: int = BUCKET_MS, crowd: int = CROWD) -> DataFrame:
    """Pairs of rows of one key whose spans overlap. Columns of the two sides other than the key must differ in name.

    Runs a first pass over both sides (see above). crowd: rows of one side that a task takes of a cell, at least.
    """
    (la, lb), most, total = _first_pass(key, (left, cells_spanned(*a, bucket_ms)), (right, cells_spanned(*b, bucket_ms)))
    x = left.withColumn("_l0", cell(a[0], bucket_ms)).withColumn("_l1", cells_spanned(*a, bucket_ms))
    y = right.withColumn("_r0", cell(b[0], bucket_ms)).withColumn("_r1", cells_spanned(*b, bucket_ms))
    x = _placed(x, (0, around("_l0", lb)), (1, cover("_l0", "_l1", la))).drop("_l0", "_l1")
    y = _placed(y, (0, cover("_r0", "_r1", lb)), (1, around("_r0", la))).drop("_r0", "_r1")
    first = F.col(a[0]) >= F.col(b[0])
    met = _meet(x, y, key, most, total, crowd).where(overlaps(*a, *b) & (first == (F.col("_way") == 0)))
    return met.drop("_way", "_level", "_place", "_deal")


def point_join(points: DataFrame, spans: DataFrame, key: str, at: str, b: tuple[str, str], closed_end: bool = False, bucket_ms: int = BUCKET_MS, crowd: int = CROWD) -> DataFrame:
    """Pairs of a point and a span that holds it: start <= at < end, or start < at <= end if closed_end."""
    shown = F.col(at) - int(closed_end)
    (_, levels), most, total = _first_pass(key, (points, F.lit(1).cast("long")), (spans, cells_spanned(*b, bucket_ms)))
    x = _placed(points.withColumn("_l0", cell(shown, bucket_ms)), (0, around("_l0", levels))).drop("_l0")
    y = spans.withColumn("_r0", cell(b[0], bucket_ms)).withColumn("_r1", cells_spanned(*b, bucket_ms))
    y = _placed(y, (0, cover("_r0", "_r1", levels))).drop("_r0", "_r1")
    start, end = F.col(b[0]), F.col(b[1])
    inside = (start < F.col(at)) & (F.col(at) <= end) if closed_end else (start <= F.col(at)) & (F.col(at) < end)
    return _meet(x, y, key, most, total, crowd).where(inside).drop("_way", "_level", "_place", "_deal")


def islands(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """df with `island`: a number that grows wherever a span begins after all before it have ended (touching spans are one)."""
    order = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge(df: DataFrame, key: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The union of the spans of each key as disjoint spans."""
    return islands(df.where(F.col(end) > F.col(start)), key, start, end).groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def complement(df: DataFrame, bounds: DataFrame, key: str, start: str = "start_ms", end: str = "end_ms", lo: str = "lo_ms", hi: str = "hi_ms") -> DataFrame:
    """What of [lo, hi) of each key no span covers."""
    cut = df.join(bounds, key).select(key, F.greatest(start, lo).alias(start), F.least(end, hi).alias(end)).where(F.col(end) > F.col(start))
    edges = merge(cut, [key], start, end).unionByName(bounds.select(key, F.col(lo).alias(start), F.col(lo).alias(end)))
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start, end))
    gaps = edges.withColumn("_next", following).join(bounds.select(key, F.col(hi).alias("_hi")), key)
    return gaps.select(key, F.col(end).alias(start), F.coalesce("_next", "_hi").alias(end)).where(F.col(end) > F.col(start))


def subtract(base: DataFrame, sub: DataFrame, key: str, start: str = "start_ms", end: str = "end_ms", least_ms: int = 50) -> DataFrame:
    """The base spans without the others: pieces shorter than least_ms are dropped, then what touches is merged."""
    sub = merge(sub, [key], start, end).select(key, F.col(start).alias("_s"), F.col(end).alias("_e"))
    whole = merge(base, [key], start, end)
    holes = overlap_join(whole, sub, key, (start, end), ("_s", "_e"))
    order = Window.partitionBy(key, start, end).orderBy("_s")
    pieces = holes.withColumn("_next", F.lead("_s").over(order)).withColumn("_nth", F.row_number().over(order))
    after = pieces.select(key, F.col("_e").alias("a"), F.coalesce("_next", end).alias("z"))
    ahead = pieces.where("_nth = 1").select(key, F.col(start).alias("a"), F.col("_s").alias("z"))
    free = whole.join(holes.select(key, start, end).distinct(), [key, start, end], "left_anti").select(key, F.col(start).alias("a"), F.col(end).alias("z"))
    left = after.unionByName(ahead).unionByName(free).where(F.col("z") - F.col("a") >= least_ms)
    return merge(left.select(key, F.col("a").alias(start), F.col("z").alias(end)), [key], start, end)


def clock(retained: DataFrame, key: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Retained spans with `out_ms`: where each begins on the clock that plays them one after the other."""
    before = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    return retained.withColumn("out_ms", F.coalesce(F.sum(F.col(end) - F.col(start)).over(before), F.lit(0)))


def to_output(points: DataFrame, retained: DataFrame, key: str, at: str, clamp: bool = True) -> DataFrame:
    """points with `output_ms`. A point in a gap maps to the join that replaces it, or to null if not clamp.

    As-of join: points and span starts are laid on one time line and the last start is carried forward.
    """
    spans = clock(retained, key).select(key, F.col("start_ms").alias("_t"), F.struct("start_ms", "end_ms", "out_ms").alias("_span"), F.lit(0).alias("_kind"))
    line = points.withColumn("_t", F.col(at)).withColumn("_kind", F.lit(1)).unionByName(spans, allowMissingColumns=True)
    last = F.last("_span", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    span = F.col("_last")
    inside = F.col(at) < span["end_ms"]
    out = F.when(span.isNull(), F.lit(0) if clamp else F.lit(None)).when(inside, span["out_ms"] + F.col(at) - span["start_ms"])
    out = out.otherwise(span["out_ms"] + span["end_ms"] - span["start_ms"]) if clamp else out
    return line.withColumn("_last", last).where("_kind = 1").withColumn("output_ms", out.cast("long")).drop("_t", "_kind", "_span", "_last")


def to_source(points: DataFrame, retained: DataFrame, key: str, at: str) -> DataFrame:
    """points of the output clock with `source_ms`: beyond the last span, its end."""
    spans = clock(retained, key).select(key, F.col("out_ms").alias("_t"), F.struct("start_ms", "end_ms", "out_ms").alias("_span"), F.lit(0).alias("_kind"))
    line = points.withColumn("_t", F.col(at)).withColumn("_kind", F.lit(1)).unionByName(spans, allowMissingColumns=True)
    last = F.last("_span", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    source = F.least(F.col("_last")["start_ms"] + F.col(at) - F.col("_last")["out_ms"], F.col("_last")["end_ms"])
    return line.withColumn("_last", last).where("_kind = 1").withColumn("source_ms", source.cast("long")).drop("_t", "_kind", "_span", "_last")


def nearest(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str) -> DataFrame:
    """points with `distance_ms` to the nearest mark of the key; null without marks."""
    line = points.withColumn("_t", F.col(at)).withColumn("_kind", F.lit(1)).unionByName(marks.select(key, F.col(mark).alias("_t"), F.col(mark).alias("_mark"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_t", "_kind")
    back = F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_mark", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("_t") - back, ahead - F.col("_t"))
    return line.withColumn("distance_ms", gap).where("_kind = 1").drop("_t", "_kind", "_mark")


def thin(points: Column, least_ms: int, first_after: int | None = None) -> Column:
    """Of a sorted array of times, those that lie at least least_ms after the last one kept: a fold inside the row.

    first_after: the first kept lies at least least_ms after this time as well.
    """
    begin = F.lit(first_after).cast("long")
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), begin.alias("last"))

    def take(acc, x):
        ok = acc["last"].isNull() | (x - acc["last"] >= least_ms)
        return F.struct(F.when(ok, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"), F.when(ok, x).otherwise(acc["last"]).alias("last"))

    return F.aggregate(points, start, take, lambda acc: acc["kept"])


def runs(df: DataFrame, key: list[str], index: str) -> DataFrame:
    """df with `run`: rows of consecutive indices have one run number."""
    return df.withColumn("run", F.col(index) - F.row_number().over(Window.partitionBy(*key).orderBy(index)))


def within_media(spans: DataFrame, start: str, end: str, first, last) -> DataFrame:
    """spans cut to [first, last); what lies outside is dropped."""
    cut = spans.withColumns({start: F.greatest(F.col(start), F.lit(first)), end: F.least(F.col(end), F.lit(last))})
    return cut.where(F.col(end) > F.col(start))


def not_exclusive(spans: DataFrame, key: str, start: str, end: str, *ties: str) -> DataFrame:
    """spans that begin before an earlier one of their key has ended, with overlaps_end_ms."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, *ties).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("overlaps_end_ms", before).where(F.col("overlaps_end_ms") > F.col(start))


def end_to_end(spans: DataFrame, key: str, start: str, end: str, *ties: str) -> DataFrame:
    """spans with offset_ms: where each begins if they are played one after another."""
    before = Window.partitionBy(key).orderBy(start, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("offset_ms", F.coalesce(F.sum(F.col(end) - F.col(start)).over(before), F.lit(0)))


def between(spans: DataFrame, key: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """key, pause_start_ms, pause_end_ms: what lies between consecutive disjoint spans."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return spans.select(key, F.col(end).alias("pause_start_ms"), following.alias("pause_end_ms")).where("pause_end_ms is not null")


def all_cuts(key: str, *sources: DataFrame) -> DataFrame:
    """key, cut_ms of several cut tables (key, cut_ms), each place once."""
    out = sources[0].select(key, "cut_ms")
    for s in sources[1:]:
        out = out.unionByName(s.select(key, "cut_ms"))
    return out.distinct()


def retained_order(spans: DataFrame, key: str, start: str, end: str, *ties: str) -> DataFrame:
    """spans after the first of their key, with overlaps: do they begin before the one before has ended?"""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, *ties))
    return spans.withColumn("_b", before).where("_b is not null").withColumn("overlaps", F.col("_b") > F.col(start)).drop("_b")
