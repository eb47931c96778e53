"""Rules about one row or one small registry: conditions and outcomes to use in contracts, filters and reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as X


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_log_probability(value) -> Column:
    """Finite and not above 0."""
    return (col(value) <= 0) & ~F.isnan(col(value)) & (col(value) > float("-inf"))


def both_or_neither(a, b) -> Column:
    """A decision was made by a person if and only if it says so: two conditions that must agree."""
    return col(a) == col(b)


def all_or_none(*values, allowed: dict[str, tuple] | None = None) -> Column:
    """All columns are set, or none is; set ones (by name) have an allowed value."""
    nulls = [col(v).isNull() for v in values]
    same = reduce(and_, [nulls[0] == n for n in nulls[1:]])
    fits = [col(name).isNull() | col(name).isin(*options) for name, options in (allowed or {}).items()]
    return reduce(and_, fits, same)


def tier_outcome(tokens, ceiling: int) -> Column:
    """ok, `over the ceiling`, or `unknown` where the count is null."""
    n = col(tokens)
    return F.when(n.isNull(), "unknown").when(n > ceiling, "over the ceiling").otherwise("ok")


def meets(least: dict[str, float], most: dict[str, float]) -> Column:
    """Every named score reaches its least value, and none passes its most."""
    return reduce(and_, [F.col(c) >= x for c, x in least.items()] + [F.col(c) <= x for c, x in most.items()])


def safe_key(value, pattern: str) -> Column:
    """Is an identifier safe as a key: does the whole of it fit the pattern?"""
    return col(value).rlike(f"^(?:{pattern})$")


def within_tolerance(measured, wanted, tolerance) -> Column:
    return F.abs(col(measured) - col(wanted)) <= tolerance


def still_speech(speech, ms, motion, least_ms: int = 2000, most_motion: float = 0.05) -> Column:
    """Speech over a picture that hardly moves, long enough to notice; an unknown motion does not count."""
    return col(speech) & (col(ms) >= least_ms) & (col(motion) <= most_motion)


def labels_within(rows: DataFrame, labels: dict[str, Column], start: str, end: str) -> DataFrame:
    """rows with `label`, `cited` and `grounded` for each label: does its text cite a time inside the span?"""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), t.alias("said")) for n, t in labels.items()]))
    said = rows.withColumn("_l", each).select("*", "_l.label", F.size(X.cited_times("_l.said")).alias("cited"), X.cited_times("_l.said").alias("_t")).drop("_l")
    return said.withColumn("grounded", F.exists("_t", lambda t: t.between(F.col(start), F.col(end)))).drop("_t")


def within_window(start, window_end, least_ms: int) -> Column:
    """Does something that begins here, and lasts at least so long, fit the window?"""
    return col(start) + least_ms <= col(window_end)


def media_clock(window_start, seconds) -> Column:
    """Seconds in a window, on the clock of the whole recording; halves go to the even millisecond."""
    return col(window_start) + F.bround(col(seconds) * 1000).cast("long")


def commercially_usable(rows: DataFrame, key: str, licences: DataFrame, refused: tuple[str, ...]) -> DataFrame:
    """rows with `licence` (of a registry: key, licence; `open` where it has none), without those of a refused one."""
    out = rows.join(licences.select(key, "licence"), key, "left").withColumn("licence", F.coalesce("licence", F.lit("open")))
    return out.where(~F.col("licence").isin(*refused))


def attributions(*uses: DataFrame) -> DataFrame:
    """source, notice, n: what tables of (source), one row for each use, owe a notice to."""
    rows = reduce(DataFrame.unionByName, [u.select("source") for u in uses])
    return rows.groupBy("source").agg(F.concat(F.lit("uses "), F.first("source")).alias("notice"), F.count("*").alias("n"))


def in_both(allowed: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """Names that are on both lists; there must be none."""
    return allowed.select(key).intersect(denied.select(key))


def profile(rows: DataFrame, key: str, profiles: dict[str, int], default: int, name: str) -> DataFrame:
    """rows with the threshold that the profile of their kind gives, else the default. profiles is written into the plan."""
    table = F.create_map(*[x for k, v in profiles.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn(name, F.coalesce(F.try_element_at(table, F.col(key)), F.lit(default)))


def rating_outcomes(expected: DataFrame, rated: DataFrame, key: str, score: str, least: int = 1, most: int = 5) -> DataFrame:
    """key and outcome: ok, missing, unexpected, rated twice, or out of range, for everything expected or rated."""
    once = rated.groupBy(key).agg(F.max(score).alias("_s"), F.min(score).alias("_s0"), F.count("*").alias("_n"))
    both = expected.select(key, F.lit(True).alias("_e")).distinct().join(once, key, "full_outer")
    out = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_s").isNull(), "missing").when(F.col("_n") > 1, "rated twice")
    return both.select(key, out.when(~F.col("_s").between(least, most), "out of range").otherwise("ok").alias("outcome"))


def over_ceiling(spans: DataFrame, key: str, start: str, end: str, ceiling_ms: int) -> DataFrame:
    """key, n_long, longest_ms of the spans that are too long to be transcribed at once."""
    ms = F.col(end) - F.col(start)
    return spans.where(ms > ceiling_ms).groupBy(key).agg(F.count("*").alias("n_long"), F.max(ms).alias("longest_ms"))


def intact(rows: DataFrame, recorded: DataFrame, key: str, content) -> DataFrame:
    """key and intact: is the digest of the content the one on record (key, digest)? Rows without a record are not intact."""
    now = rows.select(key, F.sha2(col(content), 256).alias("_now")).join(recorded.select(key, "digest"), key, "left")
    return now.select(key, F.coalesce(F.col("_now") == F.col("digest"), F.lit(False)).alias("intact"))


def stale(derived: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Derived rows (key, source_digest) whose source (key, digest) is gone or has another digest now."""
    return derived.join(sources.select(key, F.col("digest").alias("source_digest")).distinct(), [key, "source_digest"], "left_anti")


def dangling(cited: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows of cited whose name is not among the known ones."""
    return cited.join(known.select(name).distinct(), name, "left_anti")


def changes(a: DataFrame, b: DataFrame, key: str, compared: dict[str, str]) -> DataFrame:
    """key, found, and for each (column, name) whether it differs between two versions; nulls are equal to nulls."""
    other = b.select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in compared])
    differs = [(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(n) for c, n in compared.items()]
    return a.join(other, key, "left").select(key, F.coalesce("_found", F.lit(False)).alias("found"), *differs)


def effective(originals: DataFrame, revisions: DataFrame, key: str, replaced: dict[str, str]) -> DataFrame:
    """key, version and columns of every original and every revision; a revision's column (name: column of revisions) replaces where it is set."""
    first = originals.select(key, F.lit("original").alias("version"), *replaced)
    parts = [F.coalesce(F.col(new), F.col(old)).alias(old) for old, new in replaced.items()]
    return first.unionByName(originals.join(revisions, key).select(key, F.lit("revision").alias("version"), *parts))


def findings(approved: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Approved rows that break a rule of today, with the first it breaks as `finding`."""
    first = F.coalesce(*[F.when(bad, F.lit(why)) for why, bad in rules.items()])
    return approved.withColumn("finding", first).where("finding is not null")


def page(rows: DataFrame, key: str, rank, *ties, limit: int = 10) -> DataFrame:
    """The first `limit` rows of each key by rank (null and 0 last) and ties, with `place`, and the key's `total`."""
    own = Window.partitionBy(key)
    order = own.orderBy(F.nullif(col(rank), F.lit(0)).asc_nulls_last(), *ties)
    return rows.withColumns({"place": F.row_number().over(order), "total": F.count("*").over(own)}).where(F.col("place") <= limit)


def placed(rows: DataFrame, key: str, *order, limit: int | None = None, name: str = "place") -> DataFrame:
    """rows with their place in the order of their key, the first `limit` of them."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)
