"""Number expressions: intervals of rates, costs, clocks, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.intervals import col

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054


def rate(part, whole) -> Column:
    """part / whole; null where nothing was counted."""
    return col(part) / F.nullif(col(whole), F.lit(0))


def wilson(p, n, z: float = Z95) -> Column:
    """The Wilson interval of a rate as a struct (low, high), inside [0, 1]; null where n is 0."""
    p, n = col(p), F.nullif(col(n), F.lit(0))
    base = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low, high = F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))
    return F.struct(F.when(n.isNotNull(), low).alias("low"), F.when(n.isNotNull(), high).alias("high"))


def margin(p, n) -> Column:
    return F.lit(1.96) * F.sqrt(col(p) * (1 - col(p)) / F.nullif(col(n), F.lit(0)))


def token_cost(tokens, batched=False, cached=False) -> Column:
    """USD of so many tokens at 2 a million; a tenth if cached, half if batched."""
    lit = lambda x: F.lit(x) if isinstance(x, bool) else col(x)
    return col(tokens) / 1e6 * 2 * F.when(lit(cached), 0.1).otherwise(1.0) * F.when(lit(batched), 0.5).otherwise(1.0)


def video_tokens(seconds, per_second: int = 300) -> Column:
    return (col(seconds) * per_second).cast("long")


def frames(ms, fps) -> Column:
    """Whole frames nearest to a time, halves to even."""
    return F.bround(col(ms) * (fps if isinstance(fps, Column) else F.lit(float(fps))) / 1000).cast("long")


def srt_time(ms) -> Column:
    t = col(ms)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def timecode(ms, fps: float) -> Column:
    """hh:mm:ss:ff; at 29.97 and 59.94 frames are numbered with the dropped ones left out, and `;` stands before them."""
    whole, n = round(fps), frames(ms, fps)
    drop = abs(fps - whole) > 1e-6
    if drop:
        lost = whole // 15
        ten, minute = round(fps * 600), whole * 60 - lost
        d, m = F.floor(n / ten), n % ten
        n = n + 9 * lost * d + F.when(m > lost, lost * F.floor((m - lost) / minute)).otherwise(0)
    sep = ";" if drop else ":"
    return F.format_string(f"%02d:%02d:%02d{sep}%02d", F.floor(n / (whole * 3600)).cast("long"), (F.floor(n / (whole * 60)) % 60).cast("long"), (F.floor(n / whole) % 60).cast("long"), (n % whole).cast("long"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null where the lengths differ or a vector has no length."""
    ok = (F.size(col(a)) == F.size(col(b))) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b)))


def similarity01(a, b) -> Column:
    """Cosine in [0, 1]; 0 where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))


def upper_median(values) -> Column:
    """The element at half the count (rounded down) of the sorted values, nulls left out."""
    kept = F.sort_array(F.filter(col(values), lambda x: x.isNotNull()))
    return F.when(F.size(kept) > 0, F.get(kept, F.floor(F.size(kept) / 2).cast("int")))
