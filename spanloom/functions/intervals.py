"""Half-open spans [start, end) in integer milliseconds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlaps(a_in, a_out, b_in, b_out) -> Column:
    return (col(a_in) < col(b_out)) & (col(b_in) < col(a_out))


def contains(outer_in, outer_out, inner_in, inner_out) -> Column:
    return (col(outer_in) <= col(inner_in)) & (col(inner_out) <= col(outer_out))


def shared_ms(a_in, a_out, b_in, b_out) -> Column:
    return F.greatest(F.lit(0), F.least(col(a_out), col(b_out)) - F.greatest(col(a_in), col(b_in)))


def iou(a_in, a_out, b_in, b_out) -> Column:
    """Intersection over union of two spans; null where one has no length."""
    both = shared_ms(a_in, a_out, b_in, b_out)
    whole = (col(a_out) - col(a_in)) + (col(b_out) - col(b_in)) - both
    return F.when((col(a_out) > col(a_in)) & (col(b_out) > col(b_in)), both / whole)
