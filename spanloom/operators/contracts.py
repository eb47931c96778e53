"""Contracts: a reasons column instead of an exception, and the split into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_reasons(df: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """df with the names of the broken rules, in order. A rule is a condition that is true for a bad row; null is not bad."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(bad, F.lit(why)) for why, bad in rules.items()])))


def split(df: DataFrame, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): nothing is dropped silently."""
    return df.where(F.size(name) == 0).drop(name), df.where(F.size(name) > 0)


def strict(df: DataFrame, name: str = "reasons") -> DataFrame:
    """df, but reading a row with a reason fails the job with it."""
    refused = F.raise_error(F.array_join(name, ", ")).cast("boolean")
    return df.where(F.when(F.size(name) == 0, F.lit(True)).otherwise(refused)).drop(name)


def span_rules(start: str, end: str) -> dict[str, Column]:
    return {"negative start": F.col(start) < 0, "ends before it starts": F.col(end) <= F.col(start)}


def overlap_rule(key: str, start: str, end: str) -> Column:
    return F.lag(end).over(Window.partitionBy(key).orderBy(start, end)) > F.col(start)


def json_keys(payload: str, required: list[str], optional: list[str] = []) -> tuple[Column, Column]:  # noqa: B006
    """(missing, extra) keys of a JSON object; both null where it is none. Repeated keys cannot be seen."""
    keys = F.json_object_keys(payload)
    want = F.array(*[F.lit(k) for k in required])
    return F.array_except(want, keys), F.array_except(keys, F.array(*[F.lit(k) for k in [*required, *optional]]))


def resolve(rows: DataFrame, model: str, allowed: DataFrame, denied: DataFrame) -> DataFrame:
    """rows with status: denied, unknown, or the role the allow list gives. Lists: (name, role), (name); small registries."""
    a = allowed.select(F.col("name").alias(model), "role")
    d = denied.select(F.col("name").alias(model), F.lit(True).alias("_denied"))
    out = rows.join(a, model, "left").join(d, model, "left")
    return out.withColumn("status", F.when(F.col("_denied"), "denied").when(F.col("role").isNull(), "unknown").otherwise(F.col("role"))).drop("_denied", "role")


def precedence(*layers: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, layer it came from): the first layer that is not null."""
    value = F.coalesce(*[c for _, c in layers])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in layers])
    return value, source
