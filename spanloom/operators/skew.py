"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy with more than 1/HEAVY of all rows, so there are at most HEAVY of them; each is dealt over SALTS tasks.
HEAVY, SALTS = 1024, 64


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with what a table has for their keys; n: how many rows have the key; total: at least all rows.

    The list of heavy keys is bounded by HEAVY and therefore broadcast; their rows are dealt over SALTS tasks by a
    hash of the whole row, and the table's rows for them go to each of those.
    """
    heavy = table.where(F.col(n) * HEAVY > total).select(*keys).distinct().withColumn("_heavy", F.lit(True))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).drop("_heavy")
    salts = F.when(F.col(n) * HEAVY > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("_salt", F.explode(salts)), [*keys, "_salt"]).drop("_salt")
