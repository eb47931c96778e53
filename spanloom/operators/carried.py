"""Folds with a state that is handed from split to split, for keys with more rows than a task takes.

A key's rows are cut into splits of its order. All splits are folded at once, each from the state that is guessed for it (none,
as at the start); then every split whose predecessor ended otherwise is folded again from there, until no state differs. What is
left is the serial fold's own result. Rules that forget, as a camera that has moved, agree after a round or two; a rule that never
does needs a round for each split, each with fewer splits.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.scratch import Scratch

#: step(key, rows, others, state, last) -> (result, state). rows, others: frames; state: text, None at the start; last: is it the key's last split?
Step = Callable[[object, pd.DataFrame, pd.DataFrame, str | None, bool], tuple[pd.DataFrame, str]]


def carried(df: DataFrame, others: DataFrame, key: str, order: list[str], ties: list[str], step: Step, schema: str, split_rows: int) -> DataFrame:
    """The result of a fold over the rows of each key in their order; rows equal in `order` stay in one split.

    others: rows of each key that every split of it may look at, few of them. Keys are not null.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "carried")
    parts = max(1, -(-df.count() // split_rows))
    rows = scratch.save(df.repartitionByRange(parts, key, *order).withColumn("_split", F.spark_partition_id()), "rows")
    line = Window.partitionBy(key).orderBy("_split")
    splits = rows.select(key, "_split").distinct().withColumn("_last", F.lead("_split").over(line).isNull())
    splits = scratch.save(splits.select(key, "_split", "_last", F.lag("_split").over(line).alias("_before")), "splits")
    names, kind = [c.split()[0] for c in schema.split(", ")], df.schema[key].dataType.simpleString()
    whole = f"{schema}, _of {kind}, _split int, _exit string"

    def fold(group, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        state = a["_entry"].iloc[0]
        got, end = step(group[0], a.sort_values([*order, *ties]), b, None if pd.isna(state) else state, bool(a["_last"].iloc[0]))
        got = got[names].assign(_exit=None)
        return pd.concat([got, pd.DataFrame([{"_exit": end}])]).assign(_of=group[0], _split=group[1]).convert_dtypes()

    todo = splits.select(key, "_split", "_last", F.lit(None).cast("string").alias("_entry"))
    used, results, n = None, None, 0
    while True:
        each = todo.join(others, key).select(*others.columns, "_split")
        own = rows.join(todo, [key, "_split"])
        done = scratch.save(own.groupBy(key, "_split").cogroup(each.groupBy(key, "_split")).applyInPandas(fold, whole), f"round{n}").withColumn("_round", F.lit(n))
        entries = todo.select(key, "_split", "_entry", F.lit(n).alias("_round"))
        results, used = (done, entries) if results is None else (results.unionByName(done), used.unionByName(entries))
        newest = lambda x, by: x.groupBy(*by).agg(F.max("_round").alias("_round"))
        exits = results.where("_exit is not null").select(F.col("_of").alias("_k"), F.col("_split").alias("_s"), "_exit", "_round")
        exits = exits.join(newest(exits, ["_k", "_s"]), ["_k", "_s", "_round"]).select("_k", "_s", "_exit")
        now = used.join(newest(used, [key, "_split"]), [key, "_split", "_round"]).select(F.col(key).alias("_k2"), F.col("_split").alias("_s2"), "_entry")
        met = splits.join(exits, (F.col(key) == F.col("_k")) & (F.col("_before") == F.col("_s")), "left").join(now, (F.col(key) == F.col("_k2")) & (F.col("_split") == F.col("_s2")))
        n += 1
        todo = scratch.save(met.where(~F.col("_exit").eqNullSafe(F.col("_entry"))).select(key, "_split", "_last", F.col("_exit").alias("_entry")), f"todo{n}")
        if todo.isEmpty():
            break
        used = scratch.save(used, f"used{n}")
    final = newest(results, ["_of", "_split"])
    return results.where("_exit is null").join(final, ["_of", "_split", "_round"]).select(*names)
