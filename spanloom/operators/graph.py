"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.scratch import Scratch


#: Edges of a written partition: rounds of few edges are written by few tasks.
EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for every node of edges (u, v).

    Each round points every larger neighbour at the smallest one, then every node at its smallest neighbour;
    the edges become stars in a number of rounds that grows with the logarithm of the longest path. Rounds
    are written, so lineage stays short. Minima are pre-aggregated; the join back to a node with very many edges is
    by key, for Spark to split where it is large. Only edges move, and none to the driver.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now, mark = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (got["n"], got["s"]):
            break
        mark = (got["n"], got["s"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # One exchange by u serves what follows: repeated edges go, minima are found, edges meet them.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        now = scratch.save(small.distinct().coalesce(1 + got["n"] // EDGES))
        scratch.drop(scratch.n - 1)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
