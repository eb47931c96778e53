"""Corpus curation: deterministic samples, blind studies, splits without leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.graph import components

NUL = "\u0000"


def rank_digest(namespace: str, *fields) -> Column:
    """sha256 of the namespace and the fields, joined by NUL; a null field counts as the empty text."""
    parts = [F.coalesce(F.col(f).cast("string") if isinstance(f, str) else f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat_ws(NUL, F.lit(namespace), *parts), 256)


#: Hexadecimal digits of a digest that name a bucket: 4096 of them, however many rows there are.
BUCKET_DIGITS = 3


def with_before(rows: DataFrame, keys: list[str], digest: str, order: list[str], amount: Column | None = None) -> DataFrame:
    """rows with `before`: the sum of an amount (1) over the rows of the same keys that come earlier by (digest, order).

    Digests are spread evenly, so rows are ranked inside buckets of them; what comes before a bucket is a running
    sum over at most 4096 bucket totals of a key. No key's rows meet in one task.
    """
    amount = F.lit(1) if amount is None else amount
    bucketed = rows.withColumn("_a", amount.cast("long")).withColumn("_bucket", F.substring(digest, 1, BUCKET_DIGITS))
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_a").alias("_t"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(digest, *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("_own", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    on = [ranked["_bucket"] == base["_kb"]] + [ranked[k].eqNullSafe(base[f"_k{i}"]) for i, k in enumerate(keys)]
    return ranked.join(base, on).withColumn("before", F.col("_own") + F.col("_base")).select(*rows.columns, "before")


def stratified_sample(items: DataFrame, stratum: str, item_id: str, quota: int, namespace: str) -> DataFrame:
    """The first `quota` items of each stratum in the order of their digests."""
    placed = with_before(items.withColumn("_digest", rank_digest(namespace, item_id)), [stratum], "_digest", [item_id])
    return placed.withColumn("place", (F.col("before") + 1).cast("int")).where(F.col("place") <= quota).drop("_digest", "before")


def freeze_study(items: DataFrame, stratum: str, item_id: str, namespace: str, holdout: float = 0.2) -> DataFrame:
    """items with split (a fifth of each stratum, one at least, is held out), option_a by parity, and an opaque review_id."""
    digest = rank_digest(namespace, item_id)
    placed = with_before(items.withColumn("_split", rank_digest(namespace + "-split", item_id)), [stratum], "_split", [item_id])
    sizes = items.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_size"))
    placed = placed.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")))
    held = F.col("before") < F.greatest(F.lit(1), F.floor(F.col("_size") * holdout))
    parity = F.conv(F.substring(digest, 64, 1), 16, 10).cast("int") % 2
    return placed.select(*items.columns, F.when(held, "holdout").otherwise("training").alias("split"), F.when(parity == 0, "first").otherwise("second").alias("option_a"), F.substring(rank_digest(namespace + "-review", item_id), 1, 16).alias("review_id"))


def disjoint_split(items: DataFrame, episode: str, speaker: str, holdout: float = 0.2, seed: str = "disjoint") -> DataFrame:
    """items with split: no episode and no speaker is on both sides.

    Episodes and speakers that occur together are one component. Components go to the holdout in the order of
    their digests while the rows before them are fewer than the target; the first always does.
    """
    ep = F.xxhash64(F.lit("e"), F.col(episode))
    keyed = items.withColumn("_e", ep)
    edges = keyed.where(F.col(speaker).isNotNull()).select(F.col("_e").alias("u"), F.xxhash64(F.lit("s"), F.col(speaker)).alias("v")).distinct()
    of = components(edges)
    rows = keyed.join(of.select(F.col("node").alias("_e"), "component"), "_e", "left").withColumn("component", F.coalesce("component", "_e")).drop("_e")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"), F.min(F.col(episode).cast("string")).alias("name"))
    named = sizes.withColumn("_digest", F.sha2(F.concat_ws(":", F.lit(seed), "name"), 256))
    total = sizes.agg(F.sum("n").alias("total"))
    placed = with_before(named, [], "_digest", ["component"], F.col("n")).join(F.broadcast(total))
    held = (F.col("before") == 0) | ((F.col("before") < F.greatest(F.lit(1), F.round(F.col("total") * holdout))) & (F.col("before") + F.col("n") <= F.col("total") - 1))
    return rows.join(placed.select("component", held.alias("_held")), "component").withColumn("split", F.when(F.col("_held"), "holdout").otherwise("training")).drop("_held")


def leaks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value) of everything that both sides have."""
    out = None
    for k in keys:
        both = a.select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")).intersect(b.select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")))
        out = both if out is None else out.unionByName(both)
    return out.where("value is not null")
