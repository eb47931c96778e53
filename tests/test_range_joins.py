import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import spans as P

YEAR = 365 * 24 * 3600 * 1000


def spans(n, seed, longest):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 2, None]), a := rng.randint(-5000, 5000), a + rng.choice([0, -3, 1, rng.randint(1, longest)])) for i in range(n)]


def brute(left, right):
    return sorted((i, j) for i, k, a, z in left for j, m, b, y in right if k is not None and k == m and a < y and b < z)


@pytest.mark.parametrize("longest", [10, 300, 6000])
def test_overlaps_equal_all_pairs(spark, longest):
    left, right = spans(150, 1, longest), spans(150, 2, 40)
    x = spark.createDataFrame(left, "i long, k long, s long, e long")
    y = spark.createDataFrame(right, "j long, k long, t long, u long")
    for bucket, crowd in ((1, 5), (16, P.CROWD), (100_000, 5)):
        got = P.overlap_join(x, y, "k", ("s", "e"), ("t", "u"), bucket, crowd)
        assert got.columns == ["k", "i", "s", "e", "j", "t", "u"]
        assert sorted((r.i, r.j) for r in got.collect()) == brute(left, right)


def test_points_equal_all_pairs(spark):
    rng = random.Random(3)
    held = spans(120, 4, 900)
    points = [(i, rng.choice([1, 2, None]), rng.randint(-5000, 6000)) for i in range(200)] + [(900 + i, 1, x) for i, (_, _, a, z) in enumerate(held) for x in (a, z)]
    x, y = spark.createDataFrame(points, "i long, k long, at long"), spark.createDataFrame(held, "j long, k long, s long, e long")
    for crowd in (P.CROWD, 3):
        for closed in (False, True):
            got = sorted((r.i, r.j) for r in P.point_join(x, y, "k", "at", ("s", "e"), closed, 16, crowd).collect())
            assert got == sorted((i, j) for i, k, p in points for j, m, a, z in held if k is not None and k == m and (a < p <= z if closed else a <= p < z))
    assert P.point_join(x.limit(0), y, "k", "at", ("s", "e")).count() == 0


def test_a_span_of_a_year_is_a_few_dozen_rows(spark):
    one = spark.createDataFrame([(P.BUCKET_MS * 7 + 5, YEAR)], "s long, e long").select(P.cell("s", P.BUCKET_MS).alias("lo"), P.cells_spanned("s", "e", P.BUCKET_MS).alias("n"))
    cells = one.select("lo", "n", F.explode(P.cover("lo", "n", 20)).alias("c")).select("lo", "n", "c.*").collect()
    assert len(cells) <= 2 * 20
    held = sorted(b for r in cells for b in range(r.place << r.level, (r.place + 1) << r.level))
    assert held == list(range(cells[0].lo, cells[0].lo + cells[0].n)) and len(held) > 500_000


def test_a_crowded_recording_is_dealt_over_tasks(spark):
    """A third of all rows in one recording, and a span of a year over it: no task takes more than a share of the cell's rows."""
    hot, n = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500), 30_000
    points = spark.range(n).select(F.col("id").alias("i"), hot.alias("k"), (F.col("id") * 50).alias("at"))
    held = spark.createDataFrame([(1, -1, 0, YEAR), (2, -1, 1000, 1001), (3, 7, 0, YEAR)], "j long, k long, s long, e long")
    (_, levels), most, total = P._first_pass("k", (points, F.lit(1).cast("long")), (held, P.cells_spanned("s", "e", P.BUCKET_MS)))
    assert (most, total) == (10_000, n + 3) and levels == 20
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = P.point_join(points, held, "k", "at", ("s", "e"), crowd=500)
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
        plain = P.point_join(points, held, "k", "at", ("s", "e"))
        assert got.count() == plain.count() == 10_000 + 1 * (0 if 1000 % 150 else 1) + points.where("k = 7").count()
        assert max(r[1] for r in plain.groupBy(F.spark_partition_id()).count().collect()) >= 9_000
        assert max(r[1] for r in tasks) < 2_500 and len(tasks) > 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
