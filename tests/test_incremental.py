from pyspark.sql import functions as F

from spanloom.streaming import incremental as N


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*.parquet")}


def rows(spark, data):
    return spark.createDataFrame([(p, i, v) for p, vs in data.items() for i, v in enumerate(vs)], "part string, i long, v long")


def totals(seen):
    def compute(df):
        got = df.groupBy("part").agg(F.sum("v").alias("total"))
        seen.append({r.part for r in df.select("part").distinct().collect()})
        return got

    return compute


def test_a_second_run_writes_only_what_changed(spark, tmp_path):
    stage, seen = N.Stage(spark, str(tmp_path), "part", "part string, total long"), []
    first = {"a": [1, 2], "b": [3], "c": [4, 5], "d": [6], None: [7]}
    assert {r.outcome for r in stage.run(rows(spark, first), totals(seen)).collect()} == {"miss"}
    before = files(tmp_path / "table")
    second = {"a": [2, 1, 0][:2], "b": [3], "c": [4, 5, 6], "e": [8], None: [7]}  # a: same values, other rows; d: gone; e: new
    got = {r.part: r.outcome for r in stage.run(rows(spark, second), totals(seen)).collect()}
    assert got == {"a": "stale", "b": "hit", "c": "stale", "d": "gone", "e": "miss", None: "hit"}
    assert seen == [{"a", "b", "c", "d", None}, {"a", "c", "e"}]
    after = files(tmp_path / "table")
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[0] for f in same} == {"part=b", "part=d", "part=__HIVE_DEFAULT_PARTITION__"}
    assert {r.part: r.total for r in stage.table().collect()} == {"a": 3, "b": 3, "c": 15, "e": 8, None: 7}
    assert {r.outcome for r in stage.run(rows(spark, second), totals(seen)).collect()} == {"hit"} and len(seen) == 2
    assert files(tmp_path / "table") == after


def test_other_metadata_makes_all_stale_and_empty_results_stay_empty(spark, tmp_path):
    N.Stage(spark, str(tmp_path), "part", "part string, total long", "v1").run(rows(spark, {"a": [1], "b": [2]}), totals([]))
    other = N.Stage(spark, str(tmp_path), "part", "part string, total long", "v2")
    got = other.run(rows(spark, {"a": [1], "b": [2]}), lambda df: totals([])(df).where("part <> 'a'"))
    assert {r.outcome for r in got.collect()} == {"stale"}
    assert [tuple(r) for r in other.table().collect()] == [("b", 2)]  # the old row of `a` is still on disk, and counts no more


def test_a_run_that_died_before_its_manifest_is_made_again(spark, tmp_path):
    stage = N.Stage(spark, str(tmp_path), "part", "part string, total long")
    stage.run(rows(spark, {"a": [1], "b": [2]}), totals([]))
    kept = sorted((tmp_path / "manifest").rglob("*"))
    stage.run(rows(spark, {"a": [9], "b": [2]}), totals([]))
    for p in sorted((tmp_path / "manifest").rglob("*")):
        if p not in kept:
            p.unlink()  # as if it had died
    assert {r.part: r.total for r in stage.table().collect()} == {"b": 2}
    assert {r.part: r.outcome for r in stage.run(rows(spark, {"a": [9], "b": [2]}), totals([])).collect()} == {"a": "stale", "b": "hit"}
    assert {r.part: r.total for r in stage.table().collect()} == {"a": 9, "b": 2}


def test_digests_do_not_depend_on_order(spark):
    df = rows(spark, {"a": list(range(50)), "b": [1, 1, 1]})
    one = {tuple(r) for r in N.part_digests(df, "part").collect()}
    assert one == {tuple(r) for r in N.part_digests(df.orderBy(F.desc("i")).repartition(3), "part").collect()}
    assert one != {tuple(r) for r in N.part_digests(df.unionByName(df.where("part = 'b'").limit(1)), "part").collect()}
    assert N.part_digests(df.limit(0), "part").count() == 0


def test_cache_computes_each_content_once(spark, tmp_path):
    cache, asked = N.Cache(spark, str(tmp_path), ["k"], "digest", "double long"), []

    def compute(df):
        asked.append(sorted(r.k for r in df.collect()))
        return df.withColumn("double", F.col("v") * 2)

    def want(data):
        return spark.createDataFrame(list(data.items()), "k long, v long").withColumn("digest", F.md5(F.col("v").cast("string").cast("binary")))

    def fill(data):
        return {r.k: (r.outcome, r.double) for r in cache.fill(want(data), compute).collect()}

    assert fill({1: 10, 2: 20}) == {1: ("miss", 20), 2: ("miss", 40)}
    assert fill({1: 10, 2: 21, 3: 30}) == {1: ("hit", 20), 2: ("stale", 42), 3: ("miss", 60)}
    assert fill({1: 10, 2: 20}) == {1: ("hit", 20), 2: ("hit", 40)}  # what returns is still there
    assert asked == [[1, 2], [2, 3], []]
