"""What is shuffled or broadcast: read off the plans, and results beside those of the whole table."""

from pyspark.sql import functions as F

from spanloom import tables as T
from spanloom.operators import sentences as S
from spanloom.operators import spans as P

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df):
    """For each shuffle by hash whether words are made below it."""
    lines = plan(df).splitlines()
    return [any("posexplode" in x for x in lines[i:]) for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


def test_a_range_join_broadcasts_no_placed_rows(spark):
    x = spark.range(3).selectExpr("id as k", "id as s", "id + 10 as e")
    y = spark.range(3).selectExpr("id as k", "id as t", "id + 20 as u")
    assert "BroadcastHashJoin" not in plan(P.overlap_join(x, y, "k", ("s", "e"), ("t", "u")))


def test_sentences_shuffle_texts_not_words(spark):
    assert shuffled(S.segment(T.words(spark, SF))) == [False]


def test_transcripts_shuffle_nothing(spark):
    assert "Exchange" not in plan(T.transcripts(spark, SF))
    got = T.transcripts(spark, SF).select("media_id", F.posexplode("words").alias("pos", "x")).select("media_id", F.col("pos").cast("long").alias("pos"), "x.*")
    whole = T.words(spark, SF)
    assert got.select(whole.columns).exceptAll(whole).isEmpty() and whole.exceptAll(got.select(whole.columns)).isEmpty()


def test_words_of_named_recordings(spark):
    of = spark.createDataFrame([(3, 500, 900), (3, 2000, 2500), (5, 0, 10**9), (10**7, 0, 5)], "media_id long, in_ms long, out_ms long")
    whole = T.words(spark, SF).where("media_id in (3, 5)")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(T.words(spark, SF, of)) == rows(whole)
    assert rows(T.words(spark, SF, of, whole=False)) == rows(whole.where("media_id = 5 or (start_ms < 2500 and end_ms > 500)"))
