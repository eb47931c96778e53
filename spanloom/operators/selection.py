"""Fusion and greedy selection in rounds: one-to-one merges, voting, diverse picks with a reason for every row.

The greedy rules are defined by one strict order. Every round settles all rows that no earlier open row can
affect, so a round is a few joins over the pairs that still matter, and the result equals the serial rule.
The number of rounds is the longest chain of conflicts, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import intervals as I
from spanloom.functions import numbers as N
from spanloom.operators.chains import numbered
from spanloom.operators.spans import overlap_join
from spanloom.scratch import Scratch


def one_to_one(pairs: DataFrame, left: str, right: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs that the greedy rule keeps: lefts in order, each claims its first free right.

    A pair in which each is the other's first open choice is final; it and all pairs that share a side with it
    leave, until no pair is left. Both orders must be strict.
    """
    scratch = Scratch(pairs.sparkSession, "one_to_one")
    open_pairs, chosen = scratch.save(pairs), None
    while not open_pairs.isEmpty():
        mine = F.row_number().over(Window.partitionBy(left).orderBy(*right_order))
        theirs = F.row_number().over(Window.partitionBy(right).orderBy(*left_order))
        final = scratch.save(open_pairs.withColumn("_a", mine).withColumn("_b", theirs).where("_a = 1 and _b = 1").drop("_a", "_b"))
        chosen = final if chosen is None else chosen.unionByName(final)
        rest = open_pairs.join(final.select(left), left, "left_anti").join(final.select(right), right, "left_anti")
        open_pairs = scratch.save(rest.select(*pairs.columns))
    return pairs.limit(0) if chosen is None else chosen


def merge_candidates(verbal: DataFrame, visual: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Union of two ranked candidate tables (candidate_id, media_id, in_ms, out_ms, rank).

    A verbal candidate claims the best free visual one with IoU >= least_iou; the merged row has the verbal
    span, both ranks and both ids in sources. Everything else stays as it is: nothing is lost.
    """
    a = verbal.select("media_id", F.col("candidate_id").alias("a_id"), F.col("in_ms").alias("a_in"), F.col("out_ms").alias("a_out"), F.col("rank").alias("a_rank"))
    b = visual.select("media_id", F.col("candidate_id").alias("b_id"), F.col("in_ms").alias("b_in"), F.col("out_ms").alias("b_out"), F.col("rank").alias("b_rank"))
    close = overlap_join(a, b, "media_id", ("a_in", "a_out"), ("b_in", "b_out")).where(I.iou("a_in", "a_out", "b_in", "b_out") >= least_iou)
    met = one_to_one(close, "a_id", "b_id", ["a_rank", "a_id"], ["b_rank", "b_id"])
    both = met.select("media_id", F.col("a_in").alias("in_ms"), F.col("a_out").alias("out_ms"), F.lit("both").alias("path"), F.col("a_rank").alias("verbal_rank"), F.col("b_rank").alias("visual_rank"), F.array("a_id", "b_id").alias("sources"))
    nul = F.lit(None).cast("long")
    one = a.join(met.select("a_id"), "a_id", "left_anti").select("media_id", F.col("a_in").alias("in_ms"), F.col("a_out").alias("out_ms"), F.lit("verbal").alias("path"), F.col("a_rank").alias("verbal_rank"), nul.alias("visual_rank"), F.array("a_id").alias("sources"))
    two = b.join(met.select("b_id"), "b_id", "left_anti").select("media_id", F.col("b_in").alias("in_ms"), F.col("b_out").alias("out_ms"), F.lit("visual").alias("path"), nul.alias("verbal_rank"), F.col("b_rank").alias("visual_rank"), F.array("b_id").alias("sources"))
    return both.unionByName(one).unionByName(two)


def rejected_by_order(conflicts: DataFrame) -> DataFrame:
    """(hi) of the rows that a greedy pass in order leaves out; conflicts: (lo, hi), lo before hi.

    Rows without an open conflict before them are taken; whatever conflicts with them is rejected.
    """
    scratch = Scratch(conflicts.sparkSession, "selection")
    edges, out = scratch.save(conflicts.select("lo", "hi").distinct()), conflicts.select("hi").limit(0)
    while not edges.isEmpty():
        taken = edges.select("lo").distinct().join(edges.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
        gone = scratch.save(edges.join(taken, "lo", "left_semi").select("hi").distinct())
        out = out.unionByName(gone)
        rest = edges.join(gone, "hi", "left_anti").join(gone.withColumnRenamed("hi", "lo"), "lo", "left_anti")
        edges = scratch.save(rest.select("lo", "hi"))
    return out


def ordered_conflicts(rows: DataFrame, key: str, row_id: str, place: str, condition, a: tuple[str, str] = ("in_ms", "out_ms"), reach_ms: int = 0) -> DataFrame:
    """(lo, hi) for rows of a key that meet a condition on columns x_* (earlier) and y_* (later); spans at most reach_ms apart."""
    names = [c for c in rows.columns if c != key]
    x = rows.select(key, *[F.col(c).alias(f"x_{c}") for c in names]).withColumn("_x1", F.col(f"x_{a[1]}") + reach_ms)
    y = rows.select(key, *[F.col(c).alias(f"y_{c}") for c in names])
    met = overlap_join(x.withColumn("_x0", F.col(f"x_{a[0]}") - reach_ms), y, key, ("_x0", "_x1"), (f"y_{a[0]}", f"y_{a[1]}"))
    return met.where(F.col(f"x_{place}") < F.col(f"y_{place}")).where(condition).select(F.col(f"x_{row_id}").alias("lo"), F.col(f"y_{row_id}").alias("hi"))


def vote(runs: DataFrame, least_iou: float = 0.6, least_votes: int = 2) -> DataFrame:
    """Spans that several runs agree on: media_id, leader_id, in_ms, out_ms, votes, mean_score, rank.

    runs: candidate_id, media_id, run, in_ms, out_ms, score. In order of (-score, in_ms, candidate_id) a span
    joins the first leader it matches or becomes one; votes are distinct runs.
    """
    own = runs.select("media_id", "candidate_id", "run", "in_ms", "out_ms", "score")
    placed = numbered(own, "media_id", [F.desc("score"), "in_ms", "candidate_id"])
    scratch = Scratch(runs.sparkSession, "vote")
    rows = scratch.save(placed.select(*own.columns, (F.col("i") + 1).cast("int").alias("place")))
    edges = scratch.save(ordered_conflicts(rows, "media_id", "candidate_id", "place", I.iou("x_in_ms", "x_out_ms", "y_in_ms", "y_out_ms") >= least_iou))
    lost = rejected_by_order(edges).withColumnRenamed("hi", "candidate_id")
    leaders = rows.join(lost, "candidate_id", "left_anti")
    places = leaders.select(F.col("candidate_id").alias("lo"), "place")
    joined = edges.join(places, "lo").join(lost.withColumnRenamed("candidate_id", "hi"), "hi", "left_semi").groupBy("hi").agg(F.min_by("lo", "place").alias("leader_id"))
    members = rows.join(joined.withColumnRenamed("hi", "candidate_id"), "candidate_id", "left").withColumn("leader_id", F.coalesce("leader_id", "candidate_id"))
    counted = members.groupBy("media_id", "leader_id").agg(F.countDistinct("run").alias("votes"), F.avg("score").alias("mean_score")).where(F.col("votes") >= least_votes)
    spans = counted.join(leaders.select(F.col("candidate_id").alias("leader_id"), "in_ms", "out_ms"), "leader_id")
    rank = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("votes"), F.round("mean_score", 9).desc(), "in_ms", "leader_id"))
    return spans.select("media_id", "leader_id", "in_ms", "out_ms", "votes", "mean_score", rank.alias("rank"))


#: Rows of a recording that a task compares with a pick, at least; where there are very many rows, a SHARE of all of them.
CROWD, SHARE = 4096, 1024


def crowded(placed: DataFrame, deal: int, crowd: int = CROWD) -> DataFrame:
    """media_id, parts of the recordings with too many rows for a task: at most SHARE of them, so their list may be broadcast."""
    limit = max(crowd, placed.count() // SHARE)
    counts = placed.groupBy("media_id").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    return counts.select("media_id", F.least(F.lit(deal), F.ceil(F.col("_n") / limit)).cast("long").alias("parts"))


def diverse(rows: DataFrame, quota: int, separation_ms: int = 15_000, most_similar: float = 0.5, deal: int = 16, carry: tuple[str, ...] = (), alike=None, crowd: int = CROWD) -> DataFrame:
    """rows (media_id, candidate_id, in_ms, out_ms, score, words array) with selected and reason.

    In order of (-score, candidate_id) a row is taken unless the quota is full (checked first), it overlaps a
    taken one, lies closer than separation_ms to one, or shares more than most_similar of its words with one.
    alike: another condition for the last, on the words and the columns named in carry, x_* for the taken row's.

    Round n takes the first open row of every key and closes what conflicts with it, so whole word sets are
    compared at most `quota` times a row, never row by row. A key of more than `crowd` rows is dealt over up to `deal` tasks,
    each of which gets its picks; the words are shuffled once and held between the rounds, which write ids and the taken rows only.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "diverse")
    bare = rows.drop("words")
    placed = scratch.save(numbered(bare, "media_id", [F.desc("score"), "candidate_id"]).select(*bare.columns, (F.col("i") + 1).cast("int").alias("place")))
    wide = F.broadcast(scratch.save(crowded(placed, deal, crowd)))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    salt = F.pmod(F.xxhash64("candidate_id"), parts).alias("salt")
    salted = rows.join(wide, "media_id", "left").select("media_id", "candidate_id", "in_ms", "out_ms", F.array_distinct("words").alias("words"), *carry, salt)
    held = salted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "media_id", "salt").persist()
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt")
    over = I.overlaps("x_in_ms", "x_out_ms", "in_ms", "out_ms")
    gap = F.greatest(F.col("in_ms") - F.col("x_out_ms"), F.col("x_in_ms") - F.col("out_ms"))
    same = similarity("x_words", "words") > most_similar if alike is None else alike
    conflict = over | (gap < separation_ms) | F.coalesce(same, F.lit(False))
    still, taken = placed.select("media_id", "candidate_id", "place"), None
    for nth in range(1, quota + 1):
        first = still.groupBy("media_id").agg(F.min(F.struct("place", "candidate_id")).alias("x")).select("media_id", F.col("x.place").alias("x_place"), F.col("x.candidate_id").alias("candidate_id"))
        first = first.join(wide, "media_id", "left").select("media_id", "x_place", F.col("candidate_id").alias("lo"), salt)
        # An equality would become a key of the join, for which all words were shuffled again.
        # The held words are streamed past a table of a few rows a key: a merge join would sort them all, twice a round.
        found = held.join(first.hint("shuffle_hash"), ["media_id", "salt"]).where(F.array_contains(F.array("lo"), F.col("candidate_id")))
        picks = scratch.save(found.select("media_id", "lo", F.col("in_ms").alias("x_in_ms"), F.col("out_ms").alias("x_out_ms"), "x_place", *[F.col(c).alias(f"x_{c}") for c in ("words", *carry)], F.lit(nth).alias("nth")))
        own = picks.drop("x_words", *[f"x_{c}" for c in carry])
        taken = own if taken is None else taken.unionByName(own)
        if nth == quota or picks.isEmpty():
            break
        apart = held.join(picks.join(wide, "media_id", "left").select(*picks.columns, every).hint("shuffle_hash"), ["media_id", "salt"]).where(~conflict).select("candidate_id", "x_place")
        still = scratch.save(still.join(apart, "candidate_id").where("place > x_place").select("media_id", "candidate_id", "place"))
    held.unpersist()
    if taken is None:
        return placed.withColumn("reason", F.lit("quota")).withColumn("selected", F.lit(False))
    full = taken.where(F.col("nth") == quota).select("media_id", F.col("x_place").alias("full_at"))
    reach = taken.select("media_id", "x_in_ms", "x_out_ms", "x_place", (F.col("x_in_ms") - separation_ms).alias("_x0"), (F.col("x_out_ms") + separation_ms).alias("_x1"))
    near = overlap_join(reach, placed.select("media_id", "candidate_id", "in_ms", "out_ms", "place"), "media_id", ("_x0", "_x1"), ("in_ms", "out_ms")).where("x_place < place").where(over | (gap < separation_ms))
    cause = near.groupBy("candidate_id").agg(F.min(F.when(over, 1).otherwise(2)).alias("kind"))
    out = placed.join(full, "media_id", "left").join(cause, "candidate_id", "left").join(taken.select(F.col("lo").alias("candidate_id"), "nth"), "candidate_id", "left")
    beyond = F.coalesce(F.col("place") > F.col("full_at"), F.lit(False))
    # A row without media_id is in no recording and conflicts with none; a row left out for no other cause is similar.
    free = F.col("nth").isNotNull() | F.col("media_id").isNull()
    reason = F.when(beyond, "quota").when(free, F.lit(None)).when(F.col("kind") == 1, "overlap").when(F.col("kind") == 2, "separation").otherwise("similar")
    return out.withColumn("reason", reason).withColumn("selected", F.col("reason").isNull()).drop("full_at", "kind", "nth")


def episode_package(rows: DataFrame, quota: int = 3, least_quality: float = 0.6, separation_ms: int = 15_000, most_lexical: float = 0.5, most_semantic: float = 0.8, distinct_views: bool = True) -> DataFrame:
    """media_id, candidate_id, state, reason: the clips that go into an episode's package, and why the others do not.

    rows: those of diverse, with vector (array<double> or null), perspective, critical and clear (null where nobody
    looked). Low quality and critical defects are refused first. Of the rest, two are alike in words or in vectors,
    unless their perspectives differ (and distinct_views holds). What is taken is approved if clear, else it needs review.
    """
    first = F.when(F.col("score") < least_quality, "low quality").when(F.coalesce("critical", F.lit(False)), "defects")
    checked = rows.withColumn("gate", first)
    view = lambda c: F.lower(F.trim(c))
    alike = F.coalesce(similarity("x_words", "words") > most_lexical, F.lit(False)) | F.coalesce(N.similarity01("x_vector", "vector") > most_semantic, F.lit(False))
    if distinct_views:
        alike = alike & view("x_perspective").eqNullSafe(view("perspective"))
    open_rows = checked.where("gate is null").drop("gate", "critical")
    got = diverse(open_rows, quota, separation_ms, carry=("vector", "perspective"), alike=alike)
    state = F.when(~F.col("selected"), "rejected").when(F.coalesce("clear", F.lit(False)), "approved").otherwise("needs review")
    refused = checked.where("gate is not null").select("media_id", "candidate_id", F.lit("rejected").alias("state"), F.col("gate").alias("reason"))
    return got.select("media_id", "candidate_id", state.alias("state"), "reason").unionByName(refused)


def similarity(a: str, b: str):
    """Jaccard similarity of two arrays of distinct words; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def lowest_quarter(rows: DataFrame, key: list[str], score: str, position: str) -> DataFrame:
    """rows with `low`: among the floor(n / 4) lowest scores of the key, ties by position."""
    own = Window.partitionBy(*key)
    return rows.withColumn("low", F.row_number().over(own.orderBy(score, position)) <= F.floor(F.count("*").over(own) / 4))
