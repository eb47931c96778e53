import hashlib
import random

import numpy as np
import pytest

from spanloom.llm import centroid_clustering as K


def brute(rows, clusters, rounds):
    """By the wording of the contract, with Python's integers."""
    kept = [(i, [int(np.floor(K.SCALE * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == K.SIZE and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{K.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    cents = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(cents)):
            own = [v for (_, v), c in zip(kept, of) if c == k]
            if own:
                cents[k] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in kept]
    whole = sum(d for _, d, _ in last)
    return sorted((str(i), k, d, sum(e for _, e, c in last if c == k), whole, hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in last)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance string")


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(K.SIZE)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(150)]
    rows += [(1000, rows[0][1])] * 60 + [(None, rows[1][1]), (None, rows[2][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("-inf")] + [0.0] * 63), (2006, [1.0] * 65)]
    rows += [(3000 + i, [float(i % 2)] * 64) for i in range(10)]
    docs = table(spark, rows).repartition(5)
    got = K.cluster(docs)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    assert sorted((str(r.vec_id), *tuple(r)[1:6]) for r in got.collect()) == brute(rows, K.CLUSTERS, K.ROUNDS)


def test_few_equal_and_no_vectors(spark):
    for rows in ([(1, [0.5] * 64)], [(i, [-0.25] * 64) for i in range(20)], [(i, [i / 3] * 64) for i in range(3)]):
        got = K.cluster(table(spark, rows)).collect()
        assert sorted((str(r.vec_id), *tuple(r)[1:6]) for r in got) == brute(rows, K.CLUSTERS, K.ROUNDS)
    assert K.cluster(table(spark, [(1, None)])).count() == 0
    assert K.cluster(table(spark, [(1, [1.0] * 64)]).limit(0)).count() == 0


def test_a_component_that_does_not_fit_is_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        K.cluster(table(spark, [(1, [1e9] * 64)])).collect()


def test_search_is_exact_and_measures_less():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (40, 8)) * 10
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8))
    cluster, best, measured = K.Orchard(centres).nearest(x)
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured < 0.6 * every.size
    grid = rng.integers(0, 3, (2000, 2))  # many ties
    cents = rng.integers(0, 3, (12, 2))
    cluster, best, _ = K.Orchard(cents).nearest(grid)
    every = ((grid[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
