"""Centroid clustering in integers, with Orchard's search for the nearest centroid.

Every centroid keeps the others sorted by distance. A vector starts at one centroid and walks its list; a closer
centroid found there becomes the current one and its list is walked instead. Centroids met once are marked. The walk
ends where the list is strictly beyond twice the current distance: nothing further can be nearer, and nothing
further can tie, so ties are decided exactly (smaller number). A whole Arrow batch walks in step.

Each round is one pass over the table. A task adds up its own vectors and emits clusters * (dimensions + 1) sums at
most, so no cluster, whatever its share of the rows, is ever gathered; the driver gets the sums of the centroids, whose
number is a parameter. Vectors are not shuffled at all.

Defined cases: vectors that are null, of another length, or hold a null or a value that is not finite are left out;
a component beyond 2**27 in size (of the integers) is an error, as distances would not fit a long; rows that repeat, in id
or vector, count each; a null id counts as the empty text where the start is drawn; equal ids are drawn in the order
of their vectors; fewer vectors than clusters give as many clusters as vectors, an empty table gives no rows;
equal centroids leave the later ones empty; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.scratch import Scratch

#: Fixed values of the query: components, their scale, clusters, rounds, and what the start is drawn by.
SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Integers beyond this could overflow a squared distance; vectors that are walked together.
MOST, STEP = 1 << 27, 4096


def integers(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors, and these as integers floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, bool), np.zeros((0, size), np.int64)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = lengths == size
    values = column.filter(pa.array(fit)).flatten()
    x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
    finite = np.isfinite(x).all(axis=1)
    fit[np.flatnonzero(fit)[~finite]] = False
    x = np.floor(x[finite] * scale)
    if x.size and np.abs(x).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} / {scale}; its squared distances do not fit a long")
    return fit, x.astype(np.int64)


class Orchard:
    """Nearest of the centroids by sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = np.asarray(centroids, np.int64)
        self.between = ((self.centroids[:, None] - self.centroids[None]) ** 2).sum(axis=2)
        self.lists = np.argsort(self.between, axis=1, kind="stable")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row of x, and how many distances that took."""
        n, k = len(x), len(self.centroids)
        now, best = np.zeros(n, np.int64), ((x - self.centroids[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at, active, measured = np.zeros(n, np.int64), np.arange(n), n
        while len(active):
            active = active[at[active] < k]
            nearby = self.lists[now[active], at[active]]
            # Squares: beyond twice the distance is beyond four times its square. No rounding; `>` lets ties in.
            on = self.between[now[active], nearby] <= 4 * best[active]
            active, nearby = active[on], nearby[on]
            at[active] += 1
            new = ~seen[active, nearby]
            rows, met = active[new], nearby[new]
            seen[rows, met] = True
            d = ((x[rows] - self.centroids[met]) ** 2).sum(axis=1)
            measured += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (met < now[rows]))
            rows = rows[closer]
            now[rows], best[rows], at[rows] = met[closer], d[closer], 0
        return now, best, measured


def _walk(b: pa.RecordBatch, orchard: Orchard, size: int, scale: int):
    """(rows kept, their integers, clusters, distances) by runs of STEP rows."""
    for lo in range(0, b.num_rows, STEP):
        fit, x = integers(b.column("embedding").slice(lo, STEP), size, scale)
        if len(x):
            yield lo + np.flatnonzero(fit), x, *orchard.nearest(x)[:2]


def start(vectors: DataFrame, clusters: int, seed: str, size: int, scale: int) -> np.ndarray:
    """The kept vectors that come first by the hash of their id."""
    schema = "vec_id long, vector array<long>"

    def run(batches):
        for b in batches:
            fit, x = integers(b.column("embedding"), size, scale)
            flat = pa.array(x.ravel(), pa.int64())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(fit)), rows], names=["vec_id", "vector"])

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.mapInArrow(run, schema).orderBy(drawn, "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in first], np.int64).reshape(len(first), size)


def moved(vectors: DataFrame, centroids: np.ndarray, size: int, scale: int) -> np.ndarray:
    """The centroids after one round: exact floor of the mean of their vectors; an empty one stays."""
    orchard, schema = Orchard(centroids), "cluster int, place int, total long"

    def run(batches):
        sums, counts = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            for _, x, cluster, _ in _walk(b, orchard, size, scale):
                order = np.argsort(cluster, kind="stable")
                heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                sums[cluster[order][heads]] += np.add.reduceat(x[order], heads)
                counts += np.bincount(cluster, minlength=len(centroids))
        full = np.flatnonzero(counts)
        which, place = np.repeat(full, size + 1), np.tile(np.arange(-1, size), len(full))
        total = np.concatenate((counts[full, None], sums[full]), axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(place, pa.int32()), pa.array(total, pa.int64())], names=["cluster", "place", "total"])

    rows = vectors.select("embedding").mapInArrow(run, schema).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(r["cluster"], r["place"]): int(r["total"]) for r in rows}
    out = centroids.copy()
    for c in {c for c, _ in totals}:
        out[c] = [totals[c, i] // totals[c, -1] for i in range(size)]
    return out


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of every vector of (vec_id, embedding)."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = start(vectors, clusters, seed, size, scale)
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, moved(vectors, centroids, size, scale)
        if np.array_equal(before, centroids):  # every further round would give the same
            break
    spark = table.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    orchard = Orchard(centroids)

    def run(batches):
        for b in batches:
            for rows, _, which, distance in _walk(b, orchard, size, scale):
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(which, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = Scratch(spark, "centroid_clustering").save(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    whole = sum(inertia.values())
    each = spark.createDataFrame([(c, d, whole, digest(centroids[c]), centroids[c].tolist()) for c, d in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    # One row for each centroid, whose number is a parameter.
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(C.read(spark, sf_dir, "embeddings")).drop("centroid")


def _oracle() -> str:
    """The rounds written out; every step is materialised, or the plan would double with each of them."""
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"""vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS INTEGER) AS cluster, x FROM vectors
  QUALIFY cluster < {CLUSTERS})"""]
    for r in range(1, ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT arg_min(cluster, (d, cluster)) AS cluster, any_value(x) AS x
  FROM (SELECT v.n, v.x, c.cluster, {near} AS d FROM (SELECT *, row_number() OVER () AS n FROM vectors) v, c{r - 1} c) GROUP BY n),
s{r} AS MATERIALIZED (
  SELECT cluster, i, CAST(sum(e) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT cluster, unnest(x) AS e, unnest(range({SIZE})) AS i FROM a{r}) GROUP BY ALL),
m{r} AS MATERIALIZED (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY cluster),
c{r} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.x, c{r - 1}.x) AS x FROM c{r - 1} LEFT JOIN m{r} USING (cluster))""")
    steps.append(f"""last AS MATERIALIZED (
  SELECT any_value(vec_id) AS vec_id, arg_min(cluster, (d, cluster)) AS cluster, CAST(min(d) AS BIGINT) AS distance
  FROM (SELECT v.n, v.vec_id, c.cluster, {near} AS d FROM (SELECT *, row_number() OVER () AS n FROM vectors) v, c{ROUNDS} c) GROUP BY n)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(x, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} USING (cluster)"""


ORACLE = _oracle()
