"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

1. One pass over the texts hashes the distinct word shingles of each, takes MinHash values, folds them into an
   odd sketch (a bitmap of parities) and combines them into band keys.
2. Texts with equal shingle sets are one class from here on, so exact copies never meet each other.
3. Classes that share a band key are compared by sketch: the population count of the XOR of two sketches
   estimates their similarity closely where it is high. Buckets are cut into blocks; a block is compared within
   itself and with a few rows that all blocks get, and what is then still outside the largest component of its
   bucket is compared with the whole bucket. What leaves a task is a spanning forest, never all pairs.
4. The components of those forests are candidate clusters. The members' texts come to their cluster (compared
   in blocks in the same way) and similarities are computed on full shingle sets. Again only a spanning
   forest of confirmed links leaves a task; its components are the result.

A pair at the threshold shares no band with probability `MISS` at most, and sketches are given 0.2 of slack,
over five standard deviations. Everything after that is exact.

Defined cases: null and empty texts have no shingles and are linked with nothing; a null id is linked with
nothing, has no component and is kept; rows with one id count as one document; the smallest id names a
component, so there are no ties; a very long text is hashed whole, as one array of its task; an empty table gives
no rows; `groups` reads id and text only, `keep_one` carries columns of any name along.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.operators.graph import components
from spanloom.scratch import Scratch

ROWS, MISS = 5, 1e-5
SKETCH_BITS, SLACK = 512, 0.2
SKETCH_BLOCK, TEXT_BLOCK = 1024, 256


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and where each text's begin. Fewer words than `size`: all of them as one."""
    starts, _, bounds = C.words(data, at)
    hashes = C.span_hashes(data, starts, C.FOLDED_KEYS)
    where = C.starts_in_rows(bounds, size)
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
    values = C.grams(hashes, size)[where] if len(where) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        alone = np.array([C.grams(hashes[bounds[i] : bounds[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        rows = np.concatenate((rows, short))
        values = np.concatenate((values, C.mix(alone + C.GRAM_KEYS[40 + counts[short] % 20])))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[fresh], values[fresh]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set digests (n, 2), band keys (n, bands), sketches (n, SKETCH_BITS / 64)) of non-empty sets; rows of empty sets are 0."""
    n = len(bounds) - 1
    digest, keys, sketch = np.zeros((n, 2), np.uint64), np.zeros((n, bands), np.uint64), np.zeros((n, SKETCH_BITS // 64), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return digest, keys, sketch
    cut = bounds[full]
    digest[full, 0] = np.add.reduceat(C.mix(values), cut)
    digest[full, 1] = np.add.reduceat(C.mix(values ^ C.GRAM_KEYS[1]), cut)
    rng = np.random.default_rng(77)
    turns = rng.integers(1, 1 << 64, (2, bands * ROWS), np.uint64) | np.uint64(1)
    bits = np.zeros((len(full), SKETCH_BITS), np.uint8)
    for band in range(bands):
        total = np.zeros(len(full), np.uint64)
        for r in range(ROWS):
            k = band * ROWS + r
            least = np.minimum.reduceat((values ^ turns[0, k]) * turns[1, k], cut)
            total += C.mix(least) * C.GRAM_KEYS[r]
            bits[np.arange(len(full)), (C.mix(least + turns[0, k]) % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
        keys[full, band] = C.mix(total + np.uint64(band))
    sketch[full] = np.packbits(bits, axis=1).view(np.uint64)
    return digest, keys, sketch


def similarity(distance: np.ndarray, samples: int) -> np.ndarray:
    """Estimated Jaccard similarity of two sets whose odd sketches differ in so many bits."""
    share = np.minimum(2 * distance / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / (4 * samples) * np.log1p(-share)


def may_link(sizes: np.ndarray, sketches: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, samples: int) -> np.ndarray:
    """For index pairs (a, b): do sizes and sketches leave a link possible?"""
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    ok = small >= threshold * large
    distance = np.bitwise_count(sketches[a] ^ sketches[b]).sum(-1)
    return ok & (similarity(distance, samples) >= threshold - SLACK)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    free, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            for v in np.flatnonzero(linked[u] & free).tolist():
                free[v] = False
                out.append((u, v))
                queue.append(v)
    return out


FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def features(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    bands = bands_for(threshold)

    def run(batches):
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("text")):
                values, bounds = shingle_sets(data, at, size)
                digest, keys, sketch = signatures(values, bounds, bands)
                signed = digest.view(np.int64)
                offsets = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[lo:hi],
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(signed[:, 0]),
                        pa.array(signed[:, 1]),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def first_cells(members: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """members of (key, node, n_members) with `cells`: every row lies in one block of its group, and about block / 8 rows of a large group lie in all."""
    blocks = F.ceil(F.col("n_members") / block).cast("int")
    own = F.pmod(F.xxhash64(node, key), blocks).cast("int")
    everywhere = F.pmod(F.xxhash64(key, node, F.lit("everywhere")), F.col("n_members")) < block // 8
    parts = F.when(everywhere, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return members.withColumn("cells", F.transform(parts, lambda p: F.struct(p.alias("p"), F.lit(0).alias("q"))))


def other_cells(members: DataFrame, found: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """The rows of large groups that are still to be compared, with `cells`: rows outside the largest component of
    their group (found: node, component) meet all rows of it. What is inside that component is linked already."""
    large = members.where(F.col("n_members") > block)
    large = large.join(found.withColumnRenamed("node", node), node, "left").withColumn("_c", F.coalesce("component", node)).drop("component")
    top = large.groupBy(key, "_c").agg(F.count("*").alias("_n")).groupBy(key).agg(F.max(F.struct("_n", "_c")).alias("_top"))
    open_rows = large.join(top, key).withColumn("_others", F.col("n_members") - F.col("_top._n")).where("_others > 0")
    rows, cols = (F.ceil(F.col(n) / block).cast("int") for n in ("_others", "n_members"))
    row, col = F.pmod(F.xxhash64(node, key), rows).cast("int"), F.pmod(F.xxhash64(key, node), cols).cast("int")

    def cell(p, q):
        return F.struct(p.alias("p"), q.alias("q"))

    # A row on both sides comes once to the cell where it would meet itself.
    along = F.transform(F.sequence(F.lit(0), cols - 1), lambda q: cell(row, q))
    across = F.transform(F.sequence(F.lit(0), rows - 1), lambda p: cell(p, col))
    outside = F.col("_c") != F.col("_top._c")
    cells = F.when(outside, F.concat(along, F.filter(across, lambda c: c["p"] != row))).otherwise(across)
    return open_rows.select(*members.columns, cells.alias("cells"))


def in_cells(rows: DataFrame, key: str, node: str) -> DataFrame:
    """Each row in all its cells, cells whole and sorted in one task."""
    spread = rows.withColumn("_c", F.explode("cells")).select(*[c for c in rows.columns if c not in ("cells", "n_members")], "_c.p", "_c.q")
    return spread.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", node)


def linked_components(members: DataFrame, key: str, node: str, block: int, links, scratch: Scratch, name: str) -> DataFrame:
    """node and component over the links inside groups; members: key, node, n_members; links: a function from rows with cells to edges.

    Blocks of a group are compared within themselves and with a few rows that all blocks get; what this leaves
    apart is compared with the whole group. A group of N copies of one text is linked by the first step, so it
    costs about N rows, not N * N / block; no pair of different components is left out.
    """
    once = components(links(first_cells(members, key, node, block)))
    once = scratch.save(once, f"{name}_once")
    rest = links(other_cells(members, once, key, node, block))
    return components(once.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest))


def _edges(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def sketch_forests(members: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) between classes of one cell that may link; members: bucket, rep, n_shingles, sketch, cells."""
    samples = bands_for(threshold) * ROWS

    def run(batches):
        for table, starts in C.groups_of(batches, ["bucket", "p", "q"]):
            reps = table.column("rep").to_numpy()
            sizes = table.column("n_shingles").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(reps), -1)
            counts = np.diff(starts)
            for m in np.unique(counts[counts > 1]):
                first = starts[:-1][counts == m]
                if m <= 16:  # all groups of one size at a time
                    i, j = np.triu_indices(m, 1)
                    a, b = (first[:, None] + i).reshape(-1), (first[:, None] + j).reshape(-1)
                    ok = may_link(sizes, sketches, a, b, threshold, samples)
                    if m == 2:
                        yield _edges(reps[a[ok]], reps[b[ok]])
                        continue
                    picked = []
                    matrix = np.zeros((len(first), m, m), bool)
                    matrix[:, i, j] = matrix[:, j, i] = ok.reshape(len(first), -1)
                    for g in np.flatnonzero(matrix.any((1, 2))):
                        picked += [(first[g] + x, first[g] + y) for x, y in forest(matrix[g])]
                    if picked:
                        x, y = np.array(picked).T
                        yield _edges(reps[x], reps[y])
                    continue
                for f in first:
                    own = np.arange(f, f + m)
                    matrix = np.stack([may_link(sizes, sketches, np.full(m, r), own, threshold, samples) for r in own])
                    np.fill_diagonal(matrix, False)
                    tree = np.array(forest(matrix), np.int64).reshape(-1, 2) + f
                    yield _edges(reps[tree[:, 0]], reps[tree[:, 1]])

    return in_cells(members, "bucket", "rep").mapInArrow(run, "u long, v long").distinct()


def exact_links(values: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of 100 * |A and B| >= percent * |A or B| for the sets of one group."""
    m, sizes = len(bounds) - 1, np.diff(bounds)
    unique, which, times = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[which] > 1
    rows, cols = np.repeat(np.arange(m), sizes)[shared], column[which[shared]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    both = np.zeros((m, m))
    width = max(64, 4_000_000 // m)
    for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, [lo, lo + width])
        part = np.zeros((m, width), np.float32)
        part[rows[a:b], cols[a:b] - lo] = 1
        both += part @ part.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= (sizes[:, None] > 0) & (sizes[None, :] > 0)
    np.fill_diagonal(linked, False)
    return linked


def exact_forests(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (u, v), a spanning forest for each cell; members: cluster, node, text, cells."""

    def run(batches):
        for table, starts in C.groups_of(batches, ["cluster", "p", "q"]):
            nodes = table.column("node").to_numpy()
            u, v = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s < 2:
                    continue
                values, bounds, at = [], [0], 0
                for _, _, data, rows in C.chunks(table.column("text").slice(s, e - s)):
                    got, edge = shingle_sets(data, rows, size)
                    values.append(got)
                    bounds += (edge[1:] + at).tolist()
                    at += len(got)
                tree = forest(exact_links(np.concatenate(values), np.array(bounds), percent))
                u += [nodes[s + a] for a, _ in tree]
                v += [nodes[s + b] for _, b in tree]
            yield _edges(u, v)

    return in_cells(members, "cluster", "node").mapInArrow(run, "u long, v long").distinct()


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: links have 100 * intersection >= percent * union."""
    spark, threshold = docs.sparkSession, percent / 100
    scratch = Scratch(spark, "near_dedup")
    feats = scratch.save(features(docs, size, threshold), "features")
    named = feats.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes, "classes")

    banded = classes.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("bucket"))
    counts = banded.groupBy("bucket").agg(F.count("*").alias("n_members")).where("n_members > 1")
    members = scratch.save(banded.join(counts, "bucket"), "members")
    sketches = classes.select("rep", "n_shingles", "sketch")
    maybe = linked_components(members, "bucket", "rep", SKETCH_BLOCK, lambda rows: sketch_forests(rows.join(sketches, "rep"), threshold), scratch, "maybe")
    clusters = scratch.save(maybe.select("node", F.col("component").alias("cluster")), "nodes")

    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n_members")), "cluster")
    # One join strategy at every size: how much moves then follows the input.
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    links = linked_components(sized, "cluster", "node", TEXT_BLOCK, lambda rows: exact_forests(texts.join(rows.hint("merge"), "node"), size, percent), scratch, "links")
    links = scratch.save(links, "links")

    by_class = classes.select("d1", "d2", "n_shingles", "rep").join(links.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("_component"))
    plain = feats.select("doc_id", "n_shingles", "d1", "d2")
    none = plain.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    some = plain.where("n_shingles > 0 and doc_id is not null").join(by_class, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", F.col("_component").alias("component_id"))
    out = some.unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the smallest id of each group; of rows with that id all stay."""
    gone = groups(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op5(spark, sf_dir: str) -> DataFrame:
    return groups(C.read(spark, sf_dir, "documents"), size=3, percent=85)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
runs AS (
  SELECT doc_id, CASE WHEN n >= 3 THEN word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w
    WHEN pos = 0 THEN concat_ws(' ', word, lead(word, 1) OVER w) END AS shingle
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sets AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE shingle IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM met JOIN sizes a ON u = a.doc_id JOIN sizes b ON v = b.doc_id WHERE 100 * met.n >= 85 * (a.n + b.n - met.n)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sizes
  UNION
  SELECT reach.u, b.v FROM reach JOIN both_ways b ON reach.v = b.u),
classes AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (doc_id)
"""
