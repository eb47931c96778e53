"""Runs that redo only what changed: a table by partition with a manifest of its input, and a cache of rows by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from spanloom.scratch import Scratch
from spanloom.streaming.ledgers import reuse

DIGEST = "_digest"


def part_digests(rows: DataFrame, part: str, salt: str = "") -> DataFrame:
    """part, digest: of the rows of each partition, whatever their order; repeated rows count. Sums are made before the exchange."""
    h = F.xxhash64(*[c for c in rows.columns if c != part])
    of = rows.select(part, h.alias("_h"), F.xxhash64(h, F.lit(1)).alias("_g")).groupBy(part)
    got = of.agg(F.count("*").alias("_n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"), F.bit_xor("_g").alias("_x"))
    return got.select(part, F.sha2(F.concat_ws(":", F.lit(salt), *[F.col(c).cast("string") for c in ("_n", "_s", "_x")]), 256).alias("digest"))


class Stage:
    """A stage of a job: root/table by partition, root/manifest with the digest of the input each partition was made from.

    A partition whose input digest is recorded under the same metadata (a producer's revision, say) is left alone.
    Others are computed from their rows only and overwrite their own folders; the manifest is appended last, and rows count
    only under the digest it names. So a run that dies in between leaves partitions that the next run makes again, and a partition
    whose input is gone, or gives no rows, is empty. One run at a time; null partitions are one partition.
    """

    def __init__(self, spark: SparkSession, root: str, part: str, schema: str, metadata: str = "") -> None:
        self.spark, self.root, self.part, self.metadata = spark, root.rstrip("/"), part, metadata
        self.schema = StructType.fromDDL(schema)
        self._records = StructType([self.schema[part]]).add("digest", StringType()).add("run", "long")

    def _there(self, name: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return f"{self.root}/{name}"

    def manifest(self) -> DataFrame:
        """part, digest, run: the last record of each partition; digest is null where the input is gone."""
        rows = self.spark.read.schema(self._records).parquet(self._there("manifest"))
        return rows.groupBy(self.part).agg(F.max_by(F.struct("digest", "run"), "run").alias("r")).select(self.part, "r.*")

    def outcomes(self, rows: DataFrame) -> DataFrame:
        """part, digest, outcome of a further run: hit, stale (other input or metadata), miss (new), gone."""
        now = part_digests(rows, self.part, self.metadata).withColumn("_now", F.lit(True))
        have = self.manifest().select(F.col(self.part).alias("_part"), F.col("digest").alias("_have"), F.lit(True).alias("_known"))
        met = now.join(have, now[self.part].eqNullSafe(have["_part"]), "full")
        outcome = F.when(F.col("_now").isNull(), F.when(F.col("_have").isNotNull(), "gone")).when(F.col("_have").isNull(), "miss").when(F.col("_have") == F.col("digest"), "hit").otherwise("stale")
        named = met.select(F.when(F.col("_now").isNull(), F.col("_part")).otherwise(F.col(self.part)).alias(self.part), "digest", outcome.alias("outcome"))
        return named.where("outcome is not null")

    def run(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Bring the table up to date with rows; compute maps rows of some partitions to their part of the table. Gives the outcomes."""
        scratch = Scratch(self.spark, "stage")
        state = scratch.save(self.outcomes(rows), "outcomes")
        number = (self.manifest().agg(F.max("run")).first()[0] or 0) + 1
        todo = state.where("outcome in ('stale', 'miss')").select(F.col(self.part).alias("_part"), F.col("digest").alias(DIGEST))
        if not todo.isEmpty():
            made = compute(rows.join(todo, rows[self.part].eqNullSafe(todo["_part"]), "left_semi"))
            made = made.join(todo, made[self.part].eqNullSafe(todo["_part"])).select(*self.schema.names, DIGEST)
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self._there("table"))
        record = state.where("outcome <> 'hit'").select(self.part, "digest", F.lit(number).cast("long").alias("run"))
        record.coalesce(1).write.mode("append").parquet(self._there("manifest"))
        return state

    def table(self) -> DataFrame:
        """The rows of all partitions as of the last run."""
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add(DIGEST, StringType())).parquet(self._there("table"))
        now = self.manifest().where("digest is not null").select(F.col(self.part).alias("_part"), F.col("digest").alias("_now"))
        return rows.join(now, rows[self.part].eqNullSafe(now["_part"]) & (rows[DIGEST] == now["_now"]), "left_semi").select(*self.schema.names)


class Cache:
    """Derived rows by key and content: root/rows holds what was computed, and nothing is computed twice for one digest.

    schema: of the derived columns. Rows are appended; a changed source adds a row under its new digest and leaves the old
    one, which serves again should the source return. Keys are not null and, with the digest, name one row of what is wanted.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], digest: str, schema: str) -> None:
        self.spark, self.root, self.keys, self.digest, self.schema = spark, f"{root.rstrip('/')}/rows", keys, digest, StructType.fromDDL(schema)

    def stored(self, like: DataFrame) -> DataFrame:
        """keys, digest and derived columns of all that was computed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return self.spark.read.schema(StructType([*(like.schema[c] for c in (*self.keys, self.digest)), *self.schema.fields])).parquet(self.root)

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """wanted with outcome (hit, stale, miss, as found) and the derived columns; compute gets the rows that are no hits and adds these."""
        names = [*self.keys, self.digest]
        state = Scratch(self.spark, "cache").save(reuse(wanted.select(*names), self.stored(wanted), self.keys, self.digest), "state")
        fresh = wanted.join(state.where("outcome <> 'hit'"), names, "left_semi")
        compute(fresh).select(*names, *self.schema.names).write.mode("append").parquet(self.root)
        return wanted.join(state, names).join(self.stored(wanted), names)
