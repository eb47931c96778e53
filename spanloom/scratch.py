"""Tables written between the steps of an operator, in the folder the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a step's shuffle files when its statement ends; nothing reads them once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A written table cuts lineage: a lost executor costs the tasks it ran, not the steps before.

    Where spark.checkpoint.dir is unset, a local session gets a temporary folder, and a cluster an error: its
    executors could not read what others wrote. The folder goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="spanloom-")
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        folder = self._path("")
        self._files(folder).mkdirs(folder)
        self._files(folder).deleteOnExit(folder)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """df, written and read again: what comes after it does not repeat what came before."""
        self.n += 1
        path, before = f"{self.root}/{name or self.n}", self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            path = self._path(str(name))
            self._files(path).delete(path, True)
