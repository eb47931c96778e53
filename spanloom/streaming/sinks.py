"""A sink that a stream may repeat: several tables of a batch and, last, the record that commits them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS, STAGED = "_commits", "_staged"
RECORD = "name string, n long, run string, batch long"


class Delivery:
    """For foreachBatch: each table is a function of the batch, written to root/<table>/run=<query>/batch=<id>.

    A batch is there when its commit record is: that is written beside, and renamed into place after all tables.
    A batch that comes again after its commit changes nothing; one that was cut short is written anew. The run is the
    query's own id, which a restart from its checkpoint keeps and a query with a new checkpoint does not share.
    """

    def __init__(self, root: str, tables: dict[str, Callable[[DataFrame], DataFrame]], form: str = "parquet") -> None:
        self.root, self.tables, self.form = root.rstrip("/"), tables, form

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "static"
        place, done = f"run={run}/batch={batch_id}", f"{COMMITS}/run={run}/batch={batch_id}"
        if self._exists(spark, done):
            return
        batch.persist()  # every table reads it
        try:
            counts = []
            for name, make in self.tables.items():
                path = f"{self.root}/{name}/{place}"
                rows = make(batch)
                rows.write.mode("overwrite").format(self.form).save(path)
                counts.append((name, spark.read.schema(rows.schema).format(self.form).load(path).count()))
            spark.createDataFrame(counts, "name string, n long").coalesce(1).write.mode("overwrite").json(f"{self.root}/{STAGED}/{place}")
            self._rename(spark, f"{STAGED}/{place}", done)
        finally:
            batch.unpersist()

    def _path(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _exists(self, spark: SparkSession, name: str) -> bool:
        files, path = self._path(spark, name)
        return files.exists(path)

    def _rename(self, spark: SparkSession, name: str, to: str) -> None:
        files, source = self._path(spark, name)
        _, target = self._path(spark, to)
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"{source} could not be renamed to {target}")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """name, n, run, batch of every table of every committed batch; n: rows."""
    return spark.read.schema(RECORD).json(f"{root.rstrip('/')}/{COMMITS}")


def delivered(spark: SparkSession, root: str, name: str, schema, form: str = "parquet") -> DataFrame:
    """The rows of a table that committed batches hold. The list of batches is small: one row each."""
    from pyspark.sql.types import LongType, StringType, StructType

    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*fields.fields]).add("run", StringType()).add("batch", LongType())
    rows = spark.read.schema(whole).format(form).load(f"{root.rstrip('/')}/{name}")
    done = committed(spark, root).where(F.col("name") == name).select("run", "batch")
    return rows.join(done, ["run", "batch"], "left_semi").select(*fields.names)
