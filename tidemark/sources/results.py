"""The results table kept at one row for each result: upserts rewrite the strategies they touch, and writers notice each other."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..storage import scratch, stage

KEY = ("strategy", "result_id")


class ConcurrentWrite(RuntimeError):
    """Another writer is at work on the table, or was when this one began. Nothing was changed."""


class _Commits:
    """Numbered marks beside the table: ``<n>`` is made by the writer that goes n-th, ``<n>.done`` when its rows are there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.root = spark._jvm, self._at(spark, f"{path}/_commits")
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def _at(spark: SparkSession, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path)

    def last(self, stale_after: float) -> int:
        """The last commit's number. An error while it isn't done, unless its mark is older than ``stale_after`` seconds: its writer is gone."""
        if not self.fs.exists(self.root):
            return 0
        marks = {x.getPath().getName(): x.getModificationTime() for x in self.fs.listStatus(self.root)}
        n = max((int(m) for m in marks if m.isdigit()), default=0)
        if n and f"{n}.done" not in marks and time.time() - marks[str(n)] / 1000 < stale_after:
            raise ConcurrentWrite(f"commit {n} is not done")
        return n

    def _make(self, name: str) -> bool:
        return self.fs.createNewFile(self.jvm.org.apache.hadoop.fs.Path(self.root, name))

    def claim(self, n: int) -> None:
        self.fs.mkdirs(self.root)
        if not self._make(str(n)):
            raise ConcurrentWrite(f"commit {n} was made by another writer")

    def done(self, n: int) -> None:
        self._make(f"{n}.done")


def upsert_results(results: DataFrame, path: str, *, order: str = "saved_at", stale_after: float = 3600.0) -> int:
    """Puts ``results(strategy, result_id, <order>, ...)`` in the table at ``path``: of an id the last by ``order`` stays, one row.

    Only the partitions of strategies that ``results`` has are read and written, by a dynamic overwrite, so older rows of the same
    ids are gone for good and a read ranks nothing. Of ids that come several times, and against the row that is there, the greatest
    ``order`` wins, the new one if equal. Columns that one side lacks are NULL there. A writer that finds another one at work, or that
    another one overtook since it read, raises ``ConcurrentWrite`` and changes nothing. The table must be of a store whose files are made
    exclusively (HDFS, local and most object stores' connectors). Gives the commit's number.
    """
    spark = results.sparkSession
    commits = _Commits(spark, path)
    seen = commits.last(stale_after)
    with scratch(spark):
        new = stage(results, "upsert")
        try:
            old = spark.read.parquet(path).join(new.select("strategy").distinct(), "strategy", "left_semi")
            both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        except AnalysisException:
            if seen:
                raise
            both = new.withColumn("__new", F.lit(1))  # the first rows
        last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col(order).desc_nulls_last(), F.col("__new").desc()))
        merged = stage(both.withColumn("__last", last).where("__last = 1").drop("__last", "__new"), "merged")
        commits.claim(seen + 1)
        merged.repartition("strategy").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)
        commits.done(seen + 1)
    return seen + 1


def stored_results(spark: SparkSession, path: str, *, strategy: str | None = None) -> DataFrame:
    """All results of a table that only ``upsert_results`` writes, or a strategy's."""
    found = spark.read.parquet(path)
    return found if strategy is None else found.where(F.col("strategy") == strategy)
