"""A panel that grows by batches: a batch reads the state that earlier ones left for each asset, never their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.elementwise import EPSILON
from ..operators.axes import Series
from ..operators.scan import Channel, scanned_on
from ..storage import scratch

VERSION = "__version"
STATED = {"__total": "total", "__n": "n"}  # channels under the names that states have for them
KINDS = ("rolling_mean", "rolling_std", "cumsum", "ema", "rsi")


class IncrementalPanel:
    """Rows and running computations in ``path``: ``rows/`` by version, and in ``state/`` one row for each asset and version.

    ``computes`` names each computation, e.g. ``{"m": ("rolling_mean", 20), "e": ("ema", 20), "t": ("cumsum",), "r": ("rsi", 14)}``, over
    ``column``, where NULL and NaN count as 0. Appending in parts gives what one pass over all rows gives, if no part holds rows of an
    asset from before the parts appended already; rows that come late count in the order of the parts. A version is there once its state
    is: a batch that failed midway is written anew, one that is there already is left alone, so a stream may replay batches.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, computes: dict[str, tuple], s: Series = Series()) -> None:
        unknown = {kind for kind, *_ in computes.values()} - set(KINDS)
        if unknown:
            raise ValueError(f"unknown computations: {sorted(unknown)}")
        self.spark, self.path, self.column, self.computes, self.s = spark, path.rstrip("/"), column, computes, s
        self.windows = tuple(sorted({args[0] for kind, *args in computes.values() if kind.startswith("rolling")}))
        self.width = max(self.windows, default=1)

    def _channels(self) -> dict[str, Channel]:
        found: dict[str, Channel] = {"__total": ("sum", 1.0), "__n": ("count", 1.0)}
        for kind, *args in self.computes.values():
            if kind == "ema":
                found[f"__x{args[0]}"] = ("x", 2.0 / (args[0] + 1))
            if kind == "rsi":
                found |= {f"__{k}{args[0]}": (k, 1.0 / args[0]) for k in ("gain", "loss")}
        return found

    def versions(self) -> list[int]:
        """Those that are whole, ascending."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [x.getPath() for x in fs.listStatus(at)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{VERSION}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def state(self) -> DataFrame | None:
        """A row for each asset as of the last version; of earlier states only the one before is kept."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/state/{VERSION}={found[-1]}") if found else None

    def rows(self) -> DataFrame:
        """All rows appended, with their computations."""
        found = self.versions()
        if not found:
            raise ValueError(f"nothing was appended to {self.path}")
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/{VERSION}={v}" for v in found)).drop(VERSION)

    def initialize(self, df: DataFrame) -> None:
        """The first rows. An error if there are some."""
        if self.versions():
            raise ValueError(f"{self.path} has rows already")
        self.append(df, 0)

    def append(self, df: DataFrame, version: int | None = None) -> None:
        """Rows of the first append's columns; ``version`` is the next one by default."""
        found = self.versions()
        version = (found[-1] + 1 if found else 0) if version is None else version
        if version in found:
            return
        if found and version < found[-1]:
            raise ValueError(f"version {version} comes after {found[-1]}")
        before = self.state()
        with scratch(self.spark):
            told = self._computed(df, before)
            told.where("__row").select(*df.columns, *self.computes).write.mode("overwrite").parquet(f"{self.path}/rows/{VERSION}={version}")
            self._next_state(told).write.mode("overwrite").parquet(f"{self.path}/state/{VERSION}={version}")
        self._forget(found[:-1])

    def _forget(self, versions: list[int]) -> None:
        """Empties states: their folders stay as marks of whole versions."""
        for version in versions:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/{VERSION}={version}")
            fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for file in fs.listStatus(at):
                if file.getPath().getName().startswith("part-"):
                    fs.delete(file.getPath(), False)

    def _computed(self, df: DataFrame, before: DataFrame | None) -> DataFrame:
        """The rows with all computations, and the states before and after them, by one sort of both."""
        before = before and before.withColumnsRenamed({k: c for c, k in STATED.items()})
        told = scanned_on(df, self.column, self.s, self._channels(), self.windows, self.width, before)
        return told.withColumns({name: self._one(kind, *args) for name, (kind, *args) in self.computes.items()})

    @staticmethod
    def _one(kind: str, n: int = 0) -> Column:
        if kind == "cumsum":
            return F.col("__total")
        if kind == "ema":
            return F.col(f"__x{n}")
        if kind == "rsi":
            gain, loss = F.col(f"__gain{n}"), F.col(f"__loss{n}")
            return F.when(loss > EPSILON, 100.0 - 100.0 / (1.0 + gain / loss)).when(gain > EPSILON, 100.0).otherwise(50.0)
        return F.col(f"__mean_{n}" if kind == "rolling_mean" else f"__std_{n}")

    def _next_state(self, told: DataFrame) -> DataFrame:
        kept = {"tail": "__tail", "last": "__x", **{STATED.get(c, c): c for c in self._channels()}}
        ends = told.where("__end").groupBy(F.col(self.s.asset).alias("asset")).agg(F.max_by(F.struct(*(F.col(c).alias(k) for k, c in kept.items())), F.struct("__block", "__place")).alias("end"))
        return ends.select("asset", *(f"end.{k}" for k in kept)).withColumn("n", F.col("n").cast("long"))

    def stream(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Appends what the stream has, batch by batch, and ends; a later call with the same checkpoint goes on."""
        return source.writeStream.foreachBatch(lambda batch, i: self.append(batch, i + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

