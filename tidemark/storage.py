"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


class _Open(threading.local):
    """The scratch blocks that this thread is in, innermost last, with what was staged in each."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a local folder if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_FOLDER).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing,
    and joins on the result get plain exchanges that AQE can split when a key is hot."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if _open.blocks:
        _open.blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete what was written under ``paths``."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted at the end, so no DataFrame that outlives the block may read them, but for those staged
    by the function given, which belong to the block around this one."""
    own: list[str] = []
    outer = _open.blocks[-1] if _open.blocks else None
    _open.blocks.append(own)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        kept = stage(df, tag)
        path = own.pop()
        if outer is not None:
            outer.append(path)
        return kept

    try:
        yield keep
    finally:
        _open.blocks.pop()
        drop(spark, own)
