"""Word counts per row, and ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage
from .text import chunks, column, word_bounds


def with_word_counts(df: DataFrame, text_column: str, name: str) -> DataFrame:
    """``df`` with the text column replaced by its number of words (null: 0), as long ``name``."""
    kept = [f for f in df.schema if f.name != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(word_bounds(c)[2]) for c in chunks(column(batch, text_column))]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, f.name) for f in kept] + [pa.array(total.astype(np.int64))], [f.name for f in kept] + [name])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row within its ``keys``, in ``order``.

    Rows are range-partitioned by keys and order, so a hot group is spread over many tasks; each task numbers the runs of
    equal keys it sees. A run that goes on from the task before gets that task's count on top; those offsets are one
    row for each partition, found on the driver from one summary row for each partition.
    """
    sort = [*(F.col(k).asc_nulls_last() for k in keys), *order]
    spread = df.withColumn("__key", F.xxhash64(*keys, *(F.col(k).isNull() for k in keys))).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, rows = None, 0, 0
        for batch in batches:
            key = column(batch, "__key").to_numpy(zero_copy_only=False)
            n = len(key)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is None or key[0] != last
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(begin < 0, at + seen + 1, at - begin + 1)
            last, seen = key[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64)), pa.array(at + rows)], [*batch.schema.names, "__place", "__row"])
            rows += n

    schema = T.StructType([*spread.schema, T.StructField("__place", T.LongType()), T.StructField("__row", T.LongType())])
    numbered = stage(spread.mapInArrow(run, schema), "ranked")
    summary = numbered.groupBy("__part").agg(F.min_by("__key", "__row").alias("first"), F.max_by("__key", "__row").alias("last"), F.max_by("__place", "__row").alias("tail"), F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    offsets, before, carried = [], None, 0
    for part in summary:
        more = carried if before == part["first"] else 0
        offsets.append((part["__part"], part["first"], more))
        carried = part["tail"] + (more if part["tail"] == part["n"] else 0)
        before = part["last"]
    table = df.sparkSession.createDataFrame(offsets, "__part int, __first long, __more long")
    more = F.when(F.col("__key") == F.col("__first"), F.col("__more")).otherwise(0)
    return numbered.join(F.broadcast(table), "__part").withColumn(name, F.col("__place") + more).drop("__part", "__key", "__place", "__row", "__first", "__more")
