"""SuperMinHash near-duplicate grouping of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import link
from .minhash import band_keys, superminhash
from .shared import side, stage
from .text import binary, chunks, column, lists, set_digest, shingle_sets

BANDS, ROWS = 24, 6  # a pair at 0.85 collides nowhere with probability 1.2e-5


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id")
            for c in chunks(column(batch, "body")):
                values, offsets = shingle_sets(c, width)
                high, low = set_digest(values, offsets)
                keys = band_keys(superminhash(values, offsets, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids[c.rows], pa.array(np.diff(offsets)), pa.array(high), pa.array(low), lists(keys)],
                    ["id", "n", "high", "low", "keys"],
                )

    return docs.mapInArrow(run, "id long, n long, high long, low long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id")
            for c in chunks(column(batch, "body")):
                yield pa.RecordBatch.from_arrays([ids[c.rows], column(batch, "leader")[c.rows], binary(*shingle_sets(c, width))], ["id", "leader", "hashes"])

    return docs.mapInArrow(run, "id long, leader long, hashes binary")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    A row's set is its distinct ``width``-word shingles (fewer words: the whole sequence; null or blank text: empty and
    linked with nothing). Rows link at a Jaccard of ``percent`` hundredths or more. Equal sets are grouped first, by a
    128-bit digest; one row of each goes on to banding, verification on full sets and union-find.
    Rows that repeat an id are each grouped by their own set, and may join their groups. A row with a null id is linked with
    nothing: its component is null and it is kept. Other columns are not read.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("body"))
    signed = stage(_signed(docs, width, bands, rows), "signed")
    classes = stage(signed.where("n > 0 and id is not null").groupBy("high", "low").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("n").alias("n")), "classes")
    found = link(classes.select(F.col("first").alias("id"), "n", "keys"), lambda led: _sets(docs.join(side(stage(led, "led")), "id"), width), percent=percent)
    labels = stage(classes.select("high", "low", "first").join(found.withColumnRenamed("id", "first"), "first", "left").select("high", "low", F.coalesce("component", "first").alias("component")), "labels")
    return (
        signed.select("id", "n", "high", "low").join(labels, ["high", "low"], "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op3_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
