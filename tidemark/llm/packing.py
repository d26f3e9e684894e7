"""Optimal length buckets with token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import ranked, with_word_counts
from .shared import stage

BUCKETS = 16
BUDGET = 32_768


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket bounds, at most ``buckets``, with the least padding for a histogram of ascending ``lengths``."""
    n = len(lengths)
    if n == 0:
        return []
    c = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    t = np.concatenate(([0], np.cumsum(counts * lengths))).astype(np.int64)
    cost = np.full(n + 1, 1 << 62, np.int64)
    cost[0] = 0
    cut = []
    for _ in range(min(buckets, n)):
        cost, back = _one_more(cost, lengths, c, t)
        cut.append(back)
    bounds, j = [], n
    for back in reversed(cut):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(back[j])
    return bounds[::-1]


def _one_more(cost: np.ndarray, lengths: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least padding of the first j lengths with one bucket more, which ends at length j, and where it begins.

    The longer the prefix, the later its last bucket begins at best. So a range's middle is solved first and halves the choice for
    both sides; all ranges of a level are worked through together, which takes O(n log n) for each bucket.
    """
    n = len(lengths)
    new, back = np.full(n + 1, 1 << 62, np.int64), np.zeros(n + 1, np.int64)
    new[0] = 0
    low, high, least, most = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(low):
        j = (low + high) // 2
        width = np.minimum(most, j - 1) - least + 1
        starts = np.cumsum(width) - width
        i = np.arange(width.sum()) - np.repeat(starts - least, width)
        end = np.repeat(j, width)
        tried = cost[i] + lengths[end - 1] * (c[end] - c[i]) - (t[end] - t[i])
        new[j] = np.minimum.reduceat(tried, starts)
        hits = np.flatnonzero(tried == new[end])
        back[j] = i[hits[np.searchsorted(hits, starts)]]
        low, high, least, most = np.concatenate((low, j + 1)), np.concatenate((j - 1, high)), np.concatenate((least, back[j])), np.concatenate((back[j], most))
        some = low <= high
        low, high, least, most = low[some], high[some], least[some], most[some]
    return new, back


def pack(lengths: DataFrame, *, id_column: str = "doc_id", length_column: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 29) -> DataFrame:
    """``(doc_id, n_tokens, bucket, bucket_len, batch, slot)`` for each row of a table of lengths.

    Every row is padded to its bucket's length, the least bound that holds it. Bounds minimise the padding of the whole
    table: the dynamic programme sees the exact histogram of all rows, one row for each distinct length. A batch of a bucket holds
    floor(budget / bucket_len) rows (at least one), in seeded order; each bucket's last batch may hold fewer. ``batch``
    counts from 0 in its bucket, ``slot`` from 0 in its batch. Null lengths count as 0, rows longer than the budget stand alone in their
    batches, rows that repeat an id or have none are rows like others; an empty table gives no rows. Other columns are not read.
    """
    narrow = stage(lengths.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(length_column), F.lit(0)).cast("long").alias("n_tokens")), "lengths")
    histogram = narrow.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toPandas()  # a row for each length, far fewer than texts
    bounds = best_bounds(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    bucket = F.lit(len(bounds) - 1)
    for i, bound in reversed(list(enumerate(bounds[:-1]))):
        bucket = F.when(F.col("n_tokens") <= bound, i).otherwise(bucket)
    bucket_len = F.element_at(F.array(*(F.lit(b) for b in bounds or [0])), F.col("bucket") + 1).cast("long")
    placed = ranked(narrow.withColumn("bucket", bucket.cast("int")), ["bucket"], [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("n_tokens")])
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1))
    return placed.withColumn("bucket_len", bucket_len).select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor((F.col("rank") - 1) / room).cast("long").alias("batch"), ((F.col("rank") - 1) % room).cast("int").alias("slot"),
    )


def pack_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``pack`` with a text's number of words (null: 0) as its length."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("body"))
    return pack(with_word_counts(named, "body", "n_tokens"), **options)


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack_documents`` of all ``documents``."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
