"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Each coordinate has its own rate, from the squares of its gradients so far, and an L1 penalty that holds weights at exactly
zero until their evidence outweighs it, so what is broadcast for scoring are the few weights that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bucket_of
from .text import LOWER, Chunk, U, chunks, column, distinct_sorted, mix64, row_sums, word_bounds, word_hashes

SAMPLE = 20_000  # labelled rows that a fit reads at most
THRESHOLD = 0.7
BITS = 18  # of a feature's index
SHARDS = 4
# of words i and i + distance: a pair's salt; at distance 0 the word itself
_GRAMS = ((0, U(1)), (1, U(0x9E3779B97F4A7C15)), (2, U(0xD1B54A32D192ED03)))
STEMS = (4, 5, 6, 7)  # leading bytes of a longer word: inflected forms share them
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _index(hashes: np.ndarray, bits: int) -> np.ndarray:
    return mix64(hashes) >> U(64 - bits)


def features(c: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of hashed features, ascending, and the texts' offsets: words, stems, pairs of neighbours, and pairs with one word between.
    Words are runs of ASCII letters, digits and bytes from 128 on; A-Z count as a-z. A stem is a word cut short, and equals that word."""
    own = Chunk(c.rows, np.where(_IN_WORD[c.data], LOWER[c.data], 32).astype(np.uint8), c.offsets)
    starts, ends, first = word_bounds(own)
    words, n = word_hashes(own, starts, ends), np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    found, rows = [], []
    for size in STEMS:
        at = np.flatnonzero(ends - starts > size)
        found.append(_index(word_hashes(own, starts[at], starts[at] + size), bits))
        rows.append(row[at])
    for distance, salt in _GRAMS:
        at = np.flatnonzero(np.arange(len(words)) + distance < np.repeat(first[1:], n))
        found.append(_index(words[at] * salt + mix64(words[at + distance] ^ salt) if distance else words[at], bits))
        rows.append(row[at])
    joined, rows = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return distinct_sorted(joined[order], np.searchsorted(rows[order], np.arange(len(n) + 1)))


@dataclass
class Ftrl:
    """``z`` and ``n`` of every coordinate, the last one the intercept's (without penalty); ``free``: those that learn."""

    z: np.ndarray
    n: np.ndarray
    free: np.ndarray
    alpha: float
    l1: float
    l2: float
    beta: float = 1.0

    @staticmethod
    def begun(free: np.ndarray, *, alpha: float, l1: float, l2: float) -> Ftrl:
        return Ftrl(np.zeros(len(free)), np.zeros(len(free)), free, alpha, l1, l2)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of some coordinates, the intercept's being the last of them."""
        z = self.z[at]
        held = np.maximum(np.abs(z) - self.l1, 0.0)
        held[-1] = abs(z[-1])
        return -np.sign(z) * held / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def update(self, features: np.ndarray, label: float) -> float:
        """Learns from one text; gives the chance of label 1 that was foreseen."""
        at = np.append(features[self.free[features]], len(self.z) - 1)
        w, n = self.weights(at), self.n[at]
        chance = 1.0 / (1.0 + math.exp(-min(max(float(w.sum()), -35.0), 35.0)))
        g = chance - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return chance


@dataclass(frozen=True)
class Weights:
    """The weights that are not zero, by ascending feature index."""

    intercept: float
    index: np.ndarray
    weight: np.ndarray
    bits: int = BITS

    def score(self, c: Chunk, dense: np.ndarray) -> np.ndarray:
        at, offsets = features(c, self.bits)
        return 1.0 / (1.0 + np.exp(-np.clip(self.intercept + row_sums(dense[at], offsets), -35, 35)))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def fit(labelled: DataFrame, *, epochs: int = 8, shards: int = SHARDS, bits: int = BITS, alpha: float = 1.0, l1: float = 9.0, l2: float = 0.1, refit_l1: float = 0.125) -> Weights:
    """Weights from ``labelled(id, text, label)``; ids are distinct, and the table is bounded by whoever calls.

    Rows are dealt to ``shards`` by a hash of the id, whatever the partitions are, and kept by the executors. In an epoch every shard
    learns from its rows, in order of hash, from the state that the last one left, and the driver averages the shards' states: two doubles for
    each coordinate and shard, however large the sample. So runs agree, and a lost executor costs a shard's pass.

    After ``epochs`` under the penalty ``l1``, as many more go over the coordinates that it left, from zero and under ``refit_l1``: what
    says which features count shrinks all weights, so the weights are fitted without it.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, "text")):
                at, offsets = features(c, bits)
                at = at.astype(np.uint32)
                packed = [at[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "place")[c.rows], column(batch, "label")[c.rows], pa.array(packed, pa.binary())], ["place", "label", "features"])

    rows = labelled.select(F.xxhash64("id", F.lit(7)).alias("place"), F.col("label").cast("double").alias("label"), "text")
    dealt = rows.mapInArrow(hashed, "place long, label double, features binary").withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartition(shards, "shard").persist()
    try:
        free = np.ones((1 << bits) + 1, bool)
        for penalty in (l1, refit_l1):
            state = Ftrl.begun(free, alpha=alpha, l1=penalty, l2=l2)
            for _ in range(epochs):
                state = _epoch(dealt, state, shards)
            free = state.weights() != 0
    finally:
        dealt.unpersist()
    w = state.weights()
    index = np.flatnonzero(w[:-1])
    return Weights(float(w[-1]), index, w[index], bits)


def _epoch(dealt: DataFrame, before: Ftrl, shards: int) -> Ftrl:
    """The mean of the states in which the shards' rows leave ``before``; a shard without rows leaves it as it is."""
    sent = dealt.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("shard", "ascending"), ("place", "ascending"), ("label", "ascending")])
        states: dict[int, Ftrl] = {}
        for shard, label, found in zip(*(rows[k].to_pylist() for k in ("shard", "label", "features")), strict=True):
            if shard not in states:
                states[shard] = replace(sent.value, z=sent.value.z.copy(), n=sent.value.n.copy())
            states[shard].update(np.frombuffer(found, np.uint32), label)
        yield pa.RecordBatch.from_arrays([pa.array(list(states)), *(pa.array([getattr(s, k).tobytes() for s in states.values()], pa.binary()) for k in "zn")], ["shard", "z", "n"])

    told = dealt.mapInArrow(run, "shard long, z binary, n binary").toArrow().sort_by("shard")
    sent.unpersist()
    own = [[np.frombuffer(x, float) for x in told[k].to_pylist()] for k in "zn"]
    rest = shards - told.num_rows
    return replace(before, z=sum(own[0], rest * before.z) / shards, n=sum(own[1], rest * before.n) / shards)


def learn(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE, **options) -> Weights:
    """Fit on the labelled documents whose crc32 bucket of 3 is not 1; of more than ``sample`` labelled ids, those of the least hashes.

    Labels with a null id or ``toxic`` are not read; of several for an id the greatest counts. Documents with a null id have no label;
    of those that repeat an id, one is learnt from, that whose text has the least hash, so the sample is bounded. Null texts are
    empty ones, others are read as a whole. Without labelled rows, and for texts without features, the score is that of the intercept.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).withColumnRenamed("doc_id", "id")
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).join(F.broadcast(chosen), "id")
    return fit(texts.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")), **options)


def with_toxicity(docs: DataFrame, weights: Weights, *, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with all its columns and its score, a row for each row; a column of the score's name is replaced.

    Null texts are scored as empty ones, long ones as a whole; equal texts have equal scores. An empty table gives no rows.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != score_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        for batch in batches:
            for c in chunks(column(batch, text_column)):
                part = batch.slice(c.rows.start, c.rows.stop - c.rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weights.score(c, dense))], [*part.schema.names, score_column])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField(score_column, T.DoubleType())]))


def op11_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by weights learnt from ``labels``; a null doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
