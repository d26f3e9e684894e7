"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bucket_of
from .text import LOWER, Chunk, chunks, column, distinct_sorted, row_sums, shingle_hashes, word_bounds, word_hashes

SAMPLE = 12_000  # labelled rows that a fit reads at most
THRESHOLD = 0.7

_CLASS = np.zeros((256, 6), bool)
_CLASS[65:91, 0] = True  # A-Z
_CLASS[97:123, 1] = True  # a-z
_CLASS[48:58, 2] = True  # digits
_CLASS[128:, 3] = True  # bytes of other scripts
_CLASS[[*b".,;:'\"?!-()"], 4] = True  # prose punctuation
_CLASS[33:127, 5] = ~_CLASS[33:127, :5].any(axis=1)  # other symbols
STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "foreign", "punctuation", "symbols", "exclaims", "lines_per_word",
    "distinct_words", "distinct_shingles", "wordless", "symbol_words", "shout_words", "stops_per_word", "long_words",
)


def text_statistics(c: Chunk) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; ratios of an empty text are 0."""
    starts, ends, first = word_bounds(c)
    n = np.diff(first).astype(float)
    size = np.diff(c.offsets).astype(float)

    def per(total: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.divide(total, base, out=np.zeros(len(base)), where=base > 0)

    def in_words(mask: np.ndarray) -> np.ndarray:
        """How many bytes of each word are in the mask."""
        return row_sums(mask.astype(np.int64), np.append(starts, len(c.data)))[: len(starts)] if len(starts) else np.zeros(0, np.int64)

    kinds = [_CLASS[:, i][c.data] for i in range(6)]
    totals = [row_sums(k.astype(np.int64), c.offsets).astype(float) for k in kinds]
    upper, lower, digits, foreign, punctuation, symbols = totals
    letters = upper + lower + foreign
    width = ends - starts
    up, sym, letter = in_words(kinds[0]), in_words(kinds[5]), in_words(kinds[0] | kinds[1] | kinds[3])
    words = word_hashes(c, starts, ends)
    unique = np.diff(distinct_sorted(words, first)[1]).astype(float)
    shingles, offsets = shingle_hashes(words, first)
    whole = np.diff(offsets).astype(float)
    once = np.diff(distinct_sorted(shingles, offsets)[1]).astype(float)
    last = LOWER[c.data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    by_row = [row_sums(m.astype(np.int64), first).astype(float) for m in (letter == 0, sym > 0, (up == letter) & (letter > 1), last == 46, width > 24)]
    return np.stack(
        [np.log1p(n), per(row_sums(width, first).astype(float), n), per(upper, letters), per(digits, size), per(foreign, size), per(punctuation, size), per(symbols, size),
         per(row_sums((c.data == 33).astype(np.int64), c.offsets).astype(float), n), per(row_sums((c.data == 10).astype(np.int64), c.offsets).astype(float), n),
         per(unique, n), per(once, whole), *(per(x, n) for x in by_row)], axis=1,
    )


def with_statistics(docs: DataFrame, text_column: str, prefix: str = "__q_") -> DataFrame:
    """``docs`` with all its columns and one double column for each statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, text_column)):
                got = text_statistics(c)
                part = batch.slice(c.rows.start, c.rows.stop - c.rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[:, i]) for i in range(len(STATISTICS)))], [*part.schema.names, *(prefix + s for s in STATISTICS)])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *(T.StructField(prefix + s, T.DoubleType()) for s in STATISTICS)]))


@dataclass(frozen=True)
class Rules:
    """``rules``: (weight, ((statistic, above, threshold), ...)); a rule holds if every statistic is above its threshold, or at most it."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self, prefix: str = "__q_") -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(_holds(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _holds(rule: tuple[tuple[str, bool, float], ...], prefix: str) -> Column:
    return reduce(Column.__and__, ((F.col(prefix + s) > t) if above else (F.col(prefix + s) <= t) for s, above, t in rule))


def _paths(node, path: dict) -> Iterator[dict]:
    """Every conjunction that leads to a node of the tree, with the tightest bound on each side of a statistic."""
    if path:
        yield path
    if node.subtreeDepth():
        split = node.split()
        at, threshold = int(split.featureIndex()), float(split.threshold())
        low, high = path.get((at, False), math.inf), path.get((at, True), -math.inf)
        yield from _paths(node.leftChild(), path | {(at, False): min(low, threshold)})
        yield from _paths(node.rightChild(), path | {(at, True): max(high, threshold)})


def _lasso(holds: np.ndarray, labels: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty on standardised columns (accelerated proximal gradient).
    The sample is bounded, so the matrix fits the driver; columns must not be constant."""
    n = len(holds)
    mean, spread = holds.mean(axis=0), holds.std(axis=0)
    z = ((holds - mean) / spread).astype(np.float32)
    axis = np.random.default_rng(1).standard_normal(z.shape[1]).astype(np.float32)
    for _ in range(40):
        axis = z.T @ (z @ axis)
        axis /= np.linalg.norm(axis)
    rate = 4 / (1.05 * max(float(np.square(z @ axis).sum()) / n, 1.0))
    w, v = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32)
    b = vb = math.log(labels.mean() / (1 - labels.mean()))
    for i in range(steps):
        error = ((1 / (1 + np.exp(-(z @ v + vb))) - labels) / n).astype(np.float32)
        step = v - rate * (error @ z)
        w_new, b_new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), vb - rate * float(error.sum())
        pull = i / (i + 3)
        v, vb, w, b = w_new + pull * (w_new - w), b_new + pull * (b_new - b), w_new, b_new
    weights = w / spread
    return b - float(weights @ mean), weights


def fit_rules(labelled: DataFrame, *, trees: int = 30, depth: int = 3, penalty: float = 0.0005, seed: int = 5) -> Rules:
    """Rules of ``labelled(label, statistics)``: the paths of a forest's trees, weighed by a lasso logistic regression.

    Without rows the score is 0.5 everywhere, with rows of one label only that label's rate, smoothed.
    """
    prefix = "__q_"
    rows = labelled.select("label", *(prefix + s for s in STATISTICS)).toPandas()
    good, n = float(rows["label"].sum()), len(rows)
    if good in (0.0, float(n)):
        return Rules(math.log((good + 1) / (n - good + 1)), ())
    table = labelled.sparkSession.createDataFrame(rows).coalesce(2)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.5, seed=seed, maxBins=64, cacheNodeIds=False)
    vectors = VectorAssembler(inputCols=[prefix + s for s in STATISTICS], outputCol="features").transform(table)
    found: dict[tuple, None] = {}
    for tree in forest.fit(vectors).trees:
        for path in _paths(tree._call_java("rootNode"), {}):
            found[tuple(sorted((STATISTICS[i], above, round(t, 12)) for (i, above), t in path.items()))] = None
    rules = list(found)
    own = {s: rows[prefix + s].to_numpy() for s in STATISTICS}
    holds = np.stack([np.logical_and.reduce([own[s] > t if above else own[s] <= t for s, above, t in rule]) for rule in rules], axis=1).astype(np.int8)
    used = np.flatnonzero((holds.sum(axis=0, dtype=np.int64) > 0) & (holds.sum(axis=0, dtype=np.int64) < n))
    intercept, weights = _lasso(holds[:, used], rows["label"].to_numpy(), penalty)
    return Rules(intercept, tuple((float(w), rules[i]) for i, w in zip(used.tolist(), weights, strict=True) if abs(w) > 1e-9))


def learn(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE, **options) -> Rules:
    """Fit on the labelled rows whose crc32 bucket of 4 is not 2; of more than ``sample`` of them, those of the least hashes.

    Labels with a null id or quality are not read; of several for an id the greatest counts. Documents with a null id have no label;
    of those that repeat an id, one is learnt from, that whose text has the least hash, so the sample is bounded. Null texts are empty
    ones. Without labelled rows every score is 0.5.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    texts = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text")).join(F.broadcast(chosen), "__id")
    single = texts.groupBy("__id").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.max("label").alias("label"))
    return fit_rules(with_statistics(single, "__text").withColumn("label", F.col("label").cast("double")), **options)


def with_quality(docs: DataFrame, rules: Rules, *, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with all its columns and its score by ``rules``, a row for each row.

    Null texts are scored as empty ones, long ones as a whole; equal texts have equal scores, whatever their id, null ones too. Columns
    of other names stay as they are (``__q_`` and a statistic's name are taken). An empty table gives no rows.
    """
    return with_statistics(docs, text_column).withColumn(score_column, rules.score()).drop(*("__q_" + s for s in STATISTICS))


def op6_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by rules learnt from ``labels``; a null doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_quality(docs.select("doc_id", "text"), rules)
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
