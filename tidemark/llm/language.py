"""Language identification: the language's family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bucket_of
from .text import LOWER, Chunk, U, chunks, column, row_sums

SAMPLE = 6_000  # labelled rows that a fit reads, about
DIMENSIONS = 2_048
# fixed values: families of language codes; a code that is not listed is a family of its own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def profiles(c: Chunk) -> np.ndarray:
    """Hashed byte-trigram frequencies (rows x DIMENSIONS) of the lower-cased letters of each text, other bytes read as spaces."""
    data = np.where(_LETTER[c.data], LOWER[c.data], 32).astype(np.uint8)
    if len(data) > 1:  # capitals of Latin-1 in UTF-8: C3 80-9E
        data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    rows = len(c.offsets) - 1
    padded = np.concatenate((np.full(1, 32, np.uint8), data, np.full(1, 32, np.uint8)))
    left, right = padded[:-2].copy(), padded[2:].copy()
    edges = c.offsets[:-1][c.offsets[:-1] < len(data)]
    left[edges] = 32
    right[edges[edges > 0] - 1] = 32
    gram = (left.astype(np.uint32) << 16) | (data.astype(np.uint32) << 8) | right
    slot = ((gram.astype(U) * U(0x9E3779B97F4A7C15)) >> U(53)).astype(np.int64)
    used = data != 32
    row = np.repeat(np.arange(rows), np.diff(c.offsets))
    counts = np.bincount((row * DIMENSIONS + slot)[used], minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS).astype(np.float32)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _has_letter(c: Chunk) -> np.ndarray:
    ascii_letters = row_sums((_LETTER & (np.arange(256) < 128))[c.data].astype(np.int64), c.offsets) > 0
    for i in np.flatnonzero(~ascii_letters & (row_sums((c.data > 127).astype(np.int64), c.offsets) > 0)):
        text = c.data[c.offsets[i] : c.offsets[i + 1]].tobytes().decode("utf-8", "ignore")
        ascii_letters[i] = any(unicodedata.category(x)[0] == "L" for x in text)
    return ascii_letters


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, accelerated gradient; the classes weigh the same)."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - mean) / spread / np.sqrt(x.shape[1])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b, v, vb = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 0.0
    rate = 1 / (2 * float((share[:, None] * z * z).sum()) + 2 + penalty)
    for i in range(steps):
        slack = share * np.maximum(0, 1 - y * (z @ v + vb)) * y
        w_new, b_new = v + rate * (2 * (slack @ z) - penalty * v), vb + rate * 2 * float(slack.sum())
        pull = i / (i + 3)
        v, vb, w, b = w_new + pull * (w_new - w), b_new + pull * (b_new - b), w_new, b_new
    w = w / spread / np.sqrt(x.shape[1])
    return w.astype(np.float32), b - float(w @ mean)


@dataclass(frozen=True)
class Tree:
    """Families, their languages, and for each decision (families: -1; else the family's number) the pairs' SVMs."""

    families: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    biases: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights + self.biases
        family, sure = self._decide(margins, -1, len(self.families), np.arange(len(x)))
        names, score = np.empty(len(x), object), sure
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            which, inner = self._decide(margins, f, len(languages), rows)
            names[rows] = np.array(languages, object)[which]
            score[rows] *= inner
        return names.tolist(), score

    def _decide(self, margins: np.ndarray, level: int, n: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By most pairs won, then by the sum of squashed margins; sure: the winner's mean chance over its pairs."""
        wins, chance = np.zeros((len(rows), n)), np.zeros((len(rows), n))
        for k, (at, i, j) in enumerate(self.pairs):
            if at == level:
                p = 1 / (1 + np.exp(-np.clip(3 * margins[rows, k].astype(float), -30, 30)))
                wins[:, i] += p >= 0.5
                wins[:, j] += p < 0.5
                chance[:, i] += p
                chance[:, j] += 1 - p
        best = (wins + chance / (n + 1)).argmax(axis=1)
        return best, chance[np.arange(len(rows)), best] / (n - 1) if n > 1 else np.ones(len(rows))


def fit_tree(x: np.ndarray, languages: list[str]) -> Tree:
    named = np.array(languages, object)
    groups: dict[str, list[str]] = {}
    for code in sorted(set(languages)):
        groups.setdefault(_FAMILY.get(code.lower().split("-")[0], code), []).append(code)
    families = [groups[k] for k in sorted(groups)]
    pairs, weights, biases = [], [], []

    def add(level: int, sides: list[np.ndarray]) -> None:
        for i, j in combinations(range(len(sides)), 2):
            rows = np.concatenate((np.flatnonzero(sides[i]), np.flatnonzero(sides[j])))
            w, b = _svm(x[rows], np.where(sides[i][rows], 1, -1).astype(np.float32))
            pairs.append((level, i, j))
            weights.append(w)
            biases.append(b)

    add(-1, [np.isin(named, codes) for codes in families])
    for f, codes in enumerate(families):
        add(f, [named == code for code in codes])
    return Tree(families, pairs, np.stack(weights, axis=1) if weights else np.zeros((x.shape[1], 0), np.float32), np.array(biases, np.float32))


def learn(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> Tree | None:
    """Fit on rows with text and language whose crc32 bucket of 3 is not 1: about ``sample`` of them, chosen by a hash of id and text,
    each language as many as it has up to an equal share, and one at least. None without such rows.

    A null id is learnt from. Rows equal in id, text and language are one row; others that share an id are chosen each by itself, so the
    sample is bounded and never empty. Of more than ``sample`` languages the most frequent are learnt, ties by name. Texts are
    read as a whole, however long.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("body")).where("lang is not null and body is not null").where(F.coalesce(bucket_of("id", 3) != 1, F.lit(True)))
    known = named.withColumn("place", F.xxhash64("id", "body", F.lit(11)))
    drawn = F.pmod("place", F.lit(1 << 30))
    counts = known.select("lang", "place").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(drawn).alias("least")).orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return None
    share = sample / len(counts)
    limit = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], max(int(min(1.0, share / r["count"]) * (1 << 30)), r["least"] + 1))))
    chosen = known.where(drawn < F.element_at(limit, F.col("lang"))).groupBy("lang", "place").agg(F.min("id").alias("id"), F.min("body").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, "body")):
                got, langs = profiles(c), column(batch, "lang")[c.rows]
                yield pa.RecordBatch.from_arrays([column(batch, "id")[c.rows].cast(pa.int64()), langs, pa.array([r.tobytes() for r in got], pa.binary())], ["id", "lang", "profile"])

    rows = chosen.mapInArrow(run, "id long, lang string, profile binary").toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    if not rows.num_rows:
        return None
    return fit_tree(np.frombuffer(b"".join(rows["profile"].to_pylist()), np.float32).reshape(rows.num_rows, -1), rows["lang"].to_pylist())


def identify(docs: DataFrame, tree: Tree | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row; ``und`` with score 0 if the text is null or holds no letter, or nothing was learnt.

    Equal texts have equal answers, whatever their id, null ones too; ties of a decision go to the earlier language by
    name. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(column(batch, "body")):
                ids = column(batch, "id")[c.rows]
                fit = _has_letter(c) if tree is not None else np.zeros(len(ids), bool)
                names, score = tree.predict(profiles(c)) if tree is not None else ([None] * len(ids), np.zeros(len(ids)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([n if f else "und" for n, f in zip(names, fit, strict=True)]), pa.array(np.where(fit, score, 0.0))], ["doc_id", "lang_pred", "score"])

    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("body"))
    return named.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learnt from them; a null doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
