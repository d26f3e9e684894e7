"""Vector codes: vectors are cut in parts, and each part is named by the nearest entry of its position's codebook.

All arithmetic on values is in integers. The nearest entry is found in a ball tree over the position's entries: metric
branch and bound with radii and distances rounded so that no ball is left out wrongly, balls that tie are visited, and whatever a leaf
holds is compared by exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import side, stage
from .text import column

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 8  # entries
LIMIT = 1 << 27  # of an integer component: squared distances of a part and of a whole vector stay exact
SLACK = 1e-12  # relative, far above the rounding of a root and a difference of doubles
BLOCK = 8_192  # vectors that are searched at a time


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``points`` to one entry."""
    return np.square(points - to).sum(axis=1)


@dataclass
class Ball:
    """Entries (by index) of a codebook: a leaf, or two balls. All lie within ``radius`` of ``centre``."""

    entries: np.ndarray
    centre: np.ndarray
    radius: float
    sides: list[Ball] = field(default_factory=list)


def ball_tree(book: np.ndarray, entries: np.ndarray | None = None) -> Ball:
    """The tree over the rows of ``book``: halves by nearness to two far entries, so equal entries are split as well."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    within = [int(_distances(own, p).max()) for p in own]
    at = int(np.argmin(within))
    ball = Ball(entries, own[at], float(np.sqrt(float(within[at]))) * (1 + SLACK))
    if len(entries) > LEAF:
        left = int(_distances(own, own[0]).argmax())
        right = int(_distances(own, own[left]).argmax())
        order = np.argsort(_distances(own, own[left]) - _distances(own, own[right]), kind="stable")
        half = len(entries) // 2
        ball.sides = [ball_tree(book, entries[np.sort(order[:half])]), ball_tree(book, entries[np.sort(order[half:])])]
    return ball


def nearest(book: np.ndarray, tree: Ball, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of its nearest entry, of equals the lowest, and the exact squared distance."""
    best, which = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(book))

    def bound(ball: Ball, rows: np.ndarray) -> np.ndarray:
        """At most the distance of any entry of the ball."""
        return np.maximum(np.sqrt(_distances(points[rows], ball.centre).astype(float)) * (1 - SLACK) - ball.radius, 0.0)

    def visit(ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not ball.sides:
            for e in ball.entries.tolist():
                d = _distances(points[rows], book[e])
                better = (d < best[rows]) | ((d == best[rows]) & (e < which[rows]))
                best[rows[better]], which[rows[better]] = d[better], e
            return
        far = [bound(s, rows) for s in ball.sides]
        first = far[0] <= far[1]
        for near, low in ((first, far[1]), (~first, far[0])):
            a, b = ball.sides if near is first else ball.sides[::-1]
            visit(a, rows[near])
            still = np.square(low[near]) * (1 - SLACK) <= best[rows[near]].astype(float)
            visit(b, rows[near][still])

    visit(tree, np.arange(len(points)))
    return which, best


@dataclass(frozen=True)
class Codebooks:
    """``books[part][entry]`` are integer components; all parts have the same number of entries."""

    books: np.ndarray

    def digest(self) -> str:
        """Lowercase hex sha256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    @cached_property
    def trees(self) -> list[Ball]:
        return [ball_tree(book) for book in self.books]

    def assign(self, values: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For runs of rows, the entry and the squared distance of each part."""
        parts, _, width = self.books.shape
        for at in range(0, len(values), BLOCK):
            own = values[at : at + BLOCK].reshape(-1, parts, width)
            found = [nearest(self.books[p], self.trees[p], own[:, p]) for p in range(parts)]
            yield slice(at, at + len(own)), np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _integers(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The batch's vectors, all of ``size`` components, as floor(SCALE * x)."""
    values = pc.list_flatten(column(batch, "vector")).to_numpy(zero_copy_only=False).astype(float)
    scaled = np.floor(values * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component is beyond {LIMIT // SCALE}: its distances are not exact in 64 bits")
    return scaled.astype(np.int64).reshape(-1, size)


def usable(vectors: DataFrame, vector_column: str, parts: int, size: int | None, *keep: str) -> DataFrame:
    """``(vector, *keep)`` of the rows whose vector can be cut in ``parts`` equal parts, all components finite; with ``size``, of that many only."""
    v = F.col("vector")
    named = vectors.select(F.col(f"`{vector_column}`").cast("array<double>").alias("vector"), *(F.col(f"`{k}`") for k in keep))
    fits = F.size(v) == size if size else (F.size(v) > 0) & (F.size(v) % parts == 0)
    return named.where(F.coalesce(fits & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def fit(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that begin as the vectors of the ``entries`` smallest ids, ascending, and move ``rounds`` times to the mean of their parts.

    Rows with unusable vectors have no say, null ids come last, repeats of an id by their vectors. A mean is floored; an entry
    without parts stays. Each round sums in the tasks first, so what is shuffled is a row for each component of an entry and task.
    Usable are vectors of finite components that can be cut in equal parts, of the number that the first such row has.
    None without any. A component of 2^19 or more is an error.
    """
    size = None
    while True:
        known = usable(vectors, vector_column, parts, size, id_column)
        first = known.orderBy(F.col(id_column).asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
        if not first.num_rows:
            return None
        size = len(first["vector"][0])
        if all(len(v) == size for v in first["vector"]):
            break
    known = usable(vectors, vector_column, parts, size, id_column)
    values = _integers(first.combine_chunks().to_batches()[0], size)
    books = Codebooks(values.reshape(len(values), parts, size // parts).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _moved(known, books, size)
    return books


def _moved(known: DataFrame, now: Codebooks, size: int) -> Codebooks:
    parts, entries, width = now.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            values = _integers(batch, size)
            for rows, which, _ in now.assign(values):
                slot = which + np.arange(parts) * entries
                np.add.at(total, slot.reshape(-1), values[rows].reshape(-1, width))
                count += np.bincount(slot.reshape(-1), minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(total[used].reshape(-1)), pa.array(np.repeat(count[used], width))], ["slot", "place", "total", "n"],
        )

    summed = known.select("vector").mapInArrow(run, "slot long, place long, total long, n long").groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    moved = now.books.reshape(-1, width).copy()
    slot, place, total, n = (summed[c].to_numpy() for c in ("slot", "place", "total", "n"))
    moved[slot, place] = total // n
    return Codebooks(moved.reshape(now.books.shape))


def encode(vectors: DataFrame, books: Codebooks, *, id_column: str = "vec_id", vector_column: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, code, error)`` of every usable vector of the codebooks' size: the entries' indexes in hex by part, and the squared distances' sum.

    Ties go to the lower index. Equal vectors have equal codes; null and repeated ids are rows of their own. An empty table
    gives no rows; other columns are not read.
    """
    size = books.books.shape[0] * books.books.shape[2]
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")
    own = list(dict.fromkeys((id_column, *keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _integers(batch, size)
            kept = [column(batch, k) for k in own]
            for rows, which, far in books.assign(values):
                codes = digits[which].view(f"S{2 * which.shape[1]}").reshape(-1).astype(str)
                yield pa.RecordBatch.from_arrays([*(k[rows] for k in kept), pa.array(codes, pa.string()), pa.array(far.sum(axis=1))], [*own, "code", "error"])

    known = usable(vectors, vector_column, len(books.books), size, *own)
    schema = known.select(*own).withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")).schema
    return known.mapInArrow(run, schema)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``, the errors by label and the codebooks' digest."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stage(encode(vectors, books, keep=("label",)), "codes")
    by_label = stage(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = coded.join(side(by_label), F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _assigned_sql(book: str) -> str:
    """Each part's nearest entry of ``book``, and its distance."""
    return f"""SELECT r, part, min_by(entry, far * {ENTRIES} + entry) AS entry, min(far) AS far FROM (
  SELECT v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS far FROM v JOIN {book} b ON v.part = b.part AND v.place = b.place GROUP BY ALL) GROUP BY ALL"""


def _moved_sql(book: str, assigned: str) -> str:
    return f"""SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
  SELECT v.part, a.entry, v.place, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM v JOIN {assigned} a ON v.r = a.r AND v.part = a.part GROUP BY ALL) m
  ON b.part = m.part AND b.entry = m.entry AND b.place = m.place"""


ORACLE_SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_bool_or([x IS NULL OR isnan(x) OR isinf(x) FOR x IN embedding])),
v AS MATERIALIZED (SELECT r, i // (n // {PARTS}) AS part, i % (n // {PARTS}) AS place, CAST(floor({SCALE} * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, e, len(e) AS n, unnest(range(len(e))) AS i FROM k)),
b0 AS MATERIALIZED (SELECT part, r AS entry, place, x FROM v WHERE r < {ENTRIES}),
a0 AS MATERIALIZED ({_assigned_sql("b0")}), b1 AS MATERIALIZED ({_moved_sql("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned_sql("b1")}), b2 AS MATERIALIZED ({_moved_sql("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned_sql("b2")}),
c AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r) CROSS JOIN s"""
