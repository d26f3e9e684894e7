"""Approximate nearest neighbours by inner product: stable projections to a few dimensions, indexed by kd-trees.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the longest norm, and a query a zero; the nearest by distance
are then those of largest inner product. Squared distances in the projection, over the true ones, follow a chi-square law, so
projected neighbours are verified in order of distance until the next is so far away that a vector nearer than the
k-th best so far would project that far with a chance of at most 1 - ``CERTAINTY``. Directions are normal (2-stable) and then made
orthogonal, which only narrows that law.

The upper levels of the kd-tree cut the projected space into cells, the shards of the index; each shard's task builds the
levels below. A query first searches the shard of its own cell. Its k-th best there gives its reach, and it goes on only to the cells
whose boxes lie within.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage
from .text import column

DIMENSIONS = 24
CERTAINTY = 0.9
LEAF = 128
SHARD_ROWS = 16_384
QUERY_ROWS = 8_192
SAMPLE_ROWS = 16_384  # that the cells' cuts are medians of, for each vector size
MOST_CELLS = 4_096  # for each vector size; beyond, cells hold several shards
BATCH = 256  # queries at a time
PAIRS = 50_000  # verified at a time
SEED = 41


@lru_cache
def chi_square_quantile(p: float, k: int) -> float:
    """The value that a chi-square variable of k degrees stays below with chance p (bisection on the incomplete gamma series)."""

    def below(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    low, high = 1e-9, 20.0 * k + 200
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


@lru_cache(maxsize=8)
def projection(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Directions for vectors of ``size`` components and the added one, scaled to keep squared distances times ``dimensions`` on average."""
    drawn = np.random.default_rng([SEED, size]).standard_normal((size + 1, min(dimensions, size + 1)))
    return np.linalg.qr(drawn)[0] * math.sqrt(size + 1)


def projected(vectors: np.ndarray, longest: float) -> np.ndarray:
    added = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0))
    return np.column_stack((vectors, added)) @ projection(vectors.shape[1])


def box_distances(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances from each point to each box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        out += np.maximum(np.maximum(low[:, axis] - p, p - high[:, axis]), 0) ** 2
    return out


class Tree:
    """kd-tree over projected points: median splits along the widest axis down to leaves, each with its bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        todo, leaves = [np.arange(len(points))], []
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                leaves.append(own)
                continue
            axis = int(np.ptp(points[own], axis=0).argmax())
            half = len(own) // 2
            order = np.argpartition(points[own, axis], half)
            todo += [own[order[:half]], own[order[half:]]]
        self.points = points
        self.leaves = leaves
        self.low = np.stack([points[x].min(axis=0) for x in leaves])
        self.high = np.stack([points[x].max(axis=0) for x in leaves])


class Cuts:
    """The upper levels of the kd-tree: ``depth`` levels of median cuts of a sample, each node along its widest axis."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.axes, self.at = depth, np.zeros(2**depth, np.int64), np.zeros(2**depth)
        own = {1: np.arange(len(sample))}
        for node in range(1, 2**depth):
            points = sample[own[node]]
            if len(points):
                axis = int(np.ptp(points, axis=0).argmax())
                self.axes[node], self.at[node] = axis, np.median(points[:, axis])
            right = points[:, self.axes[node]] >= self.at[node]
            own[2 * node], own[2 * node + 1] = own[node][~right], own[node][right]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axes[node]] >= self.at[node])
        return node - 2**self.depth


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, longest: float, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The up to k best found for each query that score at least its ``least`` (-inf where nothing is known), as rows of query, id and
    inner product, and the number of vectors verified.

    Leaves are visited in order of distance, more of them at a time as the reach shrinks; points of a leaf beyond the reach are skipped.
    """
    points = queries @ projection(queries.shape[1])[:-1]
    far = box_distances(tree.low, tree.high, points)
    order = np.argsort(far, axis=1, kind="stable")
    limit = chi_square_quantile(CERTAINTY, points.shape[1])
    base = longest * longest + (queries * queries).sum(axis=1)
    bound, at, step, verified = least.copy(), 0, 1, 0
    who, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    while at < order.shape[1]:
        reach = limit * np.maximum(base - 2 * bound, 0) + 1e-9
        visit = order[:, at : at + step]
        query, place = np.nonzero(np.take_along_axis(far, visit, 1) <= reach[:, None])
        if not len(query):
            break
        leaf = visit[query, place]
        by_leaf = np.argsort(leaf, kind="stable")
        query, leaf = query[by_leaf], leaf[by_leaf]
        cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            asks, own = query[a:b], tree.leaves[leaf[a]]
            p, x = points[asks], tree.points[own]
            apart = (p * p).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (p @ x.T)
            i, j = np.nonzero((apart <= reach[asks][:, None] + 1e-9) & (ids[own] != query_ids[asks][:, None]))
            pairs.append((asks[i], own[j]))
        asks, own = (np.concatenate(x) for x in zip(*pairs, strict=True))
        verified += len(asks)
        got = np.concatenate([np.zeros(0), *((vectors[own[i : i + PAIRS]] * queries[asks[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(asks), PAIRS))])
        good = got >= bound[asks]
        who, found, scores = np.concatenate((who, asks[good])), np.concatenate((found, ids[own[good]])), np.concatenate((scores, got[good]))
        top = np.lexsort((found, -scores, who))
        who, found, scores = who[top], found[top], scores[top]
        head = np.searchsorted(who, np.arange(len(queries)))
        rank = np.arange(len(who)) - head[who]
        last = rank == k - 1
        bound[who[last]] = np.maximum(bound[who[last]], scores[last])
        who, found, scores = who[rank < k], found[rank < k], scores[rank < k]
        at += step
        step = min(2 * step, 16)
    return query_ids[who], found, scores, verified


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """For each vector size of a batch: the size, its rows, and their vectors."""
    sizes = column(batch, "size").to_numpy()
    for size in np.unique(sizes).tolist():
        rows = pa.array(np.flatnonzero(sizes == size))
        yield size, rows, _matrix(column(batch, "v").take(rows), size)


def _searcher(longest: dict[int, float], k: int):
    """For cogrouped shards and blocks of queries."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asked.num_rows:
            own, asked = own.combine_chunks(), asked.combine_chunks()
            size = asked.column("size")[0].as_py()
            ids, vectors = own.column("of_vec_id").to_numpy(), _matrix(own.column("of_v").combine_chunks(), size)
            tree = Tree(projected(vectors, longest[size]))
            names, queries, least = asked.column("query_id").to_numpy(), _matrix(asked.column("q").combine_chunks(), size), asked.column("least").to_numpy()
            for i in range(0, len(names), BATCH):
                out.append(search(tree, ids, vectors, longest[size], names[i : i + BATCH], queries[i : i + BATCH], least[i : i + BATCH], k)[:3])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    return run


def _searched(vectors: DataFrame, asked: DataFrame, keys: list[str], longest: dict[int, float], k: int) -> DataFrame:
    """``(query_id, vec_id, score)`` of the blocks of queries ``asked`` in the shards they name by ``keys``."""
    vectors = vectors.toDF(*(f"of_{c}" for c in vectors.columns))  # both sides come from the same table
    return vectors.groupBy(*(f"of_{c}" for c in keys)).cogroup(asked.groupBy(*keys)).applyInArrow(_searcher(longest, k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row the k found nearest among all rows of other ids, by inner product.

    Every row is in the index. The cells' cuts are medians of a sample of about ``SAMPLE_ROWS`` rows of each vector size; their boxes
    hold all rows. A cell of more than ``SHARD_ROWS`` rows, such as one of equal vectors, is dealt to several shards by a hash of the id,
    and more than ``QUERY_ROWS`` queries of a shard to several blocks.

    Vectors null, empty, zero or with null or non-finite components take no part, nor do null ids; only vectors of equal
    size are compared. Equal scores rank by the smaller id. Fewer than k candidates give fewer rows, an empty table none. Rows
    that repeat an id are candidates each, never each other's; as queries they share the k best that any of them finds. Other columns
    are not read.
    """
    vector = F.col(vector_column).cast("array<double>")
    fit = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    named = vectors.where(fit & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stage(named.withColumn("size", F.size("v")), "vectors")
    # one row for each vector size
    facts = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"), F.max("asks").alias("asked")).where("asked").collect()
    longest = {r["size"]: r["longest"] for r in facts}
    depth = {r["size"]: min(math.ceil(math.log2(max(r["n"] / SHARD_ROWS, 1))), int(math.log2(MOST_CELLS))) for r in facts}
    every = {r["size"]: math.ceil(r["n"] / SAMPLE_ROWS) for r in facts if depth[r["size"]]}
    known = rows.where(F.col("size").isin(list(longest)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, own in _by_size(batch):
                points = projected(own, longest[size])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(points.reshape(-1)), points.shape[1]).cast(pa.list_(pa.float64()))], ["size", "p"])

    cuts: dict[int, Cuts] = {}
    for size, step in every.items():
        sample = known.where((F.col("size") == size) & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(step)) == 0)).mapInArrow(project, "size int, p array<double>").toArrow().column("p").combine_chunks()
        cuts[size] = Cuts(_matrix(sample, min(DIMENSIONS, size + 1)), depth[size])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, own in _by_size(batch):
                cell = cuts[size].cells(projected(own, longest[size])) if size in cuts else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.take(at).columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    placed = stage(known.mapInArrow(place, "vec_id long, v array<double>, asks boolean, size int, cell int"), "placed")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell that the task meets: the rows, and for each axis the least and the greatest value."""
        met: dict[tuple[int, int], list] = {}
        for batch in batches:
            for size, at, own in _by_size(batch):
                cell, points = column(batch, "cell").take(at).to_numpy(), projected(own, longest[size])
                order = np.argsort(cell, kind="stable")
                cell, points = cell[order], points[order]
                heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                low, high, n = np.minimum.reduceat(points, heads), np.maximum.reduceat(points, heads), np.diff(np.append(heads, len(cell)))
                for i, c in enumerate(cell[heads].tolist()):
                    old = met.get((size, c))
                    met[size, c] = [n[i], low[i], high[i]] if old is None else [old[0] + n[i], np.minimum(old[1], low[i]), np.maximum(old[2], high[i])]
        out = [(s, c, axis, int(n), float(low[axis]), float(high[axis])) for (s, c), (n, low, high) in met.items() for axis in range(len(low))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["size", "cell", "axis", "n", "low", "high"])

    # at most MOST_CELLS cells of each size
    met = placed.mapInArrow(boxes, "size int, cell int, axis int, n long, low double, high double").groupBy("size", "cell", "axis").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("size", "cell", "axis").collect()
    space: dict[int, tuple[np.ndarray, ...]] = {}
    for size in longest:
        own = [r for r in met if r["size"] == size]
        dims = min(DIMENSIONS, size + 1)
        space[size] = (np.array([r["cell"] for r in own[::dims]]), np.array([-(-r["n"] // SHARD_ROWS) for r in own[::dims]]), *(np.array([r[x] for r in own]).reshape(-1, dims) for x in ("low", "high")))
    del met
    many = {(size, int(c)): int(n) for size, (cells, slices, *_) in space.items() for c, n in zip(cells, slices, strict=True) if n > 1}

    def slice_of(ids: np.ndarray, slices: np.ndarray) -> np.ndarray:
        return (ids * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> np.int64(17)) % slices

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = np.array([many.get(x, 1) for x in zip(column(batch, "size").to_pylist(), column(batch, "cell").to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slice_of(column(batch, "vec_id").to_numpy(), slices).astype(np.int32))], [*batch.schema.names, "slice"])

    shards = stage(placed.mapInArrow(deal, "vec_id long, v array<double>, asks boolean, size int, cell int, slice int"), "shards")
    shard = ["size", "cell", "slice"]

    def blocked(asked: DataFrame, tag: str) -> DataFrame:
        """The best that queries find in the shards they name, up to ``QUERY_ROWS`` of them to a task."""
        counts = stage(asked.groupBy(*shard).count().select(*shard, F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("blocks")), "counts")
        own = shards.join(counts, shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*shard, "block", "vec_id", "v")
        block = F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("blocks")).cast("int")
        return stage(_searched(own, asked.join(counts, shard).withColumn("block", block).select(*shard, "block", "query_id", "q", "least"), [*shard, "block"], longest, k), tag)

    queries = shards.where("asks").select(*shard, F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    first = blocked(queries.withColumn("least", F.lit(float("-inf"))), "first")
    reached = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found")).where(F.col("found") >= k).select("query_id", "least")
    limits = queries.join(stage(reached, "reached"), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).withColumnRenamed("q", "v")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard within its reach, but for the one it has searched."""
        for batch in batches:
            for size, at, own in _by_size(batch):
                rows = batch.take(at)
                cells, slices, low, high = space[size]
                least = column(rows, "least").to_numpy()
                reach = chi_square_quantile(CERTAINTY, low.shape[1]) * np.maximum(longest[size] ** 2 + (own * own).sum(axis=1) - 2 * least, 0) + 1e-9
                for i in range(0, len(own), BATCH):
                    query, cell = np.nonzero(box_distances(low, high, own[i : i + BATCH] @ projection(size)[:-1]) <= reach[i : i + BATCH, None])
                    n = slices[cell]
                    query, cell, part = np.repeat(query + i, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    more = (cells[cell] != column(rows, "cell").to_numpy()[query]) | (part != column(rows, "slice").to_numpy()[query])
                    query, cell, part = query[more], cell[more], part[more]
                    for j in range(0, len(query), 4 * BATCH):
                        q, c, p = query[j : j + 4 * BATCH], cell[j : j + 4 * BATCH], part[j : j + 4 * BATCH]
                        own_rows = rows.take(pa.array(q))
                        yield pa.RecordBatch.from_arrays([column(own_rows, "size"), pa.array(cells[c].astype(np.int32)), pa.array(p.astype(np.int32)), column(own_rows, "query_id"), column(own_rows, "v"), column(own_rows, "least")], ["size", "cell", "slice", "query_id", "q", "least"])

    visits = stage(limits.select(*shard, "query_id", "v", "least").mapInArrow(visit, "size int, cell int, slice int, query_id long, q array<double>, least double"), "visits")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.union(blocked(visits, "more")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest`` for the ``embeddings`` whose vec_id is divisible by 20, against all of them."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
