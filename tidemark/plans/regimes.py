"""Hidden regimes of return series: Gaussian filters of few states, fitted for each asset or for all at once, and clusters of mean and volatility."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.axes import Series
from ..operators.selection import exact_quantiles
from ..storage import scratch, stage


ROWS = 200_000  # of whole assets, that a task fits together


def _filtered(x: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Each state's chance after each value, given the asset's values up to it; ``mean`` and ``std`` are of each asset, the longest first."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    out, now = np.empty((len(x), len(start))), np.broadcast_to(start, (len(sizes), len(start)))
    rows = np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(x))
    out[rows] = np.maximum(np.exp(-0.5 * ((x[rows][:, None] - mean[own]) / std[own]) ** 2) / std[own], 1e-300)
    left = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # assets that have more values than so many
    for i, n in enumerate(left):  # all assets' i-th values at once
        at = begins[:n] + i
        now = (now[:n] if i == 0 else now[:n] @ move) * out[at]
        now = now / now.sum(axis=1, keepdims=True)
        out[at] = now
    return out


def _fit(x: np.ndarray, begins: np.ndarray, states: int, rounds: int) -> np.ndarray:
    """Chances for several assets, one from each of ``begins`` on, each with means and deviations of its own, re-estimated from filtered chances;
    staying in a state has chance 0.95. States are in order of their means."""
    sizes = np.diff(np.append(begins, len(x)))

    def sums(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, begins, axis=0)

    def each(v: np.ndarray) -> np.ndarray:
        return np.repeat(v, sizes, axis=0)

    ranked = x[np.lexsort((x, each(np.arange(len(sizes)))))]
    place = (sizes[:, None] - 1) * ((np.arange(states) + 0.5) / states)
    low = np.floor(place).astype(int)
    below, above = ranked[begins[:, None] + low], ranked[begins[:, None] + np.minimum(low + 1, sizes[:, None] - 1)]
    mean = below + (above - below) * (place - low)
    spread = np.sqrt(sums((x - each(sums(x) / sizes)) ** 2) / sizes)
    std = np.repeat(np.maximum(spread, 1e-6)[:, None], states, axis=1)
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95)
    start = np.full(states, 1 / states)
    longest = np.argsort(-sizes, kind="stable")

    def filtered() -> np.ndarray:
        return _filtered(x, begins[longest], sizes[longest], start, move, mean[longest], std[longest])

    for _ in range(rounds):
        p = filtered()
        weight = sums(p) + 1e-12
        mean = sums(p * x[:, None]) / weight
        std = np.maximum(np.sqrt(sums(p * (x[:, None] - each(mean)) ** 2) / weight), 1e-6)
    order = np.argsort(mean, axis=1, kind="stable")
    mean, std = np.take_along_axis(mean, order, 1), np.take_along_axis(std, order, 1)
    return filtered()


def _whole_assets(batches: Iterator[pa.RecordBatch], asset: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by asset, in tables of whole assets of about ``ROWS`` rows, and where each asset begins."""
    held, size, enough = [], 0, ROWS

    def cut() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        codes = table.column(asset).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return table, np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            table, begins = cut()
            if len(begins) > 1:  # the last may go on
                yield table[: begins[-1]], begins[:-1]
                held = table[begins[-1] :].to_batches()
                size = len(table) - begins[-1]
            enough = max(ROWS, 2 * size)
    if held:
        yield cut()


def hidden_regimes(df: DataFrame, ret: str = "ret", *, states: int = 2, rounds: int = 20, s: Series = Series()) -> DataFrame:
    """``df`` with the likeliest state of each row (0: lowest mean) and its chance. NULL and NaN count as 0; a task fits whole assets, many at once,
    so it holds ``ROWS`` rows, or twice the longest asset's."""
    schema = T.StructType([*df.schema, T.StructField("state", T.IntegerType()), T.StructField("chance", T.DoubleType())])
    order = [F.col(c).asc_nulls_last() for c in (s.time, *s.ties)]
    x = F.coalesce(F.nanvl(F.col(ret).cast("double"), F.lit(0.0)), F.lit(0.0))
    dealt = df.repartition(s.asset).sortWithinPartitions(s.asset, *order).withColumn("__x", x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _whole_assets(batches, s.asset):
            p = _fit(table.column("__x").to_numpy(), begins, states, rounds)
            told = table.drop_columns("__x").append_column("state", pa.array(p.argmax(axis=1).astype("int32"))).append_column("chance", pa.array(p.max(axis=1)))
            yield from told.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, schema)


@dataclass(frozen=True)
class Regimes:
    """A Gaussian for each state, the chances of the first state, and those of moving from state to state."""

    mean: tuple[float, ...]
    std: tuple[float, ...]
    start: tuple[float, ...]
    move: tuple[tuple[float, ...], ...]

    @staticmethod
    def sticky(mean: tuple[float, ...], std: tuple[float, ...], stay: float = 0.95) -> Regimes:
        """Every state starts alike and is left with the same chance."""
        k = len(mean)
        return Regimes(mean, std, (1 / k,) * k, tuple(tuple(stay if i == j else (1 - stay) / max(k - 1, 1) for j in range(k)) for i in range(k)))

    def density(self, x: np.ndarray) -> np.ndarray:
        """Up to a factor of each value: the greatest of a row is 1."""
        mean, std = np.array(self.mean), np.array(self.std)
        log = -0.5 * ((x[:, None] - mean) / std) ** 2 - np.log(std)
        return np.exp(log - log.max(axis=1, keepdims=True))


def _products(steps: np.ndarray) -> np.ndarray:
    """Each matrix becomes the product of all up to it, each scaled to a sum of 1: chances need no more, and nothing under- or overflows."""
    out, reach = steps / steps.sum(axis=(1, 2), keepdims=True), 1
    while reach < len(out):
        joined = out[:-reach] @ out[reach:]
        out = np.concatenate((out[:reach], joined / joined.sum(axis=(1, 2), keepdims=True)))
        reach *= 2
    return out


def filtered_regimes(df: DataFrame, regimes: Regimes, ret: str = "ret", *, s: Series = Series()) -> DataFrame:
    """``df`` with ``state``, the likeliest of each row given the asset's rows up to it (of equals the first), and ``chances`` of all states.

    The filter is a product of matrices along an asset's rows, so it is a scan: the panel is sorted over all tasks, a task multiplies the
    matrices of its block, one row for each block tells the chances that the block begins with, and Columns put them in. An asset of
    any length is many blocks. NULL and NaN count as 0; a NULL asset is an asset.
    """
    k = len(regimes.mean)
    order = [s.asset, s.time, *s.ties]
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__block", F.spark_partition_id()).withColumn("__x", F.coalesce(F.nanvl(F.col(ret).cast("double"), F.lit(0.0)), F.lit(0.0)))
    move, start = np.array(regimes.move), np.array(regimes.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, state = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            assets = batch.column(batch.schema.get_field_index(s.asset)).to_pandas()
            codes = pd.factorize(pd.concat([pd.Series([last], dtype=object), assets.astype(object)]), use_na_sentinel=False)[0]
            begins = codes[1:] != codes[:-1]
            density = regimes.density(batch.column(batch.schema.get_field_index("__x")).to_numpy())
            steps = move[None] * density[:, None, :]
            steps[begins] = np.broadcast_to((start * density[begins])[:, None, :], (begins.sum(), k, k))  # whatever was before
            if not seen:  # the block's first row may go on from the block before; which it is is told later
                steps[0] = np.eye(k)
            else:
                steps[0] = state @ steps[0]
            out = _products(steps)
            place = np.arange(seen, seen + len(density))
            last, seen, state = assets.iloc[-1], seen + len(density), out[-1]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), k * k).cast(pa.list_(pa.float64()))
            own = pa.FixedSizeListArray.from_arrays(pa.array(density.reshape(-1)), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), own, flat], [*batch.schema.names, "__place", "__density", "__product"])

    schema = T.StructType([*spread.schema, T.StructField("__place", T.LongType()), T.StructField("__density", T.ArrayType(T.DoubleType())), T.StructField("__product", T.ArrayType(T.DoubleType()))])
    blocks = stage(spread.mapInArrow(run, schema), "regimes")
    ends = F.struct(F.col(s.asset).alias("asset"), "__density", "__product")
    told = blocks.groupBy("__block").agg(F.min_by(ends, "__place").alias("first"), F.max_by(ends, "__place").alias("last")).orderBy("__block").collect()
    begun, before = [], None
    for block in told:
        first, last = block["first"], block["last"]
        prior = before[1] @ move if before is not None and before[0] == first["asset"] else start
        entered = prior * np.array(first["__density"])
        entered = entered / entered.sum()
        begun.append((block["__block"], entered.tolist()))
        after = entered @ np.array(last["__product"]).reshape(k, k)
        before = (last["asset"], after / after.sum())
    table = df.sparkSession.createDataFrame(begun, "__block int, __in array<double>")
    raw = [sum((F.col("__in")[i] * F.col("__product")[i * k + j] for i in range(k)), F.lit(0.0)) for j in range(k)]
    total = sum(raw[1:], raw[0])
    chances = blocks.join(F.broadcast(table), "__block").select(*(F.col(f"`{c}`") for c in df.columns if c not in ("state", "chances")), F.array(*(x / total for x in raw)).alias("chances"))
    return chances.withColumn("state", (F.array_position("chances", F.array_max("chances")) - 1).cast("int"))


def fitted_regimes(df: DataFrame, ret: str = "ret", *, states: int = 2, rounds: int = 5, stay: float = 0.95, s: Series = Series()) -> Regimes:
    """One set of regimes for all assets' rows: Gaussians re-estimated ``rounds`` times from the filtered chances, in order of means.

    They begin at the middles of ``states`` equal parts of the values, exact quantiles of all rows, with the deviation of all. A round
    is one scan, and sums of three numbers a state in the tasks; nothing but these comes to the driver. NULL and NaN count as 0.
    """
    x = F.coalesce(F.nanvl(F.col(ret).cast("double"), F.lit(0.0)), F.lit(0.0))
    own = df.select(*dict.fromkeys((s.asset, s.time, *s.ties)), x.alias("__ret"))
    spread = own.agg(F.stddev_pop("__ret")).first()[0]
    if spread is None:
        raise ValueError("no rows to fit")
    now = Regimes.sticky(tuple(exact_quantiles(own, {"__ret": [(i + 0.5) / states for i in range(states)]})["__ret"]), (max(spread, 1e-6),) * states, stay)
    for _ in range(rounds):
        with scratch(df.sparkSession):
            p = filtered_regimes(own, now, "__ret", s=s)
            weight = [F.col("chances")[i] for i in range(states)]
            row = p.agg(*(f(w).alias(f"{k}{i}") for i, w in enumerate(weight) for k, f in (("n", F.sum), ("m", lambda w: F.sum(w * F.col("__ret"))), ("q", lambda w, i=i: F.sum(w * (F.col("__ret") - now.mean[i]) * (F.col("__ret") - now.mean[i])))))).first()
        n = [row[f"n{i}"] + 1e-12 for i in range(states)]
        mean = [row[f"m{i}"] / n[i] for i in range(states)]
        # squares about the mean before, moved to the new one
        std = [max(row[f"q{i}"] / n[i] - (mean[i] - now.mean[i]) ** 2, 0.0) ** 0.5 for i in range(states)]
        now = replace(now, mean=tuple(mean), std=tuple(max(v, 1e-6) for v in std))
    order = np.argsort(now.mean, kind="stable").tolist()
    return replace(now, mean=tuple(now.mean[i] for i in order), std=tuple(now.std[i] for i in order))


def clustered_regimes(df: DataFrame, ret: str = "ret", *, clusters: int = 3, n: int = 20, s: Series = Series(), seed: int = 3) -> DataFrame:
    """``df`` with the cluster (0: lowest mean return) of its window's mean and volatility, over the rows with a full window."""
    full = df.withColumns({"__mean": F.avg(ret).over(s.last(n)), "__vol": F.stddev_pop(ret).over(s.last(n)), "__n": F.count(ret).over(s.last(n))}).where(F.col("__n") >= n)
    vectors = VectorAssembler(inputCols=["__mean", "__vol"], outputCol="__v").transform(full)
    model = KMeans(k=clusters, featuresCol="__v", predictionCol="__c", seed=seed).fit(vectors)
    order = {int(old): new for new, old in enumerate(np.argsort([c[0] for c in model.clusterCenters()], kind="stable"))}
    named = F.element_at(F.create_map(*(F.lit(v) for pair in order.items() for v in pair)), F.col("__c"))
    return model.transform(vectors).withColumn("cluster", named).drop("__mean", "__vol", "__n", "__v", "__c")
