"""Recursions ``state = decay * state + input`` along an asset's rows, as a prefix scan of affine maps over blocks of rows.

The panel is sorted by asset and time over all tasks, so a long asset is many blocks. A task composes the maps of its block from an unknown
state before it; one row for each block then tells every block the state that it begins with, and Columns put it in. The newest values, for moving
windows, are told likewise: a block has all but those from before it, of which the block's first rows alone have need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stage
from .axes import Series

Channel = tuple[str, float]  # input (x, gain, loss, sum or count) and its share of the new state; the rest is the decay, but sums and counts keep all


def _inputs(kind: str, x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A row's input, of the values there and one row before."""
    if kind == "count":
        return np.ones_like(x)
    return x if kind in ("x", "sum") else np.maximum(x - before, 0.0) if kind == "gain" else np.maximum(before - x, 0.0)


def _begun(kind: str, x: np.ndarray) -> np.ndarray:
    """The state after an asset's first row."""
    return x if kind in ("x", "sum") else np.full_like(x, float(kind == "count"))


def _composed(slope: np.ndarray, offset: np.ndarray) -> None:
    """In place: each row's map becomes the composition of all up to it, in as many passes as the doubling of reach takes until slopes vanish."""
    reach = 1
    while reach < len(slope) and slope[reach:].any():
        offset[reach:] += np.where(slope[reach:] == 0.0, 0.0, slope[reach:] * offset[:-reach])
        slope[reach:] = slope[reach:] * slope[:-reach]
        reach *= 2


def _spans(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the ``sizes`` newest values up to each of ``at``."""
    ends = np.cumsum(sizes)
    return np.repeat(at + 1 - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _moments(line: np.ndarray, at: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the ``n`` newest values up to each of ``at``, or of the ``known`` ones if fewer."""
    size = np.minimum(known, n)
    back = lambda k: line[np.maximum(at - k, 0)]
    mean = sum(np.where(size > k, back(k), 0.0) for k in reversed(range(n))) / size
    return mean, np.sqrt(sum(np.where(size > k, (back(k) - mean) ** 2, 0.0) for k in reversed(range(n))) / size)


def newest(rows: Column, n: int) -> Column:
    size = F.size(rows)
    return F.slice(rows, F.greatest(size - n, F.lit(0)) + 1, F.least(size, F.lit(n)))


def scanned(df: DataFrame, column: str, s: Series, channels: dict[str, Channel]) -> DataFrame:
    """``df`` with a column of each channel's state after the row.

    An asset begins with its first value (``x`` and ``sum``), with 1 (``count``) or with 0 (``gain`` and ``loss``, the changes up and down).
    NULL and NaN count as 0, a NULL asset is an asset. Sorted once, whatever the number of channels; an asset of any length is spread
    over the tasks, and what the driver sees is one row for each.
    """
    return scanned_on(df, column, s, channels).select(*(F.col(f"`{c}`") for c in (*df.columns, *channels)))


def scanned_on(df: DataFrame, column: str, s: Series, channels: dict[str, Channel], windows: tuple[int, ...] = (), width: int = 0, held: DataFrame | None = None) -> DataFrame:
    """``scanned`` of rows that go on from earlier ones, with ``__mean_n`` and ``__std_n`` of the n newest values for each n of ``windows``.

    ``held`` has a row for each asset that had rows: ``asset``, its ``width`` newest values in ``tail``, the ``last`` of them and all channels.
    It goes before the asset's rows, is told with them, and is no row of ``df`` (``__row`` is false). ``__end`` marks, for each asset and
    perhaps beside others, its last row by ``__block`` and ``__place``; there ``__tail`` has the ``width`` newest values, with ``__x`` the last.
    """
    names, kinds, shares = list(channels), [k for k, _ in channels.values()], np.array([a for _, a in channels.values()])
    decays = [1.0 if k in ("sum", "count") else 1.0 - a for k, a in channels.values()]
    x = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumns({"__x": x, "__row": F.lit(True)})
    if held is not None:
        own = held.select(F.col("asset").alias(s.asset), F.col("last").alias("__x"), F.lit(False).alias("__row"), F.struct("tail", *names).alias("__held"))
        rows = rows.withColumn("__held", F.lit(None).cast(own.schema["__held"].dataType)).unionByName(own, allowMissingColumns=True)
    order = [s.asset, "__row", s.time, *s.ties]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__block", F.spark_partition_id())
    passed = [c for c in spread.columns if c != "__held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_x, seen = None, 0.0, 0
        state, decay = np.zeros(len(names)), np.ones(len(names))
        carry, unknown = np.zeros(0), True  # newest values of the asset at hand, and whether it may have begun before the block
        for batch in batches:
            if not batch.num_rows:
                continue
            column_of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            assets = column_of[s.asset].to_pandas()
            codes = pd.factorize(pd.concat([pd.Series([last], dtype=object), assets.astype(object)]), use_na_sentinel=False)[0]
            starts = codes[1:] != codes[:-1]
            starts[0] = starts[0] and seen > 0
            x = column_of["__x"].to_numpy(zero_copy_only=False).astype(float)
            sizes, known = np.ones(len(x), int), np.zeros(0, int)  # of values that a row brings, and rows that bring a state
            if "__held" in column_of:
                known = np.flatnonzero(~column_of["__row"].to_numpy(zero_copy_only=False))
                entered = dict(zip(("tail", *names), column_of["__held"].take(pa.array(known)).flatten(), strict=True))
                starts[known] = True
                sizes[known] = entered["tail"].value_lengths().to_numpy(zero_copy_only=False)
            before = np.concatenate(([last_x], x[:-1]))
            out = []
            for j, kind in enumerate(kinds):
                slope, offset = np.where(starts, 0.0, decays[j]), np.where(starts, _begun(kind, x), shares[j] * _inputs(kind, x, before))
                if len(known):
                    offset[known] = entered[names[j]].to_numpy(zero_copy_only=False).astype(float)
                if not seen and not starts[0]:  # the state after the block's first row is the unknown
                    slope[0], offset[0] = 1.0, 0.0
                elif slope[0]:
                    offset[0] += slope[0] * state[j]
                    slope[0] *= decay[j]
                _composed(slope, offset)
                state[j], decay[j] = offset[-1], slope[-1]
                out += [pa.array(offset), pa.array(slope)]
            place, ends = np.arange(seen, seen + len(x)), np.append(starts[1:], True)
            out = [pa.array(place), pa.array(ends), *out]
            if width:
                at, begins = len(carry) + np.cumsum(sizes) - 1, np.flatnonzero(starts)
                line = np.empty(len(carry) + sizes.sum())
                line[: len(carry)] = carry
                line[at] = x
                if len(known):
                    line[_spans(at[known], sizes[known])] = entered["tail"].flatten().to_numpy(zero_copy_only=False)
                segment = np.cumsum(starts)
                count = at + 1 - np.concatenate(([0], at[begins] + 1 - sizes[begins]))[segment]  # of the asset's values that the block knows
                cut = (segment == 0) & unknown & (count < width)
                listed = np.where(ends | cut, np.minimum(count, width), 0)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(listed))), pa.int32()), pa.array(line[_spans(at, listed)]))
                out += [pa.array(cut), values, *(pa.array(v) for n in windows for v in _moments(line, at, count, n))]
                carry, unknown = line[at[-1] + 1 - min(count[-1], width) : at[-1] + 1].copy(), unknown and not len(begins)
            last, last_x, seen = assets.iloc[-1], x[-1], seen + len(x)
            yield pa.RecordBatch.from_arrays([*(column_of[c] for c in passed), *out], [*passed, *(f.name for f in fields)])

    double = T.DoubleType()
    fields = [T.StructField("__place", T.LongType()), T.StructField("__end", T.BooleanType()), *(T.StructField(f"__{k}_{n}", double) for n in names for k in ("at", "of"))]
    if width:
        fields += [T.StructField("__cut", T.BooleanType()), T.StructField("__own", T.ArrayType(double)), *(T.StructField(f"__{k}_{n}", double) for n in windows for k in ("mean", "std"))]
    blocks = stage(spread.mapInArrow(run, T.StructType([*(spread.schema[c] for c in passed), *fields])), "scan")
    tails = [F.col(c).alias(c[2:]) for c in ("__cut", "__own") if width]
    edge = F.struct(F.col(s.asset).alias("asset"), F.col("__x").alias("x"), *tails, *(F.col(f"__{k}_{n}").alias(f"{k}_{n}") for n in names for k in ("at", "of")))
    told = blocks.where("__place = 0 or __end").groupBy("__block").agg(F.min_by(edge, "__place").alias("first"), F.max_by(edge, "__place").alias("last")).orderBy("__block").collect()
    begun, before = [], None
    for block in told:
        first, last = block["first"], block["last"]
        goes_on = before is not None and before[0] == first["asset"]
        x, was = np.array([first["x"]]), np.array([before[1] if goes_on else 0.0])
        after = [decays[j] * before[2][j] + shares[j] * _inputs(kinds[j], x, was)[0] if goes_on else _begun(kinds[j], x)[0] for j in range(len(names))]
        tail = before[3] if goes_on else []
        begun.append((block["__block"], *map(float, after), tail))
        states = [last[f"at_{n}"] + (last[f"of_{n}"] and last[f"of_{n}"] * after[j]) for j, n in enumerate(names)]
        before = (last["asset"], last["x"], states, [*(tail if last["cut"] else []), *last["own"]][-width:] if width else [])
    table = df.sparkSession.createDataFrame(begun, ", ".join(["__block int", *(f"`__in_{n}` double" for n in names), "__in_tail array<double>"]))
    states = {n: F.when(F.col(f"__of_{n}") == 0.0, F.col(f"__at_{n}")).otherwise(F.col(f"__at_{n}") + F.col(f"__of_{n}") * F.col(f"__in_{n}")) for n in names}
    if width:
        states["__tail"] = tail = F.when(F.col("__cut"), newest(F.concat("__in_tail", "__own"), width)).otherwise(F.col("__own"))
        for n in windows:
            last_n = newest(tail, n)
            mean = F.aggregate(last_n, F.lit(0.0), lambda a, v: a + v) / F.size(last_n)
            std = F.sqrt(F.aggregate(last_n, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(last_n))  # noqa: B023
            states |= {f"__{k}_{n}": F.when(F.col("__cut"), v).otherwise(F.col(f"__{k}_{n}")) for k, v in (("mean", mean), ("std", std))}
    return blocks.join(F.broadcast(table), "__block").withColumns(states)
