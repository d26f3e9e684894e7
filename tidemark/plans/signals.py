"""Ready-made signals: each adds a ``signal`` column to a panel ``(time, asset, px, ...)``. None reads a later row.

A signal from several levels of operators takes its time-series part first and its cross-section last, so a panel is dealt by asset once
and by time once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import div
from ..operators import crosssection as xs
from ..operators import timeseries as ts
from ..operators.axes import Section, Series


def _scored(df: DataFrame, raw: Column, across: Section, p: float = 0.01) -> DataFrame:
    """z-scores of the winsorised values."""
    return xs.winsor(df.withColumn("__raw", raw), "__raw", across, p).withColumn("signal", xs.zscore(F.col("__raw"), across)).drop("__raw")


def momentum(df: DataFrame, n: int = 20, along: Series = Series(), across: Section = Section()) -> DataFrame:
    return _scored(df, ts.ret(F.col("px"), along, n), across)


def mean_reversion(df: DataFrame, n: int = 20, along: Series = Series(), across: Section = Section()) -> DataFrame:
    return _scored(df, -ts.ts_zscore(F.col("px"), along, n), across)


def vol_adjusted_momentum(df: DataFrame, n: int = 20, window: int = 20, along: Series = Series(), across: Section = Section()) -> DataFrame:
    staged = df.withColumns({"__one": ts.ret(F.col("px"), along, 1), "__move": ts.ret(F.col("px"), along, n)})
    return _scored(staged, F.col("__move") / F.greatest(ts.rolling_std(F.col("__one"), along, window), F.lit(1e-6)), across).drop("__one", "__move")


def trend(df: DataFrame, fast: int = 10, slow: int = 50, along: Series = Series(), across: Section = Section()) -> DataFrame:
    px = F.col("px")
    return _scored(df, div(ts.rolling_mean(px, along, fast), ts.rolling_mean(px, along, slow)) - 1.0, across)


def rsi_reversal(df: DataFrame, n: int = 14, along: Series = Series(), across: Section = Section()) -> DataFrame:
    return _scored(ts.recursive(df, "px", "rsi", along, __rsi=(n,)), 50.0 - F.col("__rsi"), across).drop("__rsi")


def breakout(df: DataFrame, n: int = 20, along: Series = Series(), across: Section = Section()) -> DataFrame:
    """Place in the window's range, from -1 to 1."""
    px, high, low = F.col("px"), ts.rolling_max(F.col("px"), along, n), ts.rolling_min(F.col("px"), along, n)
    return _scored(df, F.when(high > low, 2.0 * (px - low) / (high - low) - 1.0).otherwise(0.0), across)


def ranked_momentum(df: DataFrame, n: int = 120, skip: int = 20, along: Series = Series(), across: Section = Section()) -> DataFrame:
    """Rank of the return from n to ``skip`` rows ago."""
    past = div(ts.lag(F.col("px"), along, skip), ts.lag(F.col("px"), along, n)) - 1.0
    return df.withColumn("__raw", past).withColumn("signal", xs.rank(F.col("__raw"), across)).drop("__raw")


def quality(df: DataFrame, good: list[str], bad: list[str], across: Section = Section()) -> DataFrame:
    """Mean z-score of the columns that speak for an asset less that of those against it."""
    scores = {f"__{c}": xs.zscore(F.col(c), across) for c in (*good, *bad)}
    staged = df.withColumns(scores)
    total = sum((F.col(f"__{c}") for c in good), F.lit(0.0)) - sum((F.col(f"__{c}") for c in bad), F.lit(0.0))
    return staged.withColumn("signal", total / (len(good) + len(bad))).drop(*scores)
