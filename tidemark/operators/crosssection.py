"""Operators across the assets of one time, and weights made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import EPSILON, known, n0
from .axes import Section


def rank(x: Column, s: Section) -> Column:
    """Ordinal rank over the number of rows: 1/n for the least, 1 for the greatest, equal values by asset, NaN and NULL last."""
    return F.row_number().over(s.by(x)) / F.count(F.lit(1)).over(s.rows())


def rank_pct(x: Column, s: Section) -> Column:
    return rank(x, s) * 100.0


def mean(x: Column, s: Section) -> Column:
    return F.avg(x).over(s.rows())


def std(x: Column, s: Section, ddof: int = 0) -> Column:
    return (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(s.rows())


def total(x: Column, s: Section) -> Column:
    return F.sum(x).over(s.rows())


def count(x: Column, s: Section) -> Column:
    return F.count(x).over(s.rows())


def zscore(x: Column, s: Section, ddof: int = 0) -> Column:
    """0 where the section does not vary."""
    spread = std(x, s, ddof)
    return F.when(x.isNotNull(), F.when(spread > EPSILON, (x - mean(x, s)) / spread).otherwise(0.0))


def scale(x: Column, s: Section, mode: str = "gross") -> Column:
    """Over the sum of absolute values (tiny: 0), or ``net`` over the signed sum (tiny: unchanged)."""
    if mode == "gross":
        size = F.sum(F.abs(x)).over(s.rows())
        return F.when(x.isNotNull(), F.when(size > EPSILON, x / size).otherwise(0.0))
    size = F.sum(x).over(s.rows())
    return F.when(F.abs(size) < EPSILON, x).otherwise(x / size)


def demean(x: Column, s: Section) -> Column:
    return x - mean(x, s)


def neutralize(x: Column, s: Section, *groups: str) -> Column:
    """Less the mean of the row's group at that time (without groups: of all)."""
    return demean(x, Section(s.time, s.asset, tuple(groups)))


def group_mean(x: Column, s: Section, *groups: str) -> Column:
    return mean(x, Section(s.time, s.asset, tuple(groups)))


def _at_places(df: DataFrame, column: str, s: Section, **places: Column) -> DataFrame:
    """``df`` with the values at 0-based places among the section's known values (``__n`` in number), in ascending order.

    Places and values are two windows over one sort of the section, so nothing is gathered in a row.
    """
    x = F.col(column)
    placed = df.withColumns({"__place": F.row_number().over(s.by(x)) - 1, "__n": F.count(known(x)).over(s.rows())})
    return placed.withColumns({k: F.max(F.when((F.col("__place") == at) & (F.col("__place") < F.col("__n")), x)).over(s.rows()) for k, at in places.items()}).drop("__place", "__n")


def winsor(df: DataFrame, column: str, s: Section, p: float = 0.01, name: str | None = None) -> DataFrame:
    """``column`` (or ``name``) clipped to the values at places floor(n p) and floor(n (1 - p)) of the section's known values, without interpolation."""
    x, n = F.col(column), F.col("__n")
    bounded = _at_places(df, column, s, __low=F.floor(n * F.lit(p)), __high=F.least(F.floor(n * F.lit(1 - p)), n - 1))
    clipped = F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.col("__low")), F.col("__high"))).otherwise(x)
    return bounded.withColumn(name or column, clipped).drop("__low", "__high")


def quantile(df: DataFrame, column: str, s: Section, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """``name``: the value at place floor((n - 1) q) of the section's known values."""
    return _at_places(df, column, s, __value=F.floor((F.col("__n") - 1) * F.lit(q))).withColumnRenamed("__value", name)


def bucket(x: Column, s: Section, n: int = 5) -> Column:
    return F.least(F.greatest(F.ceil(rank(x, s) * n), F.lit(1)), F.lit(n)).cast("double")


def median(x: Column, s: Section) -> Column:
    return F.median(x).over(s.rows())


def mad(deviation_from_median: Column, s: Section) -> Column:
    """Median absolute deviation, given ``x - median(x)`` as a column of its own (NULL counts as 0)."""
    return F.median(F.abs(n0(deviation_from_median))).over(s.rows())


def long_short(x: Column, s: Section, top: float = 0.2, bottom: float = 0.2, cap: float = 0.05) -> Column:
    """Equal weights for the top and bottom shares by rank, each capped."""
    r, n = rank(x, s), F.count(F.lit(1)).over(s.rows())
    up = F.least(F.lit(cap), 1.0 / (n * top)) if top > 0 else F.lit(0.0)
    down = F.greatest(F.lit(-cap), -1.0 / (n * bottom)) if bottom > 0 else F.lit(0.0)
    return F.when(r >= 1 - top, up).when(r <= bottom, down).otherwise(0.0)


def extreme_weights(x: Column, s: Section, share: float = 0.2) -> Column:
    """1/k for the k = ceil(share n) greatest of the n known values, -1/k for the k least, 0 for the rest; the longs go first where both overlap."""
    n = F.count(known(x)).over(s.rows())
    k = F.ceil(n * F.lit(share))
    place = F.row_number().over(s.by(x))
    return F.when(place > n, 0.0).when(place > n - k, 1.0 / k).when(place <= k, -1.0 / k).otherwise(0.0)
