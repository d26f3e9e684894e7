"""Operators along an asset's rows. Windows hold fewer rows at a series' start; NULL counts as the operator's neutral value
where one is named, NaN is kept unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import EPSILON, div, known, n0, nan
from .axes import Series
from .scan import Channel, scanned


def lag(x: Column, s: Series, n: int = 1) -> Column:
    return F.lag(x, n).over(s.rows())


def lead(x: Column, s: Series, n: int = 1) -> Column:
    """Reads the future: not for signals."""
    return F.lead(x, n).over(s.rows())


def ret(x: Column, s: Series, n: int = 1) -> Column:
    return div(x, lag(x, s, n)) - 1.0


def delta(x: Column, s: Series, n: int = 1) -> Column:
    return x - lag(x, s, n)


def cumsum(x: Column, s: Series) -> Column:
    return F.sum(n0(x)).over(s.so_far())


def cumprod(x: Column, s: Series) -> Column:
    return F.product(F.coalesce(x, F.lit(1.0))).over(s.so_far())


def cummax(x: Column, s: Series) -> Column:
    return F.coalesce(F.max(known(x)).over(s.so_far()), F.lit(float("-inf")))


def cummin(x: Column, s: Series) -> Column:
    return F.coalesce(F.min(known(x)).over(s.so_far()), F.lit(float("inf")))


def ffill(x: Column, s: Series) -> Column:
    """The last known value."""
    return F.last(known(x), ignorenulls=True).over(s.so_far())


def rolling_mean(x: Column, s: Series, n: int = 20) -> Column:
    return F.avg(n0(x)).over(s.last(n))


def rolling_std(x: Column, s: Series, n: int = 20) -> Column:
    """Population deviation."""
    return F.stddev_pop(n0(x)).over(s.last(n))


def rolling_var(x: Column, s: Series, n: int = 20) -> Column:
    return F.var_pop(n0(x)).over(s.last(n))


def rolling_sum(x: Column, s: Series, n: int = 20) -> Column:
    return F.sum(n0(x)).over(s.last(n))


def rolling_min(x: Column, s: Series, n: int = 20) -> Column:
    return F.coalesce(F.min(known(x)).over(s.last(n)), F.lit(float("inf")))


def rolling_max(x: Column, s: Series, n: int = 20) -> Column:
    return F.coalesce(F.max(known(x)).over(s.last(n)), F.lit(float("-inf")))


def rolling_cov(x: Column, y: Column, s: Series, n: int = 20) -> Column:
    return F.covar_pop(n0(x), n0(y)).over(s.last(n))


def rolling_corr(x: Column, y: Column, s: Series, n: int = 20) -> Column:
    """0 where a side does not vary."""
    scale = rolling_std(x, s, n) * rolling_std(y, s, n)
    return F.when(scale > EPSILON, rolling_cov(x, y, s, n) / scale).otherwise(0.0)


def rolling_beta(x: Column, market: Column, s: Series, n: int = 20) -> Column:
    spread = rolling_var(market, s, n)
    return F.when(spread > EPSILON, rolling_cov(x, market, s, n) / spread).otherwise(0.0)


def decay_linear(x: Column, s: Series, n: int = 20) -> Column:
    """Weights 1..len, the newest heaviest, over n(n+1)/2 also where fewer rows are there."""
    rows = F.collect_list(n0(x)).over(s.last(n))
    return F.aggregate(F.transform(rows, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v) / F.lit(n * (n + 1) / 2.0)


def _window_values(x: Column, s: Series, n: int) -> Column:
    return F.collect_list(F.coalesce(x, nan())).over(s.last(n))


def ts_argmax(x: Column, s: Series, n: int = 20) -> Column:
    """Place in the window of its maximum, from 0, of equals the last; NaN is greatest."""
    rows = _window_values(x, s, n)
    return (F.size(rows) - F.array_position(F.reverse(rows), F.array_max(rows))).cast("double")


def ts_argmin(x: Column, s: Series, n: int = 20) -> Column:
    """Place in the window of its minimum, from 0, of equals the first."""
    rows = _window_values(x, s, n)
    return (F.array_position(rows, F.array_min(rows)) - 1).cast("double")


def ts_rank(x: Column, s: Series, n: int = 20) -> Column:
    """Share of the window's other rows below this one."""
    rows = _window_values(x, s, n)
    below = F.size(F.filter(rows, lambda v: (v < x) & ~F.isnan(x)))
    return F.when(x.isNull(), 0.0).otherwise(below / F.greatest(F.size(rows) - 1, F.lit(1)))


def _varies(x: Column, s: Series, n: int, then: Column) -> Column:
    return F.when(rolling_std(x, s, n) > EPSILON, then).otherwise(0.0)


def ts_skew(x: Column, s: Series, n: int = 20) -> Column:
    return _varies(x, s, n, F.skewness(n0(x)).over(s.last(n)))


def ts_kurt(x: Column, s: Series, n: int = 20) -> Column:
    """Excess kurtosis."""
    return _varies(x, s, n, F.kurtosis(n0(x)).over(s.last(n)))


def ts_product(x: Column, s: Series, n: int = 20) -> Column:
    return F.product(F.coalesce(x, F.lit(1.0))).over(s.last(n))


def ts_zscore(x: Column, s: Series, n: int = 20) -> Column:
    return _varies(x, s, n, (n0(x) - rolling_mean(x, s, n)) / rolling_std(x, s, n))


def full_window(x: Column, s: Series, n: int) -> Column:
    """NULL until n rows are there."""
    return F.when(F.row_number().over(s.rows()) >= n, x)


def atr(x: Column, s: Series, n: int = 14) -> Column:
    """Mean absolute change, the first row's being 0."""
    return F.avg(F.coalesce(F.abs(x - lag(x, s)), F.lit(0.0))).over(s.last(n))


def true_range_atr(high: Column, low: Column, close: Column, s: Series, n: int = 14) -> Column:
    before = F.lag(close).over(s.rows())
    spread = F.coalesce(F.greatest(high - low, F.abs(high - before), F.abs(low - before)), high - low)
    return F.avg(spread).over(s.last(n))


def vwap(price: Column, volume: Column, s: Series) -> Column:
    """Cumulative; 0 until there is volume."""
    total = F.sum(n0(volume)).over(s.so_far())
    return F.when(total > EPSILON, F.sum(n0(price) * n0(volume)).over(s.so_far()) / total).otherwise(0.0)


def scale_vol(x: Column, s: Series, target: float = 0.1, n: int = 20, periods: float = 252.0) -> Column:
    """Scaled to a target annual volatility of its own changes."""
    vol = rolling_std(x, s, n) * F.sqrt(F.lit(periods))
    return F.when(vol > EPSILON, x * target / vol).otherwise(0.0)


# Recursive operators: the state after a row depends on all rows before it.


def _ema(span: int) -> dict[str, Channel]:
    return {f"x{span}": ("x", 2.0 / (span + 1))}


def _rsi(n: int) -> dict[str, Channel]:
    return {f"{kind}{n}": (kind, 1.0 / n) for kind in ("gain", "loss")}


def _rsi_of(n: int) -> Column:
    gain, loss = F.col(f"__gain{n}"), F.col(f"__loss{n}")
    return F.when(loss > EPSILON, 100.0 - 100.0 / (1.0 + gain / loss)).when(gain > EPSILON, 100.0).otherwise(50.0)


_RECURSIVE = {
    "ema": (_ema, lambda span: F.col(f"__x{span}")),
    "macd": (lambda fast, slow: _ema(fast) | _ema(slow), lambda fast, slow: F.col(f"__x{fast}") - F.col(f"__x{slow}")),
    "rsi": (_rsi, _rsi_of),
}


def recursive(df: DataFrame, column: str, name: str, s: Series, **calls: tuple) -> DataFrame:
    """``df`` with one column for each call, e.g. ``recursive(df, "px", "ema", s, ema20=(20,))``: all calls share one pass.

    Names: ``ema(span)``, ``macd(fast, slow)``, ``macd_histogram(fast, slow, signal)`` (both seeded with the first value),
    ``rsi(window)`` (averages seeded with 0, the first row 50). NULL and NaN count as 0. An asset is spread over many tasks.
    """
    if name == "macd_histogram":
        lined = recursive(df, column, "macd", s, **{f"__line_{k}": args[:2] for k, args in calls.items()})
        for k, args in calls.items():
            lined = recursive(lined, f"__line_{k}", "ema", s, **{f"__signal_{k}": args[2:]})
        return lined.select(*df.columns, *((F.col(f"__line_{k}") - F.col(f"__signal_{k}")).alias(k) for k in calls))
    channels, told = _RECURSIVE[name]
    wanted = {f"__{k}": v for args in calls.values() for k, v in channels(*args).items()}
    return scanned(df, column, s, wanted).select(*df.columns, *(told(*args).alias(k) for k, args in calls.items()))
