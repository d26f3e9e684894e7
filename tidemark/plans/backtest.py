"""Backtests of weights by time and asset: yesterday's weights earn today's returns, less turnover costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.elementwise import EPSILON, n0
from ..operators.axes import Series
from ..operators.timeseries import ret

YEAR = 252.0


def _along(by: Sequence[str] = ()) -> WindowSpec:
    """A portfolio's own rows: one for each time, so one task orders them; with ``by``, one task for each portfolio or span."""
    return Window.partitionBy(*by).orderBy("time") if by else Window.orderBy("time")


def portfolio_returns(panel: DataFrame, *, price: str = "px", weight: str = "weight", cost_bps: float = 5.0, s: Series = Series()) -> DataFrame:
    """``(time, gross, turnover, ret)`` from a panel ``(time, asset, price, weight)``.

    An asset's return counts with its weight one row before (none: 0), its turnover is the change of its weight; the
    first time has neither. Unknown returns count 0. ``ret`` is gross less turnover times ``cost_bps`` / 10000.
    """
    own = s.rows()
    legs = panel.select(
        F.col(s.time).alias("time"), F.lag(weight).over(own).alias("held"),
        F.coalesce(F.nanvl(ret(F.col(price), s), F.lit(0.0)), F.lit(0.0)).alias("r"),
        F.when(F.lag(weight).over(own).isNotNull(), F.abs(F.col(weight) - F.lag(weight).over(own))).alias("moved"),
    )
    sums = legs.groupBy("time").agg(F.sum(n0(F.col("held") * F.col("r"))).alias("gross"), F.sum(n0(F.col("moved"))).alias("turnover"))
    return sums.withColumn("ret", F.col("gross") - F.col("turnover") * (cost_bps / 10_000.0))


def cumulative(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(time, ret, equity, peak, drawdown)``; the peak starts at 1. ``by``: columns of which each value has its own."""
    so_far = _along(by).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(1.0 + F.col("ret")).over(so_far))
    return grown.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(so_far))).withColumn("drawdown", 1.0 - F.col("equity") / F.col("peak"))


def rolling_sharpe(returns: DataFrame, n: int = 20) -> DataFrame:
    """0 until n rows are there and where returns do not vary."""
    w = _along().rowsBetween(1 - n, 0)
    spread = F.stddev_pop("ret").over(w)
    full = (F.row_number().over(_along()) >= n) & (spread > EPSILON)
    return returns.withColumn("sharpe", F.when(full, F.avg("ret").over(w) / spread * F.sqrt(F.lit(YEAR))).otherwise(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > EPSILON, a / b).otherwise(0.0)


def metrics(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of ``by``: returns, Sharpe, drawdown, Sortino, Calmar, hit rate, average win over average loss, and annual turnover."""
    r = F.col("ret")
    facts = cumulative(returns, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.product(1.0 + r) - 1.0).alias("total_return"), F.avg(r).alias("m"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"),
        F.max("drawdown").alias("max_drawdown"), F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / F.count(F.lit(1))).alias("down"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("win"),
        F.coalesce(-F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("loss"), (F.sum("turnover") / F.count(F.lit(1)) * YEAR).alias("turnover"),
    )
    annual = facts.withColumn("annualized_return", F.pow(1.0 + F.col("total_return"), YEAR / F.col("n")) - 1.0)
    root = F.sqrt(F.lit(YEAR))
    return annual.select(
        *by, "n", "total_return", "annualized_return", (_ratio(F.col("m"), F.col("sd")) * root).alias("sharpe"), "max_drawdown",
        (_ratio(F.col("m"), F.col("down")) * root).alias("sortino"), _ratio(F.col("annualized_return"), F.col("max_drawdown")).alias("calmar"),
        "win_rate", _ratio(F.col("win"), F.col("loss")).alias("profit_factor"), "turnover",
    )


def against_benchmark(returns: DataFrame, benchmark: DataFrame, *, plain: bool = False) -> DataFrame:
    """One row from ``(time, ret)`` of both, joined by time: beta, annual alpha, correlation, tracking error, information and capture ratios.

    Where nothing varies, or the benchmark never rises or falls, beta and capture are 1 and the other ratios 0; with ``plain`` such a ratio is NULL.
    """
    joined = returns.select("time", F.col("ret").alias("p")).join(benchmark.select("time", F.col("ret").alias("b")), "time")
    p, b, active = F.col("p"), F.col("b"), F.col("p") - F.col("b")
    facts = joined.agg(
        F.avg(p).alias("mp"), F.avg(b).alias("mb"), F.covar_samp(p, b).alias("cov"), F.var_samp(b).alias("var"), F.stddev_samp(p).alias("sp"),
        F.stddev_samp(active).alias("te"), F.avg(active).alias("ma"), F.avg(F.when(b > 0, p)).alias("pu"), F.avg(F.when(b > 0, b)).alias("bu"), F.avg(F.when(b < 0, p)).alias("pd"), F.avg(F.when(b < 0, b)).alias("bd"),
    )

    def ratio(a: Column, b: Column, other: float) -> Column:
        return F.try_divide(a, b) if plain else F.when(b > EPSILON, a / b).otherwise(other)

    def capture(a: str, b: str) -> Column:
        return F.try_divide(a, b) if plain else F.coalesce(F.try_divide(a, b), F.lit(1.0))

    known = facts.withColumn("beta", ratio(F.col("cov"), F.col("var"), 1.0))
    return known.select(
        "beta", ((F.col("mp") - F.col("beta") * F.col("mb")) * YEAR).alias("alpha"), ratio(F.col("cov"), F.col("sp") * F.sqrt("var"), 0.0).alias("correlation"),
        (F.col("te") * F.sqrt(F.lit(YEAR))).alias("tracking_error"), (ratio(F.col("ma"), F.col("te"), 0.0) * F.sqrt(F.lit(YEAR))).alias("information_ratio"),
        capture("pu", "bu").alias("up_capture"), capture("pd", "bd").alias("down_capture"),
    )


def rolling_against(returns: DataFrame, benchmark: DataFrame, n: int = 20) -> DataFrame:
    """``(time, beta, correlation)`` over full windows, 0 before."""
    joined = returns.select("time", F.col("ret").alias("p")).join(benchmark.select("time", F.col("ret").alias("b")), "time")
    w = _along().rowsBetween(1 - n, 0)
    cov, var, both = F.covar_samp("p", "b").over(w), F.var_samp("b").over(w), F.stddev_samp("p").over(w) * F.stddev_samp("b").over(w)
    full = F.row_number().over(_along()) >= n
    return joined.select("time", F.when(full & (var > EPSILON), cov / var).otherwise(0.0).alias("beta"), F.when(full & (both > EPSILON), cov / both).otherwise(0.0).alias("correlation"))


METRICS = ("total_return", "annualized_return", "sharpe", "max_drawdown", "sortino", "calmar", "win_rate", "profit_factor", "turnover")


def folds(returns: DataFrame, *, train: int, test: int, step: int | None = None, expanding: bool = False) -> DataFrame:
    """``(fold, side, at, *returns)``: the rows of each fold, ``side`` being train or test and ``at`` a row's number from 0.

    Fold k tests the ``test`` rows that follow the first ``train`` + k ``step`` rows (``step``: ``test`` by default), and trains on the
    ``train`` rows before them, or on all with ``expanding``. Only whole folds count.
    """
    step = test if step is None else step
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be at least 1")
    at, last = F.col("at"), F.floor((F.col("__n") - train - test) / step)
    placed = returns.withColumn("at", F.row_number().over(_along()) - 1).join(F.broadcast(returns.agg(F.count(F.lit(1)).alias("__n"))))
    # a row is in a span of folds: from the first whose test reaches it to the last whose training has begun
    lowest = F.greatest(F.ceil((at - (train + test) + 1) / step), F.lit(0))
    highest = last if expanding else F.least(F.floor(at / step), last)
    each = placed.where(highest >= lowest).withColumn("fold", F.explode(F.sequence(lowest.cast("int"), highest.cast("int"))))
    side = F.when(at < train + F.col("fold") * step, "train").otherwise("test")
    return each.drop("__n").withColumn("side", side).select("fold", "side", "at", *returns.columns)


def walk_forward(returns: DataFrame, *, train: int, test: int, step: int | None = None, expanding: bool = False) -> DataFrame:
    """A row for each of the ``folds``: its first and last row numbers, ``train_`` and ``test_`` of all metrics, efficiency and overfit.

    Efficiency is the Sharpe ratio in the test over that in training (0 where that is 0); below a half the fold counts as overfit.
    """
    rows = folds(returns, train=train, test=test, step=step, expanding=expanding)
    spans = rows.groupBy("fold", "side").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"))
    told = metrics(rows, ("fold", "side")).join(spans, ["fold", "side"])
    own = [told.where(F.col("side") == side).select("fold", *(F.col(c).alias(f"{side}_{c}") for c in ("start", "end", *METRICS))) for side in ("train", "test")]
    efficiency = F.when(F.abs("train_sharpe") > EPSILON, F.col("test_sharpe") / F.col("train_sharpe")).otherwise(0.0)
    return own[0].join(own[1], "fold").withColumn("efficiency", efficiency).withColumn("overfit", F.col("efficiency") < 0.5)


def walk_forward_summary(told: DataFrame) -> DataFrame:
    """One row from ``walk_forward``'s: folds, mean Sharpe ratios, their ratio, and over the tests the sum of returns, the worst drawdown, means of the rest."""
    mean = {c: F.avg(f"test_{c}").alias(c) for c in ("sortino", "calmar", "win_rate", "profit_factor", "turnover")}
    sharpe = told.agg(F.count(F.lit(1)).alias("folds"), F.avg("train_sharpe").alias("train_sharpe"), F.avg("test_sharpe").alias("test_sharpe"), F.sum("test_total_return").alias("total_return"), F.max("test_max_drawdown").alias("max_drawdown"), F.sum(F.col("overfit").cast("int")).alias("overfit"), *mean.values())
    return sharpe.withColumn("efficiency", F.when(F.abs("train_sharpe") > EPSILON, F.col("test_sharpe") / F.col("train_sharpe")).otherwise(0.0))
