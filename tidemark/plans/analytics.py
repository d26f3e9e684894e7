"""Costs, constraints, attribution, risk, factors, regimes, data quality, corporate actions and universes as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import EPSILON
from ..operators.axes import Section, Series
from ..operators.selection import exact_quantiles, order_statistics
from ..storage import stage
from .backtest import YEAR, cumulative

# --- costs

COST_MODELS = {  # fixed values: basis points, shape and coefficient of impact, annual borrow rates and least sizes of a trade by model
    "zero": {"commission_bps": 0.0, "slippage_bps": 0.0, "shape": "none", "impact": 0.0, "borrow": 0.0, "least": 0.0},
    "default": {"commission_bps": 1.0, "slippage_bps": 2.0, "shape": "sqrt", "impact": 0.1, "borrow": 0.005, "least": 0.0},
    "institutional": {"commission_bps": 0.5, "slippage_bps": 1.0, "shape": "sqrt", "impact": 0.05, "borrow": 0.003, "least": 10_000.0},
    "retail": {"commission_bps": 5.0, "slippage_bps": 5.0, "shape": "linear", "impact": 0.5, "borrow": 0.02, "least": 0.0},
}


def trade_costs(notional: Column, adv: Column, *, commission_bps: float, slippage_bps: float, impact: float, borrow: float, shape: str = "sqrt", eta: float = 0.1, gamma: float = 0.1, least: float = 0.0, is_short: Column | None = None, days: Column | float = 0.0) -> dict[str, Column]:
    """A trade's ``commission``, ``slippage``, ``impact`` and ``borrow``, and their ``total``.

    Impact is by the share of daily volume ``adv`` (linear, sqrt or almgren-chriss), 0 where that is NULL or not positive. Only a short
    (given, or else of negative notional) is lent, for so many ``days``. ``least`` is what ``worth_trading`` tests, not a cost.
    """
    size = F.abs(notional)
    share = F.when(adv > 0, size / adv).otherwise(0.0)
    moved = {"none": lambda: F.lit(0.0), "linear": lambda: impact * share, "sqrt": lambda: impact * F.sqrt(share), "almgren-chriss": lambda: eta * share + gamma * F.sqrt(share)}[shape]()
    lent = F.when(notional < 0 if is_short is None else is_short, size * borrow * days / YEAR).otherwise(0.0)
    parts = {"commission": size * commission_bps / 10_000.0, "slippage": size * slippage_bps / 10_000.0, "impact": size * moved, "borrow": lent}
    return {**parts, "total": reduce(Column.__add__, parts.values())}


def trade_cost(notional: Column, adv: Column, *, short_days: Column | None = None, **model) -> Column:
    """The total of ``trade_costs``; shorts are lent for ``short_days`` (none: not at all)."""
    return trade_costs(notional, adv, days=F.lit(0.0) if short_days is None else short_days, **model)["total"]


def cost_bps(cost: Column, notional: Column) -> Column:
    """A cost in basis points of the notional, 0 for none."""
    return F.when(F.abs(notional) > EPSILON, cost / F.abs(notional) * 10_000.0).otherwise(0.0)


def worth_trading(notional: Column, least: float) -> Column:
    """The notional, or 0 for a trade smaller than ``least``."""
    return F.when(F.abs(notional) >= least, notional).otherwise(0.0)


def rebalance_cost(trades: DataFrame, by: list[str], *, days: float = 1.0, **model) -> DataFrame:
    """``(by, total_cost, total_notional, avg_cost_bps)`` of the trades ``(notional, adv, is_short)`` of each rebalance."""
    total = trade_costs(F.col("notional"), F.col("adv"), is_short=F.col("is_short"), days=days, **model)["total"]
    sums = trades.groupBy(*by).agg(F.coalesce(F.sum(total), F.lit(0.0)).alias("total_cost"), F.coalesce(F.sum(F.abs("notional")), F.lit(0.0)).alias("total_notional"))
    return sums.withColumn("avg_cost_bps", cost_bps(F.col("total_cost"), F.col("total_notional")))


def annual_cost(value: Column, turnover: Column, **model) -> Column:
    """The cost a year of turning a portfolio of that value over so often, in equal trades each day; without volumes there is no impact."""
    return trade_costs(value * turnover / YEAR, F.lit(None).cast("double"), is_short=F.lit(False), **model)["total"] * YEAR


# --- constraints, each on ``(time, asset, weight)`` with whatever other columns


def limit_positions(weight: Column, most: float = 0.05) -> Column:
    return F.least(F.greatest(weight, F.lit(-most)), F.lit(most))


def limit_groups(df: DataFrame, group: str, most: float, s: Section = Section()) -> DataFrame:
    """Weights of a group scaled down where its gross exceeds ``most``."""
    gross = F.sum(F.abs("weight")).over(Section(s.time, s.asset, (group,)).rows())
    return df.withColumn("weight", F.col("weight") * F.when(gross > most, most / gross).otherwise(1.0))


def limit_gross(df: DataFrame, most: float, s: Section = Section()) -> DataFrame:
    gross = F.sum(F.abs("weight")).over(s.rows())
    return df.withColumn("weight", F.col("weight") * F.when(gross > most, most / gross).otherwise(1.0))


def target_net(df: DataFrame, target: float = 0.0, s: Section = Section()) -> DataFrame:
    """Every weight moved by the same amount so that they sum to ``target``."""
    return df.withColumn("weight", F.col("weight") - (F.sum("weight").over(s.rows()) - target) / F.count(F.lit(1)).over(s.rows()))


def limit_count(df: DataFrame, most: int, s: Section = Section()) -> DataFrame:
    """Only the ``most`` largest weights by size stay, of equals the smaller asset."""
    place = F.row_number().over(s.rows().orderBy(F.abs("weight").desc(), F.col(s.asset)))
    return df.withColumn("weight", F.when(place <= most, F.col("weight")).otherwise(0.0))


def limit_turnover(df: DataFrame, most: float, s: Section = Section()) -> DataFrame:
    """Blends towards the last time's given weights where one-way turnover exceeds ``most``."""
    old = F.coalesce(F.lag("weight").over(Series(s.asset, s.time).rows()), F.lit(0.0))
    moved = df.withColumn("__old", old).withColumn("__turn", F.sum(F.abs(F.col("weight") - F.col("__old"))).over(s.rows()) / 2.0)
    blend = F.when(F.col("__turn") > most, most / F.col("__turn")).otherwise(1.0)
    return moved.withColumn("weight", F.col("__old") + blend * (F.col("weight") - F.col("__old"))).drop("__old", "__turn")


def violations(df: DataFrame, *, most: float, gross: float, net: float, s: Section = Section()) -> DataFrame:
    """``(time, largest, gross, net)`` of the times that break a limit."""
    sums = df.groupBy(s.time).agg(F.max(F.abs("weight")).alias("largest"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    return sums.where((F.col("largest") > most + EPSILON) | (F.col("gross") > gross + EPSILON) | (F.abs("net") > net + EPSILON))


# --- attribution


def group_contributions(panel: DataFrame, group: str, *, weight: str = "weight", ret: str = "ret", s: Section = Section()) -> DataFrame:
    """``(group, contribution, annual)``: the sum of weight times return, and the same a year."""
    times = panel.agg(F.countDistinct(s.time).alias("times"))
    sums = panel.groupBy(group).agg(F.sum(F.col(weight) * F.col(ret)).alias("contribution"))
    return sums.join(F.broadcast(times)).withColumn("annual", F.col("contribution") * YEAR / F.col("times")).drop("times")


def brinson(portfolio: DataFrame, benchmark: DataFrame, group: str) -> DataFrame:
    """Allocation, selection and interaction by group, from ``(group, weight, ret)`` rows of both sides."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        total = df.groupBy(group).agg(F.sum("weight").alias(f"w{tag}"), F.sum(F.col("weight") * F.col("ret")).alias("c"))
        return total.withColumn(f"r{tag}", F.when(F.abs(f"w{tag}") > EPSILON, F.col("c") / F.col(f"w{tag}")).otherwise(0.0)).drop("c")

    joined = side(portfolio, "p").join(side(benchmark, "b"), group, "full_outer").fillna(0.0)
    whole = joined.agg(F.sum(F.col("wb") * F.col("rb")).alias("total_b"))
    dw, dr = F.col("wp") - F.col("wb"), F.col("rp") - F.col("rb")
    return joined.join(F.broadcast(whole)).select(group, (dw * (F.col("rb") - F.col("total_b"))).alias("allocation"), (F.col("wb") * dr).alias("selection"), (dw * dr).alias("interaction"))


def factor_attribution(joined: DataFrame, factors: list[str], ret: str = "ret") -> DataFrame:
    """One row: each factor's univariate beta and annual contribution, the annual residual alpha, and R squared."""
    r = F.col(ret)
    made = {}
    for f in factors:
        made[f"{f}_beta"] = F.when(F.var_pop(f) > EPSILON, F.covar_pop(ret, f) / F.var_pop(f)).otherwise(0.0)
    facts = joined.agg(F.avg(r).alias("m"), *(c.alias(k) for k, c in made.items()), *(F.avg(f).alias(f"{f}_mean") for f in factors), *(F.pow(F.coalesce(F.corr(ret, f), F.lit(0.0)), F.lit(2.0)).alias(f"{f}_r2") for f in factors))
    parts = {f"{f}_contribution": F.col(f"{f}_beta") * F.col(f"{f}_mean") * YEAR for f in factors}
    alpha = F.col("m") * YEAR - reduce(Column.__add__, parts.values())
    r2 = F.least(reduce(Column.__add__, (F.col(f"{f}_r2") for f in factors)), F.lit(1.0))
    return facts.select(*(F.col(f"{f}_beta") for f in factors), *(c.alias(k) for k, c in parts.items()), alpha.alias("alpha"), r2.alias("r_squared"))




# --- risk, from ``(time, ret)``

Z = {0.9: 1.282, 0.95: 1.645, 0.99: 2.326, 0.999: 3.090}  # fixed values: normal quantiles by confidence
SCENARIOS = {  # fixed values: factor shocks by scenario
    "2008_crisis": {"market": -0.40, "smb": -0.10, "hml": -0.15, "volatility": 3.0},
    "2020_covid": {"market": -0.35, "smb": -0.20, "momentum": -0.25, "volatility": 4.0},
    "2022_rates": {"market": -0.20, "growth": -0.30, "value": 0.10},
    "flash_crash": {"market": -0.10, "volatility": 5.0},
}
RETURN_SHOCKS = {"2008_crisis": -0.50, "2020_covid": -0.35, "2022_rates": -0.25, "flash_crash": -0.10}  # fixed values: of the market as a whole


def value_at_risk(returns: DataFrame, confidence: float = 0.95, ret: str = "ret") -> DataFrame:
    """One row: historical, parametric and Cornish-Fisher value at risk, and historical and parametric expected shortfall.

    The historical quantile is the return at place floor((1 - confidence) n) in ascending order, found by selection, so returns of any
    number are fine; the tail is that and all below, of equal ones as many as stand up to that place. NULL without returns.
    """
    r, z = F.col(ret), Z.get(confidence, 1.645)
    known = returns.where(r.isNotNull() & ~F.isnan(r))
    got = known.agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_pop(r).alias("sd"), F.coalesce(F.skewness(r), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(r), F.lit(0.0)).alias("kurt"), F.min(r).alias("low"), F.max(r).alias("high")).first()
    place = int(round((1 - confidence) * got["n"], 9) // 1)  # in exact decimals: 0.05 * 100 is 5
    found = order_statistics(known, {ret: [place]}, {ret: (got["n"], got["low"], got["high"])}).get((ret, place))
    q, below = F.lit(found).cast("double"), r < F.lit(found).cast("double")
    tail = known.agg(((F.coalesce(F.sum(F.when(below, r)), F.lit(0.0)) + F.max(q) * (F.lit(place + 1) - F.count_if(below))) / (place + 1)).alias("tail"))
    fact = {k: F.lit(got[k]).cast("double") for k in ("m", "sd", "skew", "kurt")}
    density = 0.3989422804014327 * 2.718281828459045 ** (-z * z / 2)
    lower = -z
    bent = F.lit(lower) + (lower**2 - 1) * fact["skew"] / 6 + (lower**3 - 3 * lower) * fact["kurt"] / 24 - (2 * lower**3 - 5 * lower) * fact["skew"] * fact["skew"] / 36
    normal = -(fact["m"] - z * fact["sd"])
    return tail.select(
        (-q).alias("historical"), normal.alias("parametric"), (normal if got["n"] < 4 else -(fact["m"] + bent * fact["sd"])).alias("cornish_fisher"),
        (-F.col("tail")).alias("historical_shortfall"), (-(fact["m"] - fact["sd"] * density / (1 - confidence))).alias("parametric_shortfall"),
    )


def rolling_var(df: DataFrame, ret: str = "ret", n: int = 20, confidence: float = 0.95, s: Series = Series()) -> DataFrame:
    """Historical value at risk over full windows, NULL before."""
    rows = F.array_sort(F.collect_list(ret).over(s.last(n)))
    at = int(round((1 - confidence) * n, 9) // 1) + 1
    return df.withColumn("var", F.when(F.row_number().over(s.rows()) >= n, -F.element_at(rows, at)))


def risk_report(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """One row from ``(time, ret)``: historical value at risk and shortfall at 95 and 99 %, annual volatility (population), and the largest drawdown."""
    known = returns.where(F.col(ret).isNotNull() & ~F.isnan(ret)).select("time", F.col(ret).alias("ret"))
    told = {c: value_at_risk(known, c).select(F.col("historical").alias(f"var_{k}"), F.col("historical_shortfall").alias(f"cvar_{k}")) for c, k in ((0.95, 95), (0.99, 99))}
    whole = cumulative(known).agg((F.stddev_pop("ret") * F.sqrt(F.lit(YEAR))).alias("volatility"), F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"))
    return told[0.95].join(F.broadcast(told[0.99])).join(F.broadcast(whole)).select("var_95", "var_99", "cvar_95", "cvar_99", "volatility", "max_drawdown")  # one row each


def marginal_var(panel: DataFrame, confidence: float = 0.95, delta: float = 0.001, s: Section = Section()) -> DataFrame:
    """``(asset, weight, marginal, component)`` from ``(time, asset, weight, ret)`` with a fixed weight for each asset.

    Marginal: the change of the historical value at risk over ``delta`` when the asset's weight grows by that and all are scaled back to a sum of
    1. Component: weight times marginal. A row counts in its time's portfolio return; assets are worked through side by side.
    """
    n = F.count(F.lit(1))
    whole = panel.groupBy(s.time).agg(F.sum(F.col("weight") * F.col("ret")).alias("__whole"))
    weights = panel.groupBy(s.asset).agg(F.max("weight").alias("weight"))
    total = weights.agg(F.sum("weight").alias("__sum"))
    place = F.floor(F.round((1 - confidence) * n.over(Window.partitionBy("__of")), 9))

    def at_risk(rows: DataFrame) -> DataFrame:
        ordered = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__of").orderBy("__r")) - 1).withColumn("__place", place)
        return ordered.where("__at = __place").select("__of", (-F.col("__r")).alias("__var"))

    now = at_risk(whole.select(F.lit(0).alias("__of"), F.col("__whole").alias("__r"))).select(F.col("__var").alias("__now"))
    moved = panel.select(F.col(s.asset).alias("__of"), s.time, "ret").join(whole, s.time).join(F.broadcast(total))  # one row
    told = at_risk(moved.select("__of", ((F.col("__whole") + delta * F.col("ret")) / (F.col("__sum") + delta)).alias("__r"))).join(F.broadcast(now))
    marginal = told.select(F.col("__of").alias(s.asset), ((F.col("__var") - F.col("__now")) / delta).alias("marginal"))
    return weights.join(marginal, s.asset).withColumn("component", F.col("weight") * F.col("marginal"))


def stress(exposures: DataFrame, scenarios: dict[str, dict[str, float]] = SCENARIOS) -> DataFrame:
    """``(scenario, impact)``: exposure times shock, summed over the factors both have, from ``(factor, exposure)``."""
    shocks = exposures.sparkSession.createDataFrame([(s, f, x) for s, own in scenarios.items() for f, x in own.items()], "scenario string, factor string, shock double")
    hit = shocks.join(exposures, "factor", "left")
    return hit.groupBy("scenario").agg(F.sum(F.coalesce(F.col("exposure"), F.lit(0.0)) * F.col("shock")).alias("impact"))


# --- factors


def rolling_exposures(df: DataFrame, factors: list[str], ret: str = "ret", n: int = 20, s: Series = Series()) -> DataFrame:
    """Univariate betas over full windows, NULL before, and the alpha they leave."""
    w, full = s.last(n), F.row_number().over(s.rows()) >= n
    out = df
    for f in factors:
        beta = F.when(F.var_pop(f).over(w) > EPSILON, F.covar_pop(ret, f).over(w) / F.var_pop(f).over(w)).otherwise(0.0)
        out = out.withColumn(f"{f}_beta", F.when(full, beta))
    left = F.avg(ret).over(w) - reduce(Column.__add__, (F.col(f"{f}_beta") * F.avg(f).over(w) for f in factors))
    return out.withColumn("alpha", left)


def decompose(df: DataFrame, factors: list[str], ret: str = "ret") -> DataFrame:
    """Each factor's contribution by its beta column, and the residual."""
    parts = [F.col(f"{f}_beta") * F.col(f) for f in factors]
    return df.withColumns({f"{f}_part": c for f, c in zip(factors, parts, strict=True)}).withColumn("residual", F.col(ret) - F.col("alpha") - reduce(Column.__add__, parts))


def portfolio_exposures(panel: DataFrame, factors: list[str], s: Section = Section()) -> DataFrame:
    """``(time, factor exposures)``: weight times exposure, summed."""
    return panel.groupBy(s.time).agg(*(F.sum(F.col("weight") * F.col(f)).alias(f) for f in factors))


def factor_risk(exposures: DataFrame, factors: list[str], covariance: DataFrame | None = None) -> DataFrame:
    """``exposures`` with ``risk``: the root of e'Se, S from ``covariance(a, b, cov)`` (of a pair one row is enough), or of e'e without it."""
    if covariance is None:
        return exposures.withColumn("risk", F.sqrt(reduce(Column.__add__, (F.col(f) * F.col(f) for f in factors))))
    # one number for each pair of the factors named
    known = {tuple(sorted((r["a"], r["b"]))): float(r["cov"]) for r in covariance.where(F.col("a").isin(factors) & F.col("b").isin(factors)).collect()}
    terms = [F.col(a) * F.col(b) * known.get(tuple(sorted((a, b))), 0.0) for a in factors for b in factors]
    return exposures.withColumn("risk", F.sqrt(reduce(Column.__add__, terms)))


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, cov)``: sample covariances of every two columns and of each with itself, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def value_factor(price: Column, earnings: Column) -> Column:
    return F.when(price != 0, earnings / price).otherwise(F.when(price.isNotNull() & earnings.isNotNull(), 0.0))


def size_factor(market_cap: Column) -> Column:
    """Its natural logarithm; NULL where that has none."""
    return F.when(market_cap > 0, F.log(market_cap))


def volatility_factor(ret: Column, n: int = 20, s: Series = Series()) -> Column:
    """Sample deviation over windows of n known returns, NULL before and across gaps."""
    w = s.last(n)
    return F.when(F.count(ret).over(w) == n, F.stddev_samp(ret).over(w))


def factor_summary(df: DataFrame, factors: list[str]) -> DataFrame:
    """``(factor, annual_mean, sharpe)`` of factor return columns."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("r")) for f in factors))).alias("x")).select("x.*").where("r is not null and not isnan(r)")
    spread = F.stddev_pop("r")
    return long.groupBy("factor").agg((F.avg("r") * YEAR).alias("annual_mean"), F.when(spread > EPSILON, F.avg("r") / spread * F.sqrt(F.lit(YEAR))).otherwise(0.0).alias("sharpe"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, correlation)`` of every two columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


# --- regimes


def volatility_regime(df: DataFrame, ret: str = "ret", short: int = 5, long: int = 20, s: Series = Series()) -> DataFrame:
    """2 where short over long volatility exceeds 1.5, 0 below 0.7, else 1, and 1 before ``long`` rows went by."""
    ratio = F.stddev_pop(ret).over(s.last(short)) / F.nullif(F.stddev_pop(ret).over(s.last(long)), F.lit(0.0))
    code = F.when(ratio > 1.5, 2).when(ratio < 0.7, 0).otherwise(1)
    return df.withColumn("vol_regime", F.when(F.row_number().over(s.rows()) > long, code).otherwise(1))


def trend_regime(df: DataFrame, price: str = "px", fast: int = 5, slow: int = 20, threshold: float = 0.02, s: Series = Series()) -> DataFrame:
    """1 up, -1 down, 0 flat, by the distance of a fast from a slow mean."""
    quick, calm = F.avg(price).over(s.last(fast)), F.avg(price).over(s.last(slow))
    gap = F.try_divide(quick - calm, calm)
    return df.withColumn("trend", F.when(gap > threshold, 1).when(gap < -threshold, -1).otherwise(0))


def combined_regime(df: DataFrame) -> DataFrame:
    """``regime`` from 2 (calm and rising) to -2 (wild and falling), with trend and volatility regimes at hand."""
    t, v = F.col("trend"), F.col("vol_regime")
    return df.withColumn("regime", F.when((t == 1) & (v < 2), 2).when(t == 1, 1).when((t == -1) & (v < 2), -1).when(t == -1, -2).otherwise(0))


# --- data quality: ``(check, column, severity, count, share)``, a row for each finding


def quality_report(df: DataFrame, columns: list[str], keys: list[str], *, missing: float = 0.05, outliers: float = 0.05, iqr: float = 1.5, z: float = 3.0) -> DataFrame:
    """Missing values, outliers by interquartile range and by deviation, and repeated keys. Quartiles are exact and of all rows, NaN left out."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    bounds = df.agg(*(x for c in columns for x in (*(F.lit(q).cast("double").alias(f"{c}_{k}") for k, q in zip(("q1", "q3"), quartiles[c], strict=True)), F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"))))
    tested = df.join(F.broadcast(bounds))
    hits = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        x, reach = F.col(c), (F.col(f"{c}_q3") - F.col(f"{c}_q1")) * iqr
        hits += [
            F.count(F.when(x.isNull(), 1)).alias(f"{c}_missing"), F.count(F.when((x < F.col(f"{c}_q1") - reach) | (x > F.col(f"{c}_q3") + reach), 1)).alias(f"{c}_iqr"),
            F.count(F.when(F.abs(x - F.col(f"{c}_m")) > z * F.col(f"{c}_s"), 1)).alias(f"{c}_z"),
        ]
    counts = tested.agg(*hits)
    names = [(f"{c}_{k}", k, c) for c in columns for k in ("missing", "iqr", "z")]
    rows = counts.select("rows", F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.col(n).alias("count")) for n, k, c in names))).alias("x")).select("x.*", "rows")
    repeats = df.groupBy(*keys).count().agg(F.sum(F.col("count") - 1).alias("count"), F.sum("count").alias("rows")).select(F.lit("duplicate").alias("check"), F.lit(",".join(keys)).alias("column"), F.coalesce("count", F.lit(0)).alias("count"), "rows")
    share = F.when(F.col("rows") > 0, F.col("count") / F.col("rows")).otherwise(0.0)
    found = rows.unionByName(repeats).withColumn("share", share)
    severity = (
        F.when(F.col("check") == "duplicate", F.when(F.col("count") > 0, "error"))
        .when(F.col("check") == "missing", F.when(F.col("share") > 0.5, "critical").when(F.col("share") > 0.2, "error").when(F.col("share") > missing, "warning"))
        .otherwise(F.when(F.col("share") > outliers, "warning"))
    )
    return found.withColumn("severity", F.coalesce(severity, F.lit("ok"))).select("check", "column", "severity", "count", "share")


def staleness(df: DataFrame, time: str, as_of: str, most_days: int) -> DataFrame:
    """One row: the last day with data, its age and whether it is too old."""
    age = F.datediff(F.lit(as_of).cast("date"), F.max(time))
    return df.agg(F.max(time).cast("date").alias("last"), age.alias("age"), F.coalesce(age > most_days, F.lit(True)).alias("stale"))


# --- corporate actions: ``(symbol, date, action, value)``


def adjust_prices(prices: DataFrame, actions: DataFrame, *, s: Series = Series()) -> DataFrame:
    """``factor``, ``adjusted`` (price) and ``adjusted_volume`` for each row: the product of the factors of its symbol's later actions.

    A split of r divides earlier prices by r and multiplies volumes, a reverse split the other way; a dividend of a percent of
    the price takes 1 - value / 100. Actions of a symbol are few: rows and actions are laid out in one series by date, and
    each row's factor is the product over what follows.
    """
    price = F.when(F.col("action") == "split", 1.0 / F.col("value")).when(F.col("action") == "reverse_split", F.col("value")).when(F.col("action") == "dividend", 1.0 - F.col("value") / 100.0).otherwise(1.0)
    volume = F.when(F.col("action") == "split", F.col("value")).when(F.col("action") == "reverse_split", 1.0 / F.col("value")).otherwise(1.0)
    events = actions.select(F.col("symbol").alias(s.asset), F.col("date").alias(s.time), price.alias("__p"), volume.alias("__v"), F.lit(0).alias("__kind"))
    rows = prices.withColumn("__kind", F.lit(1))
    # on its own day an action stands before the price, which already shows it
    later = Window.partitionBy(s.asset).orderBy(F.col(s.time).desc(), F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.unionByName(events, allowMissingColumns=True)
    both = laid.withColumns({"factor": F.product(F.coalesce("__p", F.lit(1.0))).over(later), "__volume": F.product(F.coalesce("__v", F.lit(1.0))).over(later)})
    out = both.where("__kind = 1").withColumn("adjusted", F.col("px") * F.col("factor")).withColumn("adjusted_volume", F.col("volume") * F.col("__volume"))
    return out.select(*prices.columns, "factor", "adjusted", "adjusted_volume")


def current_symbols(renames: DataFrame) -> DataFrame:
    """``(symbol, current)``: renames ``(symbol, new_symbol)`` followed to their end, however many steps; a row for each symbol.

    Each round joins what is known with itself, so a chain of n steps takes about log2(n) rounds. Of several renames of a
    symbol the greatest new one counts. Symbols on a cycle, or that lead to one, have no end: their ``current`` is null.
    """
    known = stage(renames.groupBy("symbol").agg(F.max("new_symbol").alias("current")), "renames")
    for _ in range(known.count().bit_length()):
        step = known.select(F.col("symbol").alias("__from"), F.col("current").alias("__to"))
        moved = stage(known.join(step, F.col("current") == F.col("__from"), "left").select("symbol", F.coalesce("__to", "current").alias("current"), F.col("__from").isNotNull().alias("moved")), "renames")
        known = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return known
    renamed = known.select(F.col("symbol").alias("__from"))
    return known.join(renamed, F.col("current") == F.col("__from"), "left").select("symbol", F.when(F.col("__from").isNull(), F.col("current")).alias("current"))


def symbols_at(renames: DataFrame, as_of: str, date: str = "date") -> DataFrame:
    """``(symbol, name)``: under what name each symbol that was renamed after ``as_of`` went on that day, from ``(symbol, new_symbol, date)``.

    Renames after the day are followed back to the first of them; symbols without one kept their name and have no row.
    """
    later = renames.where(F.col(date) > F.lit(as_of).cast(renames.schema[date].dataType))
    return current_symbols(later.select(F.col("new_symbol").alias("symbol"), F.col("symbol").alias("new_symbol"))).withColumnRenamed("current", "name")


# --- universes: ``(asset, date)`` with attributes


def as_of(left: DataFrame, right: DataFrame, *, on: list[str], time: str = "time", right_time: str = "date", columns: list[str]) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` by key at or before its time; no shuffle beyond one by key."""
    marks = right.select(*on, F.col(right_time).alias(time), F.struct(*columns).alias("__mark"), F.lit(0).alias("__side"))
    rows = left.withColumn("__side", F.lit(1))
    w = Window.partitionBy(*on).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.unionByName(marks, allowMissingColumns=True).withColumn("__mark", F.last("__mark", ignorenulls=True).over(w))
    return laid.where("__side = 1").select(*left.columns, *(F.col(f"__mark.{c}").alias(c) for c in columns))


def universe_union(a: DataFrame, b: DataFrame, key: str = "asset") -> DataFrame:
    """Assets of either; where both have one, b's attributes."""
    return a.join(b, key, "left_anti").unionByName(b, allowMissingColumns=True)


def universe_intersect(a: DataFrame, b: DataFrame, key: str = "asset") -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_semi")


def members_at(rows: DataFrame, membership: DataFrame, *, key: str = "asset", time: str = "time", date: str = "date") -> DataFrame:
    """The ``rows`` whose asset is in the universe at their time: in the last snapshot of ``membership(asset, date)`` at or before it.

    Snapshots count as a whole: an asset that the last one leaves out is no member, whatever earlier ones say. Before the first there are none.
    """
    dates = membership.select(F.col(date).alias(time), F.col(date).alias("__snapshot")).distinct()
    times = rows.select(time).distinct().withColumn("__snapshot", F.lit(None).cast(membership.schema[date].dataType))
    laid = times.unionByName(dates).groupBy(time).agg(F.max("__snapshot").alias("__snapshot"))  # one row for each time
    known = laid.withColumn("__snapshot", F.last("__snapshot", ignorenulls=True).over(Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))
    members = membership.select(F.col(key), F.col(date).alias("__snapshot")).distinct()
    return rows.join(known, time).join(members, [key, "__snapshot"], "left_semi").select(*rows.columns)
