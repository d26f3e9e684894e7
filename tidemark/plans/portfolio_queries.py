"""Queries of costs, constraint sets, factor and portfolio risk, names and members at a date, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crosssection as xs
from . import analytics as an
from . import constraints as cs
from .analysis_queries import _KINDS, _RETURNS, _WEIGHTED, _tidy_sql, returns, tidy, weighted
from .panels import DAYS_SQL, MONTHLY, MONTHS, MONTHS_SQL, days, months, table
from .rigor import expected_best_sharpe, rigor_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


_TRADES = "t AS (SELECT l_orderkey, l_linenumber, o_orderdate, l_extendedprice * 0.7071067811865476 AS notional, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * 20000.0 END AS adv, l_returnflag = 'R' AS is_short FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _trades(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey"), "l_linenumber", (F.col("l_extendedprice") * 0.7071067811865476).alias("notional"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") * 20_000.0).alias("adv"), (F.col("l_returnflag") == "R").alias("is_short"),
    )
    return lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))


def _cost_sql(bps: float, impact: str, borrow: float, days: float) -> str:
    return f"(notional * {bps} / 10000 + notional * coalesce({impact}, 0) + CASE WHEN is_short THEN notional * {borrow} * {days} / 252 ELSE 0 END)"


_IMPACTS = {"zero": (0.0, "0", 0.0), "default": (3.0, "0.1 * sqrt(notional / adv)", 0.005), "institutional": (1.5, "0.05 * sqrt(notional / adv)", 0.003), "retail": (10.0, "0.5 * notional / adv", 0.02)}


@_query(
    "cost_models",
    f"WITH {_TRADES}, o AS ({' UNION ALL '.join(f'SELECT {k!r} AS model, l_orderkey, l_linenumber, notional, {_cost_sql(*v, 10.0)} AS cost FROM t' for k, v in _IMPACTS.items())}) SELECT model, l_orderkey, l_linenumber, {_tidy_sql('cost', 5)}, round(CASE WHEN notional > 1e-10 THEN cost / notional * 10000 ELSE 0 END, 5) + 0.0 AS bps FROM o",
)
def _(spark, d):
    trades, made = _trades(spark, d), []
    for name, model in an.COST_MODELS.items():
        cost = an.trade_costs(F.col("notional"), F.col("adv"), is_short=F.col("is_short"), days=10.0, **model)["total"]
        made.append(F.struct(F.lit(name).alias("model"), cost.alias("cost")))
    each = trades.withColumn("x", F.explode(F.array(*made))).select("x.model", "l_orderkey", "l_linenumber", "notional", "x.cost")
    return each.select("model", "l_orderkey", "l_linenumber", (F.round("cost", 5) + 0.0).alias("cost"), (F.round(an.cost_bps(F.col("cost"), F.col("notional")), 5) + 0.0).alias("bps"))


@_query(
    "cost_rebalance",
    f"""WITH {_TRADES}, s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time, sum({_cost_sql(*_IMPACTS['default'], 5.0)}) AS total_cost, sum(notional) AS total_notional FROM t GROUP BY 1),
 o AS (SELECT *, CASE WHEN total_notional > 1e-10 THEN total_cost / total_notional * 10000 ELSE 0 END AS avg_cost_bps FROM s) SELECT time, {_tidy_sql('total_cost total_notional avg_cost_bps', 4)} FROM o""",
)
def _(spark, d):
    trades = _trades(spark, d).withColumn("time", F.date_trunc("month", "o_orderdate").cast("date"))
    return tidy(an.rebalance_cost(trades, ["time"], days=5.0, **an.COST_MODELS["default"]), 4)


@_query(
    "cost_least_trade",
    f"WITH {_TRADES} SELECT l_orderkey, l_linenumber, round(CASE WHEN notional >= 10000.0 THEN notional ELSE 0 END, 4) + 0.0 AS traded FROM t",
)
def _(spark, d):
    return tidy(_trades(spark, d).select("l_orderkey", "l_linenumber", an.worth_trading(F.col("notional"), an.COST_MODELS["institutional"]["least"]).alias("traded")), 4)


@_query("cost_annual", "SELECT c_custkey, round(c_acctbal * 4.0 / 252 * 3.0 / 10000 * 252 * sign(c_acctbal), 6) + 0.0 AS cost FROM customer")
def _(spark, d):
    return tidy(table(spark, d, "customer").select("c_custkey", an.annual_cost(F.col("c_acctbal"), F.lit(4.0), **an.COST_MODELS["default"]).alias("cost")), 6)


# --- constraint sets: weights that break every limit, and those of the month before

_TILTED = f"""WITH {_WEIGHTED}, w AS (SELECT time, asset, sector, weight * 1.3 + (asset % 7 - 2) * 0.002 AS w0 FROM sg), p AS (SELECT *, lag(w0) OVER (PARTITION BY asset ORDER BY time) AS prev FROM w)"""


def _tilted(spark: SparkSession, d: str) -> DataFrame:
    panel = weighted(spark, d).select("time", "asset", "sector", (F.col("weight") * 1.3 + (F.col("asset") % 7 - 2) * 0.002).alias("weight"))
    return panel.withColumn("previous", F.lag("weight").over(MONTHLY.rows()))


def _steps(*steps: str) -> str:
    """Each step reads weight ``w`` of the step before (first: ``w0``) and may use window ``s`` over a time."""
    parts, source, name = [], "p", "w0"
    for i, step in enumerate(steps):
        parts.append(f"s{i} AS (SELECT time, asset, sector, prev, {step.replace('@', name)} AS w{i + 1} FROM {source} WINDOW s AS (PARTITION BY time))")
        source, name = f"s{i}", f"w{i + 1}"
    return f"{_TILTED}, {', '.join(parts)}, o AS (SELECT time, asset, coalesce({name}, 0) AS weight FROM {source}) SELECT time, asset, {_tidy_sql('weight')} FROM o"


_LONG, _SHORT, _NET = "coalesce(sum(CASE WHEN @ > 0 THEN @ END) OVER s, 0)", "coalesce(sum(CASE WHEN @ < 0 THEN -@ END) OVER s, 0)", "coalesce(sum(@) OVER s, 0)"
_GROSS = "coalesce(sum(abs(@)) OVER s, 0)"
_TURNED = "(sum(abs(@ - coalesce(prev, 0))) OVER s) / 2"


def _target(x: float) -> str:
    return f"@ * CASE WHEN {x} - {_NET} > 1e-10 AND {_LONG} > 0 AND @ > 0 THEN 1 + ({x} - {_NET}) / {_LONG} WHEN {x} - {_NET} < -1e-10 AND {_SHORT} > 0 AND @ < 0 THEN 1 - ({x} - {_NET}) / {_SHORT} ELSE 1 END"


def _turnover(x: float) -> str:
    return f"CASE WHEN {_TURNED} > {x} THEN coalesce(prev, 0) + {x} / ({_TURNED}) * (@ - coalesce(prev, 0)) ELSE @ END"


def _enforced(name: str, rules: tuple[tuple, ...], *steps: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(cs.enforce(_tilted(spark, sf_dir), rules, previous="previous", s=MONTHS).select("time", "asset", "weight"))

    QUERIES[name] = query
    ORACLES[name] = _steps(*steps)


_enforced(
    "constraint_long_short_equity", cs.LONG_SHORT_EQUITY, "CASE WHEN abs(@) > 0.05 THEN sign(@) * 0.05 ELSE @ END", "CASE WHEN abs(@) >= 0.001 THEN @ END",
    f"@ * CASE WHEN {_GROSS} > 2.0 THEN 2.0 / {_GROSS} ELSE 1 END", _target(0.0), _turnover(0.3),
)
_enforced(
    "constraint_long_only", cs.LONG_ONLY, "CASE WHEN abs(@) > 0.1 THEN sign(@) * 0.1 ELSE @ END", "CASE WHEN abs(@) >= 0.005 THEN @ END", "CASE WHEN @ < 0 THEN 0.0 ELSE @ END",
    f"@ * CASE WHEN {_GROSS} > 1.0 THEN 1.0 / {_GROSS} ELSE 1 END", _target(1.0), _turnover(0.5),
)
_enforced(
    "constraint_counts", (("max_longs", 9), ("max_shorts", 7), ("max_positions", 12)),
    "CASE WHEN @ > 0 AND row_number() OVER (PARTITION BY time ORDER BY @ DESC NULLS LAST, asset) > 9 THEN NULL ELSE @ END",
    "CASE WHEN @ < 0 AND row_number() OVER (PARTITION BY time ORDER BY @ ASC NULLS LAST, asset) > 7 THEN NULL ELSE @ END",
    "CASE WHEN row_number() OVER (PARTITION BY time ORDER BY abs(@) DESC NULLS LAST, asset) > 12 THEN NULL ELSE @ END",
)
_enforced(
    "constraint_net_band", (("max_long", 0.06), ("max_net", 0.1), ("min_net", 0.05), ("long_short_ratio", 0.9, 1.05)), "CASE WHEN @ > 0.06 THEN 0.06 ELSE @ END",
    f"@ * CASE WHEN {_NET} > 0.1 AND {_LONG} > 0 AND @ > 0 THEN 1 - ({_NET} - 0.1) / {_LONG} ELSE 1 END", f"@ * CASE WHEN {_NET} < 0.05 AND {_SHORT} > 0 AND @ < 0 THEN 1 - (0.05 - {_NET}) / {_SHORT} ELSE 1 END",
    f"@ * CASE WHEN {_SHORT} > 0 AND {_LONG} / {_SHORT} < 0.9 AND @ < 0 THEN {_LONG} / (0.9 * {_SHORT}) WHEN {_SHORT} > 0 AND {_LONG} / {_SHORT} > 1.05 AND @ > 0 THEN 1.05 * {_SHORT} / {_LONG} ELSE 1 END",
)
_SECTOR = "(sum(abs(@)) OVER (PARTITION BY time, sector))"
_enforced("constraint_sectors", (("sector", 3, 0.05), ("sector", 7, 0.02)), f"@ * CASE WHEN sector = 3 AND {_SECTOR} > 0.05 THEN 0.05 / {_SECTOR} WHEN sector = 7 AND {_SECTOR} > 0.02 THEN 0.02 / {_SECTOR} ELSE 1 END")


# --- factors and risk


@_query(
    "factor_builders",
    f"""WITH {MONTHS_SQL}, g AS (SELECT *, px / (lag(px) OVER w) - 1 AS r, px / (lag(px, 6) OVER w) - 1 AS momentum FROM m WINDOW w AS (PARTITION BY asset ORDER BY time)),
 o AS (SELECT time, asset, momentum, CASE WHEN px <> 0 THEN volume / px ELSE 0 END AS value, CASE WHEN px * volume > 0 THEN ln(px * volume) END AS size, CASE WHEN count(r) OVER w = 6 THEN stddev_samp(r) OVER w END AS volatility
  FROM g WINDOW w AS (PARTITION BY asset ORDER BY time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT time, asset, {_tidy_sql('momentum value size volatility', 7)} FROM o""",
)
def _(spark, d):
    from ..operators import timeseries as ts

    panel = months(spark, d).withColumns({"r": ts.ret(F.col("px"), MONTHLY), "momentum": ts.ret(F.col("px"), MONTHLY, 6)})
    return tidy(panel.select("time", "asset", "momentum", an.value_factor(F.col("px"), F.col("volume")).alias("value"), an.size_factor(F.col("px") * F.col("volume")).alias("size"), an.volatility_factor(F.col("r"), 6, MONTHLY).alias("volatility")), 7)


_EXPOSED = f"WITH {_WEIGHTED}, ex AS (SELECT time, sum(weight * ln(px)) AS size, sum(weight * r) AS momentum FROM sg GROUP BY time)"


@_query(
    "factor_risk",
    f"""{_EXPOSED}, cv AS (SELECT covar_samp(size, size) AS ss, covar_samp(size, momentum) AS sm, covar_samp(momentum, momentum) AS mm FROM ex),
 o AS (SELECT time, sqrt(size * size * ss + 2 * size * momentum * sm + momentum * momentum * mm) AS risk, sqrt(size * size + momentum * momentum) AS plain FROM ex, cv) SELECT time, {_tidy_sql('risk plain')} FROM o""",
)
def _(spark, d):
    from ..storage import stage

    exposures = stage(an.portfolio_exposures(weighted(spark, d).withColumns({"size": F.log("px"), "momentum": F.col("r")}), ["size", "momentum"]), "exposures")
    names = ["size", "momentum"]
    plain = an.factor_risk(exposures, names).withColumnRenamed("risk", "plain")
    return tidy(an.factor_risk(plain, names, an.covariances(exposures, names)).select("time", "risk", "plain"))


@_query(
    "risk_report",
    f"""WITH {_RETURNS}, ra AS (SELECT ret, row_number() OVER (ORDER BY ret) - 1 AS pos, count(*) OVER () AS n FROM pr),
 va AS (SELECT -max(ret) FILTER (WHERE pos <= floor(round(0.05 * n, 9))) AS var_95, -max(ret) FILTER (WHERE pos <= floor(round(0.01 * n, 9))) AS var_99, -avg(ret) FILTER (WHERE pos <= floor(round(0.05 * n, 9))) AS cvar_95, -avg(ret) FILTER (WHERE pos <= floor(round(0.01 * n, 9))) AS cvar_99 FROM ra),
 cu AS (SELECT time, product(1 + ret) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM pr), pk AS (SELECT equity, greatest(1.0, max(equity) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM cu),
 o AS (SELECT va.*, (SELECT stddev_pop(ret) * sqrt(252) FROM pr) AS volatility, (SELECT max(1 - equity / peak) FROM pk) AS max_drawdown FROM va) SELECT {_tidy_sql('var_95 var_99 cvar_95 cvar_99 volatility max_drawdown')} FROM o""",
)
def _(spark, d):
    return tidy(an.risk_report(returns(spark, d)))


@_query(
    "risk_marginal_var",
    f"""WITH {_WEIGHTED}, pa AS (SELECT time, asset, coalesce(r, 0) AS r, CAST(1 + asset % 3 AS DOUBLE) / (SELECT sum(1 + a % 3) FROM (SELECT DISTINCT asset AS a FROM g) x) AS weight FROM g),
 wh AS (SELECT time, sum(weight * r) AS whole FROM pa GROUP BY time), nw AS (SELECT -whole AS v FROM (SELECT whole, row_number() OVER (ORDER BY whole) - 1 AS pos, count(*) OVER () AS n FROM wh) x WHERE pos = floor(round(0.05 * n, 9))),
 tw AS (SELECT sum(weight) AS tot FROM (SELECT DISTINCT asset, weight FROM pa) x), mv AS (SELECT asset, weight, (whole + 0.001 * r) / (tot + 0.001) AS x FROM pa JOIN wh USING (time), tw),
 ro AS (SELECT asset, weight, x, row_number() OVER (PARTITION BY asset ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM mv),
 o AS (SELECT asset, weight, (-x - v) / 0.001 AS marginal, weight * (-x - v) / 0.001 AS component FROM ro, nw WHERE pos = floor(round(0.05 * n, 9))) SELECT asset, {_tidy_sql('weight marginal component', 6)} FROM o""",
)
def _(spark, d):
    panel = weighted(spark, d).select("time", "asset", F.coalesce("r", F.lit(0.0)).alias("ret"), (1 + F.col("asset") % 3).cast("double").alias("w"))
    total = panel.groupBy("asset").agg(F.max("w").alias("w")).agg(F.sum("w").alias("s"))
    return tidy(an.marginal_var(panel.join(F.broadcast(total)).select("time", "asset", "ret", (F.col("w") / F.col("s")).alias("weight"))), 6)


# --- names and members at a date

def _renames(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's name passes to the next one a day later, in chains of forty."""
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").where(key % 40 != 0).select(key.alias("symbol"), (key + 1).alias("new_symbol"), F.date_add(F.lit("1995-01-01").cast("date"), (key % 40).cast("int")).alias("date"))


_RENAMED = "rn AS (SELECT s_suppkey AS symbol, s_suppkey + 1 AS new_symbol, DATE '1995-01-01' + CAST(s_suppkey % 40 AS INT) AS date FROM supplier WHERE s_suppkey % 40 <> 0)"


@_query(
    "corporate_symbols_at",
    f"""WITH RECURSIVE {_RENAMED}, lt AS (SELECT * FROM rn WHERE date > DATE '1995-01-15'), k AS (SELECT new_symbol AS symbol, symbol AS name FROM lt UNION ALL SELECT k.symbol, lt.symbol FROM k JOIN lt ON lt.new_symbol = k.name) SELECT symbol, min(name) AS name FROM k GROUP BY symbol""",
)
def _(spark, d):
    return an.symbols_at(_renames(spark, d), "1995-01-15")


@_query("corporate_actions_in_range", f"WITH {_RENAMED} SELECT symbol, new_symbol, date FROM rn WHERE date BETWEEN DATE '1995-01-10' AND DATE '1995-01-20'")
def _(spark, d):
    """Both ends of the range included."""
    from ..sources.files import between

    return between(_renames(spark, d), "1995-01-10", "1995-01-20", time="date")


@_query(
    "universe_members_at",
    """WITH mb AS (SELECT DISTINCT o_custkey AS asset, CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders WHERE o_orderstatus = 'F'), ds AS (SELECT DISTINCT date FROM mb),
 ro AS (SELECT o_orderkey, o_custkey AS asset, CAST(o_orderdate AS DATE) AS time FROM orders), sn AS (SELECT ro.*, ds.date FROM ro ASOF JOIN ds ON ro.time >= ds.date) SELECT o_orderkey, asset, time FROM sn SEMI JOIN mb USING (asset, date)""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("asset"), F.to_date("o_orderdate").alias("time"), "o_orderstatus")
    members = orders.where("o_orderstatus = 'F'").select("asset", F.date_trunc("month", "time").cast("date").alias("date"))
    return an.members_at(orders.drop("o_orderstatus"), members)


# --- rigor

_PHI_STEPS = 4000


def _phi(x: str) -> str:
    """The normal distribution's chance below ``x`` in SQL, by Simpson's rule."""
    return f"(0.5 + (SELECT sum((CASE WHEN i = 0 OR i = {_PHI_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({x} * i / {_PHI_STEPS}, 2) / 2)) * {x} / {_PHI_STEPS} / 3 FROM range(0, {_PHI_STEPS + 1}) si(i)) / sqrt(2 * pi()))"


@_query(
    "rigor_report",
    f"""WITH {_RETURNS}, f AS (SELECT count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS std FROM pr), st AS (SELECT any_value(n) AS n, any_value(mean / std) AS sharpe, avg(pow((ret - mean) / std, 3)) AS sk, avg(pow((ret - mean) / std, 4)) AS ku FROM pr, f),
 z AS (SELECT *, sqrt(1 - sk * sharpe + (ku - 1) / 4 * sharpe * sharpe) AS spread, abs(sharpe) * sqrt(n) AS t FROM st), q AS (SELECT *, sharpe * sqrt(n - 1) / spread AS z0, (sharpe - {expected_best_sharpe(10, 0.01)!r}) * sqrt(n - 1) / spread AS z1 FROM z),
 o AS (SELECT n, sharpe, sharpe * sqrt(252) AS annualized_sharpe, {_phi('z0')} AS psr, {_phi('z1')} AS deflated_sharpe, 2 * (1 - {_phi('t')}) AS p_single, least(20 * (1 - {_phi('t')}), 1.0) AS p_adjusted, CASE WHEN sharpe > 0 THEN 1 + pow(spread * 1.6448536269514722 / sharpe, 2) END AS least_track_record FROM q)
 SELECT n, {_tidy_sql('sharpe annualized_sharpe psr deflated_sharpe p_single p_adjusted least_track_record', 6)} FROM o""",
)
def _(spark, d):
    told = rigor_report(returns(spark, d), trials=10, variance=0.01)
    return tidy(told.select("n", "sharpe", "annualized_sharpe", "psr", "deflated_sharpe", "p_single", "p_adjusted", "least_track_record"), 6)


_NATIONS = f"""WITH {MONTHS_SQL}, np AS (SELECT time, sector AS asset, avg(px) AS px FROM m GROUP BY 1, 2), nr AS (SELECT time, asset, px / (lag(px) OVER (PARTITION BY asset ORDER BY time)) - 1 AS ret FROM np),
 kn AS (SELECT * FROM nr WHERE ret IS NOT NULL), cv AS (SELECT a.asset AS a, b.asset AS b, coalesce(covar_samp(a.ret, b.ret), 0) AS cov FROM kn a JOIN kn b USING (time) GROUP BY 1, 2)"""


def _nation_moments(spark: SparkSession, d: str):
    from ..operators import timeseries as ts
    from . import optimise as op

    panel = months(spark, d).groupBy("time", F.col("sector").alias("asset")).agg(F.avg("px").alias("px"))
    return op.moments(panel.withColumn("ret", ts.ret(F.col("px"), MONTHLY)))


@_query("optimise_moments", f"{_NATIONS} SELECT a, b, {_tidy_sql('cov')} FROM cv WHERE a <= b")
def _(spark, d):
    """Covariances of the nations' mean prices (25 assets), what every optimiser starts from."""
    names, _, cov = _nation_moments(spark, d)
    return tidy(spark.createDataFrame([(int(a), int(b), float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j], "a int, b int, cov double"))


@_query(
    "black_litterman",
    f"""{_NATIONS}, pr AS (SELECT a AS asset, 2.5 * avg(cov) AS prior FROM cv GROUP BY a), rk AS (SELECT asset, row_number() OVER (ORDER BY asset) AS k FROM pr), v AS (SELECT asset, CASE k WHEN 1 THEN 1 ELSE -1 END AS x FROM rk WHERE k <= 2),
 vc AS (SELECT a AS asset, sum(x * cov) AS cx FROM cv JOIN v ON b = asset GROUP BY a), vv AS (SELECT sum(x * cx) AS q FROM vc JOIN v USING (asset)), gap AS (SELECT 0.02 - sum(x * prior) AS g FROM pr JOIN v USING (asset)),
 o AS (SELECT asset, prior, prior + cx * g / (2 * q) AS posterior FROM pr JOIN vc USING (asset), vv, gap) SELECT asset, {_tidy_sql('prior posterior')} FROM o""",
)
def _(spark, d):
    """Equilibrium and posterior returns of the nations, with the view, half believed, that the first beats the second by 2 %."""
    import numpy as np

    from . import optimise as op

    names, _, cov = _nation_moments(spark, d)
    views = np.zeros((1, len(names)))
    views[0, :2] = 1, -1
    prior, posterior = op.black_litterman(cov, np.full(len(names), 1 / len(names)), views, np.array([0.02]), np.array([0.5]))
    return tidy(spark.createDataFrame([(int(a), float(x), float(y)) for a, x, y in zip(names, prior, posterior, strict=True)], "asset int, prior double, posterior double"))


_DAILY = _RETURNS.replace(MONTHS_SQL, DAYS_SQL).replace("FROM m)", "FROM d)")


@_query(
    "report_positions",
    f"""WITH {_DAILY} SELECT time AS date, {', '.join(f"round(coalesce(max(CASE WHEN asset = '{a}' THEN held END), 0), 6) + 0.0 AS {a}_weight, round(coalesce(max(CASE WHEN asset = '{a}' THEN r END), 0), 6) + 0.0 AS {a}_return" for a in _KINDS)} FROM legs GROUP BY time""",
)
def _(spark, d):
    """A column pair for each event type, long yesterday's best and short its worst; every day has its row."""
    from ..operators import timeseries as ts
    from ..sources.files import position_history

    moves = days(spark, d).withColumn("r", ts.ret(F.col("px"), MONTHLY))
    held = moves.withColumn("weight", xs.extreme_weights(F.col("r"), MONTHS)).withColumn("weight", F.lag("weight").over(MONTHLY.rows()))
    return tidy(position_history(held, ret="r", assets=list(_KINDS)), 6)
