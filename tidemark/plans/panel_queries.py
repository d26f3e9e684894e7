"""Queries of order statistics, schedules, users' functions and joint regressions over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators.selection import exact_quantiles
from .analysis_queries import _WEIGHTED, _tidy_sql, tidy, weighted
from .panels import DAYS_SQL, MONTHLY, MONTHS, MONTHS_SQL, TICKS, TICKS_SQL, days, finite, finite_sql, months, table, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


_FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
_MEASURES = ("l_extendedprice", "l_quantity", "l_discount")


@_query("order_statistics", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS fraction, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) + 0.0 AS value FROM lineitem" for c in _MEASURES for q in _FRACTIONS))
def _(spark, d):
    """Quantiles of three columns, one of many and two of few values, by selection."""
    found = exact_quantiles(table(spark, d, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in _MEASURES)), {c: list(_FRACTIONS) for c in _MEASURES})
    rows = [(c, q, v) for c in _MEASURES for q, v in zip(_FRACTIONS, found[c], strict=True)]
    return spark.createDataFrame(rows, "column string, fraction double, value double").withColumn("value", F.round("value", 6) + 0.0)


def _rebalanced_sql(every: str) -> str:
    return f"""WITH {_WEIGHTED}, o AS (SELECT date_trunc('{every}', time) AS period, min(time) AS opens FROM sg GROUP BY 1), ca AS (SELECT *, lag(opens) OVER (ORDER BY period) AS closed FROM o),
 pl AS (SELECT sg.time, sg.asset, coalesce(r, 0) AS r, weight AS target, opens, CASE WHEN sg.time > opens THEN opens ELSE closed END AS since FROM sg JOIN ca ON date_trunc('{every}', sg.time) = ca.period),
 st AS (SELECT asset, time AS since, target AS start FROM pl WHERE time = opens),
 gr AS (SELECT time, asset, since, coalesce(start, 0) AS start, coalesce(start, 0) * product(1 + r) OVER (PARTITION BY asset, since ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM pl LEFT JOIN st USING (asset, since) WHERE since IS NOT NULL),
 ga AS (SELECT *, held - coalesce(lag(held) OVER (PARTITION BY asset, since ORDER BY time), start) AS gain FROM gr), gs AS (SELECT since, time, sum(gain) AS gain FROM ga GROUP BY 1, 2),
 va AS (SELECT *, 1 + sum(gain) OVER (PARTITION BY since ORDER BY time) AS value FROM gs), en AS (SELECT since, arg_max(value, time) AS value FROM va GROUP BY since), la AS (SELECT asset, since, arg_max(held, time) AS held FROM gr GROUP BY 1, 2),
 be AS (SELECT ca.opens AS time, st.asset, coalesce(la.held, st.start) / en.value AS weight FROM st LEFT JOIN la USING (asset, since) JOIN en USING (since) JOIN ca ON ca.closed = st.since),
 tu AS (SELECT coalesce(st.since, be.time) AS time, sum(abs(coalesce(start, 0) - coalesce(weight, 0))) AS turnover FROM st FULL JOIN be ON st.since = be.time AND st.asset = be.asset GROUP BY 1),
 re AS (SELECT va.time, gain / (value - gain) AS gross, coalesce(turnover, 0) AS turnover FROM va LEFT JOIN tu ON va.time = tu.time)
 SELECT time, {_tidy_sql('gross turnover')}, {finite_sql('gross - turnover * 0.0005', 8)} AS ret FROM re"""


def _rebalance(every: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .rebalance import rebalanced

        return tidy(rebalanced(weighted(spark, sf_dir), every=every, ret="r", target="weight"))

    QUERIES[f"rebalance_{every}ly"], ORACLES[f"rebalance_{every}ly"] = query, _rebalanced_sql(every)


for _every in ("quarter", "year"):
    _rebalance(_every)


@_query(
    "rebalance_monthly",
    f"""WITH {DAYS_SQL}, r AS (SELECT time, asset, px / lag(px) OVER (PARTITION BY asset ORDER BY time) - 1 AS r, 1.0 / count(*) OVER (PARTITION BY time) AS weight FROM d), sg AS (SELECT * FROM r), """
    + _rebalanced_sql("month").split("weight FROM h)", 1)[-1].removeprefix(", "),
)
def _(spark, d):
    """Equal weights of the event types at the first day of each month (all days lie in one or two), drifting from day to day."""
    from .rebalance import rebalanced

    panel = days(spark, d).select("time", "asset", ts.ret(F.col("px"), MONTHLY).alias("r"), (1.0 / F.count(F.lit(1)).over(MONTHS.rows())).alias("weight"))
    return tidy(rebalanced(panel, every="month", ret="r", target="weight"))


@_query("rebalance_drifted_weights", f"""{_rebalanced_sql('quarter').split(', en AS', 1)[0]} SELECT ga.time, ga.asset, ga.since, {_tidy_sql('held')}, {finite_sql('held / value', 8)} AS weight FROM ga JOIN va ON ga.time = va.time""")
def _(spark, d):
    from .rebalance import drifting

    return tidy(drifting(weighted(spark, d), every="quarter", ret="r", target="weight").select("time", "asset", "since", "held", "weight"))


@_query("panel_apply_ts", f"WITH {TICKS_SQL} SELECT event_id, {finite_sql('1 - p / max(p) OVER (PARTITION BY asset ORDER BY time, event_id)')} AS fallen FROM t")
def _(spark, d):
    """A user's function along each user's events: how far the price is below its highest so far."""
    from ..operators.userfunctions import apply_ts

    panel = ticks(spark, d).select("asset", "time", "event_id", "p")
    return apply_ts(panel, TICKS, "fallen", lambda own: 1 - own["p"] / own["p"].cummax()).select("event_id", finite(F.col("fallen")).alias("fallen"))


@_query(
    "panel_apply_xs",
    f"""WITH {MONTHS_SQL}, e AS (SELECT time, asset, exp((coalesce(x, 0) - max(coalesce(x, 0)) OVER s) / 10000) AS e FROM m WINDOW s AS (PARTITION BY time)) SELECT time, asset, {finite_sql('e / sum(e) OVER (PARTITION BY time)', 8)} AS share FROM e""",
)
def _(spark, d):
    """A user's function across each month's suppliers: softmax of their prices."""
    import numpy as np

    from ..operators.userfunctions import apply_xs

    def softmax(own):
        x = own["x"].fillna(0.0)
        e = np.exp((x - x.max()) / 10_000)
        return e / e.sum()

    return apply_xs(months(spark, d).select("time", "asset", "x"), MONTHS, "share", softmax).select("time", "asset", finite(F.col("share"), 8).alias("share"))


@_query(
    "panel_fold",
    f"""WITH {TICKS_SQL} SELECT event_type, count(*) AS n, round(avg(p), 6) + 0.0 AS mean, round(var_pop(p), 5) + 0.0 AS variance, round(max(p) - min(p), 6) + 0.0 AS reach FROM t JOIN events USING (event_id) GROUP BY 1""",
)
def _(spark, d):
    """A user's aggregate of each event type: count, mean, variance and reach from states (n, mean, squares, least, greatest) that merge."""
    from ..operators.userfunctions import fold

    def joined(a, b):
        n, gap = a[0] + b[0], b[1] - a[1]
        return (n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4])) if n else a

    def step(state, rows):
        p = rows["p"]
        return joined(state, (len(p), float(p.mean()), float(((p - p.mean()) ** 2).sum()), float(p.min()), float(p.max())))

    def finish(state):
        return {"n": state[0], "mean": state[1], "variance": state[2] / state[0], "reach": state[4] - state[3]}

    rows = table(spark, d, "events").select("event_type", (F.col("value") + 1.0).alias("p"))
    told = fold(rows, ["event_type"], lambda: (0, 0.0, 0.0, float("inf"), float("-inf")), step, joined, finish, "n long, mean double, variance double, reach double")
    return told.select("event_type", "n", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("variance", 5) + 0.0).alias("variance"), (F.round("reach", 6) + 0.0).alias("reach"))


_N = 12
_SEEN = f"count(r) OVER w = {_N} AND count(*) OVER w = {_N}"


@_query(
    "factor_exposures_joint",
    f"""WITH {MONTHS_SQL}, g AS (SELECT *, px / lag(px) OVER (PARTITION BY asset ORDER BY time) - 1 AS r FROM m), f AS (SELECT time, avg(r) AS mk, avg(CASE WHEN sector < 12 THEN r END) - avg(CASE WHEN sector >= 12 THEN r END) AS sp FROM g GROUP BY time),
 j AS (SELECT time, asset, CASE WHEN mk IS NOT NULL AND sp IS NOT NULL THEN r END AS r, CASE WHEN r IS NOT NULL AND sp IS NOT NULL THEN mk END AS mk, CASE WHEN r IS NOT NULL AND mk IS NOT NULL THEN sp END AS sp FROM g JOIN f USING (time)),
 c AS (SELECT time, asset, {_SEEN} AS ok, covar_pop(mk, mk) OVER w AS a11, covar_pop(mk, sp) OVER w AS a12, covar_pop(sp, sp) OVER w AS a22, covar_pop(mk, r) OVER w AS b1, covar_pop(sp, r) OVER w AS b2, avg(r) OVER w AS my, avg(mk) OVER w AS m1, avg(sp) OVER w AS m2, var_pop(r) OVER w AS vy
  FROM j WINDOW w AS (PARTITION BY asset ORDER BY time ROWS BETWEEN {_N - 1} PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, CASE WHEN ok THEN (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) END AS beta_mk, CASE WHEN ok THEN (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) END AS beta_sp FROM c),
 o AS (SELECT time, asset, my - beta_mk * m1 - beta_sp * m2 AS alpha, beta_mk, beta_sp, (beta_mk * b1 + beta_sp * b2) / vy AS r2 FROM b) SELECT time, asset, {_tidy_sql('alpha beta_mk beta_sp r2', 5)} FROM o""",
)
def _(spark, d):
    """Each supplier's returns on the market's mean and the spread of two halves of the nations, both at once, over a year."""
    from .regression import joint_exposures

    moves = months(spark, d).withColumn("r", ts.ret(F.col("px"), MONTHLY))
    factors = moves.groupBy("time").agg(F.avg("r").alias("mk"), (F.avg(F.when(F.col("sector") < 12, F.col("r"))) - F.avg(F.when(F.col("sector") >= 12, F.col("r")))).alias("sp"))
    told = joint_exposures(moves.join(factors, "time"), "r", ["mk", "sp"], MONTHLY, _N)
    return tidy(told.select("time", "asset", "alpha", "beta_mk", "beta_sp", "r2"), 5)


_MOVE = "(0.95 * q + 0.05 * (1 - q))"


@_query(
    "regime_filtered",
    f"""WITH {TICKS_SQL}, l AS (SELECT *, exp(-0.5 * pow((coalesce(x, 0) - 15) / 40, 2) + 0.5 * pow((coalesce(x, 0) + 25) / 20, 2) + ln(20) - ln(40)) AS rho FROM t),
 f AS (SELECT event_id, list_reduce(list_prepend(0.5, list(rho) OVER w), lambda q, r: {_MOVE} * r / ({_MOVE} * r + 1 - {_MOVE})) AS q FROM l WINDOW w AS (PARTITION BY asset ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT event_id, CAST(CASE WHEN q > 0.5 THEN 1 ELSE 0 END AS INT) AS state, round(1 - q, 6) + 0.0 AS low, round(q, 6) + 0.0 AS high FROM f""",
)
def _(spark, d):
    """The chances of a calm and a wild state at each event of a user, given those before, by a scan of state matrices."""
    from .regimes import Regimes, filtered_regimes

    told = filtered_regimes(ticks(spark, d).select("asset", "time", "event_id", "x"), Regimes.sticky((-25.0, 15.0), (20.0, 40.0)), "x", s=TICKS)
    return told.select("event_id", "state", (F.round(F.col("chances")[0], 6) + 0.0).alias("low"), (F.round(F.col("chances")[1], 6) + 0.0).alias("high"))


@_query("regime_fitted")
def _(spark, d):
    """Means and deviations of three states, fitted to all users' events at once."""
    from .regimes import fitted_regimes

    found = fitted_regimes(ticks(spark, d).select("asset", "time", "event_id", "x"), "x", states=3, rounds=4, s=TICKS)
    return spark.createDataFrame([(i, round(m, 6), round(v, 6)) for i, (m, v) in enumerate(zip(found.mean, found.std, strict=True))], "state int, mean double, std double")
