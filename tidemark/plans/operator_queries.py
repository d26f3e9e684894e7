"""One query for each operator, over the tick panel or the month-by-supplier panel, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as e
from ..operators import crosssection as xs
from ..operators import timeseries as ts
from .panels import MONTHS, MONTHS_SQL, TICKS, TICKS_SQL, finite, finite_sql, kind, kind_sql, months, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N = 5


Made = Callable[[SimpleNamespace], Column]
Framed = Callable[[DataFrame], DataFrame]


def c(name: str) -> Column:
    return F.col(name)


def _columns() -> SimpleNamespace:
    """The panels' columns; made when a query runs, as columns need a session."""
    return SimpleNamespace(**{k: c(k) for k in "zyxpv"})


_NAN, _INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"
_WINDOWS = f"""WINDOW w AS (PARTITION BY asset ORDER BY time, event_id),
 wn AS (PARTITION BY asset ORDER BY time, event_id ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW),
 wc AS (PARTITION BY asset ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _tick(name: str, column: Made, sql: str, ctes: str = "", source: str = "t") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ticks(spark, sf_dir).select("event_id", column(_columns()).cast("double").alias("r")).select("event_id", finite(c("r")).alias("out"), kind(c("r")).alias("kind"))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {TICKS_SQL}{ctes}, o AS (SELECT event_id, CAST({sql} AS DOUBLE) AS r FROM {source} {_WINDOWS}) SELECT event_id, {finite_sql('r')} AS out, {kind_sql('r')} AS kind FROM o"


def _guard(test: str, *operands: str) -> str:
    return f"CASE WHEN {' OR '.join(f'{o} IS NULL' for o in operands)} THEN {_NAN} {test} END"


def _compare(test: str) -> str:
    return _guard(f"WHEN isnan(z) OR isnan(y) THEN 0 WHEN {test} THEN 1 ELSE 0", "z", "y")


_tick("ew_add", lambda t: e.add(t.z, t.y), "z + y")
_tick("ew_sub", lambda t: e.sub(t.z, t.y), "z - y")
_tick("ew_mul", lambda t: e.mul(t.z, t.y), "z * y")
_tick("ew_div", lambda t: e.div(t.z, t.y), f"CASE WHEN y <> 0 THEN z / y WHEN z IS NULL THEN NULL WHEN isnan(z) OR z = 0 THEN {_NAN} WHEN z > 0 THEN {_INF} ELSE -{_INF} END")
_tick("ew_neg", lambda t: e.neg(t.z), "-z")
_tick("ew_abs", lambda t: e.absolute(t.z), "abs(z)")
_tick("ew_sign", lambda t: e.sign(t.z), "CASE WHEN z IS NULL THEN NULL WHEN isnan(z) THEN 0 WHEN z > 0 THEN 1 WHEN z < 0 THEN -1 ELSE 0 END")
_tick("ew_log", lambda t: e.log(t.y), f"CASE WHEN y > 0 THEN ln(greatest(y, 1e-300)) WHEN y = 0 THEN -{_INF} ELSE {_NAN} END")
_tick("ew_log10", lambda t: e.log10(t.y), f"CASE WHEN y > 0 THEN log10(greatest(y, 1e-300)) WHEN y = 0 THEN -{_INF} ELSE {_NAN} END")
_tick("ew_exp", lambda t: e.exp(t.y), "exp(y)")
_tick("ew_pow", lambda t: e.power(t.y, 3.0), "y * y * y")
_tick("ew_clip", lambda t: e.clip(t.z, -10.0, 20.0), "CASE WHEN isnan(z) THEN -10 WHEN z IS NOT NULL THEN least(greatest(z, -10.0), 20.0) END")
_tick("ew_sqrt", lambda t: e.sqrt(t.y), f"CASE WHEN y < 0 THEN {_NAN} ELSE sqrt(abs(y)) END")
_tick("ew_floor", lambda t: e.floor(t.x), "floor(x)")
_tick("ew_ceil", lambda t: e.ceil(t.x), "ceil(x)")
_tick("ew_round", lambda t: e.round_half_away(t.y / 4.0, 0), "sign(y) * floor(abs(y / 4.0) + 0.5)")
_tick("ew_mod", lambda t: e.modulo(t.x, t.y), f"CASE WHEN y <> 0 THEN x - y * trunc(x / y) WHEN y = 0 THEN {_NAN} END")
_tick("ew_min", lambda t: e.minimum(t.z, t.y), _guard("WHEN isnan(z) THEN y WHEN isnan(y) THEN z ELSE least(z, y)", "z", "y"))
_tick("ew_max", lambda t: e.maximum(t.z, t.y), _guard("WHEN isnan(z) THEN y WHEN isnan(y) THEN z ELSE greatest(z, y)", "z", "y"))
for _name, _test in (("gt", "z > y"), ("lt", "z < y"), ("ge", "z >= y"), ("le", "z <= y")):
    _tick(f"cmp_{_name}", lambda t, made=getattr(e, _name): made(t.z, t.y), _compare(_test))
_tick("cmp_eq", lambda t: e.eq(F.round(t.z / 10.0), t.y), _compare("abs(round(z / 10.0) - y) < 1e-10"))
_tick("cmp_ne", lambda t: e.ne(F.round(t.z / 10.0), t.y), _compare("abs(round(z / 10.0) - y) >= 1e-10"))
_tick("logic_and", lambda t: e.both(t.z, t.y), _guard("WHEN z <> 0 AND y <> 0 THEN 1 ELSE 0", "z", "y"))
_tick("logic_or", lambda t: e.either(t.z - t.z, t.y), _guard("WHEN z - z <> 0 OR y <> 0 THEN 1 ELSE 0", "z", "y"))
_tick("logic_not", lambda t: e.negation(t.y), "CASE WHEN y = 0 THEN 1 ELSE 0 END")
_tick("logic_where", lambda t: e.where(t.y, t.z, t.x), _guard("WHEN y <> 0 THEN z ELSE x", "y", "z", "x"))
_tick("data_is_nan", lambda t: e.is_nan(t.z), "CASE WHEN z IS NULL THEN NULL WHEN isnan(z) THEN 1 ELSE 0 END")
_tick("data_fill_nan", lambda t: e.fill_nan(t.z, 7.0), "CASE WHEN isnan(z) THEN 7 ELSE z END")
_tick("data_coalesce", lambda t: e.first_known(t.z, t.y), "coalesce(CASE WHEN NOT isnan(z) THEN z END, y)")
_tick("data_cumsum", lambda t: ts.cumsum(t.x, TICKS), "sum(coalesce(x, 0)) OVER wc")
_tick("data_cumprod", lambda t: ts.cumprod(t.x / 50.0, TICKS), "product(coalesce(x / 50.0, 1)) OVER wc")
_tick("data_cummax", lambda t: ts.cummax(t.z, TICKS), f"coalesce(max(CASE WHEN NOT isnan(z) THEN z END) OVER wc, -{_INF})")
_tick("data_cummin", lambda t: ts.cummin(t.z, TICKS), f"coalesce(min(CASE WHEN NOT isnan(z) THEN z END) OVER wc, {_INF})")
_tick("data_ffill", lambda t: ts.ffill(t.z, TICKS), "last_value(CASE WHEN NOT isnan(z) THEN z END IGNORE NULLS) OVER wc")

_MEAN, _STD = "avg(coalesce(x, 0)) OVER wn", "stddev_pop(coalesce(x, 0)) OVER wn"
_VARIES = "CASE WHEN " + _STD + " > 1e-10 THEN {} ELSE 0 END"
_tick("ts_lag", lambda t: ts.lag(t.x, TICKS, 2), "lag(x, 2) OVER w")
_tick("ts_lead", lambda t: ts.lead(t.x, TICKS, 1), "lead(x, 1) OVER w")
_tick("ts_ret", lambda t: ts.ret(t.p, TICKS, 1), "p / (lag(p, 1) OVER w) - 1")
_tick("ts_delta", lambda t: ts.delta(t.x, TICKS, 2), "x - lag(x, 2) OVER w")
_tick("ts_rolling_mean", lambda t: ts.rolling_mean(t.x, TICKS, N), _MEAN)
_tick("ts_rolling_std", lambda t: ts.rolling_std(t.x, TICKS, N), _STD)
_tick("ts_rolling_var", lambda t: ts.rolling_var(t.x, TICKS, N), "var_pop(coalesce(x, 0)) OVER wn")
_tick("ts_rolling_sum", lambda t: ts.rolling_sum(t.x, TICKS, N), "sum(coalesce(x, 0)) OVER wn")
_tick("ts_rolling_min", lambda t: ts.rolling_min(t.z, TICKS, N), f"coalesce(min(CASE WHEN NOT isnan(z) THEN z END) OVER wn, {_INF})")
_tick("ts_rolling_max", lambda t: ts.rolling_max(t.z, TICKS, N), f"coalesce(max(CASE WHEN NOT isnan(z) THEN z END) OVER wn, -{_INF})")
_tick("ts_rolling_cov", lambda t: ts.rolling_cov(t.x, t.y, TICKS, N), "covar_pop(coalesce(x, 0), y) OVER wn")
_tick("ts_rolling_corr", lambda t: ts.rolling_corr(t.x, t.y, TICKS, N), f"CASE WHEN ({_STD}) * (stddev_pop(y) OVER wn) > 1e-10 THEN (covar_pop(coalesce(x, 0), y) OVER wn) / (({_STD}) * (stddev_pop(y) OVER wn)) ELSE 0 END")
_tick("ts_rolling_beta", lambda t: ts.rolling_beta(t.x, t.y, TICKS, N), "CASE WHEN (var_pop(y) OVER wn) > 1e-10 THEN (covar_pop(coalesce(x, 0), y) OVER wn) / (var_pop(y) OVER wn) ELSE 0 END")
_ROWS = f"least(row_number() OVER w, {N})"
_tick("ts_decay_linear", lambda t: ts.decay_linear(t.x, TICKS, N), "(" + " + ".join(f"greatest({_ROWS} - {k}, 0) * coalesce(lag(coalesce(x, 0), {k}) OVER w, 0)" for k in range(N)) + f") / {N * (N + 1) / 2}")
_LISTED = ", l AS (SELECT *, list(y) OVER wn AS ys FROM t " + _WINDOWS + ")"
_tick("ts_argmax", lambda t: ts.ts_argmax(t.y, TICKS, N), "len(ys) - list_position(list_reverse(ys), list_max(ys))", _LISTED, "l")
_tick("ts_argmin", lambda t: ts.ts_argmin(t.y, TICKS, N), "list_position(ys, list_min(ys)) - 1", _LISTED, "l")
_tick("ts_rank", lambda t: ts.ts_rank(t.y, TICKS, N), "len(list_filter(ys, lambda q: q < y)) / greatest(len(ys) - 1, 1)", _LISTED, "l")
_tick("ts_skew", lambda t: ts.ts_skew(t.x, TICKS, N), _VARIES.format(f"((avg(pow(coalesce(x, 0), 3)) OVER wn) - 3 * (avg(pow(coalesce(x, 0), 2)) OVER wn) * ({_MEAN}) + 2 * pow({_MEAN}, 3)) / pow({_STD}, 3)"))
_tick("ts_kurt", lambda t: ts.ts_kurt(t.x, TICKS, N), _VARIES.format("kurtosis_pop(coalesce(x, 0)) OVER wn"))
_tick("ts_product", lambda t: ts.ts_product(t.x / 50.0, TICKS, N), "product(coalesce(x / 50.0, 1)) OVER wn")
_tick("ts_zscore", lambda t: ts.ts_zscore(t.x, TICKS, N), _VARIES.format(f"(coalesce(x, 0) - ({_MEAN})) / ({_STD})"))
_CHANGE = ", l AS (SELECT *, coalesce(abs(p - lag(p) OVER w), 0) AS tr, coalesce(greatest(p - (p - v), abs(p - lag(p - v / 2) OVER w), abs(p - v - lag(p - v / 2) OVER w)), v) AS tr3 FROM t " + _WINDOWS + ")"
_tick("tech_atr", lambda t: ts.atr(t.p, TICKS, N), "avg(tr) OVER wn", _CHANGE, "l")
_tick("tech_vwap", lambda t: ts.vwap(t.p, t.v, TICKS), "(sum(p * v) OVER wc) / (sum(v) OVER wc)")
_tick("ts_scale_vol", lambda t: ts.scale_vol(t.x, TICKS, 0.1, N), f"CASE WHEN ({_STD}) * sqrt(252) > 1e-10 THEN x * 0.1 / (({_STD}) * sqrt(252)) ELSE 0 END")
_tick("ts_full_window_mean", lambda t: ts.full_window(ts.rolling_mean(t.x, TICKS, N), TICKS, N), f"CASE WHEN row_number() OVER w >= {N} THEN {_MEAN} END")


def _atr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = ticks(spark, sf_dir).withColumns({"high": c("p"), "low": c("p") - c("v"), "close": c("p") - c("v") / 2.0})
    return panel.select("event_id", finite(ts.true_range_atr(c("high"), c("low"), c("close"), TICKS, N)).alias("out"))


QUERIES["tech_true_range_atr"] = _atr3
ORACLES["tech_true_range_atr"] = f"WITH {TICKS_SQL}{_CHANGE} SELECT event_id, {finite_sql('avg(tr3) OVER wn')} AS out FROM l {_WINDOWS}"


def _recursive(name: str, operator: str, args: tuple, sql: str, ctes: str = "") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = ticks(spark, sf_dir).select("asset", "time", "event_id", "p")
        return ts.recursive(panel, "p", operator, TICKS, r=args).select("event_id", finite(c("r")).alias("out"))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {TICKS_SQL}{ctes}, o AS (SELECT event_id, {sql} AS r FROM {'l' if ctes else 't'} {_WINDOWS}) SELECT event_id, {finite_sql('r')} AS out FROM o"


def _ema_sql(span: int, of: str = "p") -> str:
    return f"list_reduce(list({of}) OVER wc, lambda a, q: a + {2 / (span + 1)!r} * (q - a))"


_recursive("ts_ema", "ema", (5,), _ema_sql(5))
_recursive("tech_macd", "macd", (3, 6), f"{_ema_sql(3)} - {_ema_sql(6)}")
_recursive("tech_macd_histogram", "macd_histogram", (3, 6, 4), f"line - {_ema_sql(4, 'line')}", f", l AS (SELECT *, {_ema_sql(3)} - {_ema_sql(6)} AS line FROM t {_WINDOWS})")
_RSI = f""", g AS (SELECT *, coalesce(p - lag(p) OVER w, 0) AS ch FROM t {_WINDOWS}),
 l AS (SELECT *, row_number() OVER w AS k, list_reduce(list_prepend(0.0, list(greatest(ch, 0.0)) OVER wc), lambda a, q: a + (q - a) / 14.0) AS gain,
  list_reduce(list_prepend(0.0, list(greatest(-ch, 0.0)) OVER wc), lambda a, q: a + (q - a) / 14.0) AS loss FROM g {_WINDOWS})"""
_recursive("tech_rsi", "rsi", (14,), "CASE WHEN k = 1 THEN 50.0 WHEN loss > 1e-10 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 1e-10 THEN 100.0 ELSE 50.0 END", _RSI)


def _month(name: str, column: Made, sql: str, ctes: str = "", source: str = "m") -> None:
    _months(name, lambda panel: panel.select("time", "asset", column(_columns()).alias("out")), sql, ctes, source)


def _months(name: str, made: Framed, sql: str, ctes: str = "", source: str = "m") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return made(months(spark, sf_dir)).select("time", "asset", finite(c("out").cast("double"), 7).alias("out"))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {MONTHS_SQL}{ctes}, o AS (SELECT time, asset, CAST({sql} AS DOUBLE) AS r FROM {source} WINDOW s AS (PARTITION BY time), so AS (PARTITION BY time ORDER BY x ASC NULLS LAST, asset)) SELECT time, asset, {finite_sql('r', 7)} AS out FROM o"


_RANK = "(row_number() OVER so) / (count(*) OVER s)"
_month("xs_rank", lambda t: xs.rank(t.x, MONTHS), _RANK)
_month("xs_rank_pct", lambda t: xs.rank_pct(t.x, MONTHS), f"100 * {_RANK}")
_month("xs_mean", lambda t: xs.mean(t.x, MONTHS), "avg(x) OVER s")
_month("xs_std", lambda t: xs.std(t.x, MONTHS), "stddev_pop(x) OVER s")
_month("xs_sum", lambda t: xs.total(t.x, MONTHS), "sum(x) OVER s")
_month("xs_count", lambda t: xs.count(t.x, MONTHS), "count(x) OVER s")
_month("xs_zscore", lambda t: xs.zscore(t.x, MONTHS), "CASE WHEN x IS NULL THEN NULL WHEN (stddev_pop(x) OVER s) > 1e-10 THEN (x - avg(x) OVER s) / (stddev_pop(x) OVER s) ELSE 0 END")
_month("xs_zscore_sample", lambda t: xs.zscore(t.x, MONTHS, 1), "CASE WHEN x IS NULL THEN NULL WHEN (stddev_samp(x) OVER s) > 1e-10 THEN (x - avg(x) OVER s) / (stddev_samp(x) OVER s) ELSE 0 END")
_month("xs_scale_gross", lambda t: xs.scale(t.x - 30000.0, MONTHS), "CASE WHEN x IS NULL THEN NULL WHEN (sum(abs(x - 30000.0)) OVER s) > 1e-10 THEN (x - 30000.0) / (sum(abs(x - 30000.0)) OVER s) ELSE 0 END")
_month("xs_scale_net", lambda t: xs.scale(t.x, MONTHS, "net"), "CASE WHEN abs(sum(x) OVER s) < 1e-10 THEN x ELSE x / (sum(x) OVER s) END")
_month("xs_demean", lambda t: xs.demean(t.x, MONTHS), "x - avg(x) OVER s")
_month("xs_neutralize", lambda t: xs.neutralize(t.x, MONTHS, "sector"), "x - avg(x) OVER (PARTITION BY time, sector)")
_month("xs_group_mean", lambda t: xs.group_mean(t.x, MONTHS, "sector"), "avg(x) OVER (PARTITION BY time, sector)")
_SORTED = ", l AS (SELECT *, list_sort(list(x) FILTER (WHERE x IS NOT NULL) OVER (PARTITION BY time)) AS xl FROM m)"
_months("xs_winsor", lambda panel: xs.winsor(panel, "x", MONTHS, 0.1, "out"), "CASE WHEN x IS NULL THEN NULL ELSE least(greatest(x, xl[CAST(floor(len(xl) * 0.1) AS INT) + 1]), xl[CAST(least(floor(len(xl) * 0.9), len(xl) - 1) AS INT) + 1]) END", _SORTED, "l")
_months("xs_quantile", lambda panel: xs.quantile(panel, "x", MONTHS, 0.5, "out"), "xl[CAST(floor((len(xl) - 1) * 0.5) AS INT) + 1]", _SORTED, "l")
_month("xs_bucket", lambda t: xs.bucket(t.x, MONTHS, 5), f"least(greatest(ceil({_RANK} * 5), 1), 5)")
_month("xs_median", lambda t: xs.median(t.x, MONTHS), "median(x) OVER s")
_month("xs_long_short", lambda t: xs.long_short(t.x, MONTHS, 0.2, 0.2, 0.05), f"CASE WHEN {_RANK} >= 1 - 0.2 THEN least(0.05, 1.0 / ((count(*) OVER s) * 0.2)) WHEN {_RANK} <= 0.2 THEN greatest(-0.05, -1.0 / ((count(*) OVER s) * 0.2)) ELSE 0 END")
_K = "ceil((count(x) OVER s) * 0.2)"
_month("xs_extreme_weights", lambda t: xs.extreme_weights(t.x, MONTHS), f"CASE WHEN row_number() OVER so > count(x) OVER s THEN 0 WHEN row_number() OVER so > count(x) OVER s - {_K} THEN 1.0 / {_K} WHEN row_number() OVER so <= {_K} THEN -1.0 / {_K} ELSE 0 END")


def _mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = months(spark, sf_dir).withColumn("deviation", e.n0(c("x")) - xs.median(c("x"), MONTHS))
    return panel.select("time", "asset", finite(xs.mad(c("deviation"), MONTHS)).alias("out"))


QUERIES["xs_mad"] = _mad
ORACLES["xs_mad"] = f"WITH {MONTHS_SQL}, l AS (SELECT time, asset, abs(coalesce(x, 0) - median(x) OVER (PARTITION BY time)) AS dev FROM m) SELECT time, asset, {finite_sql('median(dev) OVER (PARTITION BY time)')} AS out FROM l"
