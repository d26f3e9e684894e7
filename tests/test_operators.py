"""Hand vectors of the operators, one asset in time order or one time across assets."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import elementwise as e
from tidemark.operators import crosssection as xs
from tidemark.operators import timeseries as ts
from tidemark.operators.axes import Section, Series

X, V = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0], [2.0, 1.0, 3.0, 1.0, 1.0, 2.0]
S, C = Series("asset", "time"), Section("day", "asset")


@pytest.fixture(scope="module")
def rows(spark):
    # shuffled on purpose: input order must not matter
    made = [(1, i, x, v, 1, chr(97 + i)) for i, (x, v) in enumerate(zip(X, V, strict=True))]
    return spark.createDataFrame([made[i] for i in (3, 0, 5, 1, 4, 2)], "asset int, time int, x double, v double, day int, name string").cache()


def along(rows, column):
    return [r["o"] for r in rows.select("time", column.alias("o")).orderBy("time").collect()]


SERIES = {
    "ret": (lambda x: ts.ret(x, S), [None, -0.666667, 3.0, -0.75, 4.0, 0.8]),
    "delta": (lambda x: ts.delta(x, S, 2), [None, None, 1.0, 0.0, 1.0, 8.0]),
    "mean": (lambda x: ts.rolling_mean(x, S, 3), [3.0, 2.0, 2.666667, 2.0, 3.333333, 5.0]),
    "std": (lambda x: ts.rolling_std(x, S, 3), [0.0, 1.0, 1.247219, 1.414214, 1.699673, 3.265986]),
    "sum": (lambda x: ts.rolling_sum(x, S, 3), [3.0, 4.0, 8.0, 6.0, 10.0, 15.0]),
    "min": (lambda x: ts.rolling_min(x, S, 3), [3.0, 1.0, 1.0, 1.0, 1.0, 1.0]),
    "max": (lambda x: ts.rolling_max(x, S, 3), [3.0, 3.0, 4.0, 4.0, 5.0, 9.0]),
    "decay": (lambda x: ts.decay_linear(x, S, 3), [0.5, 0.833333, 2.833333, 2.0, 3.5, 6.333333]),
    "argmax": (lambda x: ts.ts_argmax(x, S, 3), [0, 0, 2, 1, 2, 2]),
    "argmin": (lambda x: ts.ts_argmin(x, S, 3), [0, 1, 1, 0, 1, 0]),
    "rank": (lambda x: ts.ts_rank(x, S, 3), [0.0, 0.0, 1.0, 0.0, 1.0, 1.0]),
    "skew": (lambda x: ts.ts_skew(x, S, 3), [0, 0.0, -0.381802, 0.707107, -0.528005, 0.0]),
    "kurt": (lambda x: ts.ts_kurt(x, S, 3), [0, -2.0, -1.5, -1.5, -1.5, -1.5]),
    "product": (lambda x: ts.ts_product(x, S, 3), [3.0, 3.0, 12.0, 4.0, 20.0, 45.0]),
    "zscore": (lambda x: ts.ts_zscore(x, S, 3), [0, -1.0, 1.069045, -0.707107, 0.980581, 1.224745]),
    "cumsum": (lambda x: ts.cumsum(x, S), [3.0, 4.0, 8.0, 9.0, 14.0, 23.0]),
    "cumprod": (lambda x: ts.cumprod(x, S), [3.0, 3.0, 12.0, 12.0, 60.0, 540.0]),
    "atr": (lambda x: ts.atr(x, S, 3), [0.0, 1.0, 1.666667, 2.666667, 3.333333, 3.666667]),
    "vwap": (lambda x: ts.vwap(x, F.col("v"), S), [3.0, 2.333333, 3.166667, 2.857143, 3.125, 4.3]),
}


@pytest.mark.parametrize("name", SERIES)
def test_series(rows, name):
    made, wanted = SERIES[name]
    assert along(rows, made(F.col("x"))) == [None if w is None else pytest.approx(w, abs=1e-6) for w in wanted]


RECURSIVE = {
    "ema": ((3,), [3.0, 2.0, 3.0, 2.0, 3.5, 6.25]),
    "macd": ((2, 4), [0.0, -0.533333, 0.302222, -0.411259, 0.62238, 1.729807]),
    "rsi": ((3,), [50.0, 0.0, 69.230769, 33.962264, 67.28972, 81.382979]),
}


@pytest.mark.parametrize("name", RECURSIVE)
def test_recursive(rows, name):
    args, wanted = RECURSIVE[name]
    out = ts.recursive(rows, "x", name, S, o=args).orderBy("time").collect()
    assert [r["o"] for r in out] == [pytest.approx(w, abs=1e-6) for w in wanted]


ACROSS = {
    "rank": (lambda x: xs.rank(x, Section("day", "name")), [0.5, 0.166667, 0.666667, 0.333333, 0.833333, 1.0]),
    "zscore": (lambda x: xs.zscore(x, C), [-0.304855, -1.036508, 0.060971, -1.036508, 0.426798, 1.890103]),
    "zscore1": (lambda x: xs.zscore(x, C, 1), [-0.278294, -0.946198, 0.055659, -0.946198, 0.389611, 1.72542]),
    "scale": (lambda x: xs.scale(x, C), [0.130435, 0.043478, 0.173913, 0.043478, 0.217391, 0.391304]),
    "bucket": (lambda x: xs.bucket(x, Section("day", "name"), 3), [2, 1, 2, 1, 3, 3]),
    "median": (lambda x: xs.median(x, C), [3.5] * 6),
    "long_short": (lambda x: xs.long_short(x, Section("day", "name")), [0.0, -0.05, 0.0, 0.0, 0.05, 0.05]),
}


@pytest.mark.parametrize("name", ACROSS)
def test_across(rows, name):
    made, wanted = ACROSS[name]
    assert along(rows, made(F.col("x"))) == [pytest.approx(w, abs=1e-6) for w in wanted]


def test_places_in_a_section(rows):
    names = Section("day", "name")
    assert [r["o"] for r in xs.winsor(rows, "x", names, 0.2, "o").orderBy("time").collect()] == [3.0, 1.0, 4.0, 1.0, 5.0, 5.0]
    assert [r["o"] for r in xs.quantile(rows, "x", names, 0.5, "o").orderBy("time").collect()] == [3.0] * 6


def test_ieee_corners(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 1.0), (None, 1.0), (4.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(e.div(a, b).alias("d"), e.log(b).alias("l"), e.sign(a).alias("s"), e.maximum(a, b).alias("m"), e.gt(a, b).alias("g"), e.clip(a, 0.0, 2.0).alias("c"), e.is_nan(a).alias("n"), e.both(a, b).alias("x")).collect()
    assert got[0]["d"] == math.inf and got[1]["d"] == -math.inf and math.isnan(got[2]["d"]) and math.isnan(got[3]["d"]) and got[4]["d"] is None and got[5]["d"] == 2
    assert got[0]["l"] == -math.inf and got[3]["s"] == 0 and got[3]["m"] == 1 and math.isnan(got[4]["m"]) and got[3]["g"] == 0 and got[3]["c"] == 0 and got[4]["n"] is None and got[3]["x"] == 1


def test_weights_skip_unknown_values(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (1, "c", 3.0), (1, "d", float("nan")), (1, "e", 2.0)], "time int, asset string, x double")
    got = {r["asset"]: r["w"] for r in df.select("asset", xs.extreme_weights(F.col("x"), Section()).alias("w")).collect()}
    assert got == {"a": -1.0, "b": 0.0, "c": 1.0, "d": 0.0, "e": 0.0}
