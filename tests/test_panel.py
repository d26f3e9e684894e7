"""Order statistics, schedules, users' functions and joint regressions against numpy and plain loops; buffers of streams."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import selection
from tidemark.operators.axes import Section, Series
from tidemark.operators.userfunctions import apply_ts, apply_xs, fold
from tidemark.plans.rebalance import drifting, rebalanced
from tidemark.plans.regression import joint_exposures
from tidemark.streaming import online

S = Series("asset", "time")


@pytest.mark.parametrize("few", [4096, 5])
def test_quantiles_are_those_of_a_sort(spark, monkeypatch, few):
    """Values that spread, that tie in a third of the rows, that are all equal, and none; a search of several rounds."""
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(few)
    rows = [(rng.gauss(0, 1e6), rng.choice([7.0, 7.0, rng.random()]), -2.5, None, rng.choice([None, float("nan"), -0.0, 1e300, -1e300, 3.0])) for _ in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(6)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = selection.exact_quantiles(df, {c: wanted for c in "abcde"})
    for i, c in enumerate("abce"):
        own = [r[(0, 1, 2, 4)[i]] for r in rows]
        assert got[c] == pytest.approx(np.quantile([x for x in own if x is not None and not math.isnan(x)], wanted).tolist(), rel=1e-12)
    assert got["d"] == [None] * 7
    assert selection.order_statistics(df, {"a": [0, 899, 900, -1]}).keys() == {("a", 0), ("a", 899)}


def test_weights_drift_between_settings(spark):
    """Two assets over two months; b has no row on one day, c only in the second month."""
    d = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 2), date(2024, 2, 3)]
    rows = [(d[0], "a", 0.5, 0.6), (d[1], "a", 0.1, 9.0), (d[2], "a", -0.2, 0.5), (d[3], "a", None, 9.0), (d[4], "a", 0.3, 9.0)]
    rows += [(d[0], "b", 0.0, 0.3), (d[2], "b", 0.4, 0.1), (d[4], "b", 0.2, 9.0), (d[2], "c", 0.7, 0.2), (d[3], "c", -0.5, 9.0)]
    panel = spark.createDataFrame(rows, "time date, asset string, ret double, target double")
    held = {(r["time"], r["asset"]): r["weight"] for r in drifting(panel).collect()}
    v1 = 0.6 * 1.1 + 0.3 + 0.1
    assert held[d[1], "a"] == pytest.approx(0.6 * 1.1 / v1) and (d[0], "a") not in held
    v2 = 0.6 * 1.1 * 0.8 + 0.3 * 1.4 + 0.1
    assert held[d[2], "a"] == pytest.approx(0.6 * 1.1 * 0.8 / v2) and held[d[2], "c"] == 0.0
    got = {r["time"]: r for r in rebalanced(panel, cost_bps=100.0).collect()}
    assert sorted(got) == d[1:]
    assert got[d[1]]["gross"] == pytest.approx(v1 - 1) and got[d[2]]["gross"] == pytest.approx(v2 / v1 - 1)
    turnover = abs(0.5 - 0.6 * 1.1 * 0.8 / v2) + abs(0.1 - 0.3 * 1.4 / v2) + 0.2
    assert got[d[2]]["turnover"] == pytest.approx(turnover) and got[d[2]]["ret"] == pytest.approx(v2 / v1 - 1 - turnover / 100)
    assert got[d[3]]["gross"] == pytest.approx(0.2 * -0.5) and got[d[3]]["turnover"] == 0
    assert rebalanced(panel.limit(0)).collect() == []
    with pytest.raises(ValueError, match="every"):
        rebalanced(panel, every="fortnight")


def test_users_functions(spark):
    rows = [(i % 5, ["x", "y", None][i % 3], i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "time int, asset string, k int, v double").repartition(4)
    got = apply_ts(df.withColumn("o", F.lit("replaced")), Series("asset", "time", ("k",)), "o", lambda own: own["v"].cumsum()).collect()
    for asset in ("x", "y", None):
        own = sorted((r["time"], r["k"], r["v"], r["o"]) for r in got if r["asset"] == asset)
        assert [r[3] for r in own] == np.cumsum([r[2] for r in own]).tolist()
    across = apply_xs(df, Section("time", "k"), "o", lambda own: own["v"].rank().astype(int), "long").collect()
    assert all(r["o"] == 1 + sum(q["time"] == r["time"] and q["v"] < r["v"] for q in across) for r in across)
    with pytest.raises(Exception, match="1 values for"):
        apply_ts(df, Series("asset", "time"), "o", lambda own: own["v"][:1]).collect()


def test_folds_merge_partial_states(spark, monkeypatch):
    """A hot key over many partitions, a NULL key, few states held at a time, and one table without keys."""
    from tidemark.operators import userfunctions

    monkeypatch.setattr(userfunctions, "KEYS", 3)
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + [None, *"abcdefgh"]), rng.randrange(100)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key string, v long").repartition(7)
    parts = (lambda: set(), lambda s, own: s | set(own["v"].tolist()), lambda a, b: a | b, lambda s: {"n": len(s), "top": max(s)}, "n long, top long")
    got = {r["key"]: (r["n"], r["top"]) for r in fold(df, ["key"], *parts).collect()}
    assert got == {k: (len(o), max(o)) for k in {r[0] for r in rows} for o in [{v for q, v in rows if q == k}]}
    assert fold(df, [], *parts).collect()[0]["n"] == 100 and fold(df.limit(0), ["key"], *parts).collect() == []


def test_joint_exposures_are_least_squares(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 15
    for asset in "ab":
        f = rng.standard_normal((60, 3)) * [1, 0.01, 100] + [0, 5, 0]
        y = f @ [0.5, -20.0, 0.03] + 0.2 + rng.standard_normal(60) * 0.1
        f[40:, 2] = f[40:, 0] * 3 if asset == "b" else f[40:, 2]  # from row 54 on a combination
        rows += [(asset, i, None if i == 20 else float(y[i]), *map(float, f[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "asset string, time int, y double, f double, g double, h double")
    got = {(r["asset"], r["time"]): r for r in joint_exposures(df, "y", ["f", "g", "h"], S, n).collect()}
    for asset in "ab":
        own = [r for r in rows if r[0] == asset]
        for i in range(60):
            r = got[asset, i]
            if i < n - 1 or 20 <= i < 20 + n or (asset == "b" and i >= 54):
                assert r["beta_f"] is None and r["alpha"] is None and r["r2"] is None
                continue
            part = own[i - n + 1 : i + 1]
            x, y = np.array([[1.0, *q[3:]] for q in part]), np.array([q[2] for q in part])
            want = np.linalg.lstsq(x, y, rcond=None)[0]
            assert [r["alpha"], r["beta_f"], r["beta_g"], r["beta_h"]] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-8)
            assert r["r2"] == pytest.approx(1 - ((y - x @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-8)
    assert set(joint_exposures(df, "y", ["f"], S, n).columns) == {*df.columns, "alpha", "r2", "beta_f"}


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_buffers_take_ticks_out_of_order(spark, tmp_path):
    """Ticks that come late but within the watermark are in their places; one that is too late is dropped."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    parts = [[("a", at(0), 1.0), ("a", at(30), 2.0), ("b", at(5), 9.0)], [("a", at(25), 4.0), ("a", at(30), 8.0), ("b", at(100), None)], [("a", at(1), 99.0), ("a", at(200), 16.0)], [("z", at(9000), 0.0)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for part in parts:
            spark.createDataFrame(part, "asset string, time timestamp, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("asset string, time timestamp, x double").parquet(f"{tmp_path}/in")
            online.window_buffer(stream, seconds=1800.0, late="20 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["asset"], r["time"], r["x"]): (r["n"], r["total"], r["low"], r["high"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("a", at(0), 1.0): (1, 1.0, 1.0, 1.0), ("a", at(25), 4.0): (2, 5.0, 1.0, 4.0), ("a", at(30), 2.0): (4, 15.0, 1.0, 8.0), ("a", at(30), 8.0): (4, 15.0, 1.0, 8.0),
        ("b", at(5), 9.0): (1, 9.0, 9.0, 9.0), ("b", at(100), 0.0): (1, 0.0, 0.0, 0.0), ("a", at(200), 16.0): (1, 16.0, 16.0, 16.0),
    }


def test_bars_of_bars_in_batch(spark):
    rows = [("a", datetime(2024, 1, 1) + timedelta(seconds=37 * i), float((i * 7919) % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "asset string, time timestamp, px double")
    got = online.bars_of_bars(df).orderBy("time").collect()
    want = online.bars(df, every="60 minutes").orderBy("time").collect()
    assert got == want and len(got) == 4
