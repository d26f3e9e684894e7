"""Backtest, analytics, rigor, optimisers, sources and streams on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import analytics as an
from tidemark.plans import backtest as bt
from tidemark.plans import optimise as op
from tidemark.plans import rigor
from tidemark.sources import files
from tidemark.streaming import online


def panel(spark, weights, prices):
    return spark.createDataFrame([(t, "a", float(p), float(w)) for t, (w, p) in enumerate(zip(weights, prices, strict=True))], "time int, asset string, px double, weight double")


def test_execution_lag(spark):
    got = bt.portfolio_returns(panel(spark, [0, 1, 0], [100, 110, 110]), cost_bps=0.0).orderBy("time").collect()
    assert [r["ret"] for r in got] == pytest.approx([0, 0, 0])
    got = bt.portfolio_returns(panel(spark, [1, 1, 1], [100, 110, 115.5]), cost_bps=0.0).orderBy("time").collect()
    assert [r["ret"] for r in got] == pytest.approx([0, 0.10, 0.05])


def test_metrics_of_a_known_history(spark):
    r = [0.01, -0.005, 0.02, -0.01, 0.015]
    df = spark.createDataFrame([(i, x, 0.1) for i, x in enumerate(r)], "time int, ret double, turnover double")
    got = bt.metrics(df).first()
    total = np.prod(1 + np.array(r)) - 1
    assert got["total_return"] == pytest.approx(total) and got["win_rate"] == pytest.approx(0.6) and got["max_drawdown"] == pytest.approx(0.01)
    assert got["sharpe"] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * math.sqrt(252)) and got["profit_factor"] == pytest.approx(0.015 / 0.0075)
    assert got["turnover"] == pytest.approx(0.1 * 252)


def test_splits_and_dividends_scale_what_was_before(spark):
    prices = spark.createDataFrame([(d, s, 100.0, 10.0) for d in ("2024-01-01", "2024-01-02", "2024-01-03") for s in ("a", "b")], "time string, asset string, px double, volume double").withColumn("time", F.to_date("time"))
    actions = spark.createDataFrame([("a", "2024-01-02", "split", 4.0), ("a", "2024-01-03", "dividend", 10.0)], "symbol string, date string, action string, value double").withColumn("date", F.to_date("date"))
    got = {(str(r["time"]), r["asset"]): r["factor"] for r in an.adjust_prices(prices, actions).collect()}
    assert got["2024-01-01", "a"] == pytest.approx(0.225) and got["2024-01-02", "a"] == pytest.approx(0.9) and got["2024-01-03", "a"] == 1 and got["2024-01-01", "b"] == 1


def test_as_of_takes_the_last_mark(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "asset string, time int")
    right = spark.createDataFrame([("a", 2, 7), ("a", 5, 8), ("a", 6, 9)], "asset string, date int, v int")
    assert sorted((r["asset"], r["time"], r["v"]) for r in an.as_of(left, right, on=["asset"], columns=["v"]).collect()) == [("a", 1, None), ("a", 5, 8), ("b", 5, None)]


def test_renames_are_followed(spark):
    got = an.current_symbols(spark.createDataFrame([("x", "y"), ("y", "z")], "symbol string, new_symbol string")).collect()
    assert {r["symbol"]: r["current"] for r in got} == {"x": "z", "y": "z"}


def test_rigor_formulas():
    assert rigor.norm_cdf(0) == 0.5 and rigor.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert rigor.probabilistic_sharpe(0.1, 0.0, 250, 0.0, 3.0) == pytest.approx(0.9425, abs=2e-3)
    assert rigor.deflated_sharpe(0.1, 50, 0.01, 250, 0.0, 3.0) < rigor.probabilistic_sharpe(0.1, 0.0, 250, 0.0, 3.0)
    assert rigor.least_track_record(0.0, 0.1, 0, 3) == math.inf


def test_overfitting_of_noise_is_likely_and_of_skill_is_not(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(12, 160))
    skill = noise.copy()
    skill[3] += 1.0

    def pbo(x):
        df = spark.createDataFrame([(int(i), int(t), float(x[i, t])) for i in range(12) for t in range(160)], "trial int, time int, ret double")
        return rigor.overfitting_probability(df, 6).first()["pbo"]

    assert pbo(skill) == 0.0 and pbo(noise) > 0.1


def test_optimisers_on_a_diagonal():
    cov = np.diag([1.0, 4.0])
    assert op.min_variance(cov) == pytest.approx([0.8, 0.2], abs=1e-3)
    assert op.risk_parity(cov) == pytest.approx([2 / 3, 1 / 3], abs=1e-3)
    assert op.hierarchical_risk_parity(cov) == pytest.approx([0.8, 0.2])
    assert op.component_var(np.array([0.5, 0.5]), cov).sum() == pytest.approx(1.645 * math.sqrt(1.25))


def test_wide_and_long_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("2024-01-01", 1.0, 2.0), ("2024-01-02", 3.0, None)], "date string, A double, B double")
    back = files.to_wide(files.to_long(wide)).orderBy("time").collect()
    assert back[0]["A"] == 1 and back[0]["B"] == 2 and back[1]["A"] == 3 and math.isnan(back[1]["B"])
    files.write(wide, f"{tmp_path}/x.csv")
    assert files.read(spark, f"{tmp_path}/x.csv").count() == 2


def test_vendor_formats(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Open,Close,Date\n1,2.5,2024-01-02\n1,x,2024-01-03\n")
    assert [tuple(map(str, r)) for r in files.read_vendor_bars(spark, f"{tmp_path}/v.csv").collect()] == [("2024-01-02", "2.5")]
    (tmp_path / "f.txt").write_text("made by hand\n\n,Mkt-RF,SMB,HML,RF\n20240102, 0.50, -0.10, x, 0.01\nend\n")
    got = files.read_factor_lines(spark, f"{tmp_path}/f.txt").collect()
    assert len(got) == 1 and got[0]["mkt_rf"] == pytest.approx(0.005) and math.isnan(got[0]["hml"])
    doc = '{"chart":{"result":[{"timestamp":[1,2],"indicators":{"quote":[{"close":[5.0,null]}]}}]}}'
    assert files.parse_chart_json(spark.createDataFrame([(doc,)], "value string")).count() == 1


def test_results_are_kept_and_found(spark, tmp_path):
    row = spark.createDataFrame([(1.5, 0.1), (0.5, 0.4)], "sharpe double, max_drawdown double")
    files.save_result(row, f"{tmp_path}/r", "s", "1")
    assert [r["sharpe"] for r in files.find_results(spark, f"{tmp_path}/r", strategy="s", min_sharpe=1.0).collect()] == [1.5]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{i:02d}", float(x)) for i, x in enumerate([3, 1, 4, 1, 5, 9])]
    df = spark.createDataFrame(rows, "asset string, time string, x double").withColumn("time", F.to_timestamp("time"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = online.indicators(stream, window=3, span=3, rsi_window=3).writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("told").orderBy("time").collect()
    assert [r["mean"] for r in got] == pytest.approx([3.0, 2.0, 2.666667, 2.0, 3.333333, 5.0], abs=1e-6)
    assert [r["ema"] for r in got] == pytest.approx([3.0, 2.0, 3.0, 2.0, 3.5, 6.25]) and [r["rsi"] for r in got] == pytest.approx([50.0, 0.0, 69.230769, 33.962264, 67.28972, 81.382979], abs=1e-5)


def test_current_symbols_follow_chains_to_their_end(spark):
    """Chains of 1 to 40 steps, two that meet, a cycle with a symbol that leads to it, and nothing."""
    from tidemark.plans.analytics import current_symbols

    rows = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [("b", "a7"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")]
    got = {r["symbol"]: r["current"] for r in current_symbols(spark.createDataFrame(rows, "symbol string, new_symbol string").repartition(3)).collect()}
    assert got == {**{f"a{i}": "a40" for i in range(40)}, "b": "a40", "c": "d", **dict.fromkeys("xyzw")}
    assert current_symbols(spark.createDataFrame([], "symbol string, new_symbol string")).collect() == []


def test_cost_models_by_hand():
    """Presets as published; a short of 100 000 at a quarter of the day's volume for 25.2 days."""
    assert an.COST_MODELS["retail"]["shape"] == "linear" and an.COST_MODELS["institutional"]["least"] == 10_000


def test_costs_of_a_short(spark):
    row = spark.range(1).select(*(c.alias(k) for k, c in an.trade_costs(F.lit(-100_000.0), F.lit(400_000.0), days=25.2, **an.COST_MODELS["default"]).items())).first()
    assert (row["commission"], row["slippage"], row["impact"], row["borrow"]) == pytest.approx((10.0, 20.0, 5_000.0, 50.0)) and row["total"] == pytest.approx(5_080.0)
    trades = spark.createDataFrame([(1, 1000.0, None, False), (1, -3000.0, None, True), (2, 0.0, 10.0, False)], "k int, notional double, adv double, is_short boolean")
    got = {r["k"]: (r["total_cost"], r["total_notional"], r["avg_cost_bps"]) for r in an.rebalance_cost(trades, ["k"], days=252.0, **an.COST_MODELS["default"]).collect()}
    assert got[1] == pytest.approx((1.2 + 15.0, 4000.0, 40.5)) and got[2] == (0.0, 0.0, 0.0)


def test_rules_are_enforced_in_order(spark):
    from tidemark.plans import constraints as cs

    df = spark.createDataFrame([(1, a, w, p) for a, w, p in (("a", 0.09, 0.0), ("b", 0.02, 0.04), ("c", 0.0005, 0.5), ("d", -0.03, None))], "time int, asset string, weight double, previous double")

    def left(*rules):
        return {r["asset"]: r["weight"] for r in cs.enforce(df, rules, previous="previous").collect()}

    assert left(*cs.LONG_SHORT_EQUITY[:2]) == pytest.approx({"a": 0.05, "b": 0.02, "c": 0.0, "d": -0.03})
    assert left(("max_gross", 0.07), ("max_weight", 0.05), ("min_weight", 0.001)) == pytest.approx({"a": 0.035, "b": 0.014, "c": 0.0, "d": -0.021})
    assert left(("max_longs", 1), ("max_positions", 1)) == pytest.approx({"a": 0.09, "b": 0.0, "c": 0.0, "d": 0.0})
    assert left(("target_net", 0.0), ("max_short", 0.02))["d"] == pytest.approx(-0.1105)
    # the removed asset c counts for nothing in turnover: (0.05 + 0.02 + 0.03) / 2
    assert left(("max_weight", 0.05), ("min_weight", 0.001), ("turnover", 0.025)) == pytest.approx({"a": 0.025, "b": 0.03, "c": 0.0, "d": -0.015})
    with pytest.raises(ValueError):
        left(("no_such", 1))


def test_names_and_members_at_a_date(spark):
    renames = spark.createDataFrame([("a", "b", "2001-01-01"), ("b", "c", "2005-01-01"), ("x", "y", "1999-01-01")], "symbol string, new_symbol string, date string").withColumn("date", F.to_date("date"))
    for at, wanted in (("2000-01-01", {"c": "a", "b": "a"}), ("2003-01-01", {"c": "b"}), ("2006-01-01", {})):
        assert {r["symbol"]: r["name"] for r in an.symbols_at(renames, at).collect()} == wanted
    members = spark.createDataFrame([("a", "2001-01-01"), ("b", "2001-01-01"), ("a", "2002-01-01")], "asset string, date string").withColumn("date", F.to_date("date"))
    rows = spark.createDataFrame([(a, t) for a in "ab" for t in ("2000-06-01", "2001-01-01", "2002-06-01")], "asset string, time string").withColumn("time", F.to_date("time"))
    assert sorted((r["asset"], str(r["time"])) for r in an.members_at(rows, members).collect()) == [("a", "2001-01-01"), ("a", "2002-06-01"), ("b", "2001-01-01")]


def test_marginal_risk_adds_up_to_about_the_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 400)) * np.array([[0.01], [0.02], [0.03]])
    df = spark.createDataFrame([(int(t), int(i), [0.5, 0.3, 0.2][i], float(x[i, t])) for i in range(3) for t in range(400)], "time int, asset int, weight double, ret double")
    got = {r["asset"]: r for r in an.marginal_var(df, delta=1e-6).collect()}
    whole = -np.sort(np.array([0.5, 0.3, 0.2]) @ x)[20]
    each = []
    for i in range(3):
        w = np.array([0.5, 0.3, 0.2])
        w[i] += 1e-6
        each.append((-np.sort(w / w.sum() @ x)[20] - whole) / 1e-6)
    assert [got[i]["marginal"] for i in range(3)] == pytest.approx(each, rel=1e-4) and [got[i]["component"] for i in range(3)] == pytest.approx(np.array(each) * [0.5, 0.3, 0.2], rel=1e-4)


def test_haircut_only_shrinks():
    got = rigor.bonferroni_haircut(0.2, 250, 10)
    assert 0 < got["haircut_sharpe"] < 0.2 and got["p_adjusted"] == pytest.approx(10 * got["p_single"]) and rigor.bonferroni_haircut(0.2, 250, 1)["haircut"] == pytest.approx(0.0, abs=1e-9)
    assert rigor.bonferroni_haircut(-0.2, 250, 10)["haircut_sharpe"] == pytest.approx(-got["haircut_sharpe"]) and rigor.bonferroni_haircut(0.0, 250, 10)["haircut_sharpe"] == 0


def test_results_are_replaced_filtered_and_compared(spark, tmp_path):
    path = f"{tmp_path}/r"
    row = lambda *x: spark.createDataFrame([x], "total_return double, sharpe double, max_drawdown double")
    files.save_result(row(0.1, 1.0, 0.2), path, "s", "1", tags={"desk": "x"}, result_id="a")
    files.save_result(row(0.2, 1.5, 0.1), path, "s", "2", result_id="b")
    files.save_result(row(0.3, 2.0, 0.1), path, "s", "1", tags={"desk": "x"}, result_id="a")
    assert [r["sharpe"] for r in files.find_results(spark, path, strategy="s").collect()] == [2.0, 1.5]
    assert [r["sharpe"] for r in files.find_results(spark, path, tags={"desk": "x"}, version="1").collect()] == [2.0]
    a, b = (files.latest_results(spark, path).where(F.col("result_id") == k) for k in "ab")
    got = files.compare_results(a, b).first()
    assert (got["return_diff"], got["sharpe_diff"], got["drawdown_diff"], got["winner"]) == (pytest.approx(0.1), 0.5, 0.0, "a")
    assert files.history(files.latest_results(spark, path)).first()["trend"] == "improving"
    assert "Equity" in files.report_html(row(0.1, 1.0, 0.2), "t", spark.createDataFrame([(1, 1.0, 0.0)], "time int, equity double, drawdown double"))


def test_moments_refuse_too_many_assets(spark):
    df = spark.createDataFrame([(t, a, float(t * a % 5)) for t in range(9) for a in range(4) if (t, a) != (3, 2)], "time int, asset int, ret double")
    names, mean, cov = op.moments(df)
    x = np.array([[t * a % 5 for t in range(9)] for a in range(4)], float)
    assert names == [0, 1, 2, 3] and mean[1] == pytest.approx(x[1].mean()) and cov[1, 3] == pytest.approx(np.cov(x[1], x[3])[0, 1])
    keep = [t for t in range(9) if t != 3]
    assert cov[1, 2] == pytest.approx(np.cov(x[1][keep], x[2][keep])[0, 1])
    with pytest.raises(ValueError):
        op.moments(df, most=3)


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os

    from tidemark import storage

    def there(df):
        return os.path.exists(df.inputFiles()[0].removeprefix("file:").rpartition("/")[0])

    with storage.scratch(spark) as keep_outer:
        with storage.scratch(spark) as keep:
            inner = storage.stage(spark.range(5), "a")
            kept = keep(inner.where("id > 1"), "b")
            files_of = inner.inputFiles()
        assert not os.path.exists(files_of[0].removeprefix("file:")) and there(kept) and kept.count() == 3
        last = keep_outer(kept.where("id > 2"), "c")
        files_of = kept.inputFiles()
    assert not os.path.exists(files_of[0].removeprefix("file:")) and there(last) and sorted(r["id"] for r in last.collect()) == [3, 4]
