"""Queries on a cluster and on many assets, against plain loops."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F
from tidemark.plans import backtest as bt
from tidemark.plans import regimes as rg
from tidemark.plans import rigor
from tidemark.streaming import online

ROOT = str(Path(__file__).resolve().parent.parent)
CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print("ROWS", sum(r["n"] for r in __spark_entry__.queries()["source_jdbc"](spark, sys.argv[2]).collect()))
spark.stop()
"""


def test_databases_are_read_by_other_processes(spark, tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "in").mkdir()
    spark.range(150).selectExpr("id c_custkey", "string(id) c_name", "int(id % 5) c_nationkey", "id / 7 c_acctbal", "'s' c_mktsegment").write.parquet(f"{tmp_path}/in/customer.parquet")
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    said = subprocess.run([sys.executable, "-c", CLUSTER, f"{tmp_path}/shared", f"{tmp_path}/in"], env={k: v for k, v in env.items() if k != "PYSPARK_GATEWAY_PORT"}, cwd=tmp_path, capture_output=True, text=True, timeout=180, check=False)
    assert "ROWS 150" in said.stdout, said.stderr[-2000:]


def test_database_keeps_nulls_and_quotes(spark):
    from tidemark.sources import files
    from tidemark.sources.embedded import DRIVER, write_databases

    rows = [(1, 'a "b", c\nd', 0.1), (2, "", 1e300), (3, None, None), (4, "äß", -1 / 3)]
    urls = write_databases(spark.createDataFrame(rows, "k long, s string, x double"), "things", parts=2)
    got = [tuple(r) for url in urls for r in files.read_query(spark, url, 'SELECT "k", "s", "x" FROM things', driver=DRIVER).collect()]
    assert len(urls) == 2 and sorted(got) == rows


def test_plain_benchmark_ratios_are_null_without_a_denominator(spark):
    df = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "time int, ret double")
    up, flat = df(0.01, 0.02, 0.04), df(0.01, 0.01, 0.01)
    told, plain = bt.against_benchmark(df(0.02, -0.01, 0.05), up).first(), bt.against_benchmark(df(0.02, -0.01, 0.05), up, plain=True).first()
    assert told["down_capture"] == 1.0 and plain["down_capture"] is None and plain["up_capture"] == told["up_capture"] and plain["beta"] == told["beta"]
    told, plain = bt.against_benchmark(flat, flat).first(), bt.against_benchmark(flat, flat, plain=True).first()
    assert (told["beta"], told["correlation"], told["information_ratio"]) == (1.0, 0.0, 0.0)
    assert plain["beta"] is None and plain["correlation"] is None and plain["information_ratio"] is None


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_adjusted_p_values_by_blocks(spark, n):
    rng = random.Random(n)
    tests = [(i, None if n > 1 and i % 37 == 0 else rng.choice([rng.random() ** 3, 0.01])) for i in range(n)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several blocks
    try:
        df = rigor.adjusted_p_values(spark.createDataFrame(tests, "test int, p double"))
        got = {r["test"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ranked = sorted(tests, key=lambda t: (t[1] is None, t[1] or 0.0, t[0]))
    c, top = sum(1 / i for i in range(1, n + 1)), 0.0
    down = [np.inf if p is None else p * n * c / k for k, (_, p) in enumerate(ranked, 1)]
    least = np.minimum.accumulate(down[::-1])[::-1]
    for k, (i, p) in enumerate(ranked, 1):
        top = top if p is None else max(top, (n - k + 1) * p)
        assert got[i]["holm"] == pytest.approx(min(top, 1.0)) and got[i]["bhy"] == pytest.approx(min(least[k - 1], 1.0))
        assert got[i]["bonferroni"] == (1.0 if p is None else pytest.approx(min(n * p, 1.0)))
    assert "UnboundedFollowing" not in df._jdf.queryExecution().toString() and len(got) == n


def test_sums_and_extremes_of_ranges():
    rng = np.random.default_rng(1)
    x, first = rng.normal(size=5000), rng.integers(0, 4999, 3000)
    end = np.minimum(first + rng.integers(1, 3000, 3000), 5000)
    total, low, high = online._over_ranges(x, first, end)
    assert np.allclose(total, [x[a:b].sum() for a, b in zip(first, end, strict=True)], atol=1e-9)
    assert (low == [x[a:b].min() for a, b in zip(first, end, strict=True)]).all() and (high == [x[a:b].max() for a, b in zip(first, end, strict=True)]).all()
    # each row's window holds 50,000: 10^10 values, were they added for each row
    x = np.ones(200_000)
    total, *_ = online._over_ranges(x, np.maximum(np.arange(200_000) - 50_000, 0), np.arange(200_000) + 1)
    assert total.max() == 50_001 and online._over_ranges(x[:0], np.zeros(0, int), np.zeros(0, int))[0].size == 0


def test_window_buffer_states_are_slots(spark, tmp_path):
    """A dense asset is spread over many keys, and a window reaches back over the border of a slot, both ends included."""
    base, hour = 1_704_067_200, 3600
    times = [base, base + 1, base + hour - 1, base + hour, base + hour + 1, base + 3 * hour, base + 4 * hour, base + 4 * hour + 1]
    spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(times)] + [(None, base + 99 * hour, 0.0)], "asset string, t long, x double").select("asset", F.timestamp_seconds("t").alias("time"), "x").coalesce(1).write.parquet(f"{tmp_path}/in")
    end = spark.createDataFrame([(None, base + 199 * hour, 0.0)], "asset string, t long, x double").select("asset", F.timestamp_seconds("t").alias("time"), "x")
    rocks = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(rocks, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in range(2):
            stream = online.window_buffer(spark.readStream.schema(end.schema).parquet(f"{tmp_path}/in"), seconds=float(hour))
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            query.awaitTermination()
            end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert "__slot" in str(query._jsq.toString()) or "__slot" in stream._jdf.queryExecution().logical().toString()
    finally:
        spark.conf.unset(rocks)
    got = [(r["x"], r["n"], r["total"], r["low"], r["high"]) for r in spark.read.parquet(f"{tmp_path}/out").where("asset = 'a'").orderBy("x").collect()]
    own = [[j for j, u in enumerate(times) if t - hour <= u <= t] for t in times]
    assert got == [(float(i), len(o), float(sum(o)), float(o[0]), float(o[-1])) for i, o in enumerate(own)]


def plain_regimes(x, states, rounds):
    mean, std = np.quantile(x, (np.arange(states) + 0.5) / states), np.full(states, max(float(x.std()), 1e-6))
    move = np.full((states, states), 0.05 / (states - 1))
    np.fill_diagonal(move, 0.95)
    for k in range(rounds + 1):
        p, now = [], None
        for v in x:
            now = (np.full(states, 1 / states) if now is None else now @ move) * np.maximum(np.exp(-0.5 * ((v - mean) / std) ** 2) / std, 1e-300)
            now = now / now.sum()
            p.append(now)
        p = np.array(p)
        if k < rounds:
            weight = p.sum(axis=0) + 1e-12
            mean = (p * x[:, None]).sum(axis=0) / weight
            std = np.maximum(np.sqrt((p * (x[:, None] - mean) ** 2).sum(axis=0) / weight), 1e-6)
            if k == rounds - 1:
                order = np.argsort(mean, kind="stable")
                mean, std = mean[order], std[order]
    return p


@pytest.mark.parametrize("states", [2, 3])
def test_regimes_of_many_assets_at_once(states):
    rng = np.random.default_rng(states)
    own = [rng.normal(rng.choice([-0.02, 0.03], n), 0.01) for n in (40, 1, 7, 90, 7, 2)] + [np.zeros(5)]
    got = rg._fit(np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1], states, 6)
    assert np.allclose(got, np.concatenate([plain_regimes(x, states, 6) for x in own]), atol=1e-8)


def test_assets_stay_whole(monkeypatch):
    monkeypatch.setattr(rg, "ROWS", 10)
    assets = [None] * 3 + ["a"] * 25 + ["b"] * 2 + ["c"] * 9 + ["d"]
    batches = [pa.record_batch({"asset": pa.array(assets[i : i + 4], pa.string())}) for i in range(0, len(assets), 4)]
    told = list(rg._whole_assets(iter(batches), "asset"))
    assert [v for t, _ in told for v in t.column("asset").to_pylist()] == assets and len(told) > 1
    found = [t.column("asset").to_pylist()[a] for t, begins in told for a in begins]
    assert found == [None, "a", "b", "c", "d"]


@pytest.mark.parametrize("window", [1, 4, 20])
def test_indicators_of_many_assets_at_once(window):
    """In two parts, against a step for each row; the third asset comes with the second part, the fourth's rows are many."""
    rng = np.random.default_rng(window)
    parts = [{0: 3, 1: 40, 3: 500}, {0: 30, 1: 1, 2: 5, 3: 400}]
    states = {a: ([], 0.0, 0.0, 0.0, 0.0, 0.0, 0) for a in range(4)}
    held = pd.DataFrame({"ema": 0.0, "total": 0.0, "gain": 0.0, "loss": 0.0, "before": 0.0, "last": [np.zeros(0)] * 4, "n": 0})
    for sizes in parts:
        codes = np.concatenate([np.full(n, k) for k, n in enumerate(sizes.values())])
        x, assets = rng.normal(50, 20, len(codes)), list(sizes)
        told, after = online.told_at_once(held.iloc[assets].reset_index(drop=True), codes, x, window, 20, 14)
        want = []
        for k, v in zip(codes, x, strict=True):
            states[assets[k]], row = online.step(states[assets[k]], float(v), window, 20, 14)
            want.append(row)
        assert np.allclose(np.column_stack([told[c] for c in ("mean", "std", "ema", "total", "rsi")]), want, atol=1e-9)
        for k, a in enumerate(assets):
            held = pd.DataFrame([after.iloc[k] if i == a else held.iloc[i] for i in range(4)])[list(held.columns)].reset_index(drop=True)
            assert np.allclose(held["last"][a], states[a][0]) and held["n"][a] == states[a][6]
