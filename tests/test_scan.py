"""Recursions over many blocks against plain loops, and panels that grow by batches against one pass."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import timeseries as ts
from tidemark.operators.axes import Series
from tidemark.streaming.incremental import IncrementalPanel

S = Series("asset", "time", ("k",))


def plain(xs, span=5, n=4):
    """EMA, RSI and the moving mean, deviation and sum."""
    ema = gain = loss = total = 0.0
    out = []
    for i, x in enumerate(xs):
        ema = x if i == 0 else ema + 2 / (span + 1) * (x - ema)
        change = x - xs[i - 1] if i else 0.0
        gain, loss = gain + (max(change, 0) - gain) / n, loss + (max(-change, 0) - loss) / n
        total += x
        last = xs[max(0, i - 2) : i + 1]
        mean = sum(last) / len(last)
        rsi = 50.0 if i == 0 else 100 - 100 / (1 + gain / loss) if loss > 1e-10 else 100.0 if gain > 1e-10 else 50.0
        out.append((ema, rsi, mean, (sum((v - mean) ** 2 for v in last) / len(last)) ** 0.5, total))
    return out


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.randrange(700), i, rng.choice([None, float("nan"), rng.gauss(10, 3)]) if i % 9 == 0 else rng.gauss(10, 3)) for i in range(3000)]
    rows += [("one", 1, 5000, 2.0)]
    return spark.createDataFrame(rows, "asset string, time int, k long, x double").repartition(5).cache()


def wanted(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r["time"], r["k"])):
        by.setdefault(r["asset"], []).append(r)
    return {r["k"]: told for own in by.values() for r, told in zip(own, plain([0.0 if r["x"] is None or r["x"] != r["x"] else r["x"] for r in own]), strict=True)}


@pytest.fixture
def many_blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_asset_is_many_blocks(spark, ticks, many_blocks):
    want = wanted(ticks.collect())
    for name, args, at in (("ema", (5,), 0), ("rsi", (4,), 1)):
        got = {r["k"]: r["o"] for r in ts.recursive(ticks, "x", name, S, o=args).collect()}
        assert got == pytest.approx({k: v[at] for k, v in want.items()}, abs=1e-9)
    blocks = ticks.repartitionByRange("asset", "time", "k").groupBy(F.spark_partition_id()).agg(F.max("asset").alias("a")).where("a = 'hot'").count()
    assert blocks > 3


def test_macd_and_its_histogram(spark, ticks, many_blocks):
    import pandas as pd

    got = ts.recursive(ticks, "x", "macd_histogram", S, h=(3, 6, 4), g=(2, 5, 3)).toPandas()
    for _, own in got.groupby("asset", dropna=False):
        own = own.sort_values(["time", "k"])
        x = own["x"].fillna(0.0)
        for k, (fast, slow, signal) in {"h": (3, 6, 4), "g": (2, 5, 3)}.items():
            line = x.ewm(span=fast, adjust=False).mean() - x.ewm(span=slow, adjust=False).mean()
            pd.testing.assert_series_equal(own[k], line - line.ewm(span=signal, adjust=False).mean(), check_names=False, atol=1e-9)


def test_nothing_and_one_row(spark, ticks):
    assert ts.recursive(ticks.limit(0), "x", "rsi", S, o=(4,)).collect() == []
    assert [r["o"] for r in ts.recursive(ticks.where("asset = 'one'"), "x", "rsi", S, o=(4,)).collect()] == [50.0]


COMPUTES = {"e": ("ema", 5), "r": ("rsi", 4), "m": ("rolling_mean", 3), "d": ("rolling_std", 3), "t": ("cumsum",)}


def by_key(panel):
    return {r["k"]: tuple(r[c] for c in "ermdt") for r in panel.rows().collect()}


def test_appending_equals_one_pass(spark, ticks, tmp_path, many_blocks):
    panel = IncrementalPanel(spark, f"{tmp_path}/p", "x", COMPUTES, S)
    panel.initialize(ticks.where("time < 200"))
    for a, b in ((200, 201), (201, 500), (500, 500), (500, 900)):
        panel.append(ticks.where(f"time >= {a} and time < {b}"))
    got, want = by_key(panel), wanted(ticks.collect())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert panel.state().agg(F.sum("n")).first()[0] == len(want) and panel.state().count() == 5
    states = {v: len(list((tmp_path / "p" / "state" / f"__version={v}").glob("part-*"))) for v in panel.versions()}
    assert list(states) == [0, 1, 2, 3, 4] and all(bool(n) == (v >= 3) for v, n in states.items())
    with pytest.raises(ValueError, match="already"):
        panel.initialize(ticks)


def test_a_replayed_batch_changes_nothing(spark, ticks, tmp_path):
    path = f"{tmp_path}/p"
    panel = IncrementalPanel(spark, path, "x", COMPUTES, S)
    ticks.where("time < 300").write.parquet(f"{path}/in/part=0")
    source = spark.readStream.schema(ticks.schema).parquet(f"{path}/in/*")
    panel.stream(source, f"{path}/check").awaitTermination()
    ticks.where("time >= 300").write.parquet(f"{path}/in/part=1")
    panel.append(ticks.where("time >= 300"), 2)
    ticks.limit(3).write.parquet(f"{path}/rows/__version=3")  # a batch that failed before its state was there
    panel.stream(source, f"{path}/check").awaitTermination()  # batch 1 is version 2, which is there
    got, want = by_key(panel), wanted(ticks.collect())
    assert panel.versions() == [1, 2] and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_unknown_computation(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        IncrementalPanel(spark, str(tmp_path), "x", {"q": ("quantile", 3)})


def test_a_growing_panel_is_one_sort_of_rows_and_states(spark, ticks, tmp_path, many_blocks):
    """No window along an asset, whose rows would be one task; moving windows longer than a block, over parts; results named as states are."""
    computes = {"total": ("rolling_mean", 900), "n": ("rolling_std", 7), "last": ("cumsum",), "tail": ("ema", 5)}
    panel = IncrementalPanel(spark, f"{tmp_path}/p", "x", computes, S)
    assert "Window" not in panel._computed(ticks, None)._jdf.queryExecution().toString()
    for a, b in ((0, 250), (250, 260), (260, 700)):
        panel.append(ticks.where(f"time >= {a} and time < {b}"))
    got, own = {r["k"]: (r["total"], r["n"], r["last"], r["tail"]) for r in panel.rows().collect()}, {}
    for r in sorted(ticks.collect(), key=lambda r: (r["time"], r["k"])):
        own.setdefault(r["asset"], []).append((r["k"], 0.0 if r["x"] is None or r["x"] != r["x"] else r["x"]))
    for rows in own.values():
        ema, total = rows[0][1], 0.0
        for i, (k, x) in enumerate(rows):
            long, short = ([v for _, v in rows[max(0, i + 1 - n) : i + 1]] for n in (900, 7))
            mean, ema, total = sum(short) / len(short), ema + 2 / 6 * (x - ema), total + x
            assert got.pop(k) == pytest.approx((sum(long) / len(long), (sum((v - mean) ** 2 for v in short) / len(short)) ** 0.5, total, ema), abs=1e-8)
    assert not got and {(r["asset"], r["n"], len(r["tail"]), r["last"]) for r in panel.state().collect()} == {(a, len(rows), min(len(rows), 900), rows[-1][1]) for a, rows in own.items()}


def test_an_infinite_value_stays_with_its_asset(spark, many_blocks):
    rows = [(a, i, i, float("inf") if a == "a" and i == 2 else 1.0) for a in "abc" for i in range(40)]
    got = ts.recursive(spark.createDataFrame(rows, "asset string, time int, k long, x double"), "x", "ema", S, o=(5,)).where("asset <> 'a'")
    assert [r["o"] for r in got.collect()] == pytest.approx([1.0] * 80)
