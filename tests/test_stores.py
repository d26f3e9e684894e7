"""Upserts and their writers, Arrow files, folds of a walk forward, and regimes against plain loops."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.operators.axes import Series
from tidemark.plans import backtest as bt
from tidemark.plans import regimes as rg
from tidemark.sources import arrow, results

ROW = "strategy string, result_id string, saved_at int, sharpe double"


def stored(spark, path):
    return {(r["strategy"], r["result_id"]): (r["saved_at"], r["sharpe"]) for r in results.stored_results(spark, path).collect()}


def test_upserts_leave_one_row_an_id(spark, tmp_path):
    path, df = f"{tmp_path}/r", lambda *rows: spark.createDataFrame(rows, ROW)
    assert results.upsert_results(df(("s", "a", 1, 0.1), ("s", "a", 3, 0.3), ("s", "b", 1, 0.2), ("t", "a", 1, 0.4)), path) == 1
    untouched = sorted(p.name for p in (tmp_path / "r" / "strategy=t").iterdir())
    assert results.upsert_results(df(("s", "a", 2, 9.0), ("s", "b", 1, 0.5), ("u", "c", 1, None)), path) == 2
    assert stored(spark, path) == {("s", "a"): (3, 0.3), ("s", "b"): (1, 0.5), ("t", "a"): (1, 0.4), ("u", "c"): (1, None)}
    assert spark.read.parquet(path).count() == 4 and sorted(p.name for p in (tmp_path / "r" / "strategy=t").iterdir()) == untouched
    results.upsert_results(df(("t", "a", 2, 0.6)).withColumn("more", F.lit("x")), path)
    assert spark.read.option("mergeSchema", True).parquet(path).where("strategy = 't'").first()["more"] == "x"
    assert [r["result_id"] for r in results.stored_results(spark, path, strategy="u").collect()] == ["c"]


def test_writers_notice_each_other(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/r", lambda *rows: spark.createDataFrame(rows, ROW)
    results.upsert_results(df(("s", "a", 1, 0.1)), path)
    before = results.stage

    def overtaken(table, tag):
        made = before(table, tag)
        if tag == "merged":  # another writer ends in between
            monkeypatch.setattr(results, "stage", before)
            results.upsert_results(df(("s", "b", 1, 0.2)), path)
        return made

    monkeypatch.setattr(results, "stage", overtaken)
    with pytest.raises(results.ConcurrentWrite, match="another writer"):
        results.upsert_results(df(("s", "a", 2, 9.0)), path)
    assert stored(spark, path) == {("s", "a"): (1, 0.1), ("s", "b"): (1, 0.2)}
    (tmp_path / "r" / "_commits" / "3").touch()
    with pytest.raises(results.ConcurrentWrite, match="not done"):
        results.upsert_results(df(("s", "a", 2, 9.0)), path)
    assert results.upsert_results(df(("s", "a", 2, 9.0)), path, stale_after=-1.0) == 4  # its writer is gone
    assert stored(spark, path)["s", "a"] == (2, 9.0)


def test_arrow_files_come_back(spark, tmp_path):
    path = f"{tmp_path}/a"
    rows = [(i, None if i % 7 == 0 else f"n{i % 5}", i / 3, date(2024, 1, 1) + timedelta(days=i % 40), [i, i + 1]) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, name string, x double, day date, l array<long>").repartition(3)
    assert arrow.write_arrow(df, path) == 1000
    back = arrow.read_arrow(spark, path)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    got = arrow.read_arrow(spark, path, columns=["x", "k"])
    assert got.columns == ["x", "k"] and got.where("k >= 990 and x < 331").count() == sum(i >= 990 and i / 3 < 331 for i in range(1000))
    assert back.where("name in ('n1', 'n2') and day = date'2024-01-05'").count() == sum(r[1] in ("n1", "n2") and r[3] == date(2024, 1, 5) for r in rows)
    assert back.where("name is null").count() == 143
    with pytest.raises(ValueError, match="already"):
        arrow.write_arrow(df, path)
    with pytest.raises(Exception, match="no such columns"):
        arrow.read_arrow(spark, path, columns=["nope"])
    assert arrow.write_arrow(df.limit(0), f"{tmp_path}/none") == 0


def test_arrow_reads_named_columns_and_filters_only(tmp_path):
    """A partition for each batch; what comes out of one has the named columns, and the filter's rows."""
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    file = str(tmp_path / "f.arrow")
    with pa.OSFile(file, "wb") as sink, pa.ipc.new_file(sink, pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.float64())])) as writer:
        for k in range(4):
            writer.write_batch(pa.record_batch({"a": pa.array(range(10 * k, 10 * k + 10)), "b": ["x", "y"] * 5, "c": [1.0] * 10}))
    reader = arrow.ArrowReader(file, T.StructType([T.StructField("a", T.LongType())]))
    assert len(reader.partitions()) == 4
    assert [type(f) for f in reader.pushFilters([GreaterThan(("a",), 17), StringStartsWith(("a",), "x"), EqualTo(("b",), "x")])] == [StringStartsWith, EqualTo]
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.schema.names for b in got] == [["a"]] * 4 and [b.num_rows for b in got] == [0, 2, 10, 10]


@pytest.mark.parametrize(("train", "test", "step", "expanding"), [(10, 4, None, False), (10, 4, 3, False), (7, 5, 9, True), (10, 4, 1, True), (30, 20, None, False)])
def test_walk_forward_against_slices(spark, train, test, step, expanding):
    rng = random.Random(train)
    rets = [rng.gauss(0.001, 0.02) for _ in range(40)]
    df = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), r, abs(r)) for i, r in enumerate(rets)], "time date, ret double, turnover double")
    got = {r["fold"]: r for r in bt.walk_forward(df, train=train, test=test, step=step, expanding=expanding).collect()}
    k = 0
    while train + k * (step or test) + test <= 40:
        cut = train + k * (step or test)
        for side, a, b in (("train", 0 if expanding else cut - train, cut), ("test", cut, cut + test)):
            own = np.array(rets[a:b])
            equity = np.concatenate(([1.0], np.cumprod(1 + own)))
            assert (got[k][f"{side}_start"], got[k][f"{side}_end"]) == (a, b)
            assert got[k][f"{side}_sharpe"] == pytest.approx(own.mean() / own.std(ddof=1) * math.sqrt(252))
            assert got[k][f"{side}_max_drawdown"] == pytest.approx((1 - equity / np.maximum.accumulate(equity)).max())
            assert got[k][f"{side}_turnover"] == pytest.approx(np.abs(own).mean() * 252)
        k += 1
    assert len(got) == k and sorted(got) == list(range(k))
    summary = bt.walk_forward_summary(bt.walk_forward(df, train=train, test=test, step=step, expanding=expanding)).first()
    assert summary["folds"] == k and (not k or summary["test_sharpe"] == pytest.approx(np.mean([r["test_sharpe"] for r in got.values()])))


def plain_filter(xs, g):
    now, out = None, []
    for x in xs:
        prior = np.array(g.start) if now is None else now @ np.array(g.move)
        now = prior * np.exp(-0.5 * ((x - np.array(g.mean)) / g.std) ** 2) / g.std
        now = now / now.sum()
        out.append(now)
    return np.array(out)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        asset = rng.choice(["hot"] * 9 + ["a", None])
        calm = (i // 200) % 2 == 0
        rows.append((asset, i, None if i % 50 == 0 else rng.gauss(1.0 if calm else -2.0, 0.5 if calm else 2.0)))
    return spark.createDataFrame(rows, "asset string, time int, ret double").repartition(4).cache()


def test_filtered_regimes_over_many_blocks(spark, series):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        g = rg.Regimes((-2.0, 0.0, 1.0), (2.0, 1.0, 0.5), (0.2, 0.3, 0.5), ((0.9, 0.06, 0.04), (0.1, 0.8, 0.1), (0.02, 0.03, 0.95)))
        got = rg.filtered_regimes(series, g).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 1500
    for asset in ("hot", "a", None):
        own = sorted((r for r in got if r["asset"] == asset), key=lambda r: r["time"])
        want = plain_filter([r["ret"] or 0.0 for r in own], g)
        assert np.allclose([r["chances"] for r in own], want, atol=1e-9) and [r["state"] for r in own] == want.argmax(axis=1).tolist()
    assert rg.filtered_regimes(series.limit(0), g).collect() == []


def test_fitted_regimes_are_those_of_a_loop(spark, series):
    rows = series.collect()
    by = {a: [r["ret"] or 0.0 for r in sorted((r for r in rows if r["asset"] == a), key=lambda r: r["time"])] for a in ("hot", "a", None)}
    every = np.array([x for own in by.values() for x in own])
    g = rg.Regimes.sticky(tuple(np.quantile(every, [0.25, 0.75])), (every.std(),) * 2)
    for _ in range(3):
        p = np.concatenate([plain_filter(own, g) for own in by.values()])
        mean = (p * every[:, None]).sum(axis=0) / p.sum(axis=0)
        std = np.sqrt((p * (every[:, None] - mean) ** 2).sum(axis=0) / p.sum(axis=0))
        g = rg.Regimes.sticky(tuple(mean), tuple(std))
    got = rg.fitted_regimes(series, rounds=3)
    assert got.mean == pytest.approx(g.mean, abs=1e-9) and got.std == pytest.approx(g.std, abs=1e-9)
    assert got.mean[0] < -0.5 < 0.5 < got.mean[1] and got.std[0] > got.std[1]


def test_hidden_and_clustered_regimes_tell_calm_from_wild(spark, series):
    """Of a series whose level and spread change every 200 rows."""
    own = series.where("asset = 'hot'").fillna(0.0, ["ret"])
    for told, name in ((rg.hidden_regimes(own), "state"), (rg.clustered_regimes(own, clusters=2, n=10), "cluster")):
        rows = [r for r in told.collect() if r["time"] % 200 >= 40]
        right = sum((r[name] == 1) == ((r["time"] // 200) % 2 == 0) for r in rows)
        assert right / len(rows) >= 0.85


def test_load_options(spark, tmp_path):
    from tidemark.sources.loading import load

    path = f"{tmp_path}/p.csv"
    spark.createDataFrame([("10.5", "2024-01-01", "x"), ("8", "2024-01-02", "7.9"), (None, "no date", "3"), ("4", "2024-01-03 10:00:00", None)], "a string, day string, b string").coalesce(1).write.csv(path, header=True)
    key = lambda rows: sorted(map(tuple, rows), key=str)
    days = [date(2024, 1, i) for i in (1, 2, 3)]
    assert key(load(spark, path, date_col="day").collect()) == key([(days[0], 10.5, None), (days[1], 8.0, 7.9), (None, None, 3.0), (days[2], 4.0, None)])
    assert key(load(spark, path, date_col="day", dtype="int64").collect()) == key([(days[0], 10, None), (days[1], 8, 7), (None, None, 3), (days[2], 4, None)])
    got = load(spark, path, date_col="day", dtype="category", columns=["b"])
    assert key(got.collect()) == key([(days[0], "x", 2), (days[1], "7.9", 1), (None, "3", 0), (days[2], None, None)])
    assert load(spark, path, date_col="day", dtype="float32", columns=["a"]).schema["a"].dataType.typeName() == "float"
    actions = spark.createDataFrame([("a", days[1], "split", 2.0), ("a", days[2], "dividend", 10.0), ("b", days[2], "reverse_split", 3.0)], "symbol string, date date, action string, value double")
    split = {r["date"]: (r["a"], r["b"]) for r in load(spark, path, date_col="day", adjust="split", actions=actions).collect()}
    assert split == {days[0]: (5.25, None), days[1]: (8.0, pytest.approx(23.7)), None: (None, 3.0), days[2]: (4.0, None)}
    both = {r["date"]: r["a"] for r in load(spark, path, date_col="day", adjust="split_div", actions=actions).collect()}
    assert both == {days[0]: pytest.approx(5.25 * 0.9), days[1]: pytest.approx(7.2), None: None, days[2]: 4.0}
    for options in ({"dtype": "decimal"}, {"adjust": "all"}, {"adjust": "split"}, {"date_col": "nope"}):
        with pytest.raises(ValueError):
            load(spark, path, **options)


def test_frontier_and_greatest_sharpe_beat_random_weights():
    from tidemark.plans import optimise as op

    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5)) * 0.01
    mean, cov = np.array([0.001, 0.0004, 0.0008, -0.0002, 0.0006]), np.cov(x.T)
    tried = rng.dirichlet(np.ones(5) * 0.5, 4000)
    returns, vols = tried @ mean * 252, np.sqrt(np.einsum("ij,jk,ik->i", tried, cov, tried) * 252)
    best = op.max_sharpe(mean, cov)
    assert best.sum() == pytest.approx(1) and best.min() >= 0 and (mean @ best * 252) / np.sqrt(best @ cov @ best * 252) >= 0.98 * (returns / vols).max()
    points = op.efficient_frontier(mean, cov)
    assert len(points) == 20 and all(a[1] <= b[1] + 1e-9 and a[0] <= b[0] + 1e-9 for a, b in zip(points, points[1:], strict=False))
    for told, vol, w in points:
        assert w.sum() == pytest.approx(1) and w.min() >= -1e-12
        assert not np.any((returns > told + 0.01) & (vols < vol - 0.005))
