"""Queries that write the driver's tables in each format, read them back, and give what was read; and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis_queries import _CUMULATIVE, _KINDS, _tidy_sql, returns, tidy
from ..plans.panels import DAYS_SQL, days, finite_sql, table
from ..storage import new_path
from . import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) + 0.0 AS c_acctbal, c_mktsegment FROM customer"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", (F.round("c_acctbal", 2) + 0.0).alias("c_acctbal"), "c_mktsegment")


def _round_trip(kind: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _customers(spark, sf_dir)
        path = f"{new_path(spark, 'trip')}.{kind}"
        if kind in ("csv", "parquet"):
            files.write(rows, path)
        else:
            rows.write.format(kind).save(path)
        return files.read(spark, path, schema=rows.schema)

    QUERIES[f"source_{kind}"] = query
    ORACLES[f"source_{kind}"] = _CUSTOMERS


for _kind in ("csv", "parquet", "json", "orc"):
    _round_trip(_kind)


@_query("source_parquet_partitions", f"SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM ({_CUSTOMERS}) x WHERE c_nationkey BETWEEN 3 AND 7")
def _(spark, d):
    """Written by nation, so the range reads five folders."""
    path = new_path(spark, "trip")
    files.write(_customers(spark, d), path, partition_by=["c_nationkey"])
    return files.read(spark, path).where("c_nationkey between 3 and 7").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


@_query("source_jdbc", f"SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) + 0.0 AS balance FROM ({_CUSTOMERS}) x GROUP BY c_mktsegment")
def _(spark, d):
    """Through databases that tasks make and other tasks read."""
    from .embedded import DRIVER, write_databases

    rows = _customers(spark, d)
    bounds = rows.agg(F.min("c_custkey"), F.max("c_custkey") + 1).first()
    query, read = 'SELECT "c_custkey", "c_acctbal", "c_mktsegment" FROM customers', rows.select("c_custkey", "c_acctbal", "c_mktsegment").limit(0)
    for url in write_databases(rows, "customers"):
        read = read.union(files.read_query(spark, url, query, partition_column='"c_custkey"', bounds=None if bounds[0] is None else tuple(bounds), partitions=4, driver=DRIVER))
    return read.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("c_acctbal"), 2) + 0.0).alias("balance"))


@_query("source_wide_long", f"WITH {DAYS_SQL}, k AS (SELECT DISTINCT time FROM d), a AS (SELECT DISTINCT asset FROM d) SELECT k.time, a.asset, {finite_sql('px', 7)} AS px FROM k CROSS JOIN a LEFT JOIN d ON d.time = k.time AND d.asset = a.asset")
def _(spark, d):
    """One column for each asset and back; cells without a price are NULL."""
    wide = files.to_wide(days(spark, d).select("time", "asset", "px"))
    return tidy(files.to_long(wide, "time"), 7)


@_query("source_vendor_bars", "SELECT CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) + 0.0 AS close FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, d):
    """Lines of a vendor's CSV, every seventh malformed."""
    path, bad = f"{new_path(spark, 'vendor')}.csv", F.col("o_orderkey") % 7 == 0
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("Open"), F.when(bad, "n/a").otherwise(F.format_string("%.2f", F.round("o_totalprice", 2))).alias("Close"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"))
    files.write(lines, path)
    return files.read_vendor_bars(spark, path).select("date", (F.round("close", 2) + 0.0).alias("close"))


@_query("source_factor_lines", "SELECT CAST(o_orderdate AS DATE) AS date, round(round(o_totalprice / 1000, 2) / 100, 8) AS mkt_rf, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS smb, CAST(NULL AS DOUBLE) AS hml, 0.0001 AS rf FROM orders WHERE o_orderkey % 5 <> 0")
def _(spark, d):
    """Dated lines of percents under a preamble, with one column that is no number and every fifth line a remark."""
    path = new_path(spark, "factors")
    row = F.format_string("%s, %.2f, %d.00, x, 0.01", F.date_format("o_orderdate", "yyyyMMdd"), F.round(F.col("o_totalprice") / 1000, 2), F.col("o_orderkey") % 100)
    lines = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "remark, 1, 2").otherwise(row).alias("value"))
    lines.write.text(path)
    return tidy(files.read_factor_lines(spark, path))


@_query("source_chart_json", f"WITH {DAYS_SQL} SELECT asset, CAST(time AS TIMESTAMP) AS time, {finite_sql('px', 6)} AS close FROM d WHERE day(time) % 5 <> 0")
def _(spark, d):
    """A chart document for each asset, with gaps; parsed back by asset."""
    cells = days(spark, d).select("asset", F.unix_timestamp(F.col("time").cast("timestamp")).alias("t"), F.when(F.dayofmonth("time") % 5 != 0, F.col("px")).alias("c"))
    listed = cells.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("t", F.struct("c").alias("c")))).alias("x"))
    quote = F.array(F.struct(F.transform("x", lambda r: r["c"]["c"]).alias("close")))
    result = F.array(F.struct(F.transform("x", lambda r: r["t"]).alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    docs = listed.select("asset", F.to_json(F.struct(F.struct(result.alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("value"))
    return tidy(files.parse_chart_json(docs, keep=["asset"]).withColumn("time", F.col("time").cast("timestamp_ntz")), 6)


@_query("source_synthetic_prices", f"WITH g AS (SELECT t AS time, a, CAST(('0x' || substr(md5(concat_ws('|', CAST(t AS VARCHAR), CAST(a AS VARCHAR), '1')), 1, 8)) AS BIGINT) / 4294967296.0 AS draw FROM range(0, 252) x(t), range(0, 10) y(a)), o AS (SELECT time, 'asset_' || a AS asset, 100.0 * product(1.0 + (draw - 0.5) * 0.04) OVER (PARTITION BY a ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM g) SELECT time, asset, {_tidy_sql('px', 6)} FROM o")
def _(spark, d):
    return tidy(files.random_prices(spark), 6)


_METRICS = ("total_return", "win_rate", "max_drawdown")


@_query(
    "report_rows",
    f"WITH {_CUMULATIVE}, f AS (SELECT product(1 + ret) - 1 AS total_return, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, max(drawdown) AS max_drawdown FROM de), o AS ({' UNION ALL '.join(f'SELECT {m!r} AS metric, {m} AS value FROM f' for m in _METRICS)}) SELECT metric, {_tidy_sql('value', 7)} FROM o",
)
def _(spark, d):
    from ..plans.backtest import metrics

    return tidy(files.report_rows(metrics(returns(spark, d)).select(*_METRICS)), 7)


# --- stored results: one for each market segment and nation, in the order of nations

_RESULTS = "rs AS (SELECT c_mktsegment AS strategy, c_nationkey, avg(c_acctbal) / 10000 AS total_return, avg(c_acctbal) / stddev_samp(c_acctbal) AS sharpe, stddev_samp(c_acctbal) / 20000 AS max_drawdown FROM customer GROUP BY 1, 2)"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Results as ``save_result`` lays them out; every one is saved twice, first with other numbers."""
    own = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("strategy"), "c_nationkey").agg(
        (F.avg("c_acctbal") / 10_000).alias("total_return"), (F.avg("c_acctbal") / F.stddev_samp("c_acctbal")).alias("sharpe"), (F.stddev_samp("c_acctbal") / 20_000).alias("max_drawdown"),
    )
    stamped = own.withColumns({"version": F.when(F.col("c_nationkey") % 2 == 0, "1").otherwise("2"), "tags": F.create_map(F.lit("desk"), F.concat(F.lit("d"), (F.col("c_nationkey") % 3).cast("string"))), "result_id": F.concat_ws("/", "strategy", F.col("c_nationkey").cast("string"))})
    saved_at = F.timestamp_seconds(F.lit(1_000_000) + F.col("c_nationkey"))
    return stamped.withColumn("saved_at", saved_at).unionByName(stamped.withColumn("sharpe", F.lit(99.0)).withColumn("saved_at", F.timestamp_seconds(F.lit(1_000) + F.col("c_nationkey"))))


def _store(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "results")
    files.write(_stored(spark, d), path, partition_by=["strategy"])
    return path


@_query("results_find", f"WITH {_RESULTS} SELECT c_nationkey, {_tidy_sql('total_return sharpe max_drawdown', 7)} FROM rs WHERE strategy = 'BUILDING' AND c_nationkey % 2 = 0 AND c_nationkey % 3 = 1 AND sharpe >= 0.2 AND max_drawdown <= 0.5")
def _(spark, d):
    found = files.find_results(spark, _store(spark, d), strategy="BUILDING", version="1", tags={"desk": "d1"}, min_sharpe=0.2, max_drawdown=0.5)
    return tidy(found.select("c_nationkey", "total_return", "sharpe", "max_drawdown"), 7)


@_query(
    "results_history",
    f"""WITH {_RESULTS}, p AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY c_nationkey) <= floor(count(*) OVER (PARTITION BY strategy) / 2) AS early FROM rs),
 o AS (SELECT strategy, count(*) AS n, avg(total_return) AS avg_total_return, avg(sharpe) AS avg_sharpe, avg(max_drawdown) AS avg_max_drawdown, max(sharpe) AS best_sharpe, max(total_return) AS best_return, avg(sharpe) FILTER (WHERE NOT early) - avg(sharpe) FILTER (WHERE early) AS change FROM p GROUP BY strategy)
 SELECT strategy, n, {_tidy_sql('avg_total_return avg_sharpe avg_max_drawdown best_sharpe best_return change', 7)}, CASE WHEN n < 2 THEN 'insufficient' WHEN change > 0.2 THEN 'improving' WHEN change < -0.2 THEN 'declining' ELSE 'stable' END AS trend FROM o""",
)
def _(spark, d):
    return tidy(files.history(files.latest_results(spark, _store(spark, d))), 7)


@_query("results_compare", f"WITH {_RESULTS}, o AS (SELECT a.total_return - b.total_return AS return_diff, a.sharpe - b.sharpe AS sharpe_diff, b.max_drawdown - a.max_drawdown AS drawdown_diff FROM rs a, rs b WHERE a.strategy = 'BUILDING' AND a.c_nationkey = 1 AND b.strategy = 'MACHINERY' AND b.c_nationkey = 2) SELECT {_tidy_sql('return_diff sharpe_diff drawdown_diff', 7)}, CASE WHEN sharpe_diff > 0.1 THEN 'a' WHEN sharpe_diff < -0.1 THEN 'b' ELSE 'tie' END AS winner FROM o")
def _(spark, d):
    path = _store(spark, d)
    one = lambda strategy, nation: files.latest_results(spark, path, strategy=strategy).where(F.col("c_nationkey") == nation)
    return tidy(files.compare_results(one("BUILDING", 1), one("MACHINERY", 2)), 7)


@_query(
    "results_upsert",
    f"""WITH {_RESULTS} SELECT strategy, c_nationkey, {finite_sql('CASE WHEN c_nationkey % 3 = 0 THEN sharpe + 1 ELSE sharpe END', 7)} AS sharpe, CASE WHEN c_nationkey % 3 = 0 THEN 3 WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS round FROM rs""",
)
def _(spark, d):
    """Saved whole, then every second result anew, then every third with another Sharpe ratio: one row for each at the end."""
    from .results import stored_results, upsert_results

    path, first = new_path(spark, "upsert"), _stored(spark, d).withColumn("round", F.lit(1))
    upsert_results(first, path, order="round")
    upsert_results(first.where("c_nationkey % 2 = 0").withColumn("round", F.lit(2)), path, order="round")
    upsert_results(first.where("c_nationkey % 3 = 0").withColumns({"round": F.lit(3), "sharpe": F.col("sharpe") + 1}), path, order="round")
    return tidy(stored_results(spark, path).select("strategy", "c_nationkey", "sharpe", "round"), 7)


@_query("source_arrow", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) + 0.0 AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def _(spark, d):
    """Written to Arrow files and read back, four columns of all, with filters."""
    from .arrow import read_arrow, write_arrow

    path = new_path(spark, "arrow")
    write_arrow(table(spark, d, "orders"), path.removeprefix("file://"))
    found = read_arrow(spark, path.removeprefix("file://"), columns=["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    return found.where("o_totalprice > 150000 and o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", (F.round("o_totalprice", 2) + 0.0).alias("o_totalprice"), F.to_date("o_orderdate").alias("o_orderdate"))


_SPLITS = "ac AS (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS date, CASE WHEN day(ts) = 10 THEN 'split' ELSE 'dividend' END AS action, CASE WHEN day(ts) = 10 THEN 2.0 ELSE 5.0 END AS value FROM events WHERE day(ts) IN (10, 20) AND event_type <> 'view')"


def _load_sql(which: str) -> str:
    factor = f"(SELECT coalesce(product(CASE action WHEN 'split' THEN 1 / value ELSE 1 - value / 100 END), 1) FROM ac WHERE symbol = d.asset AND ac.date > d.time AND action IN ({which}))"
    return f"WITH {DAYS_SQL}, {_SPLITS}, p AS (SELECT time, asset, px * {factor} AS px FROM d) SELECT time AS date, {', '.join(f'{finite_sql(f"max(CASE WHEN asset = {k!r} THEN px END)", 6)} AS {k}' for k in _KINDS)} FROM p GROUP BY time"


def _load_query(adjust: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        """The daily prices of all event types, written as CSV with their dates in the last column, loaded and adjusted."""
        from .loading import load

        path = f"{new_path(spark, 'load')}.csv"
        wide = files.to_wide(days(spark, d).select("time", "asset", "px"), assets=list(_KINDS))
        wide.select(*_KINDS, F.col("time").cast("string").alias("day")).write.csv(path, header=True)
        events, day = table(spark, d, "events").where("event_type <> 'view'"), F.dayofmonth("ts")
        actions = events.where(day.isin(10, 20)).select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), F.when(day == 10, "split").otherwise("dividend").alias("action"), F.when(day == 10, 2.0).otherwise(5.0).alias("value")).distinct()
        return tidy(load(spark, path, date_col="day", adjust=adjust, actions=actions), 6)

    which = {"none": "''", "split": "'split'", "split_div": "'split', 'dividend'"}[adjust]
    QUERIES[f"source_load_{adjust}"], ORACLES[f"source_load_{adjust}"] = query, _load_sql(which)


for _adjust in ("none", "split", "split_div"):
    _load_query(_adjust)


@_query(
    "source_load_category",
    """SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS o_orderstatus_code, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INT) AS o_custkey_code FROM orders""",
)
def _(spark, d):
    from .loading import load

    return load(spark, f"{d}/orders.parquet", date_col="o_orderdate", dtype="category", columns=["o_orderstatus", "o_custkey"])


# --- streams of all events, in micro-batches of files


def _as_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Times are made unique by the event's id in microseconds."""
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("asset"), "event_type", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id")).alias("time"), F.col("value").alias("x"), "event_id")


_TICKS = "e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS asset, event_type, ts + to_microseconds(event_id) AS time, value FROM events)"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _parts(ticks: DataFrame, n: int = 3) -> list[DataFrame]:
    """``ticks`` cut in spans of time of equal length."""
    time = F.unix_micros("time")
    span = ticks.agg(F.min(time), F.max(time)).first()
    if span[0] is None:
        return [ticks] * n
    cuts = [span[0] + (span[1] + 1 - span[0]) * k // n for k in range(n + 1)]
    return [ticks.where((time >= a) & (time < b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def streamed(ticks: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``made`` gives of a stream of ``ticks`` that comes in parts, is stopped after each and goes on, told to its end: a last
    tick far on, of no asset, moves the watermark past all."""
    spark, path = ticks.sparkSession, new_path(ticks.sparkSession, "stream")
    end = ticks.agg((F.max("time") + F.expr("INTERVAL 30 DAYS")).alias("time")).where("time is not null")
    last = end.select(*((F.col(c) if c == "time" else F.lit(None)).cast(ticks.schema[c].dataType).alias(c) for c in ticks.columns))
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        for part in (*_parts(ticks), last):
            part.write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(ticks.schema).parquet(f"{path}/in")
            made(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_ROCKS[0]) if before is None else spark.conf.set(_ROCKS[0], before)
    return spark.read.parquet(f"{path}/out").where("asset is not null and cast(asset as string) <> 'None'")


_STATE = """r AS (SELECT *, list(value) OVER wc AS xs, coalesce(value - lag(value) OVER wc, 0.0) AS ch FROM e WINDOW wc AS (PARTITION BY asset ORDER BY time)),
 g AS (SELECT *, row_number() OVER wc AS k, list_reduce(list_prepend(0.0, list(greatest(ch, 0.0)) OVER wc), lambda a, q: a + (q - a) / 14.0) AS gain,
  list_reduce(list_prepend(0.0, list(greatest(-ch, 0.0)) OVER wc), lambda a, q: a + (q - a) / 14.0) AS loss FROM r WINDOW wc AS (PARTITION BY asset ORDER BY time)),
 o AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, sum(value) OVER (PARTITION BY asset ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, list_reduce(xs, lambda a, q: a + 2.0 / 21.0 * (q - a)) AS ema,
  CASE WHEN k = 1 THEN 50.0 WHEN loss > 1e-10 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 1e-10 THEN 100.0 ELSE 50.0 END AS rsi
  FROM g WINDOW w AS (PARTITION BY asset ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
_TOLD = ("mean", "std", "total", "ema", "rsi")
_TOLD_SQL = ", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in _TOLD)


@_query("stream_indicators", f"WITH {_TICKS}, {_STATE} SELECT asset, time, round(value, 7) + 0.0 AS x, {_TOLD_SQL} FROM o")
def _(spark, d):
    """All indicators of each user, by a stateful stream that reads all there is and ends."""
    from ..streaming.online import indicators

    told = streamed(_as_ticks(spark, d).select("asset", "time", "x"), indicators)
    return told.select("asset", F.col("time").cast("timestamp_ntz").alias("time"), *((F.round(c, 7) + 0.0).alias(c) for c in ("x", *_TOLD)))


@_query("stream_append", f"WITH {_TICKS}, {_STATE} SELECT event_id, {_TOLD_SQL} FROM o")
def _(spark, d):
    """The same by a panel that grows in three parts: one to begin with, two as batches of a stream that is stopped and goes on."""
    from ..operators.axes import Series
    from ..streaming.incremental import IncrementalPanel

    path, ticks = new_path(spark, "append"), _as_ticks(spark, d).select("asset", "time", "event_id", "x")
    computes = {"mean": ("rolling_mean", 20), "std": ("rolling_std", 20), "total": ("cumsum",), "ema": ("ema", 20), "rsi": ("rsi", 14)}
    panel = IncrementalPanel(spark, f"{path}/panel", "x", computes, Series("asset", "time", ("event_id",)))
    for k, part in enumerate(_parts(ticks)):
        if k == 0:
            panel.initialize(part)
        else:
            part.write.parquet(f"{path}/in/part={k}")
            panel.stream(spark.readStream.schema(ticks.schema).parquet(f"{path}/in/*"), f"{path}/check").awaitTermination()
    return panel.rows().select("event_id", *((F.round(c, 7) + 0.0).alias(c) for c in _TOLD))


@_query(
    "stream_window_buffer",
    f"""WITH {_TICKS} SELECT event_type AS asset, time, round(value, 7) + 0.0 AS x, count(*) OVER w AS n, round(sum(value) OVER w, 6) + 0.0 AS total, round(min(value) OVER w, 7) + 0.0 AS low, round(max(value) OVER w, 7) + 0.0 AS high
 FROM e WINDOW w AS (PARTITION BY event_type ORDER BY time RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    """What the last six hours held at each event of a type, by event-time timers over a buffer of the window."""
    from ..streaming.online import window_buffer

    told = streamed(_as_ticks(spark, d).select(F.col("event_type").alias("asset"), "time", "x"), lambda stream: window_buffer(stream, seconds=6 * 3600.0))
    return told.select("asset", F.col("time").cast("timestamp_ntz").alias("time"), (F.round("x", 7) + 0.0).alias("x"), "n", (F.round("total", 6) + 0.0).alias("total"), *((F.round(c, 7) + 0.0).alias(c) for c in ("low", "high")))


@_query(
    "stream_bars_of_bars",
    f"""WITH {_TICKS} SELECT date_trunc('hour', time) AS time, event_type AS asset, round(arg_min(value, time), 7) + 0.0 AS open, round(max(value), 7) + 0.0 AS high, round(min(value), 7) + 0.0 AS low, round(arg_max(value, time), 7) + 0.0 AS close,
 CAST(count(*) AS DOUBLE) AS volume, count(*) AS n FROM e GROUP BY ALL""",
)
def _(spark, d):
    """Bars of an hour, of bars of five minutes, of bars of a minute, in one stream."""
    from ..streaming.online import bars_of_bars

    told = streamed(_as_ticks(spark, d).select(F.col("event_type").alias("asset"), "time", F.col("x").alias("px")), bars_of_bars)
    return told.select(F.col("time").cast("timestamp_ntz").alias("time"), "asset", *((F.round(c, 7) + 0.0).alias(c) for c in ("open", "high", "low", "close")), "volume", "n")
