"""Readers of price tables and vendor formats, and writers of panels, reports and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, *, schema=None, **options) -> DataFrame:
    """CSV for names ending in .csv or .csv.gz, JSON, ORC, else Parquet; any path that Spark reads (s3a, gs, abfss, hdfs, file)."""
    name = path.lower().rstrip("/")
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    if name.endswith((".csv", ".csv.gz")):
        return reader.csv(path, header=True, inferSchema=schema is None)
    if name.endswith((".json", ".jsonl")):
        return reader.json(path)
    return reader.orc(path) if name.endswith(".orc") else reader.parquet(path)


def read_query(spark: SparkSession, url: str, query: str, *, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options) -> DataFrame:
    """A database query over JDBC, in ranges of a column if one is named."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None or bounds is None:
        return reader.option("query", query).load()
    split = {"partitionColumn": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return reader.option("dbtable", f"({query}) q").options(**split).load()


def to_long(wide: DataFrame, time: str = "date", value: str = "px") -> DataFrame:
    """``(time, asset, value)`` from a table with one column for each asset."""
    assets = [c for c in wide.columns if c != time]
    return wide.select(F.col(time).alias("time"), *(F.col(c).cast("double") for c in assets)).unpivot("time", assets, "asset", value)


def to_wide(panel: DataFrame, value: str = "px", assets: list | None = None) -> DataFrame:
    """One row for each time and one column for each asset; of several values the greatest. Missing cells are NaN. Assets are found first unless given."""
    wide = panel.groupBy("time").pivot("asset", assets).agg(F.max(value))
    return wide.fillna(float("nan"))


def between(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Both ends included; the comparison reaches the scan."""
    return df.where(F.col(time).between(F.lit(start).cast(df.schema[time].dataType), F.lit(end).cast(df.schema[time].dataType)))


def random_prices(spark: SparkSession, times: int = 252, assets: int = 10, seed: int = 1) -> DataFrame:
    """``(time, asset, px)``: random walks from 100 with steps within 2 %."""
    grid = spark.range(times).withColumnRenamed("id", "time").withColumn("asset", F.explode(F.sequence(F.lit(0), F.lit(assets - 1))))
    drawn = F.md5(F.concat_ws("|", F.col("time").cast("string"), F.col("asset").cast("string"), F.lit(str(seed))))
    draw = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / 4294967296.0
    walk = F.product(1.0 + (draw - 0.5) * 0.04).over(Window.partitionBy("asset").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("time", F.concat(F.lit("asset_"), "asset").alias("asset"), (100.0 * walk).alias("px"))


def read_vendor_bars(spark: SparkSession, path: str) -> DataFrame:
    """``(date, close)`` from CSV lines under a header that names Date and Close in any order; malformed rows are left out."""
    rows = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in rows.columns}
    parsed = rows.select(F.try_to_timestamp(F.col(names["date"]), F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.col(names["close"]).try_cast("double").alias("close"))
    return parsed.dropna()


def read_factor_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(date, mkt_rf, smb, hml, rf)``, in fractions, from the YYYYMMDD lines of a factor file; other lines are preamble."""
    parts = F.split("value", r"\s*,\s*")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d{8}\s*,")).withColumn("value", F.trim("value"))
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double") / 100.0, F.lit(float("nan")))
    return rows.select(F.to_date(F.get(parts, F.lit(0)), "yyyyMMdd").alias("date"), *(number(i + 1).alias(c) for i, c in enumerate(("mkt_rf", "smb", "hml", "rf"))))


CHART = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>>>>>>>"


def parse_chart_json(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """``(time, close)`` from chart documents of parallel arrays, after the columns to ``keep``; null closes are left out."""
    first = F.from_json(column, CHART).getField("chart").getField("result").getItem(0)
    closes = first.getField("indicators").getField("quote").getItem(0).getField("close")
    own = keep or []
    return lines.select(*own, F.explode(F.arrays_zip(first.getField("timestamp").alias("t"), closes.alias("c"))).alias("x")).select(*own, F.timestamp_seconds("x.t").alias("time"), F.col("x.c").alias("close")).where("close is not null")


def write(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """CSV or Parquet by the name."""
    writer = df.write.mode(mode)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.csv(path, header=True) if path.lower().endswith(".csv") else writer.parquet(path)


def report_rows(metrics: DataFrame) -> DataFrame:
    """``(metric, value)`` from a one-row table of metrics."""
    names = metrics.columns
    return metrics.select(*(F.col(c).cast("double") for c in names)).unpivot([], names, "metric", "value")


def report_html(metrics: DataFrame, title: str, curve: DataFrame | None = None) -> str:
    """A small page with the one row of metrics and, from ``(time, equity, drawdown)``, one row for each time of the equity curve."""
    rows = "".join(f"<tr><td>{r['metric']}</td><td>{r['value']:.6g}</td></tr>" for r in report_rows(metrics).collect() if r["value"] is not None)
    page = f"<!DOCTYPE html><html><head><title>{title}</title></head><body><h1>{title}</h1><table>{rows}</table>"
    if curve is not None:
        points = "".join(f"<tr><td>{r['time']}</td><td>{r['equity']:.6f}</td><td>{r['drawdown']:.6f}</td></tr>" for r in curve.select("time", "equity", "drawdown").orderBy("time").toLocalIterator())
        page += f"<h2>Equity and drawdown</h2><table><tr><th>time</th><th>equity</th><th>drawdown</th></tr>{points}</table>"
    return f"{page}</body></html>"


def position_history(panel: DataFrame, *, weight: str = "weight", ret: str = "ret", assets: list | None = None) -> DataFrame:
    """``(date, <asset>_weight, <asset>_return, ...)``: one row for each time, rounded to 6 decimals, missing cells 0.

    Assets are found first unless given; a table of very many columns is better kept as the panel itself.
    """
    cells = panel.select(F.col("time").alias("date"), F.col("asset").cast("string").alias("asset"), F.col(weight).alias("w"), F.col(ret).alias("r"))
    value = lambda c, tag: F.round(F.coalesce(F.max(c), F.lit(0.0)), 6).alias(tag)
    return cells.groupBy("date").pivot("asset", assets).agg(value("w", "weight"), value("r", "return")).fillna(0.0)


def save_result(metrics: DataFrame, path: str, strategy: str, version: str, *, tags: dict[str, str] | None = None, result_id: str | None = None) -> None:
    """Append a backtest's metrics to the results table, partitioned by strategy. A ``result_id`` that is saved again replaces the earlier one."""
    marks = F.create_map(*(F.lit(x) for pair in (tags or {}).items() for x in pair)) if tags else F.create_map().cast("map<string,string>")
    stamped = metrics.withColumns({"strategy": F.lit(strategy), "version": F.lit(version), "tags": marks, "saved_at": F.current_timestamp(), "result_id": F.lit(result_id) if result_id else F.expr("uuid()")})
    stamped.write.mode("append").partitionBy("strategy").parquet(path)


def latest_results(spark: SparkSession, path: str, *, strategy: str | None = None) -> DataFrame:
    """All results, or a strategy's; of an id the last one saved."""
    found = spark.read.parquet(path)
    if strategy is not None:
        found = found.where(F.col("strategy") == strategy)  # before the window: reads one partition
    last = F.row_number().over(Window.partitionBy("strategy", "result_id").orderBy(F.col("saved_at").desc()))
    return found.withColumn("__last", last).where("__last = 1").drop("__last")


def find_results(spark: SparkSession, path: str, *, strategy: str | None = None, version: str | None = None, tags: dict[str, str] | None = None, min_sharpe: float | None = None, max_drawdown: float | None = None, by: str = "sharpe", limit: int = 20) -> DataFrame:
    """The ``limit`` best results ``by`` a metric that pass all filters; of an id the last one saved."""
    found = latest_results(spark, path, strategy=strategy)
    if version is not None:
        found = found.where(F.col("version") == version)
    for key, value in (tags or {}).items():
        found = found.where(F.col("tags")[key] == value)
    if min_sharpe is not None:
        found = found.where(F.col("sharpe") >= min_sharpe)
    if max_drawdown is not None:
        found = found.where(F.col("max_drawdown") <= max_drawdown)
    return found.orderBy(F.col(by).desc_nulls_last(), "result_id").limit(limit)


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row from one result each ``(total_return, sharpe, max_drawdown)``: differences in favour of a, and the winner by Sharpe ratio."""
    left, right = (df.select(*(F.col(c).alias(f"{tag}_{c}") for c in ("total_return", "sharpe", "max_drawdown"))) for df, tag in ((a, "a"), (b, "b")))
    gap = F.col("a_sharpe") - F.col("b_sharpe")
    return left.join(F.broadcast(right)).select(
        (F.col("a_total_return") - F.col("b_total_return")).alias("return_diff"), gap.alias("sharpe_diff"), (F.col("b_max_drawdown") - F.col("a_max_drawdown")).alias("drawdown_diff"),
        F.when(gap > 0.1, "a").when(gap < -0.1, "b").otherwise("tie").alias("winner"),
    )


def history(results: DataFrame, time: str = "saved_at") -> DataFrame:
    """A row for each strategy: its results' number, averages, bests, and the trend of the Sharpe ratio from the earlier to the later half.

    With an odd number the middle one counts as late; fewer than two give ``insufficient``.
    """
    own = Window.partitionBy("strategy")
    placed = results.withColumn("__at", F.row_number().over(own.orderBy(time, "result_id"))).withColumn("__early", F.col("__at") <= F.floor(F.count(F.lit(1)).over(own) / 2))
    change = F.avg(F.when(~F.col("__early"), F.col("sharpe"))) - F.avg(F.when(F.col("__early"), F.col("sharpe")))
    told = placed.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"avg_{c}") for c in ("total_return", "sharpe", "max_drawdown")), F.max("sharpe").alias("best_sharpe"), F.max("total_return").alias("best_return"), change.alias("change"))
    return told.withColumn("trend", F.when(F.col("n") < 2, "insufficient").when(F.col("change") > 0.2, "improving").when(F.col("change") < -0.2, "declining").otherwise("stable"))
