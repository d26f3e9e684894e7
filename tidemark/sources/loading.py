"""Wide tables of prices or attributes read with options: which column is the date, the values' type, and adjustment for corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.axes import Series
from ..plans.analytics import adjust_prices
from .files import read, to_wide

DTYPES = ("float64", "float32", "int64", "category")
ADJUST = {"none": (), "split": ("split", "reverse_split"), "split_div": ("split", "reverse_split", "dividend")}
_CASTS = {"float64": "double", "float32": "float", "int64": "long", "category": "string"}


def load(spark: SparkSession, path: str, *, date_col: str | None = None, dtype: str = "float64", adjust: str = "none", actions: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """``(date, <columns>)`` of a table that ``files.read`` reads, a row for each of its rows.

    ``date_col`` (by default the first column) becomes ``date``; what is no date there is NULL. The other columns, or those of ``columns``,
    are of ``dtype``: float64, float32, int64 (a fraction is cut off), or category, which adds a ``<column>_code`` to each column: its value's place
    among the different ones, from 0 ascending, NULL for NULL. What isn't of the type is NULL. Columns that aren't asked for aren't read.

    With ``adjust`` the columns are assets' prices, and ``actions(symbol, date, action, value)`` say what prices before an action are
    adjusted by: ``split`` for splits and reverse splits, ``split_div`` for dividends too.
    """
    if dtype not in DTYPES or adjust not in ADJUST:
        raise ValueError(f"dtype: one of {DTYPES}; adjust: one of {tuple(ADJUST)}")
    if adjust != "none" and (actions is None or not dtype.startswith("float")):
        raise ValueError("adjusting takes a table of actions, and prices of a float type")
    raw = read(spark, path)
    date = date_col or raw.columns[0]
    names = [c for c in raw.columns if c != date] if columns is None else columns
    missing = [c for c in (date, *names) if c not in raw.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    kind = dict(raw.dtypes)[date]
    day = F.to_date(F.try_to_timestamp(F.col(f"`{date}`"))) if kind == "string" else F.col(f"`{date}`").cast("date")
    typed = raw.select(day.alias("date"), *(_typed(c, dict(raw.dtypes)[c], dtype).alias(c) for c in names))
    if dtype == "category":
        return _coded(typed, names)
    return typed if adjust == "none" else _adjusted(typed, names, dtype, actions.where(F.col("action").isin(*ADJUST[adjust])))


def _typed(name: str, kind: str, dtype: str) -> Column:
    column = F.col(f"`{name}`")
    if dtype == "int64" and kind == "string":
        column = column.try_cast("double")
    if dtype == "int64" and (kind in ("string", "double", "float")):
        column = F.when(~F.isnan(column), column)
    return column.try_cast(_CASTS[dtype])


def _coded(typed: DataFrame, names: list[str]) -> DataFrame:
    """Codes by a table of each column's different values, which are few in a category; the rows are joined with it, not ranked."""
    out = typed
    for c in names:
        own = typed.select(F.col(f"`{c}`").alias("__value")).where("__value is not null").distinct()
        codes = own.withColumn("__code", (F.row_number().over(Window.orderBy("__value")) - 1).cast("int"))
        out = out.join(codes, F.col(f"`{c}`") == F.col("__value"), "left").withColumn(f"{c}_code", F.col("__code")).drop("__value", "__code")
    return out.select("date", *(f"`{x}`" for c in names for x in (c, f"{c}_code")))


def _adjusted(typed: DataFrame, names: list[str], dtype: str, actions: DataFrame) -> DataFrame:
    """Rows keep their number and their gaps: prices are adjusted by symbol, and put back by row."""
    row = typed.select("date", F.struct(*names).alias("own"))
    long = typed.select("date", *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot("date", names, "asset", "px").where("date is not null").select("date", "asset").distinct()
    facts = adjust_prices(long.withColumns({"px": F.lit(1.0), "volume": F.lit(0.0)}), actions, s=Series("asset", "date")).select(F.col("date").alias("time"), "asset", "factor")
    wide = to_wide(facts, "factor", names).withColumnsRenamed({c: f"__f_{c}" for c in names})
    joined = row.join(wide, F.col("date") == F.col("time"), "left")
    return joined.select("date", *((F.col(f"own.`{c}`") * F.coalesce(F.nanvl(F.col(f"`__f_{c}`"), F.lit(1.0)), F.lit(1.0))).cast(_CASTS[dtype]).alias(c) for c in names))
