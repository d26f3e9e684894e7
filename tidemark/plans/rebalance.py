"""Portfolios that are set to their targets on a schedule, and drift with returns in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.axes import Section

SCHEDULES = ("day", "week", "month", "quarter", "year")


def _calendar(panel: DataFrame, every: str, time: str) -> DataFrame:
    """``(period, opens, closed)``: the first time of each period with rows, and that of the period with rows before."""
    opens = panel.groupBy(F.date_trunc(every, time).alias("period")).agg(F.min(time).alias("opens"))
    return opens.withColumn("closed", F.lag("opens").over(Window.orderBy("period")))  # a row for each period


def drifting(panel: DataFrame, *, every: str = "month", ret: str = "ret", target: str = "target", s: Section = Section()) -> DataFrame:
    """``(time, asset, since, held, weight)``: what is held at each time, before any trade there.

    At the first time of each period that has rows, weights are set to that time's ``target`` (NULL: 0), after its returns. From then on,
    ``held`` is the target grown by the asset's returns since (NULL and NaN: 0), as a share of the portfolio as it was at ``since``;
    ``weight`` is its share of the portfolio as it is now, cash included, which is what targets leave over and earns nothing. Rows before the
    first setting are left out; an asset without a row keeps what it had.
    """
    if every not in SCHEDULES:
        raise ValueError(f"every: one of {SCHEDULES}")
    r = F.coalesce(F.nanvl(F.col(ret).cast("double"), F.lit(0.0)), F.lit(0.0))
    calendar = _calendar(panel, every, s.time)
    own = panel.select(F.col(s.time).alias("time"), F.col(s.asset).alias("asset"), r.alias("r"), F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("target"), F.date_trunc(every, s.time).alias("period"))
    placed = own.join(F.broadcast(calendar), "period").withColumn("since", F.when(F.col("time") > F.col("opens"), F.col("opens")).otherwise(F.col("closed")))
    set_at = placed.where(F.col("time") == F.col("opens")).select("asset", F.col("time").alias("since"), F.col("target").alias("start"))
    grown = placed.where("since is not null").join(set_at, ["asset", "since"], "left").withColumn("start", F.coalesce("start", F.lit(0.0)))
    along = Window.partitionBy("asset", "since").orderBy("time")
    held = grown.withColumn("growth", F.product(1.0 + F.col("r")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumn("held", F.col("start") * F.col("growth")).withColumn("gain", F.col("held") - F.coalesce(F.lag("held").over(along), F.col("start")))
    value = _values(held)
    return held.join(F.broadcast(value.select("time", "value")), "time").select("time", "asset", "since", "held", (F.col("held") / F.col("value")).alias("weight"), "gain", "value")


def _values(held: DataFrame) -> DataFrame:
    """``(time, since, value, gross)``: the portfolio's worth against that at ``since``, from the assets' gains, so gaps cost nothing."""
    gains = held.groupBy("since", "time").agg(F.sum("gain").alias("gain"))
    value = 1.0 + F.sum("gain").over(Window.partitionBy("since").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    return gains.withColumn("value", value).select("time", "since", "value", (F.col("gain") / (F.col("value") - F.col("gain"))).alias("gross"))


def rebalanced(panel: DataFrame, *, every: str = "month", ret: str = "ret", target: str = "target", cost_bps: float = 5.0, s: Section = Section()) -> DataFrame:
    """``(time, gross, turnover, ret)`` of a portfolio that ``drifting`` describes, a row for each time after the first setting.

    Turnover is what the new targets differ from the drifted weights at a setting, summed over all assets of either side, 0 at other
    times and at the first one; ``ret`` is gross less turnover times ``cost_bps`` / 10000.
    """
    held = drifting(panel, every=every, ret=ret, target=target, s=s)
    calendar = _calendar(panel, every, s.time)
    values = _values(held)
    targets = panel.select(F.col(s.time).alias("opens"), F.col(s.asset).alias("asset"), F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("target")).join(F.broadcast(calendar.select("opens")), "opens")
    ends = values.groupBy("since").agg(F.max_by("value", "time").alias("value"))
    last = held.groupBy("asset", "since").agg(F.max_by("held", "time").alias("held"))
    begun = targets.select("asset", F.col("opens").alias("since"), "target").join(last, ["asset", "since"], "left").withColumn("held", F.coalesce("held", "target"))
    before = begun.join(F.broadcast(ends), "since").join(F.broadcast(calendar.select(F.col("closed").alias("since"), "opens")), "since").select("opens", "asset", (F.col("held") / F.col("value")).alias("weight"))
    moved = targets.join(before, ["opens", "asset"], "full_outer").groupBy(F.col("opens").alias("time")).agg(F.sum(F.abs(F.coalesce("target", F.lit(0.0)) - F.coalesce("weight", F.lit(0.0)))).alias("turnover"))
    told = values.join(F.broadcast(moved), "time", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return told.select("time", "gross", "turnover", (F.col("gross") - F.col("turnover") * (cost_bps / 10_000.0)).alias("ret"))
