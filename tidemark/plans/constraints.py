"""Constraint sets on ``(time, asset, weight)``, enforced in order: positions, sectors, portfolio, turnover.

A rule is a tuple of its name and limits. A position that a rule removes is NULL until the end, so that sums, counts and turnover pass it
by, and 0 in the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import EPSILON
from ..operators.axes import Section

# fixed values: ready-made sets of rules
LONG_SHORT_EQUITY = (("max_weight", 0.05), ("min_weight", 0.001), ("max_gross", 2.0), ("target_net", 0.0), ("turnover", 0.3))
LONG_ONLY = (("max_weight", 0.10), ("min_weight", 0.005), ("max_short", 0.0), ("max_gross", 1.0), ("target_net", 1.0), ("turnover", 0.5))

POSITION = ("max_weight", "min_weight", "max_long", "max_short")
PORTFOLIO = ("max_gross", "max_net", "min_net", "target_net", "max_longs", "max_shorts", "max_positions", "long_short_ratio")


def _position(rule: tuple) -> Column:
    name, limit = rule
    w = F.col("weight")
    return {
        "max_weight": lambda: F.when(F.abs(w) > limit, F.signum(w) * limit).otherwise(w),
        "min_weight": lambda: F.when(F.abs(w) >= limit, w),
        "max_long": lambda: F.when(w > limit, limit).otherwise(w),
        "max_short": lambda: F.when(w < -limit, -limit).otherwise(w),
    }[name]()


def _portfolio(df: DataFrame, rule: tuple, s: Section) -> DataFrame:
    name, *limits = rule
    w, rows = F.col("weight"), s.rows()
    long, short = F.when(w > 0, w), F.when(w < 0, -w)
    sums = {"__gross": F.sum(F.abs(w)), "__net": F.sum(w), "__long": F.sum(long), "__short": F.sum(short)}
    places = {"max_longs": w.desc_nulls_last(), "max_shorts": w.asc_nulls_last(), "max_positions": F.abs(w).desc_nulls_last()}
    if name in places:
        side = {"max_longs": w > 0, "max_shorts": w < 0, "max_positions": w.isNotNull()}[name]
        place = F.row_number().over(rows.orderBy(places[name], F.col(s.asset)))
        return df.withColumn("__place", place).withColumn("weight", F.when(~side | (F.col("__place") <= limits[0]), w)).drop("__place")
    gross, net, longs, shorts = (F.coalesce(F.col(k), F.lit(0.0)) for k in sums)
    limit, diff = F.lit(float(limits[0])), F.lit(float(limits[0])) - net
    if name == "max_gross":
        scale = F.when(gross > limit, limit / gross)
    elif name == "max_net":
        scale = F.when((net > limit) & (longs > 0) & (w > 0), 1.0 - (net - limit) / longs)
    elif name == "min_net":
        scale = F.when((net < limit) & (shorts > 0) & (w < 0), 1.0 - (limit - net) / shorts)
    elif name == "target_net":
        scale = F.when((diff > EPSILON) & (longs > 0) & (w > 0), 1.0 + diff / longs).when((diff < -EPSILON) & (shorts > 0) & (w < 0), 1.0 - diff / shorts)
    elif name == "long_short_ratio":
        most = F.lit(float(limits[1]))
        scale = F.when((shorts > 0) & (longs / shorts < limit) & (w < 0), longs / (limit * shorts)).when((shorts > 0) & (longs / shorts > most) & (w > 0), most * shorts / longs)
    else:
        raise ValueError(f"no such rule: {name}")
    staged = df.withColumns({k: c.over(rows) for k, c in sums.items()})
    return staged.withColumn("weight", w * F.coalesce(scale, F.lit(1.0))).drop(*sums)


def _sectors(df: DataFrame, rules: list[tuple], sector: str, s: Section) -> DataFrame:
    """All sectors are measured before any is scaled."""
    gross = F.sum(F.abs("weight")).over(Section(s.time, s.asset, (sector,)).rows())
    most = reduce(lambda found, rule: found.when(F.col(sector) == rule[1], F.lit(float(rule[2]))), rules[1:], F.when(F.col(sector) == rules[0][1], F.lit(float(rules[0][2]))))
    return df.withColumns({"__most": most, "__gross": gross}).withColumn("weight", F.when(F.col("__gross") > F.col("__most"), F.col("weight") * F.col("__most") / F.col("__gross")).otherwise(F.col("weight"))).drop("__most", "__gross")


def enforce(df: DataFrame, rules: tuple[tuple, ...], *, sector: str = "sector", previous: str | None = None, s: Section = Section()) -> DataFrame:
    """``df`` with ``weight`` adjusted by all ``rules``: those of a position first, then ``("sector", name, limit)``, then those of the portfolio in
    the order given, then ``("turnover", limit)``, which blends towards the ``previous`` weights (NULL: 0) and needs that column.

    Of equal weights the smaller asset stays. Rules on positions and portfolios are named in ``POSITION`` and ``PORTFOLIO``.
    """
    unknown = [r[0] for r in rules if r[0] not in (*POSITION, *PORTFOLIO, "sector", "turnover")]
    if unknown:
        raise ValueError(f"no such rules: {unknown}")
    for rule in rules:
        if rule[0] in POSITION:
            df = df.withColumn("weight", _position(rule))
    limits = [r for r in rules if r[0] == "sector"]
    df = _sectors(df, limits, sector, s) if limits else df
    for rule in rules:
        if rule[0] in PORTFOLIO:
            df = _portfolio(df, rule, s)
    for rule in rules:
        if rule[0] == "turnover" and previous is not None:
            old = F.coalesce(F.col(previous), F.lit(0.0))
            turned = df.withColumn("__turned", F.sum(F.abs(F.col("weight") - old)).over(s.rows()) / 2.0)
            df = turned.withColumn("weight", F.when(F.col("__turned") > rule[1], old + rule[1] / F.col("__turned") * (F.col("weight") - old)).otherwise(F.col("weight"))).drop("__turned")
    return df.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
