"""Exact order statistics of whole columns by distributed selection: ranges are counted where the rows are, and narrowed until few values are left."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITTERS = 24  # of a range, in a round
FEW = 4_096  # values that are fetched to end a search


@dataclass
class _Range:
    """Values from ``low`` to ``high``, both included, of which the first has rank ``base`` (from 0)."""

    low: float
    high: float
    base: int
    count: int


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], known: dict[str, tuple[int, float, float]] | None = None) -> dict[tuple[str, int], float]:
    """The value at each rank (from 0, ascending) of each column, NULL and NaN left out; ranks beyond the column's values are left out.

    A round reads the table once for all columns: splitters of each range that is still open are approximate quantiles of it, and counts
    of the values below, at and between them are exact. A splitter's own value is a range of its own, so a value that fills a third of the
    rows ends a search. No task holds a column: what is held are the sketches of the splitters and at most ``FEW`` values of a range.
    ``known``: count, least and greatest value of each column, if the caller has them.
    """
    facts = known or extents(df, list(ranks))
    done: dict[tuple[str, int], float] = {}
    where: dict[tuple[str, int], _Range] = {}
    for c, wanted in ranks.items():
        n, low, high = facts[c]
        where |= {(c, r): _Range(low, high, 0, n) for r in wanted if 0 <= r < n}
    while where:
        for key in [k for k, x in where.items() if x.low == x.high]:
            done[key] = where.pop(key).low
        small = {(c, x.low, x.high) for (c, _), x in where.items() if x.count <= FEW}
        if small:
            got = _fetched(df, sorted(small))
            for key in [k for k, x in where.items() if x.count <= FEW]:
                x = where.pop(key)
                done[key] = got[key[0], x.low, x.high][key[1] - x.base]
        if where:
            _narrow(df, where)
    return done


def _value(c: str) -> Column:
    """NULL for NaN; -0.0 is 0.0."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def extents(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """Count, least and greatest value of each column."""
    row = df.agg(*(f(_value(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    return {c: (row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}


def _fetched(df: DataFrame, ranges: list[tuple[str, float, float]]) -> dict[tuple[str, float, float], list[float]]:
    row = df.agg(*(F.array_sort(F.collect_list(F.when(_value(c).between(a, b), _value(c)))).alias(f"x{i}") for i, (c, a, b) in enumerate(ranges))).first()
    return {key: row[f"x{i}"] for i, key in enumerate(ranges)}


def _narrow(df: DataFrame, where: dict[tuple[str, int], _Range]) -> None:
    """Each open range becomes the part of it that holds the rank."""
    spans = sorted({(c, x.low, x.high, x.base) for (c, _), x in where.items()})
    inside = [F.when(_value(c).between(a, b), _value(c)) for c, a, b, _ in spans]
    steps = [F.lit((k + 1) / (SPLITTERS + 1)) for k in range(SPLITTERS)]
    row = df.agg(*(F.percentile_approx(x, F.array(*steps), 2_000).alias(f"s{i}") for i, x in enumerate(inside))).first()
    cuts = [sorted(set(row[f"s{i}"])) for i in range(len(spans))]
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("span"), x.alias("x")) for i, x in enumerate(inside)))).alias("p")).select("p.*").where("x is not null")
    own = F.element_at(F.array(*(F.array(*(F.lit(c) for c in x)) for x in cuts)), F.col("span") + 1)
    # 2k: below the k-th splitter and above those before it; 2k + 1: equal to it
    part = 2 * F.size(F.filter(own, lambda c: c < F.col("x"))) + F.array_contains(own, F.col("x")).cast("int")
    got = pairs.groupBy("span", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("span", "part").collect()
    for key, x in where.items():
        i, base = spans.index((key[0], x.low, x.high, x.base)), x.base
        for r in got:
            if r["span"] != i:
                continue
            if key[1] < base + r["n"]:
                where[key] = _Range(r["low"], r["high"], base, r["n"])
                break
            base += r["n"]


def exact_quantiles(df: DataFrame, fractions: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Quantiles of each column between neighbouring values by the linear rule, NULL and NaN left out; None for a column without values."""
    facts = extents(df, list(fractions))
    places = {c: [f * (facts[c][0] - 1) for f in own] for c, own in fractions.items()}
    ranks = {c: sorted({r for p in own for r in (math.floor(p), math.ceil(p))}) if facts[c][0] else [] for c, own in places.items()}
    got = order_statistics(df, ranks, facts)

    def at(c: str, place: float) -> float | None:
        if not facts[c][0]:
            return None
        low, high = got[c, math.floor(place)], got[c, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place)) if high != low else low

    return {c: [at(c, p) for p in own] for c, own in places.items()}
