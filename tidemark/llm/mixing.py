"""Mix sources to target weights by fitting each source's word budget with whole documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import ranked, with_word_counts
from .shared import stage

WEIGHTS = (5, 2, 1)
MOST = 3
FIT = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``: one row for each source of ``sizes(source, size)``.

    Sources in code-point order, null last, get ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight. With the sources in order of size over
    weight, those that stop come first: a source stops if its limit is no more than its share of what is left by then.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = total.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    stepped = weighed.withColumn("unit", left / weight_left).withColumn("stops", F.col("limit") <= F.col("weight") * F.col("unit"))
    unit = F.max(F.when(~F.col("stops"), F.struct(-(F.col("limit") / F.col("weight")), F.col("unit")))).over(whole).getField("unit")
    return stepped.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * unit).alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that the lengths sum to ``budget`` as nearly as can be.

    All of the budget but ``FIT`` words is shared by the lengths in proportion to their counts, rounded down, and topped up with
    single documents of lengths in seeded order. The last words, about ``FIT``, are fitted by bounded-knapsack dynamic programming
    over the reachable sums (bit i: sum i), of which the one nearest the remainder is taken.
    """
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return counts.copy()
    if budget > FIT:
        taken = np.array([int(c) * (budget - FIT) // total for c in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    moved = True
    while left > FIT and moved:
        moved = False
        for i in order:
            if taken[i] < counts[i] and 0 < lengths[i] <= left - FIT // 2 and left > FIT:
                taken[i] += 1
                left -= int(lengths[i])
                moved = True
    reach = min(2 * left, left + FIT)
    mask = (1 << (reach + 1)) - 1
    sums, steps = 1, []
    for i in order:
        spare, part = int(counts[i] - taken[i]), 1
        length = int(lengths[i])
        if length <= 0 or length > reach:
            continue
        spare = min(spare, reach // length)
        while spare > 0 and not sums >> left & 1:
            n = min(part, spare)
            steps.append((i, n, sums))
            sums |= sums << (n * length) & mask
            spare -= n
            part *= 2
        if sums >> left & 1:
            break
    best = min((abs(s - left), s) for s in _near(sums, left))[1]
    for i, n, before in reversed(steps):
        if not before >> best & 1:
            taken[i] += n
            best -= n * int(lengths[i])
    return taken


def _near(sums: int, at: int) -> list[int]:
    low = sums & ((1 << (at + 1)) - 1)
    high = sums >> at
    found = [low.bit_length() - 1]
    return found + ([at + (high & -high).bit_length() - 1] if high else [])


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` for each row: how often the mix takes it.

    A target of q times its source's size and some more takes every document q times and a seeded subset once more.
    Subsets are chosen by number of documents of each exact length; of equal lengths, those of the least seeded hash of
    their id go first, so reruns agree. Null texts have size 0, a null source is a source, an empty table gives no
    rows; size-0 rows are taken 0 times. Repeated rows count like any others. Other columns are not read.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("body"))
    sizes = stage(with_word_counts(named, "body", "size"), "sizes")
    targets = stage(source_targets(sizes, weights, most), "targets")
    lengths = stage(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = int(target // size) if size else 0
        group["more"] = fit_lengths(group["size"].to_numpy(), group["n"].to_numpy(), round(target - whole * size), seed)
        group["whole"] = whole
        return group[["source", "size", "source_size", "target", "whole", "more"]]

    known = lengths.join(targets, lengths["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    plans = stage(known.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, whole long, more long"), "plans")
    placed = ranked(sizes, ["source", "size"], [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")])
    right = plans.select(F.col("source").alias("of"), F.col("size").alias("length"), "source_size", "target", "whole", "more")
    chosen = stage(placed, "placed").join(right, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length")))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("rank") <= F.col("more")).cast("long")).otherwise(0)
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
