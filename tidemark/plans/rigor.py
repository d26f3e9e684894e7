"""Statistical rigor of backtests: moments, probabilistic Sharpe ratios, multiple testing and overfitting."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

_NORMAL = NormalDist()
EULER = 0.5772156649015329


def norm_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def return_stats(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """One row: n, mean, population deviation, Sharpe a period, skewness and (raw) kurtosis."""
    r = F.col(ret)
    facts = returns.agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.coalesce(F.skewness(r), F.lit(0.0)).alias("skew"), (F.coalesce(F.kurtosis(r), F.lit(0.0)) + 3.0).alias("kurtosis"))
    return facts.withColumn("sharpe", F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0))


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float:
    """Chance that the true Sharpe ratio is above ``benchmark`` (both a period)."""
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return 0.5 if n < 2 or spread <= 0 else norm_cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_best_sharpe(trials: int, variance: float) -> float:
    """Of so many trials without skill, whose Sharpe ratios vary so much."""
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * norm_ppf(1 - 1 / trials) + EULER * norm_ppf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, trials: int, variance: float, n: int, skew: float, kurtosis: float) -> float:
    return probabilistic_sharpe(sharpe, expected_best_sharpe(trials, variance), n, skew, kurtosis)


def least_track_record(sharpe: float, benchmark: float, skew: float, kurtosis: float, confidence: float = 0.95) -> float:
    """Periods needed for that confidence; infinite if the Sharpe ratio is not above the benchmark."""
    if sharpe <= benchmark:
        return math.inf
    return 1 + (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) * (norm_ppf(confidence) / (sharpe - benchmark)) ** 2


def adjusted_p_values(tests: DataFrame, p: str = "p", name: str = "test") -> DataFrame:
    """``bonferroni``, ``holm`` and ``bhy`` columns beside each p-value; equal values rank by name, NULLs last.

    The tests are sorted over all tasks. One row for each block of them tells the others how many tests are before it, the greatest of Holm's products
    before and the least of the other products after it; so no task holds more than a block.
    """
    order = [F.col(p).asc_nulls_last(), F.col(name)]
    blocks = stage(tests.repartitionByRange(*order).withColumn("__block", F.spark_partition_id()), "tests")
    own = Window.partitionBy("__block")
    sizes = blocks.groupBy("__block").agg(F.count(F.lit(1)).cast("long").alias("n")).orderBy("__block").collect()
    m = sum(r["n"] for r in sizes)
    if not m:
        return tests.withColumns({k: F.lit(None).cast("double") for k in ("bonferroni", "holm", "bhy")})
    starts = [(r["__block"], sum(x["n"] for x in sizes[:i])) for i, r in enumerate(sizes)]
    c = tests.sparkSession.range(1, m + 1).agg(F.sum(1.0 / F.col("id"))).first()[0]
    k = F.col("__start") + F.row_number().over(own.orderBy(*order))
    placed = blocks.join(F.broadcast(tests.sparkSession.createDataFrame(starts, "__block int, __start long")), "__block")
    placed = placed.withColumn("__k", k).withColumns({"__up": (m - F.col("__k") + 1) * F.col(p), "__down": F.col(p) * m * c / F.col("__k")})
    ends = placed.groupBy("__block").agg(F.max("__up").alias("__above"), F.min("__down").alias("__below"))
    before = Window.unboundedPreceding  # what follows is met first in falling order: a frame that ends at the last row is summed anew for each row
    across = [Window.orderBy(x).rowsBetween(before, -1) for x in (F.col("__block"), F.col("__block").desc())]  # a row for each block
    ends = ends.select("__block", F.max("__above").over(across[0]).alias("__above"), F.min("__below").over(across[1]).alias("__below"))
    one = F.lit(1.0)
    told = placed.join(F.broadcast(ends), "__block").withColumns({
        "bonferroni": F.least(F.col(p) * m, one),
        "holm": F.least(F.greatest(F.max("__up").over(own.orderBy("__k").rowsBetween(before, 0)), "__above"), one),
        "bhy": F.least(F.least(F.min("__down").over(own.orderBy(F.col("__k").desc()).rowsBetween(before, 0)), "__below"), one),
    })
    return told.select(*(F.col(f"`{c}`") for c in tests.columns), "bonferroni", "holm", "bhy")


def bonferroni_haircut(sharpe: float, n: int, trials: int) -> dict[str, float]:
    """The Sharpe ratio that is left when its two-sided p-value is multiplied by the number of trials."""
    t = sharpe * math.sqrt(max(n, 1))
    p = 2 * (1 - norm_cdf(abs(t)))
    adjusted = min(p * max(trials, 1), 1.0)
    left = min(max(norm_ppf(1 - adjusted / 2) if adjusted > 0 else math.inf, 0.0), abs(t)) / math.sqrt(max(n, 1))
    return {"p_single": p, "p_adjusted": adjusted, "haircut_sharpe": math.copysign(left, sharpe) if sharpe else 0.0, "haircut": min(max(1 - left / abs(sharpe), 0.0), 1.0) if sharpe else 0.0}


def rigor_report(returns: DataFrame, *, trials: int = 1, variance: float = 0.0, periods: float = 252.0, ret: str = "ret", time: str = "time", permutations: int = 1000, seed: int = 7) -> DataFrame:
    """One row: moments, annual Sharpe, probabilistic and deflated Sharpe, the haircut for ``trials``, the permutation p-value and the least track record.

    ``variance`` is that of the trials' Sharpe ratios a period. Spark makes the moments, one row; formulas of six numbers follow on the driver.
    """
    facts = return_stats(returns, ret).first()
    n, sharpe, skew, kurtosis = facts["n"], facts["sharpe"] or 0.0, facts["skew"], facts["kurtosis"]
    told = {
        "n": n, "sharpe": sharpe, "annualized_sharpe": sharpe * math.sqrt(periods), "psr": probabilistic_sharpe(sharpe, 0.0, n, skew, kurtosis),
        "deflated_sharpe": deflated_sharpe(sharpe, trials, variance, n, skew, kurtosis), **bonferroni_haircut(sharpe, n, trials), "least_track_record": least_track_record(sharpe, 0.0, skew, kurtosis),
    }
    made = permutation_p_value(returns, ret, time, permutations, seed)
    return made.select(*(F.lit(v).cast("long" if k == "n" else "double").alias(k) for k, v in told.items()), F.col("p").alias("permutation_p"))


def permutation_p_value(returns: DataFrame, ret: str = "ret", time: str = "time", trials: int = 1000, seed: int = 7) -> DataFrame:
    """One row: the share of sign-flipped histories whose mean is at least the real one's, (k + 1) / (trials + 1).

    Signs are bits of a hash of trial and time, so reruns agree. Rows are spread over the trials where they are, and summed before they move.
    """
    each = returns.where(F.col(ret).isNotNull()).select(F.col(time).cast("string").alias("__t"), F.col(ret).alias("__r")).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    bit = F.md5(F.concat_ws("|", F.col("trial").cast("string"), F.col("__t"), F.lit(str(seed))))
    # trial 0 is the real history
    sums = each.groupBy("trial").agg(F.sum(F.when((F.col("trial") == 0) | (F.substring(bit, 1, 1) < "8"), F.col("__r")).otherwise(-F.col("__r"))).alias("s"))
    real = F.max(F.when(F.col("trial") == 0, F.col("s")))
    return sums.agg(real.alias("real"), F.collect_list("s").alias("all")).select((F.size(F.filter("all", lambda x: x >= F.col("real") - 1e-12)) / (trials + 1)).alias("p"))


def overfitting_probability(trials: DataFrame, parts: int = 8) -> DataFrame:
    """One row ``(pbo, splits)`` from ``(trial, time, ret)``: in what share of the splits of ``parts`` time blocks in halves the trial best in one half is
    below the median in the other.

    Block sums of each trial are spread over the splits, of which there are few whatever the input; of equal trials the smaller
    one is best. Distinct times, one row each, are cut in blocks by one task.
    """
    placed = trials.join(trials.select("time").distinct().withColumn("block", (F.ntile(parts).over(Window.orderBy("time")) - 1).cast("int")), "time")
    sums = placed.groupBy("trial", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    splits = F.array(*(F.struct(F.lit(i).alias("split"), F.array(*(F.lit(b) for b in inside)).alias("inside")) for i, inside in enumerate(combinations(range(parts), parts // 2))))
    spread = sums.withColumn("x", F.explode(splits)).select("trial", "block", "n", "s", "q", "x.*")
    here = F.array_contains("inside", F.col("block"))

    def sharpe(rows) -> Column:
        n, s, q = (F.coalesce(F.sum(F.when(rows, F.col(k))), F.lit(0)) for k in "nsq")
        mean = s / F.greatest(n, F.lit(1))
        deviation = F.sqrt(F.greatest(q / F.greatest(n, F.lit(1)) - mean * mean, F.lit(0.0)))
        return F.when(deviation > 1e-12, mean / deviation).otherwise(0.0)

    told = spread.groupBy("split", "trial").agg(sharpe(here).alias("inner"), sharpe(~here).alias("outer"))
    best = told.groupBy("split").agg(F.min(F.struct((-F.col("inner")).alias("rank"), "trial", "outer")).getField("outer").alias("of_best"))
    below = F.count(F.when(F.col("outer") < F.col("of_best"), 1)) + 0.5 * (F.count(F.when(F.col("outer") == F.col("of_best"), 1)) + 1)
    share = told.join(best, "split").groupBy("split").agg((below / (F.count(F.lit(1)) + 1)).alias("share"))
    return share.agg(F.avg((F.col("share") <= 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits"))
