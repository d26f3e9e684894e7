"""Regressions on several factors at once over rolling windows, from window sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.axes import Series

SINGULAR = 1e-9  # of a factor's variance, that the factors before it must leave over


def joint_exposures(df: DataFrame, y: str, factors: list[str], s: Series = Series(), n: int = 60) -> DataFrame:
    """``df`` with ``alpha``, ``r2`` and a ``beta_<factor>`` for each factor: least squares with intercept over the last ``n`` rows.

    Only windows of ``n`` rows, all of them known, count; others give NULL, and so do windows in which a factor is a combination of those
    before it (or constant). The matrix of covariances is one pass of window sums, and is solved by elimination in Columns, so nothing leaves
    the JVM; its size grows with the square of the number of factors, not with ``n``. Own column names are replaced.
    """
    w = s.last(n)
    known = reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) for c in (y, *factors)))
    k = len(factors)
    sums = {"__n": F.sum(known.cast("int")).over(w)}
    x = [F.when(known, F.col(c).cast("double")) for c in factors]
    own = F.when(known, F.col(y).cast("double"))
    for i in range(k):
        sums |= {f"__m{i}": F.avg(x[i]).over(w), f"__b{i}": F.covar_pop(x[i], own).over(w)}
        sums |= {f"__a{i}_{j}": F.covar_pop(x[i], x[j]).over(w) for j in range(i, k)}
    sums |= {"__my": F.avg(own).over(w), "__vy": F.var_pop(own).over(w)}
    out = df.withColumns(sums).withColumn("__ok", F.col("__n") == n)
    for i in range(k):  # of the symmetric matrix only the upper half is kept; each step is a projection, so no expression grows
        pivot = F.col(f"__a{i}_{i}")
        out = out.withColumn(f"__p{i}", F.col("__ok") & (pivot > SINGULAR * F.greatest(F.col(f"__m{i}") * F.col(f"__m{i}"), F.lit(1e-12))) if i == 0 else F.col("__ok") & F.col(f"__p{i - 1}") & (pivot > SINGULAR * F.col(f"__v{i}")))
        safe = F.when(F.col(f"__p{i}"), pivot)
        rows = {}
        for r in range(i + 1, k):
            share = F.col(f"__a{i}_{r}") / safe
            rows |= {f"__a{r}_{j}": F.col(f"__a{r}_{j}") - share * F.col(f"__a{i}_{j}") for j in range(r, k)}
            rows[f"__b{r}"] = F.col(f"__b{r}") - share * F.col(f"__b{i}")
        keep = {f"__v{r}": F.col(f"__a{r}_{r}") for r in range(i + 1, k)} if i == 0 else {}
        out = out.withColumns(keep | {f"__c{i}": F.col(f"__b{i}")}) if keep else out.withColumn(f"__c{i}", F.col(f"__b{i}"))
        if rows:
            out = out.withColumns(rows)
    for i in reversed(range(k)):
        rest = reduce(Column.__add__, (F.col(f"__a{i}_{j}") * F.col(f"beta_{factors[j]}") for j in range(i + 1, k)), F.lit(0.0))
        out = out.withColumn(f"beta_{factors[i]}", F.when(F.col(f"__p{k - 1}"), (F.col(f"__c{i}") - rest) / F.when(F.col(f"__a{i}_{i}") != 0, F.col(f"__a{i}_{i}"))))
    explained = reduce(Column.__add__, (F.col(f"__c{i}") * F.col(f"__c{i}") / F.when(F.col(f"__a{i}_{i}") != 0, F.col(f"__a{i}_{i}")) for i in range(k)))
    out = out.withColumns({
        "alpha": F.col("__my") - reduce(Column.__add__, (F.col(f"beta_{f}") * F.col(f"__m{i}") for i, f in enumerate(factors))),
        "r2": F.when(F.col(f"__p{k - 1}"), F.when(F.col("__vy") > 0, F.least(explained / F.col("__vy"), F.lit(1.0))).otherwise(0.0)),
    })
    return out.drop(*(c for c in out.columns if c.startswith("__") and c not in df.columns))
