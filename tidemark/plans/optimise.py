"""Portfolio optimisers: means and covariances come from one Spark aggregation, the small problem is solved with NumPy.

The matrix is assets by assets, so these are for universes of up to ``MOST_ASSETS`` assets, which the caller chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = 252.0


MOST_ASSETS = 1_000


def moments(panel: DataFrame, *, ret: str = "ret", asset: str = "asset", time: str = "time", most: int = MOST_ASSETS) -> tuple[list, np.ndarray, np.ndarray]:
    """Assets in order, their mean returns and sample covariances over the times two of them share.

    Times become rows of one column for each asset, tasks sum products of their rows, and one cell for each pair reaches the driver; more
    than ``most`` assets are an error.
    """
    known = panel.where(F.col(ret).isNotNull()).select(F.col(asset).alias("asset"), F.col(time).alias("time"), F.col(ret).cast("double").alias("ret"))
    names = [r["asset"] for r in known.select("asset").distinct().orderBy("asset").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} assets")
    n = len(names)
    if not n:
        return [], np.zeros(0), np.zeros((0, 0))
    wide = known.groupBy("time").pivot("asset", names).agg(F.max("ret")).drop("time").toDF(*(f"c{i}" for i in range(n)))

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, n, n))
        for part in parts:
            x = part.to_numpy(float)
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sums += np.stack((has.T @ has, x.T @ has, has.T @ x, x.T @ x))
        i, j = np.triu_indices(n)
        yield pd.DataFrame({"i": i, "j": j, **{k: v[i, j] for k, v in zip("nxyp", sums, strict=True)}})

    cells = wide.mapInPandas(summed, "i int, j int, n double, x double, y double, p double").groupBy("i", "j").agg(*(F.sum(k).alias(k) for k in "nxyp")).toPandas()
    mean, cov = np.zeros(n), np.zeros((n, n))
    i, j, count = cells["i"].to_numpy(), cells["j"].to_numpy(), cells["n"].to_numpy()
    shared = (cells["p"] - cells["x"] * cells["y"] / np.maximum(count, 1)).to_numpy() / np.maximum(count - 1, 1)
    cov[i, j] = cov[j, i] = np.where(count > 1, shared, 0.0)
    own = i == j
    mean[i[own]] = cells["x"].to_numpy()[own] / np.maximum(count[own], 1)
    return names, mean, cov


def _simplex(w: np.ndarray, most: float = 1.0) -> np.ndarray:
    """The nearest weights in [0, most] that sum to 1: all less one shift, found from the ordered weights, or by bisection where ``most`` binds."""
    if most >= 1.0:
        ordered = np.sort(w)[::-1]
        shifts = (np.cumsum(ordered) - 1.0) / np.arange(1, len(w) + 1)
        return np.maximum(w - shifts[np.flatnonzero(ordered > shifts)[-1]], 0.0)
    low, high = w.min() - 1.0, w.max()
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(w - mid, 0, most).sum() > 1 else (low, mid)
    return np.clip(w - (low + high) / 2, 0, most)


def min_variance(cov: np.ndarray, most: float = 1.0, steps: int = 2000) -> np.ndarray:
    return mean_variance(np.zeros(len(cov)), cov, 1.0, most, steps)


def mean_variance(mean: np.ndarray, cov: np.ndarray, aversion: float, most: float = 1.0, steps: int = 2000) -> np.ndarray:
    """Long-only weights that maximise mean less half ``aversion`` times variance, by projected gradient."""
    rate = 1.0 / (aversion * max(float(np.linalg.eigvalsh(cov)[-1]), 1e-12))
    w = np.full(len(cov), 1.0 / len(cov))
    for _ in range(steps):
        w = _simplex(w + rate * (mean - aversion * cov @ w), most)
    return w


def efficient_frontier(mean: np.ndarray, cov: np.ndarray, points: int = 20, most: float = 1.0) -> list[tuple[float, float, np.ndarray]]:
    """(annual return, annual volatility, weights) from the least to the most daring."""
    out = []
    for aversion in np.geomspace(200.0, 0.5, points):
        w = mean_variance(mean, cov, float(aversion), most, 500)
        out.append((float(mean @ w) * YEAR, float(np.sqrt(w @ cov @ w * YEAR)), w))
    return out


def max_sharpe(mean: np.ndarray, cov: np.ndarray, most: float = 1.0) -> np.ndarray:
    return max(efficient_frontier(mean, cov, 40, most), key=lambda p: p[0] / max(p[1], 1e-12))[2]


def risk_parity(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights whose contributions to the variance are alike."""
    w = 1.0 / np.sqrt(np.maximum(np.diag(cov), 1e-12))
    for _ in range(steps):
        w = w / w.sum()
        share = w * (cov @ w)
        w = w * np.sqrt(share.mean() / np.maximum(share, 1e-15))
    return w / w.sum()


def black_litterman(cov: np.ndarray, market: np.ndarray, views: np.ndarray, wanted: np.ndarray, confidence: np.ndarray, aversion: float = 2.5, tau: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Equilibrium returns and the posterior ones given ``views`` (rows over assets), their returns and confidences in (0, 1]."""
    prior = aversion * cov @ market
    scaled = tau * cov
    doubt = np.diag(np.diag(views @ scaled @ views.T) * (1 - confidence) / np.maximum(confidence, 1e-9))
    gain = scaled @ views.T @ np.linalg.pinv(views @ scaled @ views.T + doubt)
    return prior, prior + gain @ (wanted - views @ prior)


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    """Assets ordered by total correlation distance, then split in halves by inverse variance."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-15))
    distance = np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, 1))
    w, todo = np.ones(len(cov)), [np.argsort(distance.sum(axis=1), kind="stable")]

    def variance(own: np.ndarray) -> float:
        inverse = 1 / np.maximum(np.diag(cov)[own], 1e-15)
        inverse /= inverse.sum()
        return float(inverse @ cov[np.ix_(own, own)] @ inverse)

    while todo:
        own = todo.pop()
        if len(own) > 1:
            left, right = own[: len(own) // 2], own[len(own) // 2 :]
            a, b = variance(left), variance(right)
            w[left] *= b / (a + b)
            w[right] *= a / (a + b)
            todo += [left, right]
    return w


def component_var(weights: np.ndarray, cov: np.ndarray, z: float = 1.645) -> np.ndarray:
    """Each asset's part of the parametric value at risk; the parts sum to the whole."""
    whole = np.sqrt(max(float(weights @ cov @ weights), 1e-18))
    return z * weights * (cov @ weights) / whole
