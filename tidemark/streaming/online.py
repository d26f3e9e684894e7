"""Structured Streaming: online indicators with state for each asset, time-window buffers, bars, and bars of bars, with watermarks."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.scan import _composed

OUT = "asset string, time timestamp, x double, mean double, std double, ema double, total double, rsi double"
GROUPS = 512  # of assets, each with one state
RUNNING = ("ema", "total", "gain", "loss", "before")


def step(state: tuple, x: float, window: int, span: int, rsi_window: int) -> tuple[tuple, tuple]:
    """The state after ``x``, and the rolling mean and population deviation, EMA, running sum and RSI there."""
    last, ema, total, gain, loss, before, n = state
    last = [*last, x][-window:]
    mean = sum(last) / len(last)
    std = math.sqrt(max(sum((v - mean) ** 2 for v in last) / len(last), 0.0))
    alpha = 2.0 / (span + 1)
    ema = x if n == 0 else ema + alpha * (x - ema)
    total += x
    rsi = 50.0
    if n:
        change = x - before
        gain += (max(change, 0.0) - gain) / rsi_window
        loss += (max(-change, 0.0) - loss) / rsi_window
        rsi = 100 - 100 / (1 + gain / loss) if loss > 1e-10 else (100.0 if gain > 1e-10 else 50.0)
    return (last, ema, total, gain, loss, x, n + 1), (mean, std, ema, total, rsi)


def told_at_once(held: pd.DataFrame, codes: np.ndarray, x: np.ndarray, window: int, span: int, rsi_window: int) -> tuple[dict[str, np.ndarray], pd.DataFrame]:
    """What ``step`` tells of each row, and the states after, for many assets without a step for each row.

    Rows come by asset, ``codes`` from 0, in their order; ``held`` has a row for each code: ``RUNNING``, the ``last`` values and ``n``, 0 for a new asset.
    """
    starts = np.concatenate(([True], codes[1:] != codes[:-1]))
    begins, first = np.flatnonzero(starts), codes[starts]
    known = {c: held[c].to_numpy(float)[first] for c in RUNNING}
    new = held["n"].to_numpy()[first] == 0
    before = np.concatenate(([0.0], x[:-1]))
    before[begins] = np.where(new, x[begins], known["before"])

    def running(share: float, added: np.ndarray, kept: float, name: str, of_new: np.ndarray) -> np.ndarray:
        slope, offset = np.where(starts, 0.0, kept), share * added
        offset[begins] = np.where(new, of_new, kept * known[name] + offset[begins])
        _composed(slope, offset)
        return offset

    alpha, up = 2.0 / (span + 1), 1.0 / rsi_window
    change, zero = x - before, np.zeros(len(begins))
    ema, total = running(alpha, x, 1.0 - alpha, "ema", x[begins]), running(1.0, x, 1.0, "total", x[begins])
    gain, loss = running(up, np.maximum(change, 0.0), 1.0 - up, "gain", zero), running(up, np.maximum(-change, 0.0), 1.0 - up, "loss", zero)
    rsi = np.where(loss > 1e-10, 100 - 100 / (1 + gain / np.where(loss > 1e-10, loss, 1.0)), np.where(gain > 1e-10, 100.0, 50.0))
    # the values held of each asset, put before its own
    tails = [np.asarray(v, float)[1 - window :] if window > 1 else np.zeros(0) for v in held["last"].to_numpy()[first]]
    sizes, more = np.diff(np.append(begins, len(x))), np.array([len(t) for t in tails])
    at = np.arange(len(x)) + np.repeat(np.cumsum(more), sizes)
    line = np.empty(len(x) + more.sum())
    line[at] = x
    line[np.repeat(begins + np.cumsum(more) - more, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)] = np.concatenate(tails)
    place = np.arange(len(x)) - np.repeat(begins, sizes) + np.repeat(more, sizes)  # of a row among its asset's
    n = np.minimum(place + 1, window)
    inside = [(at - k, n > k) for k in reversed(range(window))]
    mean = sum(np.where(m, line[np.where(m, i, 0)], 0.0) for i, m in inside) / n
    std = np.sqrt(sum(np.where(m, (line[np.where(m, i, 0)] - mean) ** 2, 0.0) for i, m in inside) / n)
    ends = begins + sizes - 1
    after = pd.DataFrame({"ema": ema[ends], "total": total[ends], "gain": gain[ends], "loss": loss[ends], "before": x[ends]})
    after["last"] = [line[i + 1 - k : i + 1] for i, k in zip(at[ends], n[ends], strict=True)]
    after["n"] = held["n"].to_numpy()[first] + sizes
    return {"mean": mean, "std": std, "ema": ema, "total": total, "rsi": rsi}, after


def indicators(ticks: DataFrame, *, asset: str = "asset", time: str = "time", value: str = "x", window: int = 20, span: int = 20, rsi_window: int = 14) -> DataFrame:
    """A row with all indicators for each tick, in time order within each micro-batch; NULL values count as 0. Works on a stream only.

    Assets are dealt to ``GROUPS`` groups by hash. A group has one state, with a row for each of its assets, and all its rows are told at once.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches))
        held = pickle.loads(state.get[0]) if state.exists else pd.DataFrame({"asset": pd.Series(dtype=object), **{c: pd.Series(dtype=float) for c in RUNNING}, "last": pd.Series(dtype=object), "n": pd.Series(dtype="int64")})
        codes, assets = pd.factorize(own["__asset"].astype(object), use_na_sentinel=False)
        order = np.lexsort((own[time].to_numpy(), codes))
        codes, x = codes[order], own[value].fillna(0.0).to_numpy(float)[order]
        places = pd.Index(held["asset"]).get_indexer(pd.Index(assets, dtype=object))
        mine = held.take(places).reset_index(drop=True) if len(held) else held.reindex(range(len(assets)))  # -1, a new asset, takes any row
        mine["n"] = np.where(places < 0, 0, mine["n"].fillna(0)).astype("int64")
        mine["last"] = [np.zeros(0) if i < 0 else v for i, v in zip(places, mine["last"], strict=True)]
        told, after = told_at_once(mine, codes, x, window, span, rsi_window)
        after.insert(0, "asset", assets)
        others = held.drop(index=held.index[places[places >= 0]])
        state.update((pickle.dumps(pd.concat([others, after], ignore_index=True) if len(others) else after),))
        made = pd.DataFrame({"asset": np.where(pd.isna(assets), "None", assets)[codes], "time": own[time].to_numpy()[order], "x": x, **told})
        yield made[[c.split()[0] for c in OUT.split(", ")]]

    dealt = ticks.withColumn("__asset", F.col(asset).cast("string")).select("__asset", time, value, F.pmod(F.xxhash64("__asset"), F.lit(GROUPS)).alias("__group"))
    return dealt.groupBy("__group").applyInPandasWithState(run, OUT, "held binary", "append", GroupStateTimeout.NoTimeout)


def bars(ticks: DataFrame, *, every: str = "5 minutes", late: str = "10 minutes", asset: str = "asset", time: str = "time", price: str = "px", volume: str | None = None, ties: str | None = None) -> DataFrame:
    """Open, high, low, close, volume and count by tumbling window and asset; rows later than the watermark are dropped by a stream.

    Of ticks of one time those least and greatest by ``ties``, or else by price, open and close.
    """
    if ticks.isStreaming:
        ticks = ticks.withWatermark(time, late)
    made = _bars(ticks, every, asset=asset, time=time, price=price, volume=volume, ties=ties)
    return made.select(F.col("w.start").alias("time"), "asset", "open", "high", "low", "close", "volume", "n")


def _bars(ticks: DataFrame, every: str, *, asset: str = "asset", time: str = "time", price: str = "px", volume: str | None = None, ties: str | None = None) -> DataFrame:
    order = F.struct(time, ties or price)
    size = F.sum(volume) if volume else F.count(F.lit(1)).cast("double")
    return ticks.groupBy(F.window(time, every).alias("w"), F.col(asset).alias("asset")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), size.alias("volume"), F.count(F.lit(1)).alias("n"),
    )


def sessions(ticks: DataFrame, *, gap: str = "1 hour", late: str = "10 minutes", asset: str = "asset", time: str = "time") -> DataFrame:
    """``(asset, start, end, n)``: runs of ticks no further apart than ``gap``."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark(time, late)
    grouped = ticks.groupBy(F.session_window(time, gap).alias("w"), F.col(asset).alias("asset")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("asset", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bars_of_bars(ticks: DataFrame, every: tuple[str, ...] = ("1 minute", "5 minutes", "60 minutes"), **options) -> DataFrame:
    """Bars of the last length, made of the bars before them: the first of ticks as ``bars`` makes them, each longer one of the shorter.

    In a stream every length is a state of its own, and one watermark passes on through all by the bars' ``window_time``: a bar
    goes on to the next length when it is closed. A length must be a multiple of the one before.
    """
    ticks = ticks.withWatermark(options.get("time", "time"), options.pop("late", "10 minutes")) if ticks.isStreaming else ticks
    made = _bars(ticks, every[0], **options)
    for length in every[1:]:
        made = made.withColumn("at", F.window_time("w")).groupBy(F.window("at", length).alias("w"), "asset").agg(
            F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum("volume").alias("volume"), F.sum("n").alias("n"),
        )
    return made.select(F.col("w.start").alias("time"), "asset", "open", "high", "low", "close", "volume", "n")


BUFFERED = "asset string, time timestamp, x double, n bigint, total double, low double, high double"


def _over_ranges(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, least and greatest of each ``x[first:end]``, none of them empty: a range is put together of spans of 1, 2, 4... values, one for each bit of its length."""
    size, at = end - first, first.copy()
    total, low, high = np.zeros(len(first)), np.full(len(first), np.inf), np.full(len(first), -np.inf)
    sums, lows, highs, reach = x, x, x, 1
    while True:
        own = np.flatnonzero(size & reach)
        total[own] += sums[at[own]]
        low[own], high[own] = np.minimum(low[own], lows[at[own]]), np.maximum(high[own], highs[at[own]])
        at[own] += reach
        if 2 * reach > size.max(initial=0):
            return total, low, high
        sums, lows, highs = sums[:-reach] + sums[reach:], np.minimum(lows[:-reach], lows[reach:]), np.maximum(highs[:-reach], highs[reach:])
        reach *= 2


class _Buffer(StatefulProcessor):
    """An asset's rows of one slot, a ``span`` long, and of the slot before, which they look back on. Times are microseconds; rows are kept as arrays."""

    def __init__(self, span: int, time: str, value: str) -> None:
        self.span, self.time, self.value = span, time, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "at binary, x binary")
        self.told = handle.getValueState("told", "at bigint")  # rows up to then are out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        begin, kept, soonest = key[1] * self.span, [], (key[1] + 1) * self.span
        for own in rows:
            at = own[self.time].to_numpy("datetime64[us]").astype(np.int64)
            kept.append((at.tobytes(), own[self.value].fillna(0.0).to_numpy(float).tobytes()))
            soonest = min(soonest, int(at[at >= begin].min(initial=soonest)))
        self.kept.appendList(kept)
        self.handle.registerTimer(soonest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, begin = timerValues.getCurrentWatermarkInMs() * 1000, key[1] * self.span
        told = self.told.get()[0] if self.told.exists() else begin - 1
        if told >= due or not self.kept.exists():
            return
        chunks = list(self.kept.get())
        at, x = np.concatenate([np.frombuffer(c[0], np.int64) for c in chunks]), np.concatenate([np.frombuffer(c[1], float) for c in chunks])
        order = np.lexsort((x, at))
        at, x = at[order], x[order]
        first, last = np.searchsorted(at, told, "right"), np.searchsorted(at, due, "right")
        if due >= begin + self.span:
            self.kept.clear()
            self.told.clear()
        else:  # what comes next may look back a span
            keep = np.searchsorted(at, due - self.span, "left")
            self.kept.put([(at[keep:].tobytes(), x[keep:].tobytes())])
            self.told.update((due,))
            self.handle.registerTimer(int(at[last] if last < len(at) else begin + self.span) // 1000 + 1)
        if first < last:
            since, upto = np.searchsorted(at, at[first:last] - self.span, "left"), np.searchsorted(at, at[first:last], "right")
            total, low, high = _over_ranges(x, since, upto)
            yield pd.DataFrame({"asset": str(key[0]), "time": at[first:last].view("datetime64[us]"), "x": x[first:last], "n": upto - since, "total": total, "low": low, "high": high})

    def close(self) -> None:
        pass


def window_buffer(ticks: DataFrame, *, seconds: float = 3600.0, late: str = "10 minutes", asset: str = "asset", time: str = "time", value: str = "x") -> DataFrame:
    """For each tick the count, sum, least and greatest value of the asset's ticks in the ``seconds`` up to it, both ends and equal times included.

    Works on a stream only, whose state store must be RocksDB. A tick is told once the watermark has passed it, so ticks that come
    out of order within ``late`` are in their places; later ones are dropped. Time is cut in slots of ``seconds``, each with a state of its own: a tick
    goes to its slot and to the next, which may look back on it. So an asset's slots are spread over the tasks, and a slot's
    state, two windows at most, goes when the watermark has passed it. NULL values count as 0.
    """
    span = int(seconds * 1e6)
    slot = F.floor(F.unix_micros(time) / F.lit(span)).cast("long")
    slots = ticks.withWatermark(time, late).withColumn("__slot", F.explode(F.array(slot, slot + 1)))
    return slots.groupBy(asset, "__slot").transformWithStateInPandas(_Buffer(span, time, value), BUFFERED, "Append", "EventTime")
