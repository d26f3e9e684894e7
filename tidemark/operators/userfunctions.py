"""A user's own Python functions on a panel: along an asset, across a time, and as mergeable aggregates."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .axes import Section, Series

KEYS = 50_000  # states that a task holds before it passes them on


def apply_ts(df: DataFrame, s: Series, name: str, function: Callable[[pd.DataFrame], pd.Series], kind: str = "double") -> DataFrame:
    """``df`` with ``name``: what ``function`` gives for an asset's rows in time order, a value for each row.

    The function sees one asset as a whole, so its rows must fit a task; what can go on from a state is better a ``recursive`` operator or
    a ``fold``. NULL assets are an asset; without rows the function isn't called.
    """
    return _applied(df, [s.asset], [s.time, *s.ties], name, function, kind)


def apply_xs(df: DataFrame, s: Section, name: str, function: Callable[[pd.DataFrame], pd.Series], kind: str = "double") -> DataFrame:
    """``df`` with ``name``: what ``function`` gives for a time's rows in order of assets, a value for each row."""
    return _applied(df, [s.time, *s.groups], [s.asset], name, function, kind)


def _applied(df: DataFrame, keys: list[str], order: list[str], name: str, function: Callable[[pd.DataFrame], pd.Series], kind: str) -> DataFrame:
    kept = [f for f in df.schema if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T._parse_datatype_string(kind))])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable").reset_index(drop=True)
        told = pd.Series(function(own))
        if len(told) != len(own):
            raise ValueError(f"{name}: {len(told)} values for {len(own)} rows")
        return own.assign(**{name: told.to_numpy()})

    return df.select(*(f"`{f.name}`" for f in kept)).groupBy(*(F.col(f"`{k}`") for k in keys)).applyInPandas(run, schema)


def fold(df: DataFrame, keys: list[str], start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], dict], schema: str) -> DataFrame:
    """``(*keys, what finish tells)`` for each key: a user's aggregate with partial states.

    Each task takes its rows' states from ``start()`` on by ``step(state, rows)``, a batch at a time; only states are shuffled, one for
    each key and task, and ``merge(a, b)`` joins them, so a key that has a third of all rows costs a state for each task. States may
    be any value that pickles; the order in which batches and states come is not defined. NULL keys are a key. Without keys the
    table is one, and without rows there is none.
    """
    own = T.StructType([df.schema[k] for k in keys])
    partial = T.StructType([*own, T.StructField("__state", T.BinaryType())])
    told = T.StructType([*own, *T._parse_datatype_string(f"struct<{schema}>")])
    names = [f.name for f in told][len(keys) :]

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Any] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, pickle.dumps(v)) for k, v in held.items()], columns=[*keys, "__state"])

        for rows in batches:
            for key, part in rows.groupby(keys, dropna=False, sort=False) if keys else [((), rows)]:
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = step(held[key] if key in held else start(), part)
            if len(held) > KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    def merged(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        total = None
        for i, state in enumerate(states["__state"]):
            total = pickle.loads(state) if i == 0 else merge(total, pickle.loads(state))
        found = finish(total)
        return pd.DataFrame([(*key, *(found[n] for n in names))], columns=[*keys, *names])

    states = df.mapInPandas(steps, partial)
    return states.groupBy(*keys).applyInPandas(merged, told)
