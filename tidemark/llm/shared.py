"""Staged tables, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_path, scratch, stage  # noqa: F401


SIDE_BYTES = 32_000_000  # that a join's small side may have to be broadcast


def side(table: DataFrame, row_bytes: Column | int = 16) -> DataFrame:
    """A staged table as a join's side: broadcast if its rows' bytes come to at most ``SIDE_BYTES``, else merged."""
    total = table.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(table) if total <= SIDE_BYTES else table.hint("merge")


def bucket_of(column: str, parts: int):
    """crc32 of the id as decimal text, modulo ``parts`` (null ids: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)).cast("int")
