"""Small column expressions shared by the other modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def edge_bin(value: str | Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value, as tinyint: left-closed classes 0..len(edges).

    A value that is null, or below zero, belongs to no class and gets the last one.
    """
    col = _col(value)
    result = F.when((col >= 0) & (col < edges[0]), 0)
    for number, (low, high) in enumerate(zip(edges, edges[1:]), 1):
        result = result.when((col >= low) & (col < high), number)
    return result.otherwise(len(edges)).cast("tinyint")


def clip(value: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Limit to [lower, upper]; null stays null."""
    col = _col(value)
    limited = col
    if upper is not None:
        limited = F.least(limited, F.lit(upper))
    if lower is not None:
        limited = F.greatest(limited, F.lit(lower))
    return F.when(col.isNotNull(), limited)


def strip_prefix(value: str | Column, prefix: str) -> Column:
    return F.regexp_replace(_col(value), f"^{prefix}", "")


def name_part(value: str | Column, index: int, parts: int, separator: str = "_") -> Column:
    """Piece ``index`` of a name cut into ``parts`` pieces; the last piece keeps any further separators."""
    return F.get(F.split(_col(value), separator, parts), index)
