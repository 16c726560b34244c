"""Small table operators: relaxed union, transposition, pivots with fill, shares, top rows, columns by prefix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from queuescope.operators.running import join_matching
from queuescope.session import materialize

# Widening order of numeric types.
_NUMERIC = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """The type all of ``types`` can be cast to without loss of meaning; string if they have nothing in common."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if not known:
        return T.StringType()
    if all(t == known[0] for t in known):
        return known[0]
    if all(type(t) in _NUMERIC for t in known):
        widest = max(known, key=lambda t: _NUMERIC.index(type(t)))
        return T.DoubleType() if isinstance(widest, T.FloatType) else widest
    return T.StringType()


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns become null and differing types are cast to a common one."""
    types: dict[str, list[T.DataType]] = {}
    for frame in frames:
        for field in frame.schema:
            types.setdefault(field.name, []).append(field.dataType)
    target = {name: common_type(found) for name, found in types.items()}
    aligned = [
        f.select(*[F.col(c).cast(target[c]).alias(c) if c in f.columns else F.lit(None).cast(target[c]).alias(c)
                   for c in target])
        for f in frames
    ]
    return reduce(DataFrame.unionByName, aligned)


def to_rows(
    df: DataFrame, keys: Sequence[str] = (), name: str = "metric", value: str = "value",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Wide to long: one row per column, as double."""
    columns = list(columns or [c for c in df.columns if c not in keys])
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), columns, name, value
    )


def pivot_first(
    df: DataFrame, index: Sequence[str], on: str, value: str, levels: Sequence[str], fill: float | None = None
) -> DataFrame:
    """Long to wide with the given levels as columns; cells without a row are null, or ``fill``."""
    wide = df.groupBy(*index).pivot(on, list(levels)).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.na.fill(fill, subset=list(levels))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Value divided by the total of its keys. For result tables; raw tables go through a grouped total first."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total.cast("double")))


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def columns_with(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def without_prefixes(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    return df.drop(*columns_with(df, prefixes))


def null_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def without_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column that holds a null (one aggregate over the data decides)."""
    counts = null_counts(df).first().asDict()
    return df.select(*[c for c in df.columns if counts[c] == 0])


def with_group_values(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of each row's group to the row. Without keys the one result row becomes constants."""
    grouped = df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggregates.items()])
    if keys:  # written, so that Spark knows its size and need not shuffle all rows for a handful of groups
        return join_matching(df, materialize(grouped), keys)
    row = grouped.first()
    return df.withColumns({name: F.lit(row[name]).cast(grouped.schema[name].dataType) for name in aggregates})
