"""Distributed running totals, row numbers, exact quantiles and backward as-of joins.

A window that is partitioned by a few keys only would sort each key in one task. Two forms avoid it:

* *bucketed*: rows are first reduced to one row per (keys, position). Positions are cut into fixed-width buckets; a
  window runs inside each bucket, and the totals of earlier buckets are added as an offset. Because the points are
  distinct, a bucket never holds more rows than it has positions, whatever the skew of the input.
* *sorted*: for orders without a useful width (text hashes, doubles, several columns) Spark's global sort range
  partitions the rows by sampled boundaries. The sorted table is written once, and per-range totals give the offsets.
  There are at most (ranges + keys) of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from queuescope.session import materialize

DAY_SECONDS = 86_400
FINE_SECONDS = 10
_MICROS = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def position(df: DataFrame, name: str) -> Column:
    """Time column as a bigint: microseconds for timestamps, the value itself for numeric times."""
    if is_time(df, name):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("bigint")


def ticks_per_second(df: DataFrame, name: str) -> int:
    return _MICROS if is_time(df, name) else 1


def quoted(name: str) -> str:
    return f"`{name}`"


def default_widths(df: DataFrame, name: str) -> list[int]:
    """Bucket widths for times of any resolution: ten seconds within days (seconds within days for numbers)."""
    if is_time(df, name):
        return [FINE_SECONDS * _MICROS, DAY_SECONDS * _MICROS]
    return [DAY_SECONDS]


def is_fine(columns: Sequence[str], tick: int) -> Column:
    """Aggregate: whether any of the positions is no whole second (null counts as whole)."""
    return F.max(F.coalesce(F.expr(" OR ".join(f"{quoted(c)} % {tick}L <> 0" for c in columns)), F.lit(False)))


def fitting_width(df: DataFrame, name: str, fine: bool) -> int | list[int]:
    """A day for times of whole seconds, at most 86,400 points; ten seconds within days for finer ones."""
    return default_widths(df, name) if fine else DAY_SECONDS * ticks_per_second(df, name)


def bucket_of(pos: str, width: int) -> Column:
    """Number of the fixed-width bucket of a bigint column (floor division, also below zero)."""
    return F.expr(f"(`{pos}` - pmod(`{pos}`, {width}L)) div {width}L")


def join_matching(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi join on ``keys`` where null equals null; keeps the key columns of ``left`` only."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.expr(" AND ".join(f"{quoted(k)} <=> {quoted(f'_right_{k}')}" for k in keys))
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


# --------------------------------------------------------------------------------------------------- bucketed form


def scan_points(
    points: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    *,
    width: int | Sequence[int],
    marks: Sequence[str] = (),
) -> DataFrame:
    """Replace ``sums`` by their running total and ``lasts`` by their latest non-null value, in order of ``pos``.

    ``points`` must be unique on (keys, pos), and ``pos`` must be a bigint. With several widths, each a multiple of the
    one before, the buckets are themselves scanned in wider buckets, so no task sees more buckets than fit in one.
    ``marks`` come back as they are.
    """
    width, *wider = [width] if isinstance(width, int) else list(width)
    bucket = f"_cut_{pos}"
    cut = points.withColumn(bucket, bucket_of(pos, width))
    sums, lasts, marks = ([quoted(c) for c in names] for names in (sums, lasts, marks))
    place = [*[quoted(k) for k in keys], quoted(bucket)]
    # The offsets need no marks, but then they would need other columns than the rows do, and could not share their exchange.
    known = [*lasts, *marks]

    ends = cut.groupBy(*keys, bucket).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in sums],
        *[F.expr(f"max_by({c}, {quoted(pos)}) FILTER (WHERE {c} IS NOT NULL) AS {c}") for c in known],
    )
    if wider:
        offsets = _totals_before(ends, keys, bucket, sums, known, [w // width for w in wider])
    else:
        per_key = f"PARTITION BY {', '.join(place[:-1])} " if keys else ""
        before = f"OVER ({per_key}ORDER BY {place[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        offsets = ends.selectExpr(
            *place,
            *[f"sum({c}) {before} AS {c}" for c in sums],
            *[f"last({c}, true) {before} AS {c}" for c in known],
        )
    # The offset enters the bucket as its first row, so bucket and offset meet without a join.
    first = offsets.selectExpr(*place, f"CAST(NULL AS BIGINT) AS {quoted(pos)}", *sums, *known)
    inside = f"""OVER (PARTITION BY {', '.join(place)} ORDER BY {quoted(pos)} NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    return (
        cut.selectExpr(*place, quoted(pos), *sums, *lasts, *marks)
        .unionByName(first)
        .selectExpr(
            *place[:-1],
            quoted(pos),
            *[f"coalesce(sum({c}) {inside}, 0) AS {c}" for c in sums],
            *[f"last({c}, true) {inside} AS {c}" for c in lasts],
            *marks,
        )
        .where(f"{quoted(pos)} IS NOT NULL")
    )


def _totals_before(
    ends: DataFrame, keys: Sequence[str], bucket: str, sums: Sequence[str], lasts: Sequence[str], widths: Sequence[int]
) -> DataFrame:
    """Offsets of buckets by another scan: each bucket's values count from the next bucket number on."""
    key_list, values = [quoted(k) for k in keys], [*sums, *lasts]
    given = ends.selectExpr(*key_list, f"{quoted(bucket)} + 1 AS {quoted(bucket)}", *values)
    asked = ends.selectExpr(*key_list, quoted(bucket), *[f"IF(false, {c}, NULL) AS {c}" for c in values])
    points = given.unionByName(asked).groupBy(*keys, bucket).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in sums],
        *[F.expr(f"any_value({c}) FILTER (WHERE {c} IS NOT NULL) AS {c}") for c in lasts],
    )
    names = [c.strip("`") for c in values]
    return scan_points(points, keys, bucket, names[: len(sums)], names[len(sums) :], width=widths)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, str],
    *,
    width: int | Sequence[int] | None = None,
) -> DataFrame:
    """Add, per key, the total of each value over all rows with the same or an earlier ``order`` value.

    ``values`` maps output column to input column. Rows that share a position get the same total (RANGE frame).
    """
    width = width or default_widths(df, order)
    placed = df.withColumn("_pos", position(df, order))
    points = placed.groupBy(*keys, "_pos").agg(*[F.sum(c).alias(out) for out, c in values.items()])
    totals = scan_points(points, keys, "_pos", list(values), width=width)
    return join_matching(placed, totals, [*keys, "_pos"]).drop("_pos")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    payload: Mapping[str, str],
    *,
    tie_break: Sequence[str] = (),
    width: int | Sequence[int] | None = None,
) -> DataFrame:
    """Give each left row the values of the latest right row at or before it (null if there is none).

    ``payload`` maps output column to right column. Of right rows at the same time the one with the largest
    ``tie_break`` columns counts.
    """
    keys = list(keys)
    width = width or default_widths(left, left_on)
    asked = left.withColumn("_pos", position(left, left_on))
    order = F.struct(*[F.col(c) for c in tie_break]) if tie_break else F.lit(0)
    known = right.withColumn("_pos", position(right, right_on)).where(F.col("_pos").isNotNull())
    known = known.select(
        *keys,
        "_pos",
        F.struct(*[F.col(c).alias(out) for out, c in payload.items()]).alias("_payload"),
        order.alias("_order"),
    )
    probes = asked.select(
        *keys,
        "_pos",
        F.lit(None).cast(known.schema["_payload"].dataType).alias("_payload"),
        F.lit(None).cast(known.schema["_order"].dataType).alias("_order"),
    )
    points = (
        known.unionByName(probes)
        .groupBy(*keys, "_pos")
        .agg(F.max_by("_payload", F.when(F.col("_payload").isNotNull(), F.col("_order"))).alias("_payload"))
    )
    latest = scan_points(points, keys, "_pos", lasts=["_payload"], width=width)
    return (
        join_matching(asked, latest, [*keys, "_pos"], "left")
        .withColumns({out: F.col("_payload").getField(out) for out in payload})
        .drop("_pos", "_payload")
    )


# ----------------------------------------------------------------------------------------------------- sorted form


def _sorted_table(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Globally sorted, written copy of ``df`` with its sort range (`_range`) and its place in it (`_row`)."""
    slot = F.monotonically_increasing_id()
    table = materialize(df.orderBy(*keys, *order).withColumn("_slot", slot))
    return table.withColumns(
        {
            "_range": F.shiftright("_slot", _ROW_BITS),
            "_row": F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_slot")


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "row_number",
    count: str | None = None,
) -> DataFrame:
    """Add a 0-based row number per key in a total order, and optionally the number of rows of the key.

    The returned frame reads a written copy of ``df``, so it is cheap to use more than once.
    """
    keys = list(keys)
    table = _sorted_table(df, keys, order)
    parts = table.groupBy(*keys, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    per_key = W.partitionBy(*(keys or [F.lit(0)]))
    before = per_key.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.select(
        *keys,
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        *([F.sum("_n").over(per_key).alias(count)] if count else []),
    )
    # Written, so that Spark knows its size: a small one is broadcast, a large one shuffled.
    numbered = join_matching(table, materialize(shifts), [*keys, "_range"])
    return numbered.withColumn(out, F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")


def sorted_totals(
    points: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running totals (own row included) per key in any total order, for rows unique in that order.

    ``totals`` maps further output columns to values whose total over the whole key is wanted.
    """
    keys = list(keys)
    totals = totals or {}
    table = _sorted_table(points, keys, order)
    needed = sorted({*values.values(), *totals.values()})
    parts = table.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in needed])
    per_key = W.partitionBy(*(keys or [F.lit(0)]))
    before = per_key.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_range").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    shifts = parts.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{o}") for o, c in values.items()],
        *[F.sum(c).over(per_key).alias(o) for o, c in totals.items()],
    )
    totalled = table.withColumns({o: F.sum(c).over(inside) for o, c in values.items()})
    merged = join_matching(totalled, materialize(shifts), [*keys, "_range"])
    return merged.withColumns({o: F.col(o) + F.col(f"_off_{o}") for o in values}).drop(
        "_row", "_range", *[f"_off_{o}" for o in values]
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Histogram of ``value`` per key, nulls included; one row per distinct value, so ties no longer matter for skew."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def _known_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Ranks and quantiles are those of the known values."""
    return value_counts(df.where(F.col(value).isNotNull()), keys, value)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """One row per (keys, value) with the 1-based rank its rows share (ties get their mean) and their number."""
    counts = sorted_totals(_known_counts(df, keys, value), keys, [value], {"_upto": "_n"})
    return counts.select(
        *keys,
        value,
        F.col("_n").alias("n_tied"),
        (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)).alias(out),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], method: str = "linear"
) -> DataFrame:
    """Exact quantiles per key, one column per entry of ``probs``; ``nearest`` or ``linear`` interpolation."""
    keys = list(keys)
    counts = sorted_totals(
        _known_counts(df, keys, value), keys, [value], {"_upto": "_n"}, totals={"_total": "_n"}
    )
    return _pick_quantiles(counts, keys, value, probs, method)


def histogram_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], method: str = "nearest"
) -> DataFrame:
    """Like :func:`exact_quantiles` for a value with few distinct levels per key, such as node or CPU counts.

    The window runs over the histogram, whose size is the number of levels, not of rows.
    """
    keys = list(keys)
    per_key = W.partitionBy(*keys)
    upto = per_key.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    counts = _known_counts(df, keys, value).withColumns(
        {"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(per_key)}
    )
    return _pick_quantiles(counts, keys, value, probs, method)


def _pick_quantiles(
    counts: DataFrame, keys: list[str], value: str, probs: Mapping[str, float], method: str
) -> DataFrame:
    if method not in ("nearest", "linear"):
        raise ValueError("method must be 'nearest' or 'linear'")
    low, at = {}, {}
    for name, p in probs.items():
        at[name] = (F.col("_total") - 1) * F.lit(float(p))
        low[name] = F.floor(at[name] + 0.5) if method == "nearest" else F.floor(at[name])

    def nth(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col(value)))

    aggs = []
    for name in probs:
        aggs.append(nth(low[name]).alias(name))
        if method == "linear":
            aggs.append(nth(F.ceil(at[name])).alias(f"_hi_{name}"))
            aggs.append(F.first(at[name] - F.floor(at[name])).alias(f"_part_{name}"))
    picked = counts.groupBy(*keys).agg(*aggs)
    if method == "nearest":
        return picked
    return picked.select(
        *keys,
        *[(F.col(n) + (F.col(f"_hi_{n}") - F.col(n)) * F.col(f"_part_{n}")).alias(n) for n in probs],
    )
