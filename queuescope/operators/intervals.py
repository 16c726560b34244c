"""What was running at a moment: sums over all intervals that contain it.

Every interval becomes signed events (plus at its start, minus at its end), every question an event of size zero.
The events are added up per moment and their running total answers all questions in one sweep, for all resources and
all queues. The cost is linear in the number of intervals, however many of them overlap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from queuescope.operators.running import (
    DAY_SECONDS,
    bucket_of,
    fitting_width,
    is_fine,
    join_matching,
    position,
    quoted,
    scan_points,
    ticks_per_second,
)

ALLOCATED = "allocated_"

# Duration column -> output column of the remaining seconds.
REMAINING = {
    "allocated_timelimit_seconds": "active_timelimit_seconds_remaining",
    "allocated_elapsed_seconds": "active_elapsed_seconds_remaining",
}


def suffixed(prefix: str, column: str) -> str:
    return prefix + column.removeprefix(ALLOCATED)


def sum_type(df: DataFrame, name: str) -> str:
    """Integers are added as bigint and stay exact; everything else as double."""
    return "bigint" if isinstance(df.schema[name].dataType, T.IntegralType) else "double"


def settled(expression: str, kind: str) -> str:
    """Drop the residue that adding and removing the same double may leave."""
    return f"round({expression}, 6)" if kind == "double" else expression


def add_active(
    df: DataFrame,
    resources: Sequence[str] = ("allocated_mem", "allocated_cpu"),
    *,
    keys: Sequence[str] = (),
    remaining: Mapping[str, str] | None = None,
    eligible: str = "eligible_start_ts",
    start: str = "start_ts",
    end: str = "end_ts",
    width: int | Sequence[int] | None = None,
) -> DataFrame:
    """Add ``active_*``: the resources held by all other rows with ``start <= eligible < end``.

    ``remaining`` maps duration columns (seconds) to outputs that hold the seconds still to run, summed over the same
    rows, where a row ends at the earlier of its end and its start plus duration. Durations that are not in ``df``
    are skipped. ``df`` is read twice, for the events and for the join of the answers, and without ``width`` once more to
    see whether its times are whole seconds, so pass it slim and written.
    """
    tick = ticks_per_second(df, eligible)
    remaining = {d: out for d, out in (remaining or {}).items() if d in df.columns}
    kinds = {r: sum_type(df, r) for r in resources}
    stops = {d: f"_to_{d}" for d in remaining}

    def seconds(col: str) -> str:
        return f"({quoted(col)} div {tick}L)" if tick > 1 else quoted(col)

    times = {"_at": eligible, "_from": start, "_to": end}
    placed = df.withColumns({c: position(df, t) for c, t in times.items()}).withColumns(
        {
            stop: F.expr(f"least(_to, _from + CAST({quoted(d)} AS BIGINT) * {tick})")
            for d, stop in stops.items()
        }
    )
    if width is None:
        fine = placed.agg(is_fine(list(times), tick)).first()[0] or False
        width = fitting_width(df, eligible, fine)
    values = {f"_v_{r}": kinds[r] for r in resources}
    for d in remaining:
        values |= {f"_n_{d}": "bigint", f"_d_{d}": "bigint"}

    def event(pos: str, given: Mapping[str, str]) -> str:
        fields = [f"CAST({given.get(v, '0')} AS {kind}) AS {quoted(v)}" for v, kind in values.items()]
        return f"struct({quoted(pos)} AS _pos, {', '.join(fields)})"

    held = {f"_v_{r}": f"coalesce(CAST({quoted(r)} AS {kinds[r]}), 0)" for r in resources}
    began = held | {f"_n_{d}": "1" for d in stops} | {f"_d_{d}": seconds(stop) for d, stop in stops.items()}
    events = [event("_from", began), event("_to", {v: f"-{e}" for v, e in held.items()}), event("_at", {})]
    for d, stop in stops.items():
        events.append(event(stop, {f"_n_{d}": "-1", f"_d_{d}": f"-{seconds(stop)}"}))

    points = (
        placed.selectExpr(*[quoted(k) for k in keys], f"inline(array({', '.join(events)}))")
        .where("_pos IS NOT NULL")
        .groupBy(*keys, "_pos")
        .agg(*[F.expr(f"sum({quoted(v)}) AS {quoted(v)}") for v in values])
    )
    totals = scan_points(points, keys, "_pos", list(values), width=width).withColumnRenamed("_pos", "_at")
    found = join_matching(placed, totals, [*keys, "_at"], "left")

    outputs = {}
    for r in resources:
        total = f"{quoted(f'_v_{r}')} - CASE WHEN _at >= _from AND _at < _to THEN {held[f'_v_{r}']} ELSE 0 END"
        outputs[suffixed("active_", r)] = settled(total, kinds[r])
    for d, out in remaining.items():
        stop = quoted(stops[d])
        total = f"greatest({quoted(f'_d_{d}')} - {seconds('_at')} * {quoted(f'_n_{d}')}, 0)"
        own = f"greatest({seconds(stops[d])} - {seconds('_at')}, 0)"
        own = f"CASE WHEN _at >= _from AND _at < {stop} THEN {own} ELSE 0 END"
        outputs[out] = f"greatest({total} - {own}, 0)"
    kept = [quoted(c) for c in df.columns if c not in outputs]
    return found.selectExpr(*kept, *[f"{e} AS {quoted(out)}" for out, e in outputs.items()])


def add_rolling_count(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    *,
    days: int = 7,
) -> DataFrame:
    """Count, per key, the rows in ``[order - days, order)``: rows at the very same moment are not counted.

    Rows are reduced to one per (keys, moment). Time is cut into slices of ``days`` length: a moment counts in its own
    slice and, until it expires, in the next one. Each slice is one running total, so neither a key with very many rows
    nor a long frame costs more than its rows.
    """
    span = days * DAY_SECONDS * ticks_per_second(df, order)
    placed = df.withColumn("_pos", position(df, order))
    moments = (
        placed.groupBy(*keys, "_pos")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_own", bucket_of("_pos", span))
    )
    steps = moments.selectExpr(
        *[quoted(k) for k in keys],
        f"""inline(array(
            struct(_own AS _slice, _pos, _n, true AS _asks),
            struct(_own + 1 AS _slice, _pos, _n, false AS _asks),
            struct(_own + 1 AS _slice, _pos + {span}L AS _pos, -_n AS _n, false AS _asks)))""",
    )
    before = W.partitionBy(*keys, "_slice").orderBy("_pos").rangeBetween(W.unboundedPreceding, -1)
    found = (
        steps.withColumn(out, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int"))
        .where("_asks")
        .select(*keys, "_pos", out)
    )
    return join_matching(placed, found, [*keys, "_pos"], "left").drop("_pos")


def rolling_counts(
    df: DataFrame,
    keys: Sequence[str],
    place: Sequence[str],
    who: Mapping[str, str],
    order: str,
    *,
    days: int = 7,
) -> DataFrame:
    """``place`` and, per entry of ``who`` (column -> output), the rows of the same key and value in ``[order - days, order)``.

    All columns of ``who`` are stacked as (kind, value) and counted in one sweep, sliced as in :func:`add_rolling_count`.
    ``place`` is unique and holds the keys. Null values are a value of their own.
    """
    span = days * DAY_SECONDS * ticks_per_second(df, order)
    stack = ", ".join(
        f"struct({i} AS _kind, coalesce(concat('=', CAST({quoted(c)} AS STRING)), '') AS _id)" for i, c in enumerate(who)
    )
    rows = df.withColumn("_pos", position(df, order)).selectExpr(*[quoted(c) for c in place], "_pos", f"inline(array({stack}))")
    group = [*keys, "_kind", "_id"]
    moments = rows.groupBy(*group, "_pos").agg(F.count(F.lit(1)).alias("_n")).withColumn("_own", bucket_of("_pos", span))
    steps = moments.selectExpr(
        *[quoted(k) for k in group],
        f"""inline(array(
            struct(_own AS _slice, _pos, _n, true AS _asks),
            struct(_own + 1 AS _slice, _pos, _n, false AS _asks),
            struct(_own + 1 AS _slice, _pos + {span}L AS _pos, -_n AS _n, false AS _asks)))""",
    )
    before = W.partitionBy(*group, "_slice").orderBy("_pos").rangeBetween(W.unboundedPreceding, -1)
    found = steps.withColumn("_count", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int")).where("_asks")
    joined = rows.join(found.select(*group, "_pos", "_count"), [*group, "_pos"])
    return joined.groupBy(*place).agg(
        *[F.max(F.when(F.col("_kind") == i, F.col("_count"))).alias(out) for i, out in enumerate(who.values())]
    )
