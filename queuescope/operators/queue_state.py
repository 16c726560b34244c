"""What was running and what was waiting ahead at the moment each row became eligible, in one sweep of one event table.

The two questions are interval sums over the same rows, so they share their events: level -1 holds the rows while they
run, for the whole key; level l >= 0 holds them while they wait, in aligned blocks of 2**l chunks of ranks (see ``dominance``).
The levels are added up per moment and scanned together, or a few at a time if there are very many events. The answers of
a chunk then meet its rows in one cogroup, where the chunk is solved and the row's own share is taken off, so no answer is
joined back to rows twice.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.operators.dominance import CHUNK_BITS, waiting_ahead
from queuescope.operators.intervals import settled, suffixed, sum_type
from queuescope.operators.running import fitting_width, is_fine, position, quoted, scan_points, ticks_per_second
from queuescope.session import materialize

# The levels grow with the logarithm of the rows. Beyond this many events the levels are swept one after the other, as the
# shuffle files of a sweep stay until it ends.
EVENTS_AT_ONCE = 1 << 25

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queue_state(
    df: DataFrame,
    resources: Sequence[str],
    *,
    keys: Sequence[str],
    rank: str,
    remaining: Mapping[str, str] | None = None,
    eligible: str = "eligible_start_ts",
    start: str = "start_ts",
    end: str = "end_ts",
    chunk_bits: int = CHUNK_BITS,
    width: int | Sequence[int] | None = None,
    events_at_once: int = EVENTS_AT_ONCE,
) -> DataFrame:
    """keys, rank, ``active_*``, the outputs of ``remaining``, ``queued_*``: one row per row of ``df``.

    The same sums as ``add_active`` and ``add_queued`` give, for rows whose keys, rank and times are known. ``rank`` is unique
    per key. ``df`` is read three times, so pass it slim and written. Without ``width`` one job looks whether
    the times are whole seconds: a bucket is then a day, otherwise ten seconds within days. Where the levels have more than
    about ``events_at_once`` events, as many as fit, but one at least, are swept at a time and their answers written.
    """
    if not 1 <= chunk_bits <= 16:
        raise ValueError("chunk_bits must be between 1 and 16")
    tick = ticks_per_second(df, eligible)
    remaining = {d: out for d, out in (remaining or {}).items() if d in df.columns}
    kinds = {r: sum_type(df, r) for r in resources}
    values = {f"_v_{r}": kinds[r] for r in resources}
    for d in remaining:
        values |= {f"_n_{d}": "bigint", f"_d_{d}": "bigint"}

    def seconds(column: str) -> str:
        return f"({quoted(column)} div {tick}L)" if tick > 1 else quoted(column)

    placed = df.select(
        *keys, rank, position(df, eligible).alias("_at"), position(df, start).alias("_from"), position(df, end).alias("_to"),
        F.shiftright(F.col(rank), chunk_bits).cast("bigint").alias("_chunk"),
        F.expr(f"CAST({quoted(rank)} & {(1 << chunk_bits) - 1} AS INT) AS _place"),
        *[F.expr(f"coalesce(CAST({quoted(r)} AS {kinds[r]}), CAST(0 AS {kinds[r]})) AS {quoted(f'_v_{r}')}") for r in resources],
        *[F.expr(f"CAST({quoted(d)} AS BIGINT) AS {quoted(f'_l_{d}')}") for d in remaining],
    )
    placed = placed.selectExpr(
        "*", f"{seconds('_at')} AS _second",
        *[f"least(_to, _from + {quoted(f'_l_{d}')} * {tick}) AS {quoted(f'_to_{d}')}" for d in remaining],
    ).selectExpr("*", *[f"{seconds(f'_to_{d}')} AS {quoted(f'_s_{d}')}" for d in remaining])
    facts = placed.agg(
        F.max("_chunk").alias("chunk"), is_fine(["_at", "_from", "_to"], tick).alias("fine"), F.count(F.lit(1)).alias("rows")
    ).first()
    last_chunk = facts["chunk"] or 0
    width = width or fitting_width(df, eligible, facts["fine"])

    sweeps = _sweeps(facts["rows"], 3 + len(remaining), last_chunk.bit_length(), events_at_once)
    parts = [_answers(placed, keys, values, remaining, last_chunk, seconds, width, levels) for levels in sweeps]
    answers = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, map(materialize, parts))
    outputs = {suffixed("active_", r): kinds[r] for r in resources} | {out: "bigint" for out in remaining.values()}
    outputs |= {suffixed("queued_", r): "double" for r in resources}
    head = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.select(*keys, rank).schema)
    schema = head + "".join(f", {quoted(o)} {kind}" for o, kind in outputs.items())
    solved = placed.groupBy(*keys, "_chunk").cogroup(
        answers.groupBy(*[f"_key_{k}" for k in keys], "_for_chunk")
    ).applyInArrow(_solver([*keys, rank], list(resources), list(remaining), outputs), schema)
    return solved.selectExpr(
        *[quoted(c) for c in (*keys, rank)], *[f"{settled(quoted(o), kind)} AS {quoted(o)}" for o, kind in outputs.items()]
    )


def _sweeps(rows: int, running_events: int, levels: int, most: int) -> list[list[int]]:
    """The levels -1 to ``levels - 1`` in runs of about ``most`` events, or of one level.

    A row has ``running_events`` at level -1. At each other level it either waits (two events) or asks (one).
    """
    sweeps, room = [], 0.0
    for level in range(-1, levels):
        events = rows * (running_events if level < 0 else 1.5)
        if sweeps and events <= room:
            sweeps[-1].append(level)
        else:
            sweeps.append([level])
            room = most
        room -= events
    return sweeps


def _answers(placed, keys, values, remaining, last_chunk, seconds, width, swept) -> DataFrame:
    """(keys, chunk, moment, level) with the totals of the block of a swept level that the chunk asks for at the moment."""
    key_list = [quoted(k) for k in keys]

    def event(level: str, block: str, pos: str, given: Mapping[str, str]) -> str:
        fields = [f"CAST({given.get(v, '0')} AS {kind}) AS {quoted(v)}" for v, kind in values.items()]
        asks = "false" if given else "true"
        return f"struct(CAST({level} AS INT) AS _level, CAST({block} AS BIGINT) AS _block, {pos} AS _pos, {asks} AS _asked, {', '.join(fields)})"

    held = {v: quoted(v) for v in values if v.startswith("_v_")}
    gone = {v: f"-{quoted(v)}" for v in held}
    began = held | {f"_n_{d}": f"IF({quoted(f'_s_{d}')} IS NULL, 0, 1)" for d in remaining}
    began |= {f"_d_{d}": f"coalesce({quoted(f'_s_{d}')}, 0)" for d in remaining}
    events = [event("-1", "0", "_from", began), event("-1", "0", "_to", gone), event("-1", "0", "_at", {})]
    for d in remaining:
        stop = {f"_n_{d}": "-1", f"_d_{d}": f"-{quoted(f'_s_{d}')}"}
        events.append(event("-1", "0", quoted(f"_to_{d}"), stop))
    every, asked_levels = ([f"array({', '.join(events)})"], ["array(-1)"]) if -1 in swept else ([], [])
    if swept[-1] >= 0:
        levels = f"sequence({max(swept[0], 0)}, {swept[-1]})"
        # Even blocks hold waiting rows, odd ones ask their left neighbour; a block that nobody can ask holds none.
        holds = f"filter({levels}, l -> _at < _from AND (shiftright(_chunk, l) & 1) = 0 AND shiftleft(shiftright(_chunk, l) + 1, l) <= {last_chunk})"
        asks = f"filter({levels}, l -> (shiftright(_chunk, l) & 1) = 1)"
        every += [
            f"transform({holds}, l -> {event('l', 'shiftright(_chunk, l)', '_at', held)})",
            f"transform({holds}, l -> {event('l', 'shiftright(_chunk, l)', '_from', gone)})",
            f"transform({asks}, l -> {event('l', 'shiftright(_chunk, l) - 1', '_at', {})})",
        ]
        asked_levels.append(asks)
    group = [*keys, "_level", "_block"]
    points = (
        placed.selectExpr(*key_list, f"inline(concat({', '.join(every)}))").where("_pos IS NOT NULL").groupBy(*group, "_pos")
        .agg(F.max("_asked").alias("_asked"), *[F.expr(f"sum({quoted(v)}) AS {quoted(v)}") for v in values])
    )
    # Most points only add or remove; these have done their part and are not sent to the rows that ask. The mark stands before
    # the sums, where Spark puts it in the rows' plan; else the offsets' plan would not share its exchange.
    totals = scan_points(points, group, "_pos", list(values), width=width, marks=["_asked"]).where("_asked").drop("_asked")
    # Rows of a chunk that ask at the same moment share the answer.
    asked = placed.select(*keys, "_chunk", "_at").distinct().selectExpr(
        *[f"{quoted(k)} AS {quoted(f'_key_{k}')}" for k in keys], "_chunk AS _for_chunk", "_at AS _moment",
        f"explode(concat({', '.join(asked_levels)})) AS _for_level",
    )
    same = [f"{quoted(k)} = {quoted(f'_key_{k}')}" for k in keys]
    block = "_block = IF(_for_level < 0, 0, shiftright(_for_chunk, _for_level) - 1)"
    found = asked.join(totals, F.expr(" AND ".join([*same, "_level = _for_level", block, "_pos = _moment"])))
    return found.select(*[f"_key_{k}" for k in keys], "_for_chunk", "_moment", "_level", *values)


def _solver(head: list[str], resources: list[str], remaining: list[str], outputs: Mapping[str, str]):
    def solve(rows: pa.Table, answers: pa.Table) -> pa.Table:
        def column(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        at, began, ended = (column(rows, c) for c in ("_at", "_from", "_to"))
        level, moment = column(answers, "_level"), column(answers, "_moment")
        whole = np.flatnonzero(level < 0)
        whole = whole[np.argsort(moment[whole])]
        mine = whole[np.searchsorted(moment[whole], at)] if len(at) else whole[:0]
        runs, made = (began <= at) & (at < ended), []
        for r in resources:
            total = column(answers, f"_v_{r}")[mine]
            made.append(total - np.where(runs, column(rows, f"_v_{r}"), 0))
        second = column(rows, "_second")
        for d in remaining:
            # A row without a duration never runs out and is not counted; its stop is null.
            stop = rows.column(f"_to_{d}").fill_null(-(1 << 62)).to_numpy()
            until = rows.column(f"_s_{d}").fill_null(0).to_numpy()
            total = np.maximum(column(answers, f"_d_{d}")[mine] - second * column(answers, f"_n_{d}")[mine], 0)
            own = np.where((began <= at) & (at < stop), np.maximum(until - second, 0), 0)
            made.append(np.maximum(total - own, 0))
        held = np.column_stack([column(rows, f"_v_{r}").astype(float) for r in resources]) if resources else np.zeros((len(at), 0))
        ahead = waiting_ahead(column(rows, "_place"), at, began, held)
        blocks = np.flatnonzero(level >= 0)
        if len(blocks):
            times = moment[whole]
            place, answer = np.searchsorted(times, moment[blocks]), np.searchsorted(times, at)
            for k, r in enumerate(resources):
                earlier = np.bincount(place, column(answers, f"_v_{r}")[blocks].astype(float), len(times))
                ahead[:, k] += earlier[answer]
        made += [ahead[:, k] for k in range(len(resources))]
        kinds = [pa.int64() if kind == "bigint" else pa.float64() for kind in outputs.values()]
        columns = {c: rows.column(c) for c in head}
        columns |= {o: pa.array(m.astype(np.int64 if k == pa.int64() else float), k) for o, m, k in zip(outputs, made, kinds)}
        return pa.table(columns)

    return solve
