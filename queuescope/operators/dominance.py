"""What was waiting ahead: sums over all rows that wait at a moment and rank before the row that asks.

``queued_R(j)`` adds R over the rows with ``eligible_i <= eligible_j < start_i`` and ``rank_i < rank_j``, where rank
orders a queue by priority (descending), submit time and a tie break. It is a two-dimensional dominance sum and is
answered without comparing pairs:

* ranks are cut into chunks of ``2**chunk_bits`` rows; a chunk is one bounded group and is solved by itself;
* everything in earlier chunks is covered by at most one aligned block of chunks per binary digit of the chunk
  number. A waiting row is an interval event in the blocks that can be asked for, and the event sweep gives each
  block's waiting total at any moment.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuescope.operators.intervals import suffixed
from queuescope.operators.running import (
    fitting_width,
    is_fine,
    join_matching,
    position,
    quoted,
    row_numbers,
    scan_points,
    ticks_per_second,
)

CHUNK_BITS = 13  # a chunk of 8,192 rows takes a few MB; fewer bits mean more levels of events

# Send the chunk solver along with the job, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def add_queue_rank(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    priority: str = "priority",
    submit: str = "submit_ts",
    tie_break: Sequence[str] = (),
    out: str = "queue_rank",
) -> DataFrame:
    """Add the 0-based place in the queue. Rows equal in all order columns are told apart by a hash of the row."""
    order = [F.col(priority).desc(), F.col(submit).asc(), *tie_break, F.xxhash64(*df.columns)]
    return row_numbers(df, keys, order, out)


def add_queued(
    df: DataFrame,
    resources: Sequence[str] = ("allocated_mem", "allocated_cpu"),
    *,
    keys: Sequence[str] = (),
    rank: str | None = None,
    priority: str = "priority",
    submit: str = "submit_ts",
    tie_break: Sequence[str] = (),
    eligible: str = "eligible_start_ts",
    start: str = "start_ts",
    chunk_bits: int = CHUNK_BITS,
    width: int | Sequence[int] | None = None,
) -> DataFrame:
    """Add ``queued_*`` (double): the resources of waiting rows that are ahead of each row.

    Pass ``rank`` if the frame already has a column from :func:`add_queue_rank`; otherwise ``df`` is ranked and
    written first. The rows of a chunk pass through Arrow, so pass no more columns than needed.
    """
    if not 1 <= chunk_bits <= 16:
        raise ValueError("chunk_bits must be between 1 and 16")
    given = rank
    if rank is None:
        rank = "_rank"
        df = add_queue_rank(
            df, keys=keys, priority=priority, submit=submit, tie_break=tie_break, out=rank
        )
    outputs = {r: suffixed("queued_", r) for r in resources}

    placed = df.withColumns(
        {
            "_at": position(df, eligible),
            "_until": position(df, start),
            "_chunk": F.shiftright(rank, chunk_bits),
            "_place": F.expr(f"CAST({quoted(rank)} & {(1 << chunk_bits) - 1} AS INT)"),
            **{f"_r_{r}": F.expr(f"coalesce(CAST({quoted(r)} AS DOUBLE), 0D)") for r in resources},
        }
    )
    facts = placed.agg(F.max(rank).alias("last"), is_fine(["_at", "_until"], ticks_per_second(df, eligible)).alias("fine")).first()
    last_rank, width = facts["last"] or 0, width or fitting_width(df, eligible, facts["fine"])
    earlier = _earlier_chunks(placed, keys, outputs, last_rank >> chunk_bits, width)
    placed = join_matching(placed, earlier, [*keys, "_chunk", "_at"], "left")
    placed = placed.withColumns({o: F.expr(f"coalesce({quoted(o)}, 0D)") for o in outputs.values()})

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in placed.schema])
    solve = _chunk_solver(list(outputs), list(outputs.values()))
    solved = placed.groupBy(*keys, "_chunk").applyInArrow(solve, schema)
    kept = [quoted(c) for c in df.columns if c not in outputs.values() and c != (None if given else rank)]
    return solved.selectExpr(*kept, *[f"round({quoted(o)}, 6) AS {quoted(o)}" for o in outputs.values()])


def _earlier_chunks(
    placed: DataFrame, keys: Sequence[str], outputs: dict[str, str], last_chunk: int, width: int | Sequence[int]
) -> DataFrame:
    """Waiting totals of all earlier chunks per (keys, chunk, moment asked for)."""
    key_list = [quoted(k) for k in keys]
    values = [f"_r_{r}" for r in outputs]
    levels = max(last_chunk.bit_length() - 1, 0)
    blocks = placed.selectExpr(
        *key_list, "_at", "_until", "_chunk", *[quoted(v) for v in values], f"explode(sequence(0, {levels})) AS _level"
    ).withColumn("_block", F.expr("shiftright(_chunk, _level)"))

    # Left blocks (even number) hold waiting rows, right blocks ask their left neighbour, if there is one.
    def event(pos: str, sign: str) -> str:
        return f"struct({pos} AS _pos, {', '.join(f'{sign}{quoted(v)} AS {quoted(v)}' for v in values)})"

    waiting = blocks.where(
        f"_block % 2 = 0 AND _at < _until AND shiftleft(_block + 1, _level) <= {last_chunk}"
    ).selectExpr(
        *key_list, "_level", "_block", f"inline(array({event('_at', '')}, {event('_until', '-')}))"
    )
    # Rows of a chunk that ask at the same moment share the answer.
    asked = (
        blocks.where("_block % 2 = 1")
        .selectExpr(*key_list, "_chunk", "_level", "_block - 1 AS _block", "_at AS _pos")
        .distinct()
    )
    group = [*keys, "_level", "_block"]
    probes = asked.selectExpr(*key_list, "_level", "_block", "_pos", *[f"0D AS {quoted(v)}" for v in values])
    points = (
        waiting.unionByName(probes)
        .groupBy(*group, "_pos")
        .agg(*[F.expr(f"sum({quoted(v)}) AS {quoted(v)}") for v in values])
    )
    totals = scan_points(points, group, "_pos", values, width=width)
    return (
        join_matching(asked, totals, [*group, "_pos"])
        .groupBy(*keys, "_chunk", F.col("_pos").alias("_at"))
        .agg(*[F.expr(f"sum({quoted(f'_r_{r}')}) AS {quoted(o)}") for r, o in outputs.items()])
    )


def _chunk_solver(resources: list[str], outputs: list[str]):
    def solve(table: pa.Table) -> pa.Table:
        def column(name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        held = np.column_stack([column(f"_r_{r}") for r in resources])
        ahead = waiting_ahead(column("_place"), column("_at"), column("_until"), held)
        for k, name in enumerate(outputs):
            index = table.schema.get_field_index(name)
            total = pa.array(ahead[:, k] + column(name))
            table = table.set_column(index, table.schema.field(index), total)
        return table

    return solve


def waiting_ahead(place: np.ndarray, at: np.ndarray, until: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For one bounded group: per row, the sum of ``held`` over rows of lower ``place`` with at_i <= at < until_i.

    Same idea as between chunks, one binary digit of ``place`` at a time: events of the left half of each block are
    added up in time order and read by the rows of its right half.
    """
    rows = len(place)
    total = np.zeros((rows, held.shape[1]))
    waits = np.flatnonzero(until > at)
    # Additions and removals come before questions of the same moment.
    row = np.concatenate([waits, waits, np.arange(rows)])
    sign = np.concatenate([np.ones(len(waits)), -np.ones(len(waits)), np.zeros(rows)])
    when = np.concatenate([at[waits], until[waits], at])
    in_time = np.lexsort((sign == 0, when))
    row, sign = row[in_time], sign[in_time]
    digits = place[row].astype(np.uint16)
    asks = sign == 0

    for level in range(int(place.max(initial=0)).bit_length()):
        right = ((digits >> level) & 1).astype(bool)
        used = np.flatnonzero(asks == right)
        block = digits[used] >> level >> 1
        used = used[np.argsort(block, kind="stable")]
        block = np.sort(block, kind="stable")
        running = np.cumsum(held[row[used]] * sign[used, None], axis=0)
        question = np.flatnonzero(asks[used])
        first = np.searchsorted(block, block[question], side="left")
        answer = running[question]
        inside = first > 0
        answer[inside] -= running[first[inside] - 1]
        total[row[used[question]]] += answer
    return total
