"""State of the queue at the moment each job became eligible, for all queues in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope.operators.dominance import CHUNK_BITS, add_queue_rank
from queuescope.operators.intervals import REMAINING, add_rolling_count, rolling_counts
from queuescope.operators.queue_state import queue_state
from queuescope.operators.running import histogram_quantiles, join_matching
from queuescope.session import materialize, materialize_last

# Queues that hand out whole nodes; job size is counted in nodes there, in CPUs elsewhere.
NODE_QUEUES = ["standard", "standard-g"]
SIZE_FLAGS = [
    "allocated_count_small_jobs",
    "allocated_count_medium_jobs",
    "allocated_count_large_jobs",
]


def size_column(queue: str = "partition") -> Column:
    return F.when(F.col(queue).isin(*NODE_QUEUES), F.col("allocated_node")).otherwise(F.col("allocated_cpu"))


def add_size_flags(df: DataFrame, size: str | Column, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """Flag small (< median), medium and large (> 80 %) jobs by exact nearest quantiles per key."""
    sized = df.withColumn("_size", F.col(size) if isinstance(size, str) else size)
    edges = histogram_quantiles(sized, keys, "_size", {"_q50": 0.5, "_q80": 0.8}, "nearest")
    value, q50, q80 = F.col("_size"), F.col("_q50"), F.col("_q80")
    flags = [value < q50, value.between(q50, q80), value > q80]
    return (
        join_matching(sized, materialize(edges), keys, "left")  # one row per key
        .withColumns({name: flag.cast("tinyint") for name, flag in zip(SIZE_FLAGS, flags)})
        .drop("_size", "_q50", "_q80")
    )


def add_reservation_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("reservation_flag", F.when(F.col("reservation_id") > 0, 1).otherwise(0))


def add_chained_flag(df: DataFrame, seconds: int = 5) -> DataFrame:
    delay = F.timestamp_diff("SECOND", F.col("submit_ts"), F.col("eligible_start_ts"))
    return df.withColumn("chained_flag", F.when(delay > seconds, 1).otherwise(0))


def add_temporal(df: DataFrame, ts: str = "eligible_start_ts") -> DataFrame:
    hour, weekday = F.hour(ts), F.weekday(ts) + 1
    return df.withColumns(
        {
            "month": F.month(ts).cast("tinyint"),
            "year": F.year(ts).cast("smallint"),
            "hour": hour.cast("tinyint"),
            "day": F.dayofmonth(ts).cast("tinyint"),
            "day_flag": hour.between(6, 17).cast("tinyint"),
            "night_flag": ((hour < 6) | (hour >= 18)).cast("tinyint"),
            "day_of_week": weekday.cast("tinyint"),
            "weekend_flag": weekday.isin(6, 7).cast("tinyint"),
        }
    )


# Who submitted -> output column.
USAGE = {
    "user_id": "count_user_submitted_jobs_7d",
    "account_id": "count_account_submitted_jobs_7d",
}


def add_usage(
    df: DataFrame,
    keys: Sequence[str] = ("partition",),
    who: Mapping[str, str] = USAGE,
    days: int = 7,
) -> DataFrame:
    """Jobs the same user, and the same account, submitted to the queue in the days before."""
    for column, out in who.items():
        df = add_rolling_count(df, [*keys, column], "submit_ts", out, days=days)
    return df


def add_features(
    df: DataFrame,
    queue: str = "partition",
    *,
    tie_break: Sequence[str] = ("job_id",),
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """All features of cleaned jobs (see ``cleaning.preprocess``), computed per queue.

    The cleaned jobs are ranked and written once. What was running and what was queued come from one sweep of one event
    table, users and accounts from another. Each sweep's answers are written, so that its shuffle files go before the
    next one begins. The answers come together by queue and rank, which are unique.
    """
    resources = [c for c in df.columns if c.startswith("allocated_")] + SIZE_FLAGS
    place = [queue, "_queue_rank"]
    jobs = add_queue_rank(df, keys=[queue], tie_break=tie_break, out="_queue_rank")
    sized = add_size_flags(jobs, size_column(queue), [queue])
    recent = materialize(rolling_counts(jobs.select(*place, *USAGE, "submit_ts"), [queue], place, USAGE, "submit_ts"))
    state = materialize_last(lambda: queue_state(
        sized.select(*place, "eligible_start_ts", "start_ts", "end_ts", *resources), resources, keys=[queue],
        rank="_queue_rank", remaining=REMAINING, chunk_bits=chunk_bits,
    ))
    jobs = jobs.join(recent, place, "left").join(state, place)
    return (
        jobs.transform(add_reservation_flag).transform(add_chained_flag).transform(add_temporal).drop("_queue_rank")
    )
