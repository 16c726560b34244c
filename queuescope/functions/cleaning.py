"""From raw accounting rows to clean job rows: projection, filters, calendar keys and the wait-time target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.functions import resources
from queuescope.functions.scalars import edge_bin

# Raw column -> clean column.
COLUMN_NAMES = {
    "Account": "account_id",
    "UID": "user_id",
    "ReservationId": "reservation_id",
    "JobIDRaw": "job_id",
    "Priority": "priority",
    "Partition": "partition",
    "State": "state",
    "Submit": "submit_ts",
    "Eligible": "eligible_start_ts",
    "Start": "start_ts",
    "End": "end_ts",
    "ElapsedRaw": "allocated_elapsed_seconds",
    "TimelimitRaw": "timelimit_minutes",
    "AllocTRES": "allocated_resources",
}

# Queues in scope.
QUEUES = ["small", "small-g", "standard", "standard-g", "largemem", "lumid"]

# Clean columns that must not be null.
REQUIRED = [
    "submit_ts",
    "eligible_start_ts",
    "start_ts",
    "end_ts",
    "state",
    "priority",
    "timelimit_minutes",
    "allocated_resources",
]

# Lower edges, in minutes, of wait-time classes 1 to 9.
WAIT_EDGES = [5, 15, 30, 60, 120, 240, 480, 960, 1920]


def select_renamed(df: DataFrame, names: Mapping[str, str] = COLUMN_NAMES) -> DataFrame:
    return df.select(*[F.col(raw).alias(clean) for raw, clean in names.items()])


def parse_input(
    df: DataFrame,
    names: Mapping[str, str] = COLUMN_NAMES,
    required: Sequence[str] = REQUIRED,
    queues: Sequence[str] = QUEUES,
    distinct: bool = True,
) -> DataFrame:
    """Project and rename, keep known queues and complete rows, drop exact duplicates.

    The filters come first so that they reach the scan and shrink the shuffle of the distinct.
    """
    rows = (
        select_renamed(df, names)
        .where(F.col("partition").isin(*queues))
        .na.drop(subset=[names.get(c, c) for c in required])
    )
    return rows.dropDuplicates() if distinct else rows


def handle_cancellations(df: DataFrame) -> DataFrame:
    """``CANCELLED by <uid>`` and other spellings become ``CANCELLED``."""
    state = F.col("state")
    return df.withColumn("state", F.when(state.startswith("CANC"), "CANCELLED").otherwise(state))


def add_calendar_keys(df: DataFrame, ts: str = "start_ts") -> DataFrame:
    year, month, day = F.year(ts), F.month(ts), F.dayofmonth(ts)
    return df.withColumns(
        {
            "year_month": F.date_format(ts, "yyyy-MM"),
            "year_month_id": year * 100 + month,
            "year_id": year,
            "day_id": year * 10000 + month * 100 + day,
            "allocated_timelimit_seconds": F.col("timelimit_minutes") * 60,
        }
    )


def add_target(df: DataFrame, eligible: str = "eligible_start_ts", start: str = "start_ts") -> DataFrame:
    """Wait in seconds (rows with a negative wait are dropped), in minutes (half to even) and as a class."""
    waited = F.timestamp_diff("SECOND", F.col(eligible), F.col(start))
    return (
        df.withColumn("wait_time_seconds", waited)
        .where(F.col("wait_time_seconds") >= 0)
        .withColumns(
            {
                "wait_time_minutes": F.bround(F.col("wait_time_seconds") / 60, 0).cast("bigint"),
                "wait_time_bin": edge_bin("wait_time_seconds", [60 * m for m in WAIT_EDGES]),
            }
        )
    )


def fill_empty_allocations(df: DataFrame, value: float = 1, prefix: str = "allocated_") -> DataFrame:
    """Null and NaN become ``value`` in every ``allocated_*`` column; ``consumed_*`` columns stay as they are."""
    return df.na.fill(value, subset=[c for c in df.columns if c.startswith(prefix)])


def preprocess(
    df: DataFrame,
    *,
    resource_keys: Sequence[str] | None = None,
    queues: Sequence[str] = QUEUES,
    strict: bool = True,
    ignore_other_keys: bool = False,
) -> DataFrame:
    """All cleaning steps. One job looks up the resource keys of the rows that stay; each gets a column.

    Given ``resource_keys``, that job checks that no other key occurs; ``ignore_other_keys`` leaves it out, and the columns
    of any other key with it.
    """
    if not (resource_keys and ignore_other_keys):
        staying = add_target(parse_input(df, queues=queues, distinct=False))
        if resource_keys is None:
            resource_keys = resources.all_keys(staying)
        else:
            resources.check_keys(staying, resource_keys)
    return (
        df.transform(parse_input, queues=queues)
        .transform(handle_cancellations)
        .transform(add_calendar_keys)
        .transform(add_target)
        .transform(resources.unpack, keys=resource_keys, strict=strict)
        .transform(fill_empty_allocations)
    )


def at_least_minutes(df: DataFrame, minutes: int) -> DataFrame:
    """Keep jobs that waited at least ``minutes``. Apply it after the features: they need every job."""
    return df.where(F.col("wait_time_minutes") >= minutes) if minutes > 0 else df
