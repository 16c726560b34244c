"""Queries for scans, cleaning and resource columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuescope.functions import cleaning, resources
from queuescope.functions.scalars import edge_bin, name_part
from queuescope.operators.running import row_numbers
from queuescope.plans.prep import sample_fraction
from queuescope.sources.datasets import jobs_from, select_queues
from registry.tables import CTE_JOBS, CTE_RAW, ENTRY_SQL, clean_jobs, raw_jobs, table


def seconds(column: str, name: str):
    return F.unix_seconds(column).alias(name)


TIMES = {"submit_ts": "submit_s", "eligible_start_ts": "t", "start_ts": "s", "end_ts": "e"}


def timeless(df):
    """Timestamps as epoch seconds, so both engines return the same type."""
    present = {c: n for c, n in TIMES.items() if c in df.columns}
    return df.select(*[c for c in df.columns if c not in present], *[seconds(c, n) for c, n in present.items()])


RENAMED_SQL = """SELECT "Account" AS account_id, "UID" AS user_id, "ReservationId" AS reservation_id,
  "JobIDRaw" AS job_id, "Priority" AS priority, "Partition" AS partition, "State" AS state,
  "ElapsedRaw" AS allocated_elapsed_seconds, "TimelimitRaw" AS timelimit_minutes,
  "AllocTRES" AS allocated_resources, epoch("Submit")::BIGINT AS submit_s, epoch("Eligible")::BIGINT AS t,
  epoch("Start")::BIGINT AS s, epoch("End")::BIGINT AS e FROM raw"""
QUEUES_SQL = "partition IN ('small', 'small-g', 'standard', 'standard-g', 'largemem', 'lumid')"
COMPLETE_SQL = " AND ".join(
    f"{c} IS NOT NULL"
    for c in ["submit_s", "t", "s", "e", "state", "priority", "timelimit_minutes", "allocated_resources"]
)
JOB_COLUMNS = """account_id, user_id, reservation_id, job_id, priority, partition, state, submit_s, t, s, e,
  allocated_elapsed_seconds, timelimit_minutes, year_month, year_month_id, year_id, day_id,
  allocated_timelimit_seconds, wait_time_seconds, wait_time_minutes, wait_time_bin::TINYINT AS wait_time_bin,
  consumed_billing, consumed_energy, allocated_cpu, allocated_mem, allocated_node, allocated_gpu"""


def s1_scan(spark, sf_dir):
    raw = jobs_from(raw_jobs(spark, sf_dir), "all", "raw")
    return raw.select("JobIDRaw", "Partition", "State", "TimelimitRaw", "AllocTRES")


def s2_queue_scan(spark, sf_dir):
    return timeless(cleaning.select_renamed(select_queues(raw_jobs(spark, sf_dir), "small")))


def s3_sample(spark, sf_dir):
    return sample_fraction(raw_jobs(spark, sf_dir), 0.2, ["Partition"]).select("JobIDRaw", "Partition")


def s4_level(spark, sf_dir):
    return timeless(jobs_from(raw_jobs(spark, sf_dir), ["small", "small-g", "standard", "standard-g"], "preprocess"))


def c0_preprocess(spark, sf_dir):
    return timeless(clean_jobs(spark, sf_dir))


def c1_project(spark, sf_dir):
    return timeless(cleaning.select_renamed(raw_jobs(spark, sf_dir)))


def c2_distinct(spark, sf_dir):
    raw = raw_jobs(spark, sf_dir)
    return timeless(cleaning.select_renamed(raw.unionByName(raw)).dropDuplicates())


def c3_known_queues(spark, sf_dir):
    renamed = cleaning.select_renamed(raw_jobs(spark, sf_dir))
    return timeless(renamed.where(F.col("partition").isin(*cleaning.QUEUES)))


def c4_not_null(spark, sf_dir):
    return timeless(cleaning.parse_input(raw_jobs(spark, sf_dir)))


def c5_submit_order(spark, sf_dir):
    """The submit order as a column: a sorted frame has no lasting order, a row number has."""
    jobs = cleaning.parse_input(raw_jobs(spark, sf_dir)).select("job_id", "submit_ts")
    return row_numbers(jobs, [], ["submit_ts", "job_id"], "place").select("job_id", "place")


def c6_state(spark, sf_dir):
    return cleaning.handle_cancellations(cleaning.select_renamed(raw_jobs(spark, sf_dir))).select("job_id", "state")


def c7_calendar(spark, sf_dir):
    keyed = cleaning.add_calendar_keys(cleaning.select_renamed(raw_jobs(spark, sf_dir)))
    return keyed.select("job_id", "year_month", "year_month_id", "year_id", "day_id")


def c8_timelimit(spark, sf_dir):
    keyed = cleaning.add_calendar_keys(cleaning.select_renamed(raw_jobs(spark, sf_dir)))
    return keyed.select("job_id", "allocated_timelimit_seconds")


def _waits(*columns):
    def query(spark, sf_dir):
        return cleaning.add_target(cleaning.parse_input(raw_jobs(spark, sf_dir))).select("job_id", *columns)

    return query


def c12_fill(spark, sf_dir):
    unpacked = resources.unpack(cleaning.select_renamed(raw_jobs(spark, sf_dir)))
    filled = cleaning.fill_empty_allocations(unpacked)
    return filled.select("job_id", "allocated_node", "allocated_gpu", "consumed_energy", "allocated_elapsed_seconds")


def c13_min_wait(spark, sf_dir):
    return cleaning.at_least_minutes(clean_jobs(spark, sf_dir), 10).select("job_id", "wait_time_minutes")


def r1_entries(spark, sf_dir):
    slim = cleaning.select_renamed(raw_jobs(spark, sf_dir)).select("job_id", "allocated_resources")
    return resources.entries(slim)


def r6_keys(spark, sf_dir):
    return resources.keys_in(cleaning.select_renamed(raw_jobs(spark, sf_dir)))


def r7_unpack(spark, sf_dir):
    slim = cleaning.select_renamed(raw_jobs(spark, sf_dir)).select("job_id", "allocated_resources")
    return resources.unpack(slim)


def r7_pivot(spark, sf_dir):
    slim = cleaning.select_renamed(raw_jobs(spark, sf_dir)).select("job_id", "allocated_resources")
    return resources.pivot_entries(resources.entries(slim), ["job_id"])


def r7_discovered(spark, sf_dir):
    """Keys that were never declared, one with a slash, and an entry without a value."""
    more = "concat(allocated_resources, ',fs/disk=', priority, 'G', IF(priority % 2 = 0, ',license', ',license=3'))"
    slim = cleaning.select_renamed(raw_jobs(spark, sf_dir)).selectExpr("job_id", f"{more} AS allocated_resources")
    return resources.unpack(slim).select(
        "job_id", "allocated_cpu", "allocated_gpu", F.col("allocated_fs/disk").alias("disk"), "allocated_license"
    )


def f_scalars(spark, sf_dir):
    """The scalar functions of the reference on whole tables: text, rounding, limits, logarithms, nulls."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        name_part("o_orderpriority", 0, 2, "-").alias("rank_text"),
        F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("stripped"),
        F.rtrim("o_orderpriority", F.lit("GHMT")).alias("trimmed"),
        F.bround(F.floor(price) / 2, 0).alias("half_even"),
        F.greatest(F.least(price, F.lit(100000.0)), F.lit(5000.0)).alias("limited"),
        F.round(F.log1p(price), 6).alias("log_price"),
        F.round(F.expm1(price / 1000000), 6).alias("exp_price"),
        F.abs(price - 150000).alias("distance"),
        F.col("o_orderstatus").isin("O", "F").alias("settled"),
        price.between(1000, 90000).alias("mid_price"),
        edge_bin("o_totalprice", [1000, 50000, 100000]).alias("price_class"),
        F.unix_seconds(F.timestamp_add("DAY", F.lit(3), F.col("o_orderdate").cast("timestamp"))).alias("due"),
        F.date_format("o_orderdate", "yyyyMM").alias("year_month"),
        F.least(F.nullif("o_orderstatus", F.lit("O")), F.lit("P")).alias("least_known"),
        F.nullif("o_orderstatus", F.lit("O")).eqNullSafe(F.lit("F")).alias("same_status"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        s1_scan, s2_queue_scan, s3_sample, s4_level, c0_preprocess, c1_project, c2_distinct, c3_known_queues,
        c4_not_null, c5_submit_order, c6_state, c7_calendar, c8_timelimit, c12_fill, c13_min_wait, r1_entries, r6_keys, r7_unpack,
        r7_pivot, r7_discovered, f_scalars,
    ]
} | {
    "c9_target": _waits("wait_time_seconds"),
    "c10_minutes": _waits("wait_time_minutes"),
    "c11_wait_bin": _waits("wait_time_bin"),
}

_ENTRY_COLUMNS = ", ".join(
    f"{sql} AS {'consumed_' if k in ('billing', 'energy') else 'allocated_'}{k}" for k, sql in ENTRY_SQL.items()
)
_LONG = f"""{CTE_RAW},
long AS (SELECT "JobIDRaw" AS job_id, generate_subscripts(string_split("AllocTRES", ','), 1) - 1 AS place,
                unnest(string_split("AllocTRES", ',')) AS entry FROM raw),
cut AS (SELECT job_id, place, split_part(entry, '=', 1) AS k, substr(entry, strpos(entry, '=') + 1) AS v
        FROM long WHERE entry <> '')"""
_NUMBER = """CASE WHEN ends_with(v, 'T') THEN CAST(rtrim(v, 'GMT') AS DOUBLE) * 1024
     WHEN ends_with(v, 'M') THEN CAST(rtrim(v, 'GMT') AS DOUBLE) / 1024 ELSE CAST(rtrim(v, 'GMT') AS DOUBLE) END"""

SQL = {
    "s1_scan": f'{CTE_RAW} SELECT "JobIDRaw", "Partition", "State", "TimelimitRaw", "AllocTRES" FROM raw',
    "s2_queue_scan": f"{CTE_RAW} SELECT * FROM ({RENAMED_SQL}) WHERE partition = 'small'",
    "s3_sample": f"""{CTE_RAW} SELECT "JobIDRaw", "Partition" FROM (
        SELECT "JobIDRaw", "Partition", count(*) OVER (PARTITION BY "Partition") AS n,
               row_number() OVER (PARTITION BY "Partition" ORDER BY md5(concat("JobIDRaw", '_49')), "JobIDRaw") AS r
        FROM raw) WHERE r <= floor(n * 0.2)""",
    "s4_level": f"{CTE_JOBS} SELECT {JOB_COLUMNS} FROM jobs",
    "c0_preprocess": f"{CTE_JOBS} SELECT {JOB_COLUMNS} FROM jobs",
    "c1_project": f"{CTE_RAW} {RENAMED_SQL}",
    "c2_distinct": f"{CTE_RAW} SELECT DISTINCT * FROM (SELECT * FROM ({RENAMED_SQL}) UNION ALL ({RENAMED_SQL}))",
    "c3_known_queues": f"{CTE_RAW} SELECT * FROM ({RENAMED_SQL}) WHERE {QUEUES_SQL}",
    "c4_not_null": f"{CTE_RAW} SELECT DISTINCT * FROM ({RENAMED_SQL}) WHERE {QUEUES_SQL} AND {COMPLETE_SQL}",
    "c5_submit_order": f"""{CTE_RAW} SELECT job_id, row_number() OVER (ORDER BY submit_s, job_id) - 1 AS place
        FROM (SELECT DISTINCT * FROM ({RENAMED_SQL}) WHERE {QUEUES_SQL} AND {COMPLETE_SQL})""",
    "c6_state": f"""{CTE_RAW} SELECT "JobIDRaw" AS job_id,
        CASE WHEN "State" LIKE 'CANC%' THEN 'CANCELLED' ELSE "State" END AS state FROM raw""",
    "c7_calendar": f"""{CTE_RAW} SELECT "JobIDRaw" AS job_id, strftime("Start", '%Y-%m') AS year_month,
        CAST(strftime("Start", '%Y%m') AS INT) AS year_month_id, CAST(strftime("Start", '%Y') AS INT) AS year_id,
        CAST(strftime("Start", '%Y%m%d') AS INT) AS day_id FROM raw""",
    "c8_timelimit": f"""{CTE_RAW} SELECT "JobIDRaw" AS job_id,
        "TimelimitRaw" * 60 AS allocated_timelimit_seconds FROM raw""",
    "c9_target": f"{CTE_JOBS} SELECT job_id, wait_time_seconds FROM jobs",
    "c10_minutes": f"{CTE_JOBS} SELECT job_id, wait_time_minutes FROM jobs",
    "c11_wait_bin": f"{CTE_JOBS} SELECT job_id, wait_time_bin::TINYINT AS wait_time_bin FROM jobs",
    "c12_fill": f"""{CTE_RAW} SELECT "JobIDRaw" AS job_id, coalesce({ENTRY_SQL["node"]}, 1) AS allocated_node,
        coalesce({ENTRY_SQL["gpu"]}, 1) AS allocated_gpu, {ENTRY_SQL["energy"]} AS consumed_energy,
        coalesce("ElapsedRaw", 1) AS allocated_elapsed_seconds FROM raw""",
    "c13_min_wait": f"{CTE_JOBS} SELECT job_id, wait_time_minutes FROM jobs WHERE wait_time_minutes >= 10",
    "r1_entries": f"""{_LONG} SELECT job_id, place::INT AS place,
        CASE WHEN starts_with(k, 'gres') THEN 'gpu' ELSE k END AS key, {_NUMBER} AS value FROM cut""",
    "r6_keys": f"{_LONG} SELECT DISTINCT CASE WHEN starts_with(k, 'gres') THEN 'gpu' ELSE k END AS key FROM cut",
    "r7_unpack": f'{CTE_RAW} SELECT "JobIDRaw" AS job_id, {_ENTRY_COLUMNS} FROM raw',
    "r7_pivot": f"""{CTE_RAW} SELECT "JobIDRaw" AS job_id, {", ".join(f"{v} AS {k}" for k, v in ENTRY_SQL.items())}
        FROM raw""",
    "r7_discovered": f"""{CTE_RAW} SELECT "JobIDRaw" AS job_id, {ENTRY_SQL["cpu"]} AS allocated_cpu,
        {ENTRY_SQL["gpu"]} AS allocated_gpu, "Priority"::DOUBLE AS disk,
        CASE WHEN "Priority" % 2 = 1 THEN 3.0::DOUBLE END AS allocated_license FROM raw""",
    "f_scalars": """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank_text,
        regexp_replace(o_orderpriority, '^[0-9]-', '') AS stripped, rtrim(o_orderpriority, 'GHMT') AS trimmed,
        round_even(floor(o_totalprice) / 2, 0) AS half_even,
        greatest(least(o_totalprice, 100000.0), 5000.0)::DOUBLE AS limited, round(ln(1 + o_totalprice), 6) AS log_price,
        round(exp(o_totalprice / 1000000) - 1, 6) AS exp_price, abs(o_totalprice - 150000) AS distance,
        o_orderstatus IN ('O', 'F') AS settled, o_totalprice BETWEEN 1000 AND 90000 AS mid_price,
        CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice < 50000 THEN 1 WHEN o_totalprice < 100000 THEN 2
             ELSE 3 END::TINYINT AS price_class,
        epoch(o_orderdate + INTERVAL 3 DAY)::BIGINT AS due, strftime(o_orderdate, '%Y%m') AS year_month,
        least(nullif(o_orderstatus, 'O'), 'P') AS least_known,
        nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM 'F' AS same_status FROM orders""",
}
