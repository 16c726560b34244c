"""Queries for the queue-state features."""

from __future__ import annotations


from queuescope.operators.dominance import add_queue_rank, add_queued
from queuescope.operators.intervals import REMAINING, add_active
from queuescope.plans import features
from registry.cleaning import JOB_COLUMNS, timeless
from registry.tables import CTE_JOBS, clean_jobs

COUNTS = ["count_small_jobs", "count_medium_jobs", "count_large_jobs"]
RESOURCES = ["elapsed_seconds", "timelimit_seconds", "cpu", "mem", "node", "gpu"]


def q0_features(spark, sf_dir):
    return timeless(features.add_features(clean_jobs(spark, sf_dir)))


def q1_size_flags(spark, sf_dir):
    jobs = features.add_size_flags(clean_jobs(spark, sf_dir), features.size_column())
    return jobs.select("job_id", *features.SIZE_FLAGS)


def q2_active(spark, sf_dir):
    jobs = add_active(clean_jobs(spark, sf_dir), ["allocated_mem", "allocated_cpu"], keys=["partition"])
    return jobs.select("job_id", "partition", "active_mem", "active_cpu")


def q3_active_counts(spark, sf_dir):
    jobs = features.add_size_flags(clean_jobs(spark, sf_dir), features.size_column())
    columns = [c for c in jobs.columns if c.startswith("allocated_")]
    jobs = add_active(jobs, columns, keys=["partition"])
    return jobs.select("job_id", *[f"active_{c.removeprefix('allocated_')}" for c in columns])


def q4_remaining(spark, sf_dir):
    jobs = add_active(clean_jobs(spark, sf_dir), [], keys=["partition"], remaining=REMAINING)
    return jobs.select("job_id", *REMAINING.values())


def q5_queued(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir).select(
        "job_id", "partition", "priority", "submit_ts", "eligible_start_ts", "start_ts", "allocated_mem",
        "allocated_cpu",
    )
    jobs = add_queued(jobs, keys=["partition"], tie_break=["job_id"])
    return jobs.select("job_id", "partition", "queued_mem", "queued_cpu")


def q5_queued_small_chunks(spark, sf_dir):
    """The same sums with ranks cut into chunks of 256, so that most of the answer comes from the block sweep."""
    jobs = clean_jobs(spark, sf_dir).select(
        "job_id", "partition", "priority", "submit_ts", "eligible_start_ts", "start_ts", "allocated_mem",
        "allocated_cpu",
    )
    jobs = add_queued(jobs, keys=["partition"], tie_break=["job_id"], chunk_bits=8)
    return jobs.select("job_id", "partition", "queued_mem", "queued_cpu")


def q5a_queue_rank(spark, sf_dir):
    jobs = add_queue_rank(clean_jobs(spark, sf_dir), keys=["partition"], tie_break=["job_id"])
    return jobs.select("job_id", "partition", "queue_rank")


def q6_reservation(spark, sf_dir):
    return features.add_reservation_flag(clean_jobs(spark, sf_dir)).select("job_id", "reservation_flag")


def q7_chained(spark, sf_dir):
    return features.add_chained_flag(clean_jobs(spark, sf_dir)).select("job_id", "chained_flag")


TEMPORAL = ["month", "year", "hour", "day", "day_flag", "night_flag", "day_of_week", "weekend_flag"]


def q8_temporal(spark, sf_dir):
    return features.add_temporal(clean_jobs(spark, sf_dir)).select("job_id", *TEMPORAL)


def q9_usage_7d(spark, sf_dir):
    return features.add_usage(clean_jobs(spark, sf_dir)).select("job_id", *features.USAGE.values())


QUERIES = {
    f.__name__: f
    for f in [
        q0_features, q1_size_flags, q2_active, q3_active_counts, q4_remaining, q5_queued, q5_queued_small_chunks,
        q5a_queue_rank, q6_reservation, q7_chained, q8_temporal, q9_usage_7d,
    ]
}

_SIZED = f"""{CTE_JOBS},
sized AS (SELECT *, CASE WHEN partition IN ('standard', 'standard-g') THEN allocated_node ELSE allocated_cpu END AS size
          FROM jobs),
placed AS (SELECT partition, size, row_number() OVER (PARTITION BY partition ORDER BY size) - 1 AS r,
                  count(*) OVER (PARTITION BY partition) AS n FROM sized),
edges AS (SELECT partition, max(size) FILTER (WHERE r = floor((n - 1) * 0.5 + 0.5)) AS q50,
                 max(size) FILTER (WHERE r = floor((n - 1) * 0.8 + 0.5)) AS q80 FROM placed GROUP BY partition),
flagged AS (SELECT sized.*, (size < q50)::TINYINT AS allocated_count_small_jobs,
                   (size BETWEEN q50 AND q80)::TINYINT AS allocated_count_medium_jobs,
                   (size > q80)::TINYINT AS allocated_count_large_jobs
            FROM sized JOIN edges USING (partition))"""
_RUNS = "i.job_id <> j.job_id AND i.s <= j.t AND j.t < {end}"
_WAITS = """i.t <= j.t AND j.t < i.s AND (i.priority > j.priority
  OR i.priority = j.priority AND (i.submit_s < j.submit_s OR i.submit_s = j.submit_s AND i.job_id < j.job_id))"""
_INTEGER = {"elapsed_seconds", "timelimit_seconds", *COUNTS}


def _active(resource: str) -> str:
    kind = "BIGINT" if resource in _INTEGER else "DOUBLE"
    when = _RUNS.format(end="i.e")
    return f"sum(CASE WHEN {when} THEN i.allocated_{resource} ELSE 0 END)::{kind} AS active_{resource}"


def _queued(resource: str) -> str:
    return f"sum(CASE WHEN {_WAITS} THEN i.allocated_{resource} ELSE 0 END)::DOUBLE AS queued_{resource}"


def _remaining(duration: str) -> str:
    end = f"least(i.e, i.s + i.allocated_{duration})"
    when = _RUNS.format(end=end)
    return f"sum(CASE WHEN {when} THEN {end} - j.t ELSE 0 END)::BIGINT AS active_{duration}_remaining"


def _pairs(columns: list[str], cte: str = _SIZED, rows: str = "flagged", extra: str = "") -> str:
    return f"""{cte}, answers AS (SELECT j.job_id, {", ".join(columns)} FROM {rows} j JOIN {rows} i
      ON i.partition = j.partition GROUP BY j.job_id) SELECT * FROM answers{extra}"""


_FLAGS = ", ".join(f"allocated_{c}" for c in COUNTS)
_TEMPORAL = """month(x)::TINYINT AS month, year(x)::SMALLINT AS year, hour(x)::TINYINT AS hour,
  day(x)::TINYINT AS day, (hour(x) BETWEEN 6 AND 17)::TINYINT AS day_flag,
  (hour(x) < 6 OR hour(x) >= 18)::TINYINT AS night_flag, isodow(x)::TINYINT AS day_of_week,
  (isodow(x) IN (6, 7))::TINYINT AS weekend_flag""".replace("(x)", "(eligible_start_ts)")


def _usage(who: str, out: str) -> str:
    return f"""count(*) OVER (PARTITION BY partition, {who} ORDER BY submit_s
      RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)::INT AS {out}"""


_USAGE = ", ".join(_usage(w, o) for w, o in features.USAGE.items())
_RESERVATION = "CASE WHEN reservation_id > 0 THEN 1 ELSE 0 END::INT AS reservation_flag"
_CHAINED = "CASE WHEN t - submit_s > 5 THEN 1 ELSE 0 END::INT AS chained_flag"

SQL = {
    "q0_features": f"""{_SIZED}, answers AS (SELECT j.job_id,
        {", ".join([_active(r) for r in RESOURCES + COUNTS] + [_queued(r) for r in RESOURCES + COUNTS]
                   + [_remaining("timelimit_seconds"), _remaining("elapsed_seconds")])}
        FROM flagged j JOIN flagged i ON i.partition = j.partition GROUP BY j.job_id),
      plain AS (SELECT {JOB_COLUMNS}, {_RESERVATION}, {_CHAINED}, {_TEMPORAL}, {_USAGE} FROM flagged)
      SELECT * FROM plain JOIN answers USING (job_id)""",
    "q1_size_flags": f"{_SIZED} SELECT job_id, {_FLAGS} FROM flagged",
    "q2_active": f"""{CTE_JOBS} SELECT j.job_id, any_value(j.partition) AS partition, {_active("mem")},
        {_active("cpu")} FROM jobs j JOIN jobs i ON i.partition = j.partition GROUP BY j.job_id""",
    "q3_active_counts": _pairs([_active(r) for r in RESOURCES + COUNTS]),
    "q4_remaining": _pairs([_remaining("timelimit_seconds"), _remaining("elapsed_seconds")], CTE_JOBS, "jobs"),
    "q5_queued": f"""{CTE_JOBS} SELECT j.job_id, any_value(j.partition) AS partition, {_queued("mem")},
        {_queued("cpu")} FROM jobs j JOIN jobs i ON i.partition = j.partition GROUP BY j.job_id""",
    "q5a_queue_rank": f"""{CTE_JOBS} SELECT job_id, partition, row_number() OVER (PARTITION BY partition
        ORDER BY priority DESC, submit_s, job_id) - 1 AS queue_rank FROM jobs""",
    "q6_reservation": f"{CTE_JOBS} SELECT job_id, {_RESERVATION} FROM jobs",
    "q7_chained": f"{CTE_JOBS} SELECT job_id, {_CHAINED} FROM jobs",
    "q8_temporal": f"{CTE_JOBS} SELECT job_id, {_TEMPORAL} FROM jobs",
    "q9_usage_7d": f"{CTE_JOBS} SELECT job_id, {_USAGE} FROM jobs",
}
SQL["q5_queued_small_chunks"] = SQL["q5_queued"]
