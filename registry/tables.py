"""The supplied tables, and the raw job records derived from ``events``, in both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queuescope.functions.cleaning import preprocess
from queuescope.plans.features import add_features
from queuescope.session import configure, materialize, materialize_last

_written: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_QUEUE = """CASE event_type WHEN 'view' THEN 'small' WHEN 'click' THEN 'small-g' WHEN 'purchase' THEN 'standard'
                       WHEN 'signup' THEN 'standard-g' ELSE 'unknown' END"""
_RESOURCES = """concat('billing=', CAST(k AS STRING), ',cpu=', CAST(1 + k % 64 AS STRING),
              CASE k % 3 WHEN 0 THEN ',mem=2048M' WHEN 1 THEN ',mem=64G' ELSE ',mem=1T' END,
              CASE WHEN k % 11 = 0 THEN '' ELSE concat(',node=', CAST(1 + k % 8 AS STRING)) END,
              CASE WHEN event_type = 'click' THEN ',gres/gpu:mi250=8,gres/gpu=4' ELSE '' END)"""

_SPARK_RAW = f"""
WITH e AS (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS sub,
                  CAST(get_json_object(props, '$.k') AS INT) AS k, CAST(floor(value * 600) AS BIGINT) AS w
           FROM {{events}})
SELECT user_id % 10 AS Account, user_id AS UID, CASE WHEN k % 20 = 0 THEN k END AS ReservationId,
       event_id AS JobIDRaw, k AS Priority, {_QUEUE} AS `Partition`,
       CASE k % 5 WHEN 0 THEN concat('CANCELLED by ', CAST(user_id AS STRING)) WHEN 1 THEN 'FAILED'
                  ELSE 'COMPLETED' END AS State,
       sub AS Submit, timestampadd(SECOND, k % 10, sub) AS Eligible,
       CASE WHEN k % 25 = 3 THEN NULL
            ELSE timestampadd(SECOND, k % 10 + w - CASE WHEN k % 25 = 4 THEN 90000 ELSE 0 END, sub) END AS Start,
       timestampadd(SECOND, k % 10 + w + k * 600, sub) AS `End`,
       CAST(k * 600 AS BIGINT) AS ElapsedRaw, CAST((k % 7 + 1) * 60 AS BIGINT) AS TimelimitRaw,
       {_RESOURCES} AS AllocTRES
FROM e"""

_RAW_SQL = f"""
SELECT user_id % 10 AS "Account", user_id AS "UID", CASE WHEN k % 20 = 0 THEN k END AS "ReservationId",
       event_id AS "JobIDRaw", k AS "Priority", {_QUEUE} AS "Partition",
       CASE k % 5 WHEN 0 THEN concat('CANCELLED by ', CAST(user_id AS STRING)) WHEN 1 THEN 'FAILED'
                  ELSE 'COMPLETED' END AS "State",
       sub AS "Submit", sub + to_seconds(k % 10) AS "Eligible",
       CASE WHEN k % 25 = 3 THEN NULL
            ELSE sub + to_seconds(k % 10 + w - CASE WHEN k % 25 = 4 THEN 90000 ELSE 0 END) END AS "Start",
       sub + to_seconds(k % 10 + w + k * 600) AS "End",
       CAST(k * 600 AS BIGINT) AS "ElapsedRaw", CAST((k % 7 + 1) * 60 AS BIGINT) AS "TimelimitRaw",
       {_RESOURCES} AS "AllocTRES"
FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS sub,
             CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(value * 600) AS BIGINT) AS w
      FROM events)"""


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw job records as a Parquet table, derived from all of ``events`` once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        events = table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
        _written[key] = materialize(spark.sql(_SPARK_RAW, events=events))
    return _written[key]


# Cleaned jobs for the oracles. MATERIALIZED keeps the text small for the engine when it is used several times.
CTE_RAW = f"WITH raw AS MATERIALIZED ({_RAW_SQL}\n)"


def _entry(key: str) -> str:
    name = "gres[^,=]*" if key == "gpu" else key
    text = f"nullif(regexp_extract(\"AllocTRES\", '(?:^|,){name}=([^,]*)', 1), '')"
    number = f"CAST(rtrim({text}, 'GMT') AS DOUBLE)"
    return (
        f"CASE WHEN ends_with({text}, 'T') THEN {number} * 1024 WHEN ends_with({text}, 'M') THEN {number} / 1024 "
        f"ELSE {number} END"
    )


ENTRY_SQL = {k: _entry(k) for k in ["billing", "cpu", "energy", "gpu", "mem", "node"]}

CTE_JOBS = f"""{CTE_RAW},
jobs AS MATERIALIZED (
  SELECT *, (wait_time_seconds >= 300)::INT + (wait_time_seconds >= 900)::INT + (wait_time_seconds >= 1800)::INT
         + (wait_time_seconds >= 3600)::INT + (wait_time_seconds >= 7200)::INT + (wait_time_seconds >= 14400)::INT
         + (wait_time_seconds >= 28800)::INT + (wait_time_seconds >= 57600)::INT
         + (wait_time_seconds >= 115200)::INT AS wait_time_bin,
       CAST(round_even(wait_time_seconds / 60, 0) AS BIGINT) AS wait_time_minutes
  FROM (
    SELECT "Account" AS account_id, "UID" AS user_id, "ReservationId" AS reservation_id, "JobIDRaw" AS job_id,
           "Priority" AS priority, "Partition" AS partition,
           CASE WHEN starts_with("State", 'CANC') THEN 'CANCELLED' ELSE "State" END AS state,
           "Submit" AS submit_ts, "Eligible" AS eligible_start_ts, "Start" AS start_ts, "End" AS end_ts,
           epoch("Submit")::BIGINT AS submit_s, epoch("Eligible")::BIGINT AS t, epoch("Start")::BIGINT AS s,
           epoch("End")::BIGINT AS e, coalesce("ElapsedRaw", 1) AS allocated_elapsed_seconds,
           "TimelimitRaw" AS timelimit_minutes, coalesce("TimelimitRaw" * 60, 1) AS allocated_timelimit_seconds,
           strftime("Start", '%Y-%m') AS year_month, CAST(strftime("Start", '%Y%m') AS INT) AS year_month_id,
           year("Start")::INT AS year_id, CAST(strftime("Start", '%Y%m%d') AS INT) AS day_id,
           epoch("Start")::BIGINT - epoch("Eligible")::BIGINT AS wait_time_seconds,
           {ENTRY_SQL["billing"]} AS consumed_billing, {ENTRY_SQL["energy"]} AS consumed_energy,
           coalesce({ENTRY_SQL["cpu"]}, 1) AS allocated_cpu, coalesce({ENTRY_SQL["mem"]}, 1) AS allocated_mem,
           coalesce({ENTRY_SQL["node"]}, 1) AS allocated_node, coalesce({ENTRY_SQL["gpu"]}, 1) AS allocated_gpu
    FROM (SELECT DISTINCT * FROM raw)
    WHERE "Partition" IN ('small', 'small-g', 'standard', 'standard-g', 'largemem', 'lumid')
      AND "Submit" IS NOT NULL AND "Eligible" IS NOT NULL AND "Start" IS NOT NULL AND "End" IS NOT NULL
      AND "State" IS NOT NULL AND "Priority" IS NOT NULL AND "TimelimitRaw" IS NOT NULL
      AND "AllocTRES" IS NOT NULL)
  WHERE wait_time_seconds >= 0)"""


def clean_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess(raw_jobs(spark, sf_dir))


def feature_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table of all queues, written once per session and scale for the model queries."""
    key = (spark.sparkContext.applicationId, sf_dir + "#features")
    if key not in _written:
        jobs = clean_jobs(spark, sf_dir)  # the raw records are written out here, as other queries read them too
        _written[key] = materialize_last(lambda: add_features(jobs))
    return _written[key]
