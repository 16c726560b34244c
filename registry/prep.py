"""Queries for training-set preparation on the cleaned jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuescope.functions.scalars import clip
from queuescope.plans import prep
from queuescope.plans.feature_sets import FEATURE_SETS
from queuescope.plans.training import add_folds
from registry.tables import CTE_JOBS, clean_jobs

X = ["allocated_cpu", "allocated_mem", "allocated_node", "allocated_timelimit_seconds", "priority", "constant"]


def m0_feature_sets(spark, sf_dir):
    """Which cleaned columns each queue's feature sets use, from the jobs' own queues."""
    present = clean_jobs(spark, sf_dir).select("partition").distinct()
    names = F.create_map(
        *[x for q, sets in FEATURE_SETS.items()
          for x in (F.lit(q), F.array(*[F.struct(F.lit(s).alias("feature_set"), F.lit(len(c)).alias("features"))
                                        for s, c in sets.items()]))]
    )
    return present.select("partition", F.inline(names[F.col("partition")]))


def _weights(method):
    def query(spark, sf_dir):
        jobs = prep.add_sample_weights(clean_jobs(spark, sf_dir), "wait_time_seconds", method, ["partition"])
        return jobs.select("job_id", F.round("weight", 6).alias("weight"))

    return query


def m2_log(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir).select(
        "job_id", "wait_time_seconds", F.col("allocated_cpu").alias("active_cpu"),
        F.col("allocated_mem").alias("queued_mem"),
    )
    logged = prep.log_transform(jobs, "all_variables", ["wait_time_seconds"])
    back = prep.log_transform(logged, "only_target", ["wait_time_seconds"], inverse=True)
    return logged.select(
        "job_id", *[F.round(c, 6).alias(c) for c in ("wait_time_seconds", "active_cpu", "queued_mem")]
    ).join(back.select("job_id", F.round("wait_time_seconds", 4).alias("back")), "job_id")


def m3_clip(spark, sf_dir):
    jobs = prep.adjust_target(clean_jobs(spark, sf_dir), "wait_time_seconds", 60, 100_000)
    return jobs.select("job_id", "wait_time_seconds", clip("reservation_id", 10, 50).alias("limited"))


def m4_bins(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir)
    simple = prep.bin_target(jobs, "simple").select("job_id", F.col("wait_time_bin").alias("simple"))
    return simple.join(
        prep.bin_target(jobs, "binary").select("job_id", F.col("wait_time_bin").alias("is_long")), "job_id"
    )


def m5_random_split(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir).select("job_id", "partition")
    return prep.add_split(jobs, 0.2, "random", ["partition"]).drop("partition")


def m6_time_split(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir).select("job_id", "partition", "start_ts")
    return prep.add_split(jobs, 0.4, "timeseries", ["partition"]).select(
        "job_id", "is_test", "split_row", "split_rows"
    )


def m7_fscore(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir).withColumn("constant", F.lit(1))
    scores = prep.feature_scores(jobs, "wait_time_seconds", X, 3, ["partition"])
    return scores.select("partition", "feature", F.round("score", 6).alias("score"), "selected")


def m8_scale(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir).select("job_id", "wait_time_seconds", "allocated_cpu")
    scaler = prep.fit_scaler(jobs, prep.scaled_columns("all_variables", "wait_time_seconds", ["allocated_cpu"]))
    scaled = prep.scale(jobs, scaler).withColumn("back", F.col("wait_time_seconds"))
    scaled = prep.unscale(scaled, scaler, {"back": "wait_time_seconds"})
    return scaled.select(
        "job_id", *[F.round(c, 6).alias(c) for c in ("wait_time_seconds", "allocated_cpu", "back")]
    )


def _folded(strategy, label=None):
    def query(spark, sf_dir):
        jobs = prep.bin_target(clean_jobs(spark, sf_dir), "simple").select("job_id", "start_ts", "wait_time_bin")
        train = prep.add_split(jobs, 0.2, "timeseries").where("NOT is_test")
        return add_folds(train, 5, strategy, label).select("job_id", "split_row", "fold")

    return query


QUERIES = {
    f.__name__: f
    for f in [m0_feature_sets, m2_log, m3_clip, m4_bins, m5_random_split, m6_time_split, m7_fscore, m8_scale]
} | {
    "m1_weights_linear": _weights("linear"),
    "m1_weights_rank": _weights("rank"),
    "m1_weights_aggressive": _weights("aggressive"),
    "l8_folds": _folded("kfold"),
    "l8_folds_by_class": _folded("kfold", "wait_time_bin"),
    "l8_folds_by_time": _folded("timeseries"),
}

_RANKED = f"""{CTE_JOBS}, ranked AS (SELECT job_id, partition, wait_time_seconds AS y,
    rank() OVER (PARTITION BY partition ORDER BY wait_time_seconds)
      + (count(*) OVER (PARTITION BY partition, wait_time_seconds) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY partition) AS n, min(wait_time_seconds) OVER (PARTITION BY partition) AS lo,
    max(wait_time_seconds) OVER (PARTITION BY partition) AS hi FROM jobs)"""


def _weight_sql(raw: str) -> str:
    return f"""{_RANKED}, raw_weights AS (SELECT job_id, partition, ({raw})::DOUBLE AS w FROM ranked)
      SELECT job_id, round(w / avg(w) OVER (PARTITION BY partition), 6) AS weight FROM raw_weights"""


_SIMPLE = """CASE WHEN wait_time_minutes < 15 THEN 0 WHEN wait_time_minutes < 60 THEN 1 WHEN wait_time_minutes < 120
  THEN 2 WHEN wait_time_minutes < 240 THEN 3 WHEN wait_time_minutes < 480 THEN 4 ELSE 5 END"""
_SETS = {q: {s: len(c) for s, c in sets.items()} for q, sets in FEATURE_SETS.items()}
_TRAIN = f"""{CTE_JOBS}, numbered AS (SELECT job_id, {_SIMPLE} AS class,
    row_number() OVER (ORDER BY s, job_id) - 1 AS r, count(*) OVER () AS n FROM jobs),
  train AS (SELECT job_id, class, r AS split_row, floor(n * (1 - 0.2))::BIGINT AS size FROM numbered
            WHERE r < floor(n * (1 - 0.2)))"""


def _kfold(place: str, size: str) -> str:
    base, more = f"({size} // 5)", f"({size} % 5)"
    return f"""CASE WHEN {place} < {more} * ({base} + 1) THEN {place} // ({base} + 1)
      ELSE {more} + ({place} - {more} * ({base} + 1)) // greatest({base}, 1) END::INT AS fold"""


def _score(x: str) -> str:
    r2 = f"pow(corr({x}, wait_time_seconds), 2)"
    return f"""SELECT partition, '{x}' AS feature, CASE WHEN stddev_pop({x}) = 0 THEN 0
      ELSE {r2} / (1 - {r2}) * (count(*) - 2) END AS score FROM data GROUP BY partition"""


SQL = {
    "m0_feature_sets": f"{CTE_JOBS} SELECT DISTINCT partition, feature_set, features::INT AS features FROM jobs JOIN (VALUES "
    + ", ".join(f"('{q}', '{s}', {n})" for q, sets in _SETS.items() for s, n in sets.items())
    + ") v(q, feature_set, features) ON q = partition",
    "m1_weights_linear": _weight_sql("1 + (y - lo) / (hi - lo)"),
    "m1_weights_rank": _weight_sql("0.5 + r / n"),
    "m1_weights_aggressive": _weight_sql("exp(4.0 * (r - 1) / (n - 1))"),
    "m2_log": f"""{CTE_JOBS} SELECT job_id, round(ln(1 + wait_time_seconds), 6) AS wait_time_seconds,
        round(ln(1 + allocated_cpu), 6) AS active_cpu, round(ln(1 + allocated_mem), 6) AS queued_mem,
        wait_time_seconds::DOUBLE AS back FROM jobs""",
    "m3_clip": f"""{CTE_JOBS} SELECT job_id, greatest(least(wait_time_seconds, 100000), 60) AS wait_time_seconds,
        CASE WHEN reservation_id IS NOT NULL THEN greatest(least(reservation_id, 50), 10) END::INT AS limited
        FROM jobs""",
    "m4_bins": f"""{CTE_JOBS} SELECT job_id, ({_SIMPLE})::TINYINT AS simple,
        (wait_time_minutes >= 10)::TINYINT AS is_long FROM jobs""",
    "m5_random_split": f"""{CTE_JOBS}, numbered AS (SELECT job_id, row_number() OVER (PARTITION BY partition
          ORDER BY md5(concat(job_id, '_49')), job_id) - 1 AS r, count(*) OVER (PARTITION BY partition) AS n FROM jobs),
        cuts AS (SELECT *, ceil(n * 0.2)::BIGINT AS cut FROM numbered)
        SELECT job_id, r < cut AS is_test, CASE WHEN r < cut THEN r ELSE r - cut END AS split_row,
          CASE WHEN r < cut THEN cut ELSE n - cut END AS split_rows FROM cuts""",
    "m6_time_split": f"""{CTE_JOBS}, numbered AS (SELECT job_id, row_number() OVER (PARTITION BY partition
          ORDER BY s, job_id) - 1 AS r, count(*) OVER (PARTITION BY partition) AS n FROM jobs),
        cuts AS (SELECT *, floor(n * (1 - 0.4))::BIGINT AS cut FROM numbered)
        SELECT job_id, r >= cut AS is_test, CASE WHEN r < cut THEN r ELSE r - cut END AS split_row,
          CASE WHEN r < cut THEN cut ELSE n - cut END AS split_rows FROM cuts""",
    "m7_fscore": f"""{CTE_JOBS}, data AS (SELECT *, 1 AS constant FROM jobs),
        scores AS ({" UNION ALL ".join(_score(x) for x in X)})
        SELECT partition, feature, round(score, 6) AS score,
          row_number() OVER (PARTITION BY partition ORDER BY score DESC, feature) <= 3 AS selected FROM scores""",
    "m8_scale": f"""{CTE_JOBS}, stats AS (SELECT avg(wait_time_seconds) AS m, stddev_pop(wait_time_seconds) AS d,
          avg(allocated_cpu) AS cm, stddev_pop(allocated_cpu) AS cd FROM jobs)
        SELECT job_id, round((wait_time_seconds - m) / d, 6) AS wait_time_seconds,
          round((allocated_cpu - cm) / cd, 6) AS allocated_cpu, wait_time_seconds::DOUBLE AS back FROM jobs, stats""",
    "l8_folds": f"{_TRAIN} SELECT job_id, split_row, {_kfold('split_row', 'size')} FROM train",
    "l8_folds_by_class": f"""{_TRAIN}, placed AS (SELECT *, row_number() OVER (PARTITION BY class
        ORDER BY split_row) - 1 AS p, count(*) OVER (PARTITION BY class) AS c FROM train)
        SELECT job_id, split_row, {_kfold('p', 'c')} FROM placed""",
    "l8_folds_by_time": f"""{_TRAIN} SELECT job_id, split_row,
        greatest(floor((split_row - (size - 5 * (size // 6))) / (size // 6)::DOUBLE), -1)::INT AS fold FROM train""",
}
