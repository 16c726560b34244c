"""Queries on training, search and reports whose answers do not depend on what a model learns, so that SQL can state them."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from queuescope.plans import prep, reports, training
from queuescope.plans.metrics import REGRESSION_METRICS
from queuescope.plans.model_specs import ModelSpec
from queuescope.session import work_dir
from queuescope.sources import results
from registry import metrics
from registry.models import X, _given_scores, _trained
from registry.tables import CTE_JOBS, clean_jobs, feature_jobs

QUEUES = ["small", "small-g", "standard", "standard-g"]
REPEATS = 3


def l1_runs(spark, sf_dir):
    """What a run of all queues and two feature sets has left: its keys and metrics."""
    path, _, _ = _trained(spark, sf_dir)
    return results.read_table(spark, path, "accuracy", "first").select(*results.RUN_KEYS, "metric").distinct()


def s8_predictions(spark, sf_dir):
    """Held-out rows per queue and feature set, read back from the result tables."""
    path, _, _ = _trained(spark, sf_dir)
    return results.read_table(spark, path, "predictions", "first").groupBy("partition", "feature_set").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("n_jobs")
    )


def l9_expanding_rows(spark, sf_dir):
    """Rows every expanding fold trains and tests on."""
    jobs = clean_jobs(spark, sf_dir).select("job_id", "start_ts")
    train = training.add_folds(prep.add_split(jobs, 0.2, "timeseries").where("NOT is_test"), 5, "timeseries")
    parts = None
    for fold in range(5):
        for name, rows in zip(("rest", "held_out"), training.fold_parts(train, "timeseries", fold)):
            counted = rows.agg(F.lit(fold).alias("fold"), F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
            parts = counted if parts is None else parts.unionByName(counted)
    return parts


class FixedModel:
    """Predicts 2 a + b, whatever it is given."""

    def transform(self, df):
        x = vector_to_array("features")
        return df.withColumn("prediction", 2 * F.get(x, F.lit(0)) + F.get(x, F.lit(1)))


def l12_fixed_model(spark, sf_dir):
    """Drop of R2 of a fixed model when one feature comes from the rows of a repeatable shuffle."""
    jobs = clean_jobs(spark, sf_dir).selectExpr(
        "job_id", "CAST(priority AS DOUBLE) AS a", "allocated_cpu AS b", "CAST(timelimit_minutes AS DOUBLE) AS c",
        "CAST(2 * priority + allocated_cpu + timelimit_minutes / 10 AS DOUBLE) AS y",
    )
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(jobs)
    drops = training.permutation_importance(FixedModel(), rows, ["a", "b", "c"], "y", "regression", repeats=REPEATS)
    return drops.select("feature", F.round("value", 6).alias("value"))


def l456_held_out(spark, sf_dir):
    """Held-out jobs of a forest, of boosted trees (both six classes) and of a network (two): who, which class, valid."""
    jobs = feature_jobs(spark, sf_dir)
    x = X[:6]
    specs = {
        "rf": ModelSpec("rf", {"n_estimators": [2], "max_depth": [2]}, "classification", folds=2, upper=11),
        "xgb": ModelSpec("xgb", {"n_estimators": [2], "max_depth": [2]}, "classification", folds=2, upper=11),
        "mlp": ModelSpec("mlp", {"hidden_layer_sizes": [(4,)], "max_iter": [5], "learning_rate_init": [0.01]},
                         "classification", folds=2, upper=11, scaling="all_variables"),
    }
    out = None
    for family, spec in specs.items():
        bins = "binary" if family == "mlp" else "simple"
        run = training.predict(jobs, "wait_time_bin", x, spec, bins=bins)
        classes = len(prep.CLASS_EDGES[bins]) + 1
        rows = run.predictions.selectExpr(
            f"'{family}' AS family", "job_id", "CAST(y_true AS INT) AS y_true",
            f"y_pred >= 0 AND y_pred < {classes} AND y_pred = floor(y_pred) AS valid",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def l11_shares(spark, sf_dir):
    """Importances of a forest: one per feature, none negative, together one."""
    path, _, _ = _trained(spark, sf_dir)
    table = results.read_table(spark, path, "feature_importance", "first")
    return table.groupBy("partition", "feature_set").agg(
        F.round(F.sum("value"), 6).alias("total"), F.min(F.col("value") >= 0).alias("valid")
    )


def e12_given_scores(spark, sf_dir):
    """The cross-validation report of given scores."""
    scores = _given_scores(spark, sf_dir).selectExpr("'rf' AS model", "'full' AS feature_set", "*")
    return reports.cv_report(scores, "regression", folds=2).selectExpr(
        "partition", "model", "feature_set", "round", "param_depth", "round(mean_test_mae, 6) AS mean_test_mae",
        "round(mean_test_r2, 6) AS mean_test_r2", "rank_test_mae",
    )


def e15_written(spark, sf_dir):
    """Reports of given predictions, written, read back and counted."""
    path = f"{work_dir(spark)}/results-{uuid.uuid4().hex}"
    jobs = clean_jobs(spark, sf_dir)
    key = "'given' AS run_id"
    guesses = metrics.predictions(spark, sf_dir).where("partition <> 'unknown'")
    results.write_table(path, "predictions", guesses.selectExpr(key, "partition", "model", "feature_set", "job_id", "y_true", "y_pred"))
    results.write_table(path, "cv_scores", _given_scores(spark, sf_dir).selectExpr(key, "'run' AS model", "'full' AS feature_set", "*"))
    one = guesses.selectExpr(key, "partition", "model", "feature_set").distinct()
    results.write_table(path, "accuracy", one.selectExpr("*", "'rmse' AS metric", "1.0D AS value"))
    results.write_table(path, "feature_importance", one.selectExpr("*", "'a' AS feature", "1.0D AS value"))
    results.write_table(path, "feature_selection", one.selectExpr("*", "'a' AS feature", "1.0D AS score", "true AS selected"))
    made = reports.create_reports(spark, path, "given", jobs, QUEUES, "regression")
    results.write_reports(f"{path}/reports", made)
    total = None
    for name in made:
        counted = spark.read.parquet(f"{path}/reports/{name}").agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n"))
        total = counted if total is None else total.unionByName(counted)
    return total


QUERIES = {
    f.__name__: f
    for f in [l1_runs, s8_predictions, l9_expanding_rows, l12_fixed_model, l456_held_out, l11_shares, e12_given_scores, e15_written]
}

_SETS = "(VALUES ('baseline'), ('minimal')) t(feature_set)"
_MINE = f"WHERE partition IN ({', '.join(repr(q) for q in QUEUES)})"
_GIVEN = f"""{CTE_JOBS}, scores AS (
    SELECT partition, (priority // 50)::INT AS round, (priority % 3)::INT AS candidate, (job_id % 2)::INT AS fold,
           -avg(wait_time_minutes) AS v FROM jobs GROUP BY ALL),
  means AS (SELECT partition, round, candidate, avg(v) AS m FROM scores GROUP BY ALL)"""
_SWAPPED = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r} AS repeat, p.y, {guess} AS p FROM placed p JOIN placed d"
    f" ON d.place = (p.place + ({r + 1} * p.n) // {REPEATS + 1}) % p.n"
    for r in range(REPEATS)
    for f, guess in (("a", "2 * d.a + p.b"), ("b", "2 * p.a + d.b"), ("c", "2 * p.a + p.b"))
)
_R2 = "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))"
_LOG_BINS = "floor(log10(y_pred) * 10)::INT"

SQL = {
    "l1_runs": f"""{CTE_JOBS} SELECT DISTINCT 'first' AS run_id, partition, 'rf' AS model, feature_set, metric FROM jobs, {_SETS},
        (VALUES {", ".join(f"('{m}')" for m in REGRESSION_METRICS)}) u(metric) {_MINE}""",
    "s8_predictions": f"""{CTE_JOBS} SELECT partition, feature_set, n, n AS n_jobs FROM (
        SELECT partition, ceil(count(*) * 0.2)::BIGINT AS n FROM jobs {_MINE} GROUP BY partition), {_SETS}""",
    "l9_expanding_rows": f"""{CTE_JOBS}, numbered AS (SELECT row_number() OVER (ORDER BY s, job_id) - 1 AS r, count(*) OVER () AS n
          FROM jobs),
        train AS (SELECT r, floor(n * (1 - 0.2))::BIGINT AS size FROM numbered WHERE r < floor(n * (1 - 0.2))),
        folds AS (SELECT greatest(floor((r - (size - 5 * (size // 6))) / (size // 6)::DOUBLE), -1)::INT AS fold FROM train)
        SELECT f::INT AS fold, part, CASE part WHEN 'rest' THEN count(*) FILTER (WHERE fold < f)
            ELSE count(*) FILTER (WHERE fold = f) END AS n
        FROM folds, range(5) t(f), (VALUES ('rest'), ('held_out')) u(part) GROUP BY f, part""",
    "l12_fixed_model": f"""{CTE_JOBS}, placed AS MATERIALIZED (SELECT priority::DOUBLE AS a, allocated_cpu AS b,
            (2 * priority + allocated_cpu + timelimit_minutes / 10)::DOUBLE AS y,
            row_number() OVER (ORDER BY md5(concat(job_id, '_49')), job_id) - 1 AS place, count(*) OVER () AS n FROM jobs),
        swapped AS ({_SWAPPED}),
        drops AS (SELECT feature, repeat, (SELECT {_R2} FROM (SELECT y, 2 * a + b AS p FROM placed)) - ({_R2}) AS drop_
          FROM swapped GROUP BY feature, repeat)
        SELECT feature, round(avg(drop_), 6) AS value FROM drops GROUP BY feature""",
    "l456_held_out": f"""{CTE_JOBS}, numbered AS (SELECT job_id, wait_time_minutes AS w,
          row_number() OVER (ORDER BY md5(concat(job_id, '_49')), job_id) - 1 AS r, count(*) OVER () AS n FROM jobs),
        test AS (SELECT * FROM numbered WHERE r < ceil(n * 0.2))
        SELECT family, job_id, CASE family WHEN 'mlp' THEN (w >= 10)::INT ELSE (w >= 15)::INT + (w >= 60)::INT + (w >= 120)::INT
            + (w >= 240)::INT + (w >= 480)::INT END AS y_true, true AS valid
        FROM test, (VALUES ('rf'), ('xgb'), ('mlp')) t(family)""",
    "l11_shares": f"""{CTE_JOBS} SELECT DISTINCT partition, feature_set, 1.0::DOUBLE AS total, true AS valid FROM jobs, {_SETS}
        {_MINE}""",
    "e12_given_scores": f"""{_GIVEN} SELECT partition, 'rf' AS model, 'full' AS feature_set, round,
          (candidate + 3)::VARCHAR AS param_depth, round(m, 6) AS mean_test_mae, round(4 * m, 6) AS mean_test_r2,
          (rank() OVER (PARTITION BY partition, round ORDER BY m DESC))::INT AS rank_test_mae FROM means""",
    "e15_written": f"""{_GIVEN}, mine AS (SELECT * FROM jobs {_MINE}), pred AS (
          SELECT partition, model, feature_set, CASE model WHEN 'limit' THEN allocated_timelimit_seconds
            ELSE allocated_elapsed_seconds END / CASE feature_set WHEN 'full' THEN 2.0 ELSE 1.0 END AS y_pred
          FROM mine, (VALUES ('limit'), ('run')) m(model), (VALUES ('minimal'), ('full')) s(feature_set))
        SELECT 'accuracy_by_partition' AS report, 4::BIGINT AS n
        UNION ALL SELECT 'accuracy_by_model', 2 * count(DISTINCT partition) FROM mine
        UNION ALL SELECT 'accuracy_by_feature_set', 2 * count(DISTINCT partition) FROM mine
        UNION ALL SELECT 'cv', count(*) FROM means {_MINE}
        UNION ALL SELECT 'cv_' || partition || '_run', count(*) FROM means {_MINE} GROUP BY partition
        UNION ALL SELECT 'feature_importance', 2 * count(DISTINCT partition) FROM mine
        UNION ALL SELECT 'histogram', count(*) FROM (SELECT DISTINCT model, feature_set, {_LOG_BINS} FROM pred WHERE y_pred > 0)
        UNION ALL SELECT 'granular', 4 * count(DISTINCT partition) FROM mine
        UNION ALL SELECT 'held_out_' || partition, count(*) FROM mine GROUP BY partition""",
}
