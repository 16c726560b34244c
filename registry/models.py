"""Queries that train models on the feature table; checked by rows and properties, as other engines fit otherwise."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from queuescope.plans import prep, reports, training
from queuescope.plans.feature_sets import FEATURE_SETS
from queuescope.plans.model_specs import IntRange, ModelSpec
from queuescope.session import materialize, work_dir
from queuescope.sources import results
from queuescope.sources.datasets import create_datasets, read_dataset, read_queue
from registry.tables import CTE_JOBS, clean_jobs, feature_jobs, raw_jobs

X = FEATURE_SETS["standard"]["full"]
FOREST = ModelSpec(
    "rf", {"n_estimators": [5, 10], "max_depth": [4, 6]}, folds=2, lower=1, log_policy="only_target",
    weights="aggressive",
)
BOOSTED = ModelSpec(
    "xgb", {"n_estimators": [5], "max_depth": [4], "learning_rate": [0.1, 0.3]}, folds=2, lower=1,
    log_policy="only_target", weights="aggressive",
)
FOREST_CLASSES = FOREST.but(task="classification", log_policy="none", weights="none", upper=11)


def _accuracy(run):
    return run.accuracy.select("metric", "value")


def _regression(spec, split="random", scaling="none"):
    def query(spark, sf_dir):
        jobs = feature_jobs(spark, sf_dir)
        return _accuracy(training.predict(jobs, "wait_time_seconds", X, spec.but(scaling=scaling), split=split))

    return query


def _classification(spec, bins="binary"):
    def query(spark, sf_dir):
        jobs = feature_jobs(spark, sf_dir)
        return _accuracy(training.predict(jobs, "wait_time_bin", X, spec, bins=bins))

    return query


def _prepared(spark, sf_dir, folds=2, strategy="kfold"):
    jobs = feature_jobs(spark, sf_dir).withColumn("y", F.log1p("wait_time_seconds"))
    jobs = prep.add_split(jobs.select("job_id", "start_ts", "y", *X), 0.2, "timeseries")
    jobs = VectorAssembler(inputCols=X, outputCol="features").transform(jobs).drop(*X)
    train = materialize(training.add_folds(jobs.where("NOT is_test"), folds, strategy))
    return train, jobs.where("is_test")


def _searched(search, strategy="kfold", folds=2, **changes):
    def query(spark, sf_dir):
        train, _ = _prepared(spark, sf_dir, folds, strategy)
        spec = ModelSpec(
            "rf", {"n_estimators": [3, 6], "max_depth": [3, 5]}, search=search, folds=folds, fold_strategy=strategy,
            draws=3,
        ).but(**changes)
        _, scores = training.search(train, spec, "y", len(X))
        return training.with_params_text(scores).select("candidate", "params_text", "fold", "metric", "value")

    return query


def l10_cv_results(spark, sf_dir):
    scores = _searched("grid")(spark, sf_dir)
    return training.cv_results(scores, "regression", folds=2)


def l11_importance(spark, sf_dir):
    train, _ = _prepared(spark, sf_dir)
    model = training.build_estimator(FOREST, {"n_estimators": 10}, "y", len(X)).fit(train)
    return training.tree_importance(spark, model, X)


def l12_permutation(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    model = training.build_estimator(FOREST, {"n_estimators": 10}, "y", len(X)).fit(train)
    return training.permutation_importance(model, test, X, "y", "regression", repeats=3)


_results: dict[tuple[str, str], str] = {}


def _trained(spark, sf_dir):
    """Result tables of all queues and two feature sets, trained once per session and scale; returns their folder."""
    jobs = feature_jobs(spark, sf_dir)
    queues = ["small", "small-g", "standard", "standard-g"]
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _results:
        path = f"{work_dir(spark)}/results-{uuid.uuid4().hex}"
        plan = {q: {"models": ["rf"], "feature_sets": ["baseline", "minimal"]} for q in queues}
        spec = FOREST.but(grid={"n_estimators": [5], "max_depth": [4]})
        datasets = {q: jobs.where(F.col("partition") == q) for q in queues}
        _results[key] = training.train_models(
            datasets, plan, FEATURE_SETS, {"rf": spec}, run_id="first", export_path=path
        )
    return _results[key], jobs, queues


def l1_grid_of_runs(spark, sf_dir):
    path, _, _ = _trained(spark, sf_dir)
    return results.read_table(spark, path, "accuracy", "first")


def s7_result_tables(spark, sf_dir):
    path, _, _ = _trained(spark, sf_dir)
    counts = [
        results.read_table(spark, path, t).groupBy("run_id", "partition").agg(
            F.lit(t).alias("table"), F.count(F.lit(1)).alias("n")
        )
        for t in results.TABLES
    ]
    runs = spark.read.json(f"{path}/runs").select(
        "run_id", F.lit(None).cast("string").alias("partition"), F.lit("runs").alias("table"),
        F.lit(1).cast("bigint").alias("n"),
    )
    for other in counts:
        runs = runs.unionByName(other)
    return runs


def e12_cv(spark, sf_dir):
    path, _, _ = _trained(spark, sf_dir)
    return reports.cv_report(results.read_table(spark, path, "cv_scores", "first"), "regression", folds=2)


def e15_reports(spark, sf_dir):
    """All reports of a run, written and counted."""
    path, jobs, queues = _trained(spark, sf_dir)
    made = reports.create_reports(spark, path, "first", jobs, queues, "regression")
    results.write_reports(f"{path}/reports", made)
    counted = [
        spark.read.parquet(f"{path}/reports/{n}").agg(F.lit(n).alias("report"), F.count(F.lit(1)).alias("n"))
        for n in made
    ]
    total = counted[0]
    for other in counted[1:]:
        total = total.unionByName(other)
    return total


def s5_datasets(spark, sf_dir):
    """Raw records as a Parquet file, written as feature tables per queue, and one queue read back."""
    path = f"{work_dir(spark)}/datasets-{uuid.uuid4().hex}"
    raw_jobs(spark, sf_dir).write.parquet(f"{path}/raw")
    create_datasets(spark, ["small", "small-g", "standard", "standard-g"], f"{path}/raw", f"{path}/jobs",
                    min_wait_minutes=10)
    return read_queue(spark, f"{path}/jobs", "standard").select(
        "job_id", "wait_time_minutes", "partition"
    )


def s5_two_writes(spark, sf_dir):
    """Two queues written one after the other, the first of them once more: both stay, nothing doubles."""
    path = f"{work_dir(spark)}/datasets-{uuid.uuid4().hex}"
    raw_jobs(spark, sf_dir).write.parquet(f"{path}/raw")
    for queue in ("small", "standard", "small"):
        create_datasets(spark, [queue], f"{path}/raw", f"{path}/jobs", level="preprocess")
    return read_dataset(spark, f"{path}/jobs").select("job_id", "wait_time_seconds", "partition")


def s5_empty_rerun(spark, sf_dir):
    """Two queues written, then one of them again with a wait that nobody meets: it is empty, the other one stays."""
    path = f"{work_dir(spark)}/datasets-{uuid.uuid4().hex}"
    raw_jobs(spark, sf_dir).write.parquet(f"{path}/raw")
    create_datasets(spark, ["small", "standard"], f"{path}/raw", f"{path}/jobs", level="preprocess")
    create_datasets(spark, ["small"], f"{path}/raw", f"{path}/jobs", level="preprocess", min_wait_minutes=10**9)
    return read_dataset(spark, f"{path}/jobs").select("job_id", "wait_time_seconds", "partition")


def s7_empty_rerun(spark, sf_dir):
    """Predictions of two runs, one of them written again without rows: only the other is left."""
    path = f"{work_dir(spark)}/results-{uuid.uuid4().hex}"
    for run in ("first", "second"):
        guesses = clean_jobs(spark, sf_dir).where("partition = 'small'").selectExpr(
            f"'{run}' AS run_id", "partition", "'limit' AS model", "'full' AS feature_set", "job_id",
            "CAST(wait_time_seconds AS DOUBLE) AS y_true",
        )
        results.write_table(path, "predictions", guesses)
    keys = {"run_id": "first", "partition": "small", "model": "limit", "feature_set": "full"}
    results.write_table(path, "predictions", guesses.limit(0), keys)
    return results.read_table(spark, path, "predictions")


def s7_rerun(spark, sf_dir):
    """Predictions and the run's record written twice under the same keys, read back as they were written once."""
    path = f"{work_dir(spark)}/results-{uuid.uuid4().hex}"
    guesses = clean_jobs(spark, sf_dir).selectExpr(
        "'again' AS run_id", "partition", "'limit' AS model", "'full' AS feature_set", "job_id",
        "CAST(wait_time_seconds AS DOUBLE) AS y_true", "CAST(allocated_timelimit_seconds AS DOUBLE) AS y_pred",
    )
    for _ in range(2):
        results.write_table(path, "predictions", guesses)
        results.write_run(spark, path, "again", "{}", "{}")
    records = spark.read.json(f"{path}/runs").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"))
    return results.read_table(spark, path, "predictions", "again").join(records, "run_id")


def _given_scores(spark, sf_dir):
    """Scores of three candidates in two rounds and two folds that follow from the jobs, not from a fit."""
    return clean_jobs(spark, sf_dir).selectExpr(
        "partition", "CAST(priority % 3 AS INT) AS candidate", "CAST(job_id % 2 AS INT) AS fold",
        "CAST(priority DIV 50 AS INT) AS round", "wait_time_minutes AS w",
        "inline(array(struct('mae' AS metric, 1 AS f), struct('mape' AS metric, 2 AS f),"
        " struct('rmse' AS metric, 3 AS f), struct('r2' AS metric, 4 AS f)))",
    ).groupBy("partition", "round", "candidate", "fold", "metric").agg(F.expr("-avg(w * f)").alias("value")).selectExpr(
        "partition", "round", "candidate", "fold", "metric", "value",
        "map('depth', CAST(candidate + 3 AS STRING), 'trees', '9') AS params",
    )


def l10_given_scores(spark, sf_dir):
    """The table of a halving search: a row per round and candidate, a column per parameter."""
    scores = training.with_params_text(_given_scores(spark, sf_dir))
    table = training.cv_results(scores, "regression", ["partition"], folds=2)
    return table.selectExpr(
        "partition", "round", "candidate", "param_depth", "param_trees", "round(mean_test_mae, 6) AS mean_test_mae",
        "round(std_test_rmse, 6) AS std_test_rmse", "round(split1_test_r2, 6) AS split1_test_r2", "rank_test_mae",
    )


def l7_halving_rounds(spark, sf_dir):
    """Scores per round of a halving search: four candidates, then the best third of them, rounded up."""
    train, _ = _prepared(spark, sf_dir)
    spec = ModelSpec("rf", {"n_estimators": [2, 3], "max_depth": [2, 3]}, search="halving", folds=2)
    _, scores = training.search(train, spec, "y", len(X))
    return scores.groupBy("round").agg(
        F.countDistinct("candidate").alias("n_candidates"), F.count(F.lit(1)).alias("n_scores")
    )


def l2_held_out(spark, sf_dir):
    """The held-out rows of a forest: which jobs, their true waits, and that predictions beat the mean of the rest."""
    jobs = feature_jobs(spark, sf_dir)
    spec = FOREST.but(grid={"n_estimators": [10], "max_depth": [6]}, lower=0, weights="none")
    run = training.predict(jobs, "wait_time_seconds", X, spec, split="timeseries")
    own, zero = run.predictions.selectExpr(
        "avg(abs(log1p(y_true) - log1p(greatest(y_pred, 0))))", "avg(log1p(y_true))"
    ).first()
    return run.predictions.selectExpr(
        "job_id", "CAST(round(y_true) AS BIGINT) AS y_true",
        "y_pred IS NOT NULL AND NOT isnan(y_pred) AND abs(y_pred) < 1e300 AS finite",
    ).withColumn("better_than_nothing", F.lit(own < zero))


QUERIES = {
    f.__name__: f
    for f in [l10_cv_results, l11_importance, l12_permutation, l1_grid_of_runs, s7_result_tables, e12_cv, e15_reports,
              s5_datasets, s5_two_writes, s5_empty_rerun, s7_rerun, s7_empty_rerun, l10_given_scores, l7_halving_rounds, l2_held_out]
} | {
    "l2_run_timeseries": _regression(FOREST, "timeseries", "all_variables"),
    "l4_forest": _regression(FOREST),
    "l4_forest_classes": _classification(FOREST_CLASSES, "simple"),
    "l5_boosted": _regression(BOOSTED),
    "l5_boosted_binary": _classification(BOOSTED.but(task="classification", log_policy="none", weights="none")),
    "l6_network": _classification(
        ModelSpec("mlp", {"hidden_layer_sizes": [(10,)], "max_iter": [30]}, "classification", folds=2,
                  scaling="all_variables", fold_strategy="timeseries"),
    ),
    "l7_grid_search": _searched("grid"),
    "l7_random_search": _searched("random", grid={"n_estimators": IntRange(3, 8), "max_depth": [3, 5]}),
    "l7_halving_search": _searched("halving"),
    "l9_expanding_folds": _searched("grid", "timeseries", 3, grid={"n_estimators": [4], "max_depth": [4]}),
}

SQL = {
    "s5_two_writes": f"""{CTE_JOBS} SELECT job_id, wait_time_seconds, partition FROM jobs
        WHERE partition IN ('small', 'standard')""",
    "s5_empty_rerun": f"""{CTE_JOBS} SELECT job_id, wait_time_seconds, partition FROM jobs WHERE partition = 'standard'""",
    "s7_empty_rerun": f"""{CTE_JOBS} SELECT 'second' AS run_id, partition, 'limit' AS model, 'full' AS feature_set, job_id,
        wait_time_seconds::DOUBLE AS y_true FROM jobs WHERE partition = 'small'""",
    "s7_rerun": f"""{CTE_JOBS} SELECT 'again' AS run_id, partition, 'limit' AS model, 'full' AS feature_set, job_id,
        wait_time_seconds::DOUBLE AS y_true, allocated_timelimit_seconds::DOUBLE AS y_pred, 1::BIGINT AS n_records
        FROM jobs""",
    "l10_given_scores": f"""{CTE_JOBS}, scores AS (
          SELECT partition, (priority // 50)::INT AS round, (priority % 3)::INT AS candidate, (job_id % 2)::INT AS fold,
                 -avg(wait_time_minutes) AS v FROM jobs GROUP BY ALL),
        means AS (SELECT partition, round, candidate, avg(v) AS m, 3 * stddev_pop(v) AS s,
                         4 * max(v) FILTER (WHERE fold = 1) AS second FROM scores GROUP BY ALL)
        SELECT partition, round, candidate, (candidate + 3)::VARCHAR AS param_depth, '9' AS param_trees,
          round(m, 6) AS mean_test_mae, round(s, 6) AS std_test_rmse, round(second, 6) AS split1_test_r2,
          (rank() OVER (PARTITION BY partition, round ORDER BY m DESC))::INT AS rank_test_mae FROM means""",
    "l7_halving_rounds": """SELECT * FROM (VALUES (0, 4::BIGINT, 32::BIGINT), (1, 2::BIGINT, 16::BIGINT))
        t(round, n_candidates, n_scores)""",
    "l2_held_out": f"""{CTE_JOBS}, numbered AS (SELECT job_id, wait_time_seconds,
          row_number() OVER (ORDER BY s, job_id) - 1 AS r, count(*) OVER () AS n FROM jobs)
        SELECT job_id, wait_time_seconds AS y_true, true AS finite, true AS better_than_nothing FROM numbered
        WHERE r >= floor(n * (1 - 0.2))""",
    "s5_datasets": f"""{CTE_JOBS} SELECT job_id, wait_time_minutes, partition FROM jobs
        WHERE partition = 'standard' AND wait_time_minutes >= 10""",
}
