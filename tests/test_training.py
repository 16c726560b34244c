"""Preparation, search, training and reports on rows whose target follows from a feature."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from queuescope.plans import metrics, prep, reports, training
from queuescope.plans.feature_sets import FEATURE_SETS
from queuescope.plans.model_specs import REGRESSORS, IntRange, ModelSpec
from queuescope.sources import results

RF = ModelSpec("rf", {"n_estimators": [5], "max_depth": [3, 6]}, folds=2, lower=1, log_policy="only_target",
               weights="aggressive")


@pytest.fixture(scope="module")
def jobs(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        load, noise = rnd.random(), rnd.random()
        wait = int(60 + 40_000 * load**2 + 30 * noise)
        rows.append((i, i, "small", load, noise, wait, wait // 60, 0, 1_700_000_000 + 60 * i))
    df = spark.createDataFrame(
        rows,
        """job_id bigint, priority bigint, partition string, active_load double, noise double,
        wait_time_seconds bigint, wait_time_minutes bigint, wait_time_bin int, start_s bigint""",
    )
    return df.withColumn("start_ts", F.timestamp_seconds("start_s")).drop("start_s").cache()


def values(df):
    return {r.metric: r.value for r in df.collect()}


def test_weights_have_mean_one(jobs):
    for method in ("linear", "rank", "aggressive"):
        row = prep.add_sample_weights(jobs, "wait_time_seconds", method).agg(
            F.avg("weight"), F.corr("weight", "wait_time_seconds")
        ).first()
        assert row[0] == pytest.approx(1.0) and row[1] > 0.5
    assert "weight" not in prep.add_sample_weights(jobs, "wait_time_seconds", "none").columns
    with pytest.raises(ValueError):
        prep.add_sample_weights(jobs, "wait_time_seconds", "other")


def test_weights_of_a_constant_target_are_one(jobs):
    flat = jobs.withColumn("y", F.lit(4.0))
    for method in ("linear", "rank", "aggressive"):
        assert prep.add_sample_weights(flat, "y", method).select("weight").distinct().collect() == [(1.0,)]


def test_split_sizes_are_exact_and_repeatable(jobs):
    first = prep.add_split(jobs, 0.21, "random")
    assert first.where("is_test").count() == 126
    again = prep.add_split(jobs.orderBy(F.desc("job_id")), 0.21, "random")
    assert first.where("is_test").select("job_id").exceptAll(again.where("is_test").select("job_id")).count() == 0
    timed = prep.add_split(jobs, 0.25, "timeseries").where("is_test").agg(F.count("*"), F.min("job_id")).first()
    assert tuple(timed) == (150, 450)


def test_errors_for_unknown_choices(jobs):
    for call in (
        lambda: prep.bin_target(jobs, "fine"),
        lambda: prep.log_transform(jobs, "some", ["wait_time_seconds"]),
        lambda: prep.add_split(jobs, method="other"),
        lambda: prep.scaled_columns("other", "y", []),
        lambda: metrics.within_aggregates("a", "b", "hours"),
        lambda: training.candidates(RF.but(search="other")),
        lambda: training.build_estimator(RF.but(family="mlp"), {}, "y", 2),
    ):
        with pytest.raises(ValueError):
            call()


def test_feature_sets_are_nested():
    for queue, sets in FEATURE_SETS.items():
        assert set(sets["minimal"]) < set(sets["naive"]) < set(sets["baseline"]) < set(sets["full"])
        assert ("allocated_gpu" in sets["minimal"]) == (queue == "small-g")


def test_candidates(jobs):
    assert training.candidates(RF) == [{"n_estimators": 5, "max_depth": 3}, {"n_estimators": 5, "max_depth": 6}]
    drawn = training.candidates(REGRESSORS["xgb"])
    assert len(drawn) == 30 and drawn == training.candidates(REGRESSORS["xgb"])
    assert all(80 <= c["n_estimators"] < 700 and 0.01 <= c["learning_rate"] <= 0.3 for c in drawn)
    with pytest.raises(ValueError):
        training.candidates(RF.but(search="grid", grid={"n_estimators": IntRange(1, 5)}))


def test_folds_cover_every_row_once(jobs):
    train = prep.add_split(jobs, 0.2, "timeseries").where("NOT is_test")
    sizes = training.add_folds(train, 7).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [69, 69, 69, 69, 68, 68, 68]
    timed = training.add_folds(train, 3, "timeseries").groupBy("fold").count().orderBy("fold").collect()
    assert [(r["fold"], r["count"]) for r in timed] == [(-1, 120), (0, 120), (1, 120), (2, 120)]
    rest, held_out = training.fold_parts(training.add_folds(train, 3, "timeseries"), "timeseries", 1)
    assert (rest.count(), held_out.count()) == (240, 120)
    assert rest.agg(F.max("start_ts")).first()[0] < held_out.agg(F.min("start_ts")).first()[0]


def test_forest_learns_and_finds_the_feature(jobs):
    run = training.predict(jobs, "wait_time_seconds", ["active_load", "noise"], RF)
    scores = values(run.accuracy)
    assert scores["r2"] > 0.8 and set(scores) == set(metrics.REGRESSION_METRICS)
    assert run.predictions.count() == 120
    importance = {r.feature: r.value for r in run.feature_importance.collect()}
    assert importance["active_load"] > 0.9
    assert run.params["max_depth"] == 6


def test_permutation_importance_and_halving(jobs):
    rows = jobs.withColumn("y", F.log1p("wait_time_seconds"))
    rows = VectorAssembler(inputCols=["active_load", "noise"], outputCol="features").transform(rows)
    rows = training.add_folds(prep.add_split(rows, 0.2), 2)
    spec = RF.but(search="halving", grid={"n_estimators": [2, 4, 6], "max_depth": [1, 2, 6]})
    best, scores = training.search(rows.where("NOT is_test"), spec, "y", 2)
    assert best["max_depth"] == 6
    rounds = {r["round"]: r["n"] for r in scores.groupBy("round").agg(F.countDistinct("candidate").alias("n")).collect()}
    assert rounds == {0: 9, 1: 3, 2: 1}
    model = training.build_estimator(spec, best, "y", 2).fit(rows)
    found = {r.feature: r.value for r in training.permutation_importance(
        model, rows, ["active_load", "noise"], "y", "regression", repeats=2).collect()}
    assert found["active_load"] > 1 and abs(found["noise"]) < 0.1


def test_classifiers(jobs):
    for family, grid in [("rf", {"n_estimators": [5]}), ("xgb", {"n_estimators": [3]})]:
        spec = ModelSpec(family, grid, "classification", folds=2, upper=11)
        scores = values(training.predict(jobs, "wait_time_bin", ["active_load", "noise"], spec).accuracy)
        assert scores["f1"] > 0.9 and scores["roc_auc"] > 0.95
    many = values(training.predict(
        jobs, "wait_time_bin", ["active_load", "noise"],
        ModelSpec("xgb", {"n_estimators": [3]}, "classification", folds=2, upper=11), bins="simple").accuracy)
    assert many["f1"] > 0.7 and many["roc_auc_macro_ovo"] > 0.9


def test_runs_are_stored_and_reported(spark, jobs, tmp_path):
    path = str(tmp_path)
    sets = {"small": {"minimal": ["noise"], "full": ["active_load", "noise"]}}
    plan = {"small": {"models": ["rf"], "feature_sets": ["minimal", "full"]}}
    for run_id in ("one", "two"):
        training.train_models({"small": jobs}, plan, sets, {"rf": RF.but(grid={"n_estimators": [3]})}, run_id=run_id,
                              export_path=path, save_models=run_id == "one")
    assert results.read_table(spark, path, "accuracy").count() == 48
    assert results.read_table(spark, path, "accuracy", "one").count() == 24
    made = reports.create_reports(spark, path, "two", jobs, ["small"], "regression")
    accuracy = {r.metric: r for r in made["accuracy_by_feature_set"].collect()}
    assert accuracy["perc_err_under_60min"]["full"].endswith("%")
    assert float(accuracy["r2"]["full"]) > float(accuracy["r2"]["minimal"])
    assert made["feature_importance"].columns == ["partition", "model", "feature", "minimal", "full"]
    assert made["granular"].count() == 2
    lead = reports.cv_report_of(made["cv"], "small", "rf")
    assert lead.columns[:2] == ["feature_set", "mean_test_mae"]
    attached = reports.add_errors(
        reports.attach_predictions(jobs, results.read_table(spark, path, "predictions", "two")))
    assert {"y_pred_rf_full", "rf_full_err", "rf_minimal_err"} <= set(attached.columns)
    assert attached.count() == 120
    written = results.write_reports(f"{path}/reports", made, "csv")
    assert len(written) == len(made)
