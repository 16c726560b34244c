"""Compare runs: accuracy, cross-validation, importance and per-wait reports, built from the result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuescope.functions.scalars import name_part, strip_prefix
from queuescope.operators.relational import (
    columns_with,
    null_counts,
    pivot_first,
    share_of_total,
    without_prefixes,
)
from queuescope.plans.metrics import metrics_by_wait
from queuescope.plans.training import cv_results, with_params_text
from queuescope.sources import results

DIMENSIONS = ["partition", "model", "feature_set"]
SET_ORDER = ["minimal", "naive", "baseline", "full"]  # fixed values: least to most valuable
# Leading columns of the cross-validation report.
CV_LEAD = {
    "regression": ["mean_test_mae", "mean_test_rmse", "mean_test_r2", "mean_test_mape", "rank_test_mae"],
    "classification": ["mean_test_f1_macro", "mean_test_balanced_accuracy", "mean_test_roc_auc", "rank_test_f1_macro"],
}


def levels_of(df: DataFrame, column: str) -> list[str]:
    """Distinct names of a result dimension (a few per run)."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def split_result_name(df: DataFrame, name: str = "result_name", prefix: str = "res_") -> DataFrame:
    """``res_<queue>_<model>_<set>`` to three columns; the set keeps any further underscores."""
    text = strip_prefix(name, prefix)
    parts = {d: name_part(text, i, 3) for i, d in enumerate(DIMENSIONS)}
    return df.select(*[c.alias(d) for d, c in parts.items()], *[c for c in df.columns if c != name])


def split_prediction_name(df: DataFrame, name: str = "metric", prefix: str = "y_pred_") -> DataFrame:
    """``y_pred_<model>_<set>`` to two columns."""
    text = strip_prefix(name, prefix)
    return df.select(
        name_part(text, 0, 2).alias("model"), name_part(text, 1, 2).alias("feature_set"),
        *[c for c in df.columns if c != name],
    )


def format_accuracy(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Shares as percent text, other metrics as text, both with two decimals (half to even)."""
    share = F.concat(F.bround(F.col(value) * 100, 2).cast("string"), F.lit("%"))
    return df.withColumn(
        value, F.when(F.col(metric).startswith("perc"), share).otherwise(F.bround(value, 2).cast("string"))
    )


def accuracy_report(accuracy: DataFrame, compare: str) -> DataFrame:
    """One row per metric and pair of the other two dimensions, one column per level of ``compare``."""
    if compare not in DIMENSIONS:
        raise ValueError(f"compare must be in {DIMENSIONS}")
    fixed = [d for d in DIMENSIONS if d != compare]
    return pivot_first(accuracy, [*fixed, "metric"], compare, "value", levels_of(accuracy, compare)).orderBy(
        *fixed, "metric"
    )


def accuracy_reports(accuracy: DataFrame) -> dict[str, DataFrame]:
    formatted = format_accuracy(accuracy)
    return {f"accuracy_by_{d}": accuracy_report(formatted, d) for d in DIMENSIONS}


def cv_report(scores: DataFrame, task: str, folds: int | None = None) -> DataFrame:
    """Mean scores and rank of each candidate per queue, model and set; technical columns are dropped."""
    if task not in CV_LEAD:
        raise ValueError(f"task must be in {sorted(CV_LEAD)}")
    table = cv_results(with_params_text(scores), task, DIMENSIONS, folds or 1)
    lead = CV_LEAD[task]
    spare = [c for c in columns_with(table, ["rank_test_"]) if c not in lead]
    table = without_prefixes(table, ["split", "std"]).drop(*spare, "candidate")
    rest = [c for c in table.columns if c not in [*DIMENSIONS, *lead]]
    return table.select(*DIMENSIONS, *lead, *rest).orderBy(*DIMENSIONS, lead[-1])


def cv_report_of(report: DataFrame, queue: str, model: str) -> DataFrame:
    """The report of one queue and model, without columns that hold nulls there."""
    part = report.where((F.col("partition") == queue) & (F.col("model") == model)).drop("partition", "model")
    nulls = null_counts(part).first().asDict()
    return part.select(*[c for c in part.columns if not nulls[c]])


def importance_report(importance: DataFrame) -> DataFrame:
    """Share of each feature in its set's total, one column per set, sorted from the smallest set on."""
    shares = share_of_total(importance, DIMENSIONS, "value", "share")
    present = [s for s in SET_ORDER if s in levels_of(importance, "feature_set")]
    wide = pivot_first(shares, ["partition", "model", "feature"], "feature_set", "share", present, fill=0.0)
    return wide.orderBy("partition", "model", *[F.desc(s) for s in present], "feature")


def attach_predictions(jobs: DataFrame, predictions: DataFrame, id_column: str = "job_id") -> DataFrame:
    """Held-out jobs with one ``y_pred_<model>_<set>`` column per run, matched by job."""
    named = predictions.withColumn("_name", F.concat_ws("_", F.lit("y_pred"), "model", "feature_set"))
    wide = pivot_first(named, [id_column], "_name", "y_pred", levels_of(named, "_name"))
    return jobs.join(wide, id_column)


def add_errors(df: DataFrame, y: str = "wait_time_seconds") -> DataFrame:
    """``<model>_<set>_err`` for every ``y_pred_<model>_<set>``."""
    errors = {}
    for column in columns_with(df, ["y_pred_"]):
        model, _, name = column.removeprefix("y_pred_").partition("_")
        errors[f"{model}_{name or 'default'}_err"] = F.col(y) - F.col(column)
    return df.withColumns(errors)


def granular_report(
    predictions: DataFrame, jobs: DataFrame, metric: str = "perc_err_under_10min",
    bins: Sequence[int] = (0, 30, 60, 120, 240), id_column: str = "job_id", minutes: str = "wait_time_minutes",
    unit: str = "wait_time_seconds",
) -> DataFrame:
    """One metric per class of wait, for every queue, model and feature set at once."""
    known = predictions.join(jobs.select(id_column, minutes), id_column)
    return metrics_by_wait(
        known, bins, minutes, y="y_true", y_pred="y_pred", keys=DIMENSIONS, metrics=[metric], unit=unit
    ).orderBy(*DIMENSIONS)


def prediction_histogram(predictions: DataFrame, value: str = "y_pred", per_decade: int = 10) -> DataFrame:
    """Rows per logarithmic class of the predicted value, per model and set; values of zero or less have no class."""
    place = F.floor(F.log10(value) * per_decade)
    return (
        predictions.where(F.col(value) > 0)
        .groupBy("model", "feature_set", place.cast("int").alias("log_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def create_reports(
    spark: SparkSession, path: str, run_id: str, jobs: DataFrame, queues: Sequence[str], task: str
) -> dict[str, DataFrame]:
    """All reports of a run. ``jobs`` holds the feature rows of the queues."""
    tables = {t: results.read_table(spark, path, t, run_id) for t in results.TABLES}
    tables = {t: df.where(F.col("partition").isin(*queues)) for t, df in tables.items()}
    reports = accuracy_reports(tables["accuracy"])
    reports["cv"] = cv_report(tables["cv_scores"], task)
    for queue in levels_of(tables["cv_scores"], "partition"):
        for model in levels_of(tables["cv_scores"].where(F.col("partition") == queue), "model"):
            reports[f"cv_{queue}_{model}"] = cv_report_of(reports["cv"], queue, model)
    reports["feature_importance"] = importance_report(tables["feature_importance"])
    reports["histogram"] = prediction_histogram(tables["predictions"])
    if task == "regression":
        reports["granular"] = granular_report(tables["predictions"], jobs)
        for queue in levels_of(tables["predictions"], "partition"):
            reports[f"held_out_{queue}"] = held_out_errors(spark, path, run_id, jobs, queue)
    return reports


def held_out_errors(
    spark: SparkSession, path: str, run_id: str, jobs: DataFrame, queue: str, y: str = "wait_time_seconds"
) -> DataFrame:
    """The held-out jobs of a queue with the prediction and the error of every model and feature set of a run."""
    predictions = results.read_table(spark, path, "predictions", run_id).where(F.col("partition") == queue)
    return add_errors(attach_predictions(jobs.where(F.col("partition") == queue), predictions), y)
