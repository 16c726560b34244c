"""Result tables of training runs: Parquet tables with a part per run, queue, model and feature set.

Writing the results of the same keys again replaces them, so a run can be repeated, also one that has no rows left.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuescope.sources.versions import read_parts, write_parts

RUN_KEYS = ["run_id", "partition", "model", "feature_set"]
TABLES = ["accuracy", "cv_scores", "feature_importance", "feature_selection", "predictions"]


def write_table(path: str, table: str, df: DataFrame, keys: Mapping[str, str] | None = None) -> None:
    """Replace the results of the keys in ``df``, and of ``keys``, which the write stands for even if it has no rows."""
    if table not in TABLES:
        raise ValueError(f"table must be in {TABLES}")
    write_parts(df, f"{path}/{table}", RUN_KEYS, [[keys[k] for k in RUN_KEYS]] if keys else None)


def read_table(spark: SparkSession, path: str, table: str, run_id: str | None = None) -> DataFrame:
    """All results, or those of one run (only its folders are read), as they were committed last."""
    df = read_parts(spark, f"{path}/{table}", None if run_id is None else {0: run_id})
    return df.select(*[F.col(k).cast("string") for k in RUN_KEYS], *[c for c in df.columns if c not in RUN_KEYS])


def write_model(path: str, keys: Mapping[str, str], model: Any) -> str:
    folder = f"{path}/models/" + "/".join(f"{k}={keys[k]}" for k in RUN_KEYS)
    model.write().overwrite().save(folder)
    return folder


def write_run(spark: SparkSession, path: str, run_id: str, feature_sets: str, model_parameters: str) -> None:
    """Record of a run: its feature sets and model parameters as JSON text."""
    row = [(run_id, feature_sets, model_parameters)]
    runs = spark.createDataFrame(row, "run_id string, feature_sets string, model_parameters string")
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{path}/runs")


def write_reports(path: str, reports: Mapping[str, DataFrame], form: str = "parquet") -> list[str]:
    """Write each report to its own folder, as Parquet or CSV."""
    if form not in ("parquet", "csv"):
        raise ValueError("form must be 'parquet' or 'csv'")
    for name, df in reports.items():
        writer = df.write.mode("overwrite")
        writer.parquet(f"{path}/{name}") if form == "parquet" else writer.csv(f"{path}/{name}", header=True)
    return [f"{path}/{name}" for name in reports]
