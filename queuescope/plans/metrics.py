"""Regression and classification metrics as grouped aggregates: one plan scores any number of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope.operators.relational import pivot_first, to_rows
from queuescope.operators.running import exact_quantiles, join_matching, sorted_totals

EPSILON = 2.220446049250313e-16  # fixed value: machine epsilon of a double
WITHIN_MINUTES = [1, 3, 5, 10, 30, 60]  # fixed values
# Seconds in the unit of a target column.
TARGET_UNITS = {"wait_time_seconds": 1, "wait_time_minutes": 60}

REGRESSION_METRICS = ["rmse", "mape", "r2", "median_ae", "mean_ae", "max_error"] + [
    f"perc_err_under_{m}min" for m in WITHIN_MINUTES
]


def error_aggregates(y: str, y_pred: str) -> dict[str, Column]:
    """Aggregates that need no order: rmse, mape, r2, mean and largest error."""
    true, error = F.col(y).cast("double"), F.col(y).cast("double") - F.col(y_pred)
    squares = F.sum(error * error)
    spread = F.var_pop(true) * F.count(F.lit(1))
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.abs(error) / F.greatest(F.abs(true), F.lit(EPSILON))),
        "r2": F.when(spread > 0, 1 - F.try_divide(squares, spread)).otherwise(
            F.when(squares == 0, 1.0).otherwise(0.0)
        ),
        "mean_ae": F.avg(F.abs(error)),
        "max_error": F.max(F.abs(error)),
    }


def within_aggregates(y: str, y_pred: str, unit: str) -> dict[str, Column]:
    """Share of rows with an error of at most so many minutes."""
    if unit not in TARGET_UNITS:
        raise ValueError(f"target must be one of {sorted(TARGET_UNITS)}")
    error = F.abs(F.col(y) - F.col(y_pred))
    return {
        f"perc_err_under_{m}min": F.avg((error <= m * 60 / TARGET_UNITS[unit]).cast("int"))
        for m in WITHIN_MINUTES
    }


def regression_table(
    df: DataFrame, y: str, y_pred: str, keys: Sequence[str] = (), unit: str = "wait_time_seconds"
) -> DataFrame:
    """One row per key, one column per metric."""
    aggregates = error_aggregates(y, y_pred) | within_aggregates(y, y_pred, unit)
    table = df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggregates.items()])
    # The median comes from a distributed sort of the distinct errors, not from one list of errors per key.
    errors = df.select(*keys, F.abs(F.col(y).cast("double") - F.col(y_pred)).alias("_error"))
    medians = exact_quantiles(errors, keys, "_error", {"median_ae": 0.5}, "linear")
    if keys:
        table = join_matching(table, medians, keys, "left")
    else:
        row = medians.first()
        table = table.withColumn("median_ae", F.lit(row[0] if row else None).cast("double"))
    return table.select(*keys, *REGRESSION_METRICS)


def regression_metrics(
    df: DataFrame, y: str, y_pred: str, keys: Sequence[str] = (), unit: str = "wait_time_seconds"
) -> DataFrame:
    """Long form: (keys, metric, value)."""
    return to_rows(regression_table(df, y, y_pred, keys, unit), keys)


def bin_label(bins: Sequence[int], minutes: str) -> Column:
    col, label = F.col(minutes), F.when(F.col(minutes) >= bins[-1], f"{bins[-1]}+")
    for low, high in zip(bins, bins[1:]):
        label = label.when((col >= low) & (col < high), f"{low}_{high}")
    return label


def bin_names(bins: Sequence[int]) -> list[str]:
    return [f"{a}_{b}" for a, b in zip(bins, bins[1:])] + [f"{bins[-1]}+"]


def metrics_by_wait(
    df: DataFrame,
    bins: Sequence[int] = (0, 30, 60, 120, 240),
    minutes: str = "wait_time_minutes",
    y: str = "wait_time_seconds",
    y_pred: str = "y_pred",
    keys: Sequence[str] = (),
    metrics: Sequence[str] = tuple(REGRESSION_METRICS[:10]),
    unit: str = "wait_time_seconds",
) -> DataFrame:
    """Metrics per class of wait, one ``value_<class>`` column each; a class without rows gives null."""
    labelled = df.withColumn("_bin", bin_label(bins, minutes)).where(F.col("_bin").isNotNull())
    long = regression_metrics(labelled, y, y_pred, [*keys, "_bin"], unit)
    names = bin_names(bins)
    wide = pivot_first(long.where(F.col("metric").isin(*metrics)), [*keys, "metric"], "_bin", "value", names)
    return wide.withColumnsRenamed({n: f"value_{n}" for n in names})


# -------------------------------------------------------------------------------------------------- classification


def confusion(df: DataFrame, y: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(y).cast("int").alias("y"), F.col(y_pred).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_metrics(df: DataFrame, y: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Macro F1 over all labels seen or predicted, and the mean recall over the labels seen."""
    counts = confusion(df, y, y_pred, keys)
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    per_label = (
        counts.select(
            *keys,
            F.inline(
                F.array(
                    F.struct(F.col("y").alias("label"), F.col("n").alias("seen"), F.lit(0).cast("bigint").alias("said"),
                             hit.cast("bigint").alias("hit")),
                    F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("seen"), F.col("n").alias("said"),
                             F.lit(0).cast("bigint").alias("hit")),
                )
            ),
        )
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("seen", "said", "hit")])
    )
    return per_label.groupBy(*keys).agg(
        F.avg(2 * F.col("hit") / (F.col("seen") + F.col("said"))).alias("f1"),
        F.avg(F.when(F.col("seen") > 0, F.col("hit") / F.col("seen"))).alias("balanced_accuracy"),
    )


def auc_table(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve per key by rank sums: (keys, auc, n, n_hits).

    ``counts`` holds rows (keys, _score, _hit, _n). The area is null if a key has only hits or only misses.
    """
    points = counts.groupBy(*keys, "_score").agg(
        F.sum("_n").alias("_n"), F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)).alias("_hits")
    )
    ranked = sorted_totals(points, keys, ["_score"], {"_upto": "_n"})
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
    sums = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_hits").alias("n_hits"), F.sum(rank * F.col("_hits")).alias("_ranks")
    )
    hits = F.col("n_hits").cast("double")
    area = F.try_divide(F.col("_ranks") - hits * (hits + 1) / 2, hits * (F.col("n") - hits))
    return sums.select(*keys, area.alias("auc"), "n", "n_hits")


def auc_metrics(
    df: DataFrame, y: str, probabilities: str, classes: int, keys: Sequence[str] = ()
) -> DataFrame:
    """ROC AUC per key from an array of class probabilities.

    Two classes give ``roc_auc``. More give one-versus-rest and one-versus-one averages, plain and weighted by how
    common the classes (or pairs of classes) are. A class that does not occur is left out.
    """
    every = F.array(*[F.lit(c) for c in range(1 if classes == 2 else 0, classes)])
    scored = df.select(
        *keys, F.col(y).cast("int").alias("_y"), F.col(probabilities).alias("_p"), F.explode(every).alias("_c")
    )
    # A histogram of scores per true class and scored class; everything below works on these counts.
    counts = scored.groupBy(*keys, "_y", "_c", F.get("_p", F.col("_c")).alias("_score")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    counts = counts.withColumn("_hit", F.col("_y") == F.col("_c"))
    if classes == 2:
        return auc_table(counts, keys).select(*keys, F.col("auc").alias("roc_auc"))

    rest = auc_table(counts, [*keys, "_c"]).withColumn("_weight", F.col("n_hits"))
    # Class c against class o: rows of c are hits, rows of o are misses, both ranked by the score of c.
    others = F.when(F.col("_hit"), F.array_except(every, F.array("_y"))).otherwise(F.array("_y"))
    against = auc_table(counts.withColumn("_o", F.explode(others)), [*keys, "_c", "_o"])
    pair = [F.least("_c", "_o").alias("_a"), F.greatest("_c", "_o").alias("_b")]
    both = against.groupBy(*keys, *pair).agg(F.avg("auc").alias("auc"), F.max("n").alias("_weight"))

    def averages(table: DataFrame, name: str) -> DataFrame:
        kept = table.where(F.col("auc").isNotNull())
        return kept.groupBy(*keys).agg(
            F.avg("auc").alias(f"roc_auc_macro_{name}"),
            (F.sum(F.col("auc") * F.col("_weight")) / F.sum("_weight")).alias(f"roc_auc_weighted_{name}"),
        )

    ovr, ovo = averages(rest, "ovr"), averages(both, "ovo")
    if keys:
        return join_matching(ovr, ovo, keys)
    row = ovo.first()
    return ovr.withColumns({c: F.lit(row[c]).cast("double") for c in ovo.columns})


def classification_metrics(
    df: DataFrame, y: str, y_pred: str, probabilities: str, classes: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Long form: (keys, metric, value) with macro F1, balanced accuracy and the ROC areas."""
    labels = label_metrics(df, y, y_pred, keys)
    areas = auc_metrics(df, y, probabilities, classes, keys)
    if keys:
        table = join_matching(labels, areas, keys, "left")
    else:
        row = areas.first()
        table = labels.withColumns({c: F.lit(row[c] if row else None).cast("double") for c in areas.columns})
    return to_rows(table, keys)
