"""Train and tune wait-time models with Spark ML.

Data stays in DataFrames. The prepared rows are written once and every fit reads them; all candidates of a search are
scored in one plan over their joint predictions.
"""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queuescope.operators.relational import to_rows
from queuescope.operators.running import row_numbers
from queuescope.plans import prep
from queuescope.plans.metrics import (
    classification_metrics,
    error_aggregates,
    regression_metrics,
)
from queuescope.plans.model_specs import ModelSpec
from queuescope.session import materialize, materialize_last
from queuescope.sources import results

DEEPEST_TREE = 30  # largest depth Spark ML accepts
CONCURRENT_FITS = 3  # candidates of a search that are fitted at the same time
SCORES = {
    "regression": ["mae", "mape", "rmse", "r2"],
    "classification": ["f1_macro", "balanced_accuracy", "roc_auc"],
}
REFIT = {"regression": "mae", "classification": "f1_macro"}


# --------------------------------------------------------------------------------------------------------- estimators


def _subset(share: Any) -> str:
    return "all" if share is None else str(share)


def _depth(depth: int | None) -> int:
    """No depth means the deepest tree there is; a larger number than that is refused."""
    if depth is None:
        return DEEPEST_TREE
    if int(depth) > DEEPEST_TREE:
        raise ValueError(f"max_depth is {DEEPEST_TREE} at most")
    return int(depth)


# How a parameter of the usual Python estimators is called here, per family.
PARAMETERS = {
    "rf": {
        "n_estimators": ("numTrees", int),
        "max_depth": ("maxDepth", _depth),
        "min_samples_leaf": ("minInstancesPerNode", int),
        "criterion": ("impurity", lambda c: "entropy" if c == "log_loss" else c),
        "max_features": ("featureSubsetStrategy", _subset),
    },
    "xgb": {
        "n_estimators": ("maxIter", int),
        "learning_rate": ("stepSize", float),
        "subsample": ("subsamplingRate", float),
        "max_depth": ("maxDepth", _depth),
        "gamma": ("minInfoGain", float),
        "min_child_weight": ("minInstancesPerNode", int),
        "colsample_bytree": ("featureSubsetStrategy", _subset),
    },
    "mlp": {"max_iter": ("maxIter", int), "learning_rate_init": ("stepSize", float)},
}


def build_estimator(
    spec: ModelSpec, params: Mapping[str, Any], label: str, features: int, classes: int = 2, weight: str | None = None
):
    """Spark ML estimator for a parameter set; columns are ``features``, ``label`` and optionally the weight."""
    known = PARAMETERS.get(spec.family)
    if known is None or (spec.family == "mlp" and spec.task == "regression"):
        raise ValueError(f"no {spec.task} model '{spec.family}'")
    values = {**spec.fixed, **params}
    layers = values.pop("hidden_layer_sizes", (10,))
    options = {known[p][0]: known[p][1](v) for p, v in values.items()}
    if spec.family == "mlp" and "stepSize" in options:
        options["solver"] = "gd"  # the default solver has no step size
    columns = {"featuresCol": "features", "labelCol": label, "seed": spec.seed}
    if weight and spec.family != "mlp":
        columns["weightCol"] = weight
    if spec.task == "regression":
        kind = RandomForestRegressor if spec.family == "rf" else GBTRegressor
        return kind(**columns, **options)
    if spec.family == "rf":
        return RandomForestClassifier(**columns, **options)
    if spec.family == "mlp":
        return MultilayerPerceptronClassifier(**columns, layers=[features, *layers, classes], **options)
    boosted = GBTClassifier(**columns, **options)
    if classes == 2:
        return boosted
    return OneVsRest(classifier=boosted, featuresCol="features", labelCol=label, weightCol=weight)


def as_probabilities(predicted: DataFrame, classes: int) -> Column:
    """Class probabilities as an array; one-versus-rest gives margins, which are mapped to shares."""
    if "probability" in predicted.columns:
        return vector_to_array("probability")
    margins = vector_to_array("rawPrediction")
    odds = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    return F.transform(odds, lambda o: o / total)


# ------------------------------------------------------------------------------------------------------------- search


def grid_of(spec: ModelSpec) -> list[dict[str, Any]]:
    names = list(spec.grid)
    if any(hasattr(v, "draw") for v in spec.grid.values()):
        raise ValueError("a grid search needs lists of values")
    return [dict(zip(names, values)) for values in product(*spec.grid.values())]


def candidates(spec: ModelSpec) -> list[dict[str, Any]]:
    """Parameter sets to try. A random search over lists only that has no more members than draws is the whole grid."""
    if spec.search in ("grid", "halving"):
        return grid_of(spec)
    if spec.search != "random":
        raise ValueError(f"unknown search '{spec.search}'")
    source = random.Random(spec.seed)
    if not any(hasattr(v, "draw") for v in spec.grid.values()):
        grid = grid_of(spec)
        return grid if len(grid) <= spec.draws else source.sample(grid, spec.draws)

    def draw(values: Any) -> Any:
        return values.draw(source) if hasattr(values, "draw") else source.choice(list(values))

    return [{name: draw(values) for name, values in spec.grid.items()} for _ in range(spec.draws)]


def add_folds(
    train: DataFrame, folds: int, strategy: str = "kfold", label: str | None = None, place: str = "split_row",
    size: str = "split_rows",
) -> DataFrame:
    """Add ``fold``, from the place of a row among the training rows.

    ``kfold`` cuts equal runs (per class if ``label`` is given). ``timeseries`` numbers equal test blocks at the end
    and gives -1 to the rows before them; fold i trains on everything before block i.
    """
    if strategy == "timeseries":
        block = F.floor(F.col(size) / (folds + 1))
        fold = F.greatest(F.floor((F.col(place) - (F.col(size) - folds * block)) / block), F.lit(-1))
        return train.withColumn("fold", fold.cast("int"))
    if label:
        train = row_numbers(train, [label], [place], "_place", count="_size")
        place, size = "_place", "_size"
    base, more = F.floor(F.col(size) / folds), F.pmod(F.col(size), F.lit(folds))
    longer = more * (base + 1)
    fold = F.when(F.col(place) < longer, F.floor(F.col(place) / (base + 1))).otherwise(
        more + F.floor((F.col(place) - longer) / F.greatest(base, F.lit(1)))
    )
    return train.withColumn("fold", fold.cast("int")).drop("_place", "_size")


def fold_parts(train: DataFrame, strategy: str, fold: int) -> tuple[DataFrame, DataFrame]:
    held_out = F.col("fold") == fold
    rest = F.col("fold") < fold if strategy == "timeseries" else F.col("fold") != fold
    return train.where(rest), train.where(held_out)


def score_candidates(
    train: DataFrame, spec: ModelSpec, tried: Mapping[int, Mapping[str, Any]], label: str, features: int, classes: int,
    weight: str | None,
) -> DataFrame:
    """(candidate, fold, metric, value) for the given candidates. Larger is better: errors are negative.

    A few candidates are fitted at a time. The predictions of each are written and its models let go, so neither the driver
    nor the plan grows with the number of candidates.
    """

    def predictions_of(candidate: tuple[int, Mapping[str, Any]]) -> DataFrame:
        number, params = candidate
        parts = []
        for fold in range(spec.folds):
            rest, held_out = fold_parts(train, spec.fold_strategy, fold)
            model = build_estimator(spec, params, label, features, classes, weight).fit(rest)
            predicted = model.transform(held_out)
            columns = [F.col(label).cast("double").alias("y"), F.col("prediction").alias("p")]
            if spec.task == "classification":
                columns.append(as_probabilities(predicted, classes).alias("probabilities"))
            parts.append(predicted.select(F.lit(number).alias("candidate"), F.lit(fold).alias("fold"), *columns))
        return materialize(reduce(DataFrame.unionByName, parts))

    with ThreadPoolExecutor(CONCURRENT_FITS) as pool:
        contexts = [copy_context() for _ in tried]  # what a thread writes belongs to the search
        fits = pool.map(lambda context, candidate: context.run(predictions_of, candidate), contexts, tried.items())
        joint = reduce(DataFrame.unionByName, list(fits))
    keys = ["candidate", "fold"]
    if spec.task == "regression":
        errors = error_aggregates("y", "p")
        wide = joint.groupBy(*keys).agg(
            (-errors["mean_ae"]).alias("mae"), (-errors["mape"]).alias("mape"), (-errors["rmse"]).alias("rmse"),
            errors["r2"].alias("r2"),
        )
        return to_rows(wide, keys)
    long = classification_metrics(joint, "y", "p", "probabilities", classes, keys)
    name = F.col("metric")
    return long.withColumn(
        "metric", F.when(name == "f1", "f1_macro").when(name == "roc_auc_weighted_ovr", "roc_auc").otherwise(name)
    ).where(F.col("metric").isin(*SCORES["classification"]))


def best_of(scores: DataFrame, metric: str, keep: int = 1) -> list[int]:
    """Best candidates by their mean score (one row per candidate comes to the driver)."""
    means = scores.where(F.col("metric") == metric).groupBy("candidate").agg(F.avg("value").alias("v"))
    return [r[0] for r in means.orderBy(F.desc("v"), "candidate").limit(keep).collect()]


def search(
    train: DataFrame, spec: ModelSpec, label: str, features: int, classes: int = 2, weight: str | None = None
) -> tuple[dict[str, Any], DataFrame]:
    """Best parameters and the scores (round, candidate, params, fold, metric, value) of everything tried.

    Halving scores all candidates on a share of the rows, keeps the best third (rounded up) and triples the rows, until
    the last round uses all rows. Other searches have one round, 0.
    """
    spark = train.sparkSession
    tried = dict(enumerate(candidates(spec)))
    shown = spark.createDataFrame(
        [(n, {k: str(v) for k, v in params.items()}) for n, params in tried.items()],
        "candidate int, params map<string,string>",
    )
    metric = REFIT[spec.task]
    if spec.search != "halving":
        scores = materialize_last(lambda: score_candidates(train, spec, tried, label, features, classes, weight))
        best = best_of(scores, metric)[0]
        scores = scores.withColumn("round", F.lit(0))
    else:
        rounds, left = 1, len(tried)
        while left >= 3:
            rounds, left = rounds + 1, left // 3
        remaining, parts = dict(tried), []
        for step in range(rounds):
            share = 3 ** (rounds - 1 - step)
            rows = train.where(F.pmod(F.xxhash64("split_row"), F.lit(share)) == 0) if share > 1 else train
            scores = materialize_last(lambda: score_candidates(rows, spec, remaining, label, features, classes, weight))
            parts.append(scores.withColumn("round", F.lit(step)))
            order = best_of(scores, metric, -(-len(remaining) // 3) if step < rounds - 1 else 1)
            best, remaining = order[0], {n: remaining[n] for n in order}
        scores = reduce(DataFrame.unionByName, parts)
    return tried[best], scores.join(shown, "candidate")


def cv_results(scores: DataFrame, task: str, keys: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """One row per round and candidate: scores per fold, their mean and deviation, the rank by mean, the parameters."""
    keys = [*keys, "round"] if "round" in scores.columns else list(keys)
    searched = {}
    if "params" in scores.columns:  # one column per searched parameter; a search has a handful of them
        names = scores.select(F.explode(F.map_keys("params")).alias("name")).distinct().collect()
        searched = {f"param_{r['name']}": F.col("params")[r["name"]] for r in sorted(names)}
    spread = scores.withColumns(searched).groupBy(*keys, "candidate", "params_text", *searched).pivot("metric", SCORES[task])
    picks = [F.max(F.when(F.col("fold") == f, F.col("value"))).alias(f"split{f}_test") for f in range(folds)]
    wide = spread.agg(F.avg("value").alias("mean_test"), F.stddev_pop("value").alias("std_test"), *picks)
    names = {}
    for metric in SCORES[task]:
        for column in ["mean_test", "std_test", *[f"split{f}_test" for f in range(folds)]]:
            names[f"{metric}_{column}"] = f"{column}_{metric}"
    wide = wide.withColumnsRenamed(names)
    # One row per candidate: a window over a table of search results.
    for metric in SCORES[task]:
        order = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(f"mean_test_{metric}"))
        wide = wide.withColumn(f"rank_test_{metric}", F.rank().over(order))
    return wide.orderBy(*keys, f"rank_test_{REFIT[task]}", "candidate")


def with_params_text(scores: DataFrame) -> DataFrame:
    """Maps cannot be grouped: parameters as ordered JSON text."""
    return scores.withColumn("params_text", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params")))))


# ---------------------------------------------------------------------------------------------------------- importance


def tree_importance(spark: SparkSession, model: Any, x: Sequence[str]) -> DataFrame:
    parts = model.models if hasattr(model, "models") else [model]
    rows = [m.featureImportances.toArray() for m in parts]
    values = [float(sum(r[i] for r in rows) / len(rows)) for i in range(len(x))]
    return spark.createDataFrame(list(zip(x, values)), "feature string, value double").orderBy(
        F.desc("value"), "feature"
    )


def permutation_importance(
    model: Any, df: DataFrame, x: Sequence[str], y: str, task: str, id_column: str = "job_id", repeats: int = 10,
    seed: int = prep.SEED,
) -> DataFrame:
    """Mean drop of R² (or accuracy) when one feature takes its values from another row.

    The rows are put in the order of a repeatable shuffle once. In each repeat a row's donor stands a fixed number of places
    further on, another number each time. A row is scored once per feature and repeat, with that feature replaced; rows,
    features and repeats are one plan, and nothing is gathered.

    The steps cut the places into ``repeats + 1`` runs of one length, give or take one. Places equally far into their runs
    are each other's donors, so a row is sent once or twice to a group of that size, not once per repeat.
    """
    slim = df.select(F.col(id_column), F.col(y).cast("double").alias("_y"), vector_to_array("features").alias("_x"))
    placed = row_numbers(slim, [], [prep.shuffled(id_column, seed), F.col(id_column)], "_place")
    rows, runs = max(placed.count(), 1), repeats + 1
    steps = [(r + 1) * rows // runs for r in range(repeats)]

    def into(place: str) -> str:
        """How far a place is into its run; run k begins at floor(k * rows / runs)."""
        return f"({place} - (((({place} + 1) * {runs}L - 1) div {rows}L) * {rows}L) div {runs}L)"

    asked_by = [into(f"pmod(_place - {step}L, {rows}L)") for step in steps]
    groups = F.expr(f"array_distinct(array({', '.join([into('_place'), *asked_by])}))")
    members = placed.select("_place", "_y", "_x", F.explode(groups).alias("_group")).groupBy("_group").agg(
        F.collect_list(F.struct("_place", "_y", "_x")).alias("_rows")
    )
    donor = f"filter(_rows, d -> d._place = pmod(m._place + step, {rows}L))[0]._x"
    mixes = f"transform(array({', '.join(f'{step}L' for step in steps)}), (step, r) -> struct(r AS _repeat, m._y AS _y, m._x AS _x, {donor} AS _donor))"
    mixed = members.select(
        F.inline(F.expr(f"flatten(transform(filter(_rows, m -> {into('m._place')} = _group), m -> {mixes}))"))
    )
    features = F.explode(F.sequence(F.lit(0), F.lit(len(x) - 1))).alias("_f")
    replaced = F.expr("transform(_x, (v, i) -> IF(i = _f, _donor[i], v))")
    vectors = mixed.select("*", features).select("_repeat", "_f", "_y", array_to_vector(replaced).alias("features"))
    as_they_are = df.select(F.lit(-1).alias("_repeat"), F.lit(-1).alias("_f"), F.col(y).cast("double").alias("_y"), "features")
    if task == "regression":
        score = error_aggregates("_y", "prediction")["r2"]
    else:
        score = F.avg((F.col("_y") == F.col("prediction")).cast("int"))

    def scored(rows: DataFrame) -> DataFrame:
        return model.transform(rows).groupBy("_repeat", "_f").agg(score.alias("_score"))

    # Of its own: in one plan with the mixed rows it would make all of these first.
    base = scored(as_they_are).select("_score").first()[0]
    names = F.array(*[F.lit(c) for c in x])
    return (
        scored(vectors)
        .groupBy(F.get(names, F.col("_f")).alias("feature"))
        .agg(F.avg(F.lit(base) - F.col("_score")).alias("value"))
        .orderBy(F.desc("value"), "feature")
    )


# ---------------------------------------------------------------------------------------------------------------- runs


@dataclass
class RunResult:
    """Everything one run produces, as DataFrames, plus the fitted model and its parameters."""

    feature_selection: DataFrame
    cv_scores: DataFrame
    feature_importance: DataFrame
    accuracy: DataFrame
    predictions: DataFrame
    model: Any
    params: dict[str, Any]


def predict(
    df: DataFrame, y: str, x: Sequence[str], spec: ModelSpec, *, test_size: float = 0.2, split: str = "random",
    bins: str = "binary", k: int | None = None, id_column: str = "job_id",
) -> RunResult:
    """Prepare the rows of one queue, tune and fit a model, and score it on the held-out rows.

    Features and target are scored in one space: predictions are brought back to the unit of the target, and
    permutation importance stays in the space the model was fitted in. Rows that are split already (by
    ``prep.add_split``) keep their split, so the runs of a queue can share one.
    """
    spark = df.sparkSession
    task = spec.task
    rows = prep.adjust_target(df, y, spec.lower, spec.upper)
    rows = prep.bin_target(rows, bins)
    if task == "classification" and y != "wait_time_bin":
        raise ValueError("classification predicts wait_time_bin")
    rows = rows.withColumns({c: F.col(c).cast("double") for c in [*x, y]})
    rows = prep.log_transform(rows, spec.log_policy, [y] if task == "regression" else [])
    selection = prep.feature_scores(rows, y, x, k)
    chosen = list(x)
    if k is not None and k < len(x):
        best = {r[0] for r in selection.where("selected").select("feature").collect()}
        chosen = [c for c in x if c in best]
    parts = [c for c in ("is_test", "split_row", "split_rows") if c in df.columns]
    slim = rows.select(*dict.fromkeys([id_column, "start_ts", *chosen, y, *parts]))
    rows = materialize_last(lambda: slim if parts else prep.add_split(slim, test_size, split, id_column=id_column))

    scaler = {}
    if task == "regression" or spec.scaling == "all_variables":
        wanted = [c for c in prep.scaled_columns(spec.scaling, y, chosen) if task == "regression" or c != y]
        scaler = prep.fit_scaler(rows.where("NOT is_test"), wanted)
        rows = prep.scale(rows, scaler)
    rows = VectorAssembler(inputCols=chosen, outputCol="features", handleInvalid="error").transform(rows)
    rows = rows.drop(*[c for c in chosen if c != y])
    fitted, test = rows.where("NOT is_test"), rows.where("is_test")
    weight = "weight" if spec.weights != "none" and spec.family != "mlp" else None

    def folded() -> DataFrame:
        weighted = prep.add_sample_weights(fitted, y, spec.weights, out=weight) if weight else fitted
        return add_folds(weighted, spec.folds, spec.fold_strategy, label=y if task == "classification" else None)

    train = materialize_last(folded)
    classes = 2
    if task == "classification":
        classes = len(prep.CLASS_EDGES[bins]) + 1
    params, scores = search(train, spec, y, len(chosen), classes, weight)
    model = build_estimator(spec, params, y, len(chosen), classes, weight).fit(train)

    predicted = model.transform(test)
    columns = {"y_true": F.col(y), "y_pred": F.col("prediction")}
    if task == "classification":
        columns["probabilities"] = as_probabilities(predicted, classes)
    out = predicted.select(id_column, *[c.alias(n) for n, c in columns.items()])
    if task == "regression":
        out = prep.unscale(out, scaler, {"y_true": y, "y_pred": y})
        if spec.log_policy != "none":
            out = out.withColumns({c: F.expm1(c) for c in ("y_true", "y_pred")})
    out = materialize(out)
    if task == "regression":
        accuracy = regression_metrics(out, "y_true", "y_pred", unit=y)
    else:
        accuracy = classification_metrics(out, "y_true", "y_pred", "probabilities", classes)
    if spec.permutation_importance or spec.family == "mlp":
        importance = permutation_importance(model, test, chosen, y, task, id_column, seed=spec.seed)
    else:
        importance = tree_importance(spark, model, chosen)
    return RunResult(selection, scores, importance, accuracy, out.drop("probabilities"), model, params)


def train_models(
    datasets: Mapping[str, DataFrame], plan: Mapping[str, Mapping[str, Sequence[str]]],
    feature_sets: Mapping[str, Mapping[str, Sequence[str]]], specs: Mapping[str, ModelSpec], *, run_id: str,
    export_path: str, y: str = "wait_time_seconds", test_size: float = 0.2, split: str = "random",
    bins: str = "binary", save_models: bool = True,
) -> str:
    """Run every queue x model x feature set of ``plan`` and append the results to the tables in ``export_path``.

    ``plan`` maps a queue to its ``models`` and ``feature_sets``; ``datasets`` maps it to its feature table.
    """
    spark = None
    for queue, todo in plan.items():
        spark = datasets[queue].sparkSession
        df = prep.add_split(datasets[queue], test_size, split)  # written once, shared by all runs of the queue
        for model in todo["models"]:
            for name in todo["feature_sets"]:
                run = predict(
                    df, y, feature_sets[queue][name], specs[model], test_size=test_size, split=split, bins=bins
                )
                keys = dict(zip(results.RUN_KEYS, [run_id, queue, model, name]))
                for table in results.TABLES:
                    rows = getattr(run, table)
                    if table == "cv_scores":
                        rows = rows.select("round", "candidate", "params", "fold", "metric", "value")
                    rows = rows.select(*[F.lit(v).alias(k) for k, v in keys.items()], "*")
                    results.write_table(export_path, table, rows, keys)
                if save_models:
                    results.write_model(export_path, keys, run.model)
    if spark is not None:
        described = {m: asdict(s) for m, s in specs.items()}
        results.write_run(
            spark, export_path, run_id, json.dumps({q: dict(s) for q, s in feature_sets.items()}),
            json.dumps(described, default=str),
        )
    return export_path
