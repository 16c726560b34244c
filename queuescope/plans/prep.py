"""Training-set preparation: target limits and classes, log and scale transforms, weights, splits, feature scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queuescope.functions.scalars import clip, edge_bin
from queuescope.operators.relational import to_rows, with_group_values
from queuescope.operators.running import average_ranks, join_matching, row_numbers
from queuescope.session import materialize

SEED = 49  # fixed value

# Lower edges, in minutes, of the target classes.
CLASS_EDGES = {"simple": [15, 60, 120, 240, 480], "binary": [10]}


def adjust_target(df: DataFrame, y: str, lower: float, upper: float) -> DataFrame:
    return df.withColumn(y, clip(y, lower, upper))


def bin_target(df: DataFrame, strategy: str, minutes: str = "wait_time_minutes", out: str = "wait_time_bin"):
    if strategy not in CLASS_EDGES:
        raise ValueError(f"strategy must be one of {sorted(CLASS_EDGES)}")
    return df.withColumn(out, edge_bin(minutes, CLASS_EDGES[strategy]))


def log_transform(df: DataFrame, policy: str, target: Sequence[str], inverse: bool = False) -> DataFrame:
    """log1p, or its inverse limited to zero and up, of the target or of the target and all load columns."""
    if policy == "none":
        return df
    if policy == "only_target":
        columns = list(target)
    elif policy == "all_variables":
        columns = list(target) + [c for c in df.columns if c.startswith(("active", "queued"))]
    else:
        raise ValueError("policy must be one of 'all_variables', 'only_target', 'none'")
    if inverse:
        return df.withColumns({c: clip(F.expm1(c), 0.0) for c in columns})
    return df.withColumns({c: F.log1p(c) for c in columns})


def add_sample_weights(
    df: DataFrame, y: str, method: str = "rank", keys: Sequence[str] = (), out: str = "weight"
) -> DataFrame:
    """Weights that stress high targets, with mean 1 per key.

    Ranks come from the histogram of the target, so a target value that very many rows share is one row there.
    """
    if method == "none":
        return df
    if method == "linear":
        stats = {"_lo": F.min(y), "_hi": F.max(y), "_mean": F.avg(y)}
        spread = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
        weight = 1 + F.try_divide(F.col(y) - F.col("_lo"), spread)
        mean = 1 + F.try_divide(F.col("_mean") - F.col("_lo"), spread)
        return with_group_values(df, keys, stats).withColumn(
            out, F.coalesce(weight / mean, F.lit(1.0))
        ).drop(*stats)
    if method not in ("rank", "aggressive"):
        raise ValueError("method must be one of 'none', 'linear', 'rank', 'aggressive'")
    ranks = with_group_values(average_ranks(df, keys, y, "_rank"), keys, {"_count": F.sum("n_tied")})
    if method == "rank":
        raw = 0.5 + F.col("_rank") / F.col("_count")
    else:
        raw = F.exp(4.0 * F.try_divide(F.col("_rank") - 1, F.col("_count") - 1))
    ranks = ranks.withColumn("_raw", F.coalesce(raw, F.lit(1.0)))
    ranks = with_group_values(ranks, keys, {"_total": F.sum(F.col("_raw") * F.col("n_tied"))})
    weights = ranks.select(*keys, y, (F.col("_raw") * F.col("_count") / F.col("_total")).alias(out))
    return join_matching(df, weights, [*keys, y], "left")


def shuffled(id_column: str, seed: int | str = SEED) -> Column:
    """Order key of a repeatable shuffle."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"_{seed}")))


def sample_fraction(
    df: DataFrame, fraction: float, keys: Sequence[str] = (), id_column: str = "JobIDRaw", seed: int = SEED
) -> DataFrame:
    """Exactly ``floor(n * fraction)`` rows per key, the same ones every time; taken before cleaning."""
    if fraction >= 1.0:
        return df
    # Only the order is sorted and written; the rows themselves are read once more and compared with their key's last place.
    order = F.struct(shuffled(id_column, seed).alias("h"), F.col(id_column).alias("id"), F.xxhash64(*df.columns).alias("row"))
    slim = df.select(*keys, order.alias("_order"))
    numbered = row_numbers(slim, keys, ["_order"], "_row_number", count="_count")
    taken = F.col("_row_number") < F.floor(F.col("_count") * fraction)
    last = materialize(numbered.where(taken).groupBy(*keys).agg(F.max("_order").alias("_last")))
    beyond = join_matching(numbered, last, keys).where(~taken & (F.col("_order") == F.col("_last")))
    placed = join_matching(df.withColumn("_order", order), last, keys)
    if beyond.isEmpty():
        return placed.where("_order <= _last").drop("_order", "_last")
    # Copies of a whole row stand on both sides of the cut: of these only as many as fit are taken.
    fit = join_matching(numbered, last, keys).where(taken & (F.col("_order") == F.col("_last"))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_fit")
    )
    copies = row_numbers(placed.where("_order = _last"), keys, ["_order"], "_copy")
    copies = join_matching(copies, fit, keys).where("_copy < _fit").drop("_copy", "_fit")
    return placed.where("_order < _last").unionByName(copies).drop("_order", "_last")


def add_split(
    df: DataFrame,
    test_size: float = 0.2,
    method: str = "random",
    keys: Sequence[str] = (),
    id_column: str = "job_id",
    start: str = "start_ts",
    seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``, the row's 0-based place ``split_row`` among its part, and the size ``split_rows`` of the part.

    ``random`` tests on the first ceil(n * test_size) rows of a repeatable shuffle; ``timeseries`` trains on the first
    floor(n * (1 - test_size)) rows by start.
    """
    if method == "random":
        order = [shuffled(id_column, seed), F.col(id_column)]
    elif method == "timeseries":
        order = [F.col(start), F.col(id_column)]
    else:
        raise ValueError("method must be 'random' or 'timeseries'")
    numbered = row_numbers(df, keys, order, "_row_number", count="_count")
    row, count = F.col("_row_number"), F.col("_count")
    if method == "random":
        cut = F.ceil(count * test_size)
        is_test = row < cut
        place, size = F.when(row < cut, row).otherwise(row - cut), F.when(row < cut, cut).otherwise(count - cut)
    else:
        cut = F.floor(count * (1 - test_size))
        is_test = row >= cut
        place, size = F.when(row < cut, row).otherwise(row - cut), F.when(row < cut, cut).otherwise(count - cut)
    return numbered.withColumns({"is_test": is_test, "split_row": place, "split_rows": size}).drop(
        "_row_number", "_count"
    )


LARGEST_DOUBLE = 1.7976931348623157e308


def feature_scores(df: DataFrame, y: str, x: Sequence[str], k: int | None = None, keys: Sequence[str] = ()):
    """Univariate F score of every feature, in one pass; ``selected`` marks the best ``k`` (all by default).

    A constant feature scores 0.
    """
    k = len(x) if k is None else min(k, len(x))
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        # corr() divides by zero for a constant feature, so the correlation is put together here.
        *[F.try_divide(F.covar_pop(c, y), F.stddev_pop(c) * F.stddev_pop(y)).alias(c) for c in x],
    )
    r = F.coalesce("r", F.lit(0.0))
    long = to_rows(wide, [*keys, "_n"], "feature", "r", x).withColumn("_r2", r * r)
    score = F.col("_r2") / (1 - F.col("_r2")) * (F.col("_n") - 2)
    best = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("score"), "feature")
    return long.select(
        *keys, "feature", F.when(F.col("_r2") >= 1, F.lit(LARGEST_DOUBLE)).otherwise(score).alias("score")
    ).withColumn("selected", F.row_number().over(best) <= k)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, from one aggregate; a zero deviation counts as 1."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(c).cast("double").alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"std_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"mean_{i}"], row[f"std_{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled_columns(policy: str, y: str, x: Sequence[str]) -> list[str]:
    if policy not in ("all_variables", "only_target", "none"):
        raise ValueError("policy must be one of 'all_variables', 'only_target', 'none'")
    return {"all_variables": [*x, y], "only_target": [y], "none": []}[policy]


def scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mean) / std for c, (mean, std) in scaler.items()})


def unscale(df: DataFrame, scaler: Mapping[str, tuple[float, float]], columns: Mapping[str, str]) -> DataFrame:
    """Undo the scaling; ``columns`` maps columns of ``df`` to the scaler entry they follow."""
    return df.withColumns(
        {c: F.col(c) * scaler[s][1] + scaler[s][0] for c, s in columns.items() if s in scaler}
    )
