"""Read raw records, choose the level of processing, and write feature tables partitioned by queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuescope.functions.cleaning import QUEUES, at_least_minutes, preprocess
from queuescope.plans.features import add_features
from queuescope.plans.prep import sample_fraction
from queuescope.sources.versions import read_parts, write_parts

# Queues that can be asked for by name.
SELECTABLE = ["small", "small-g", "standard", "standard-g"]
LEVELS = ["raw", "preprocess", "with_features"]


def select_queues(raw: DataFrame, queues: str | Sequence[str] = "all") -> DataFrame:
    """All records, or those of one or more queues; the filter is pushed to the Parquet scan."""
    names = [queues] if isinstance(queues, str) else list(queues)
    if "all" in names:
        return raw
    if not set(names) <= set(SELECTABLE):
        raise ValueError(f"queue must be in {SELECTABLE}")
    return raw.where(F.col("Partition") == names[0] if len(names) == 1 else F.col("Partition").isin(*names))


def jobs_from(
    raw: DataFrame,
    queues: str | Sequence[str] = "all",
    level: str = "with_features",
    fraction: float = 1.0,
    resource_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Raw records at the wanted level. A fraction is taken per queue, before cleaning.

    Every resource key of the data becomes a column; ``resource_keys`` fixes the columns, and fails if keys are missing.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be in {LEVELS}")
    rows = sample_fraction(select_queues(raw, queues), fraction, [] if "all" in ([queues] if isinstance(queues, str) else queues) else ["Partition"])
    if level == "raw":
        return rows
    clean = preprocess(rows, resource_keys=resource_keys)
    return clean if level == "preprocess" else add_features(clean)


def get_partition(
    spark: SparkSession, data_path: str, queue: str = "all", level: str = "with_features", fraction: float = 1.0,
    resource_keys: Sequence[str] | None = None,
) -> DataFrame:
    return jobs_from(spark.read.parquet(data_path), queue, level, fraction, resource_keys)


def create_datasets(
    spark: SparkSession,
    queues: Sequence[str],
    data_path: str,
    export_path: str,
    fraction: float = 1.0,
    level: str = "with_features",
    min_wait_minutes: int = 0,
    resource_keys: Sequence[str] | None = None,
) -> list[str]:
    """Write all queues in one job as one committed version, and return the folder of every queue asked for.

    ``all`` stands for every known queue. Queues that are written replace what they had, also if no row is left; those of
    others stay. A queue without rows gets an empty folder.

    Every queue has the same columns. A resource no job of a queue asks for counts as missing there, so it is filled
    like any other missing allocation.
    """
    queues = [queues] if isinstance(queues, str) else list(queues)
    jobs = jobs_from(spark.read.parquet(data_path), queues, level, fraction, resource_keys)
    column = "Partition" if level == "raw" else "partition"
    if level != "raw":
        jobs = at_least_minutes(jobs, min_wait_minutes)
    wanted = QUEUES if "all" in queues else queues
    parts = write_parts(jobs, export_path, [column], [(q,) for q in wanted])
    folders = []
    for queue in wanted:
        folder = parts[(queue,)]
        if folder is None:  # a path that can be read by itself
            folder = f"empty/{column}={queue}"
            spark.createDataFrame([], jobs.schema).write.mode("overwrite").parquet(f"{export_path}/{folder}")
        folders.append(f"{export_path}/{folder}")
    return folders


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """All queues of a written dataset, as its last committed version has them."""
    return read_parts(spark, path)


def read_queue(spark: SparkSession, path: str, queue: str) -> DataFrame:
    """One queue of a written dataset; other queues' folders are not read."""
    return read_parts(spark, path, {0: queue})
