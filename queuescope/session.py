"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The results of a sweep are joined back to the rows that asked for them. One moment may be asked for by a
    # large share of all rows, so that join must be splittable even if it costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Methods above this size are not compiled to machine code; wide projections are faster cut into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Event rows are mostly zeros and compress very well, so a partition that is small on disk is not small to process.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128kb",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator here relies on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "queuescope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables: the session's ``spark.checkpoint.dir``.

    Only a session in one process (master ``local`` or ``local[...]``) without that setting gets a temporary folder;
    everywhere else the setting is required, because other machines do not see a folder on this one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="queuescope-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but as Parquet, so later reads prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tables/{uuid.uuid4().hex}"
    with _shuffles_end_with_writes(spark):
        df.write.parquet(path)
    _written.append(path)
    on_the_way = _on_the_way.get()
    if on_the_way is not None:
        on_the_way.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_last(make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`materialize` what ``make`` returns, and delete the tables that were written on the way to it.

    Only for tables that ``make`` writes itself and nothing but its result reads: no lazy frame of them may be kept. Threads
    that ``make`` starts belong to it if they run in a copy of its context.
    """
    paths: list[str] = []
    outer = _on_the_way.set(paths)
    try:
        table = materialize(make())
    finally:
        _on_the_way.reset(outer)
    *passed, last = paths
    for path in passed:
        _written[_written.index(path)] = ""  # keeps the place, so that marks stay valid
        _delete(table.sparkSession, path)
    if (further_out := _on_the_way.get()) is not None:
        further_out.append(last)
    return table


_written: list[str] = []
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)

# What a write shuffles is never read again, but its files stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers: dict[str, tuple[int, str | None]] = {}
_writers_lock = threading.Lock()


@contextmanager
def _shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files at their end. The last of several threads puts the setting back."""
    session = spark._jsparkSession.sessionUUID()
    with _writers_lock:
        count, before = _writers.get(session) or (0, spark.conf.get(_CLEANUP, None))
        _writers[session] = (count + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _writers_lock:
            count, before = _writers.pop(session)
            if count > 1:
                _writers[session] = (count - 1, before)
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def written_tables() -> int:
    """A mark for :func:`release_tables`: how many tables have been written so far."""
    return len(_written)


def release_tables(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written after the mark ``since``. Call it once no result that reads them is needed any more."""
    while len(_written) > since:
        if path := _written.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
