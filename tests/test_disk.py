"""What stays on disk: shuffle files, tables on the way, sweeps of a few levels, rows sent for permutation importance."""

import hashlib
import os
import random
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from queuescope import session
from queuescope.operators import queue_state as state
from queuescope.operators.dominance import add_queue_rank
from queuescope.operators.intervals import REMAINING
from queuescope.plans import prep, training
from queuescope.plans.model_specs import ModelSpec


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in map(str, spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()))
            if os.path.basename(f).startswith("shuffle_") and f.endswith(".data")}


def tables(spark):
    folder = f"{session.work_dir(spark)}/tables".removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def grouped(spark, rows=1000):
    return spark.range(rows).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(session._CLEANUP, None)
    table = session.materialize(grouped(spark))
    for _ in range(50):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session._CLEANUP, None) == setting
    assert table.agg(F.sum("n")).first()[0] == 1000


def test_tables_on_the_way_are_deleted(spark):
    kept = session.materialize(grouped(spark))
    mark, before = session.written_tables(), tables(spark)

    def make():
        inner = session.materialize_last(lambda: session.materialize(grouped(spark)).withColumn("m", F.lit(1)))
        return inner.join(session.materialize(grouped(spark, 70)).select("k", F.col("n").alias("o")), "k")

    table = session.materialize_last(make)
    assert len(tables(spark) - before) == 1 and not before - tables(spark)
    assert table.agg(F.sum("n"), F.sum("o"), F.sum("m")).first() == (1000, 70, 7)
    session.release_tables(spark, since=mark)
    assert tables(spark) == before and kept.count() == 7


def test_a_failure_on_the_way_leaves_the_scope(spark):
    with pytest.raises(ValueError):
        session.materialize_last(lambda: (_ for _ in ()).throw(ValueError("no")))
    assert session._on_the_way.get() is None


def test_a_search_leaves_its_scores_only(spark):
    rows = spark.range(60).selectExpr("id AS job_id", "CAST(id % 2 AS DOUBLE) AS y", "CAST(id % 2 AS DOUBLE) AS a")
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    train = session.materialize(training.add_folds(prep.add_split(rows, 0.2).where("NOT is_test"), 2))
    before = tables(spark)
    spec = ModelSpec("rf", {"n_estimators": [1, 2], "max_depth": [1]}, "classification", folds=2)
    _, scores = training.search(train, spec, "y", 1)
    assert len(tables(spark) - before) == 1
    assert scores.where("metric = 'f1_macro'").count() == 4


def test_levels_swept_apart_give_the_same(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        submit = rnd.randrange(60)
        start = submit + rnd.choice([0, 2, 9])
        rows.append((i, rnd.choice("ab"), submit, submit, start, start + rnd.choice([0, 1, 8]), rnd.randrange(4),
                     rnd.randrange(1, 9), rnd.choice([None, 3, 7])))
    df = spark.createDataFrame(
        rows, "job_id bigint, partition string, submit_ts bigint, eligible_start_ts bigint, start_ts bigint, end_ts bigint,"
        " priority int, allocated_cpu int, allocated_timelimit_seconds bigint",
    )
    ranked = add_queue_rank(df, keys=["partition"], tie_break=["job_id"], out="place")

    def swept(**options):
        out = state.queue_state(ranked, ["allocated_cpu"], keys=["partition"], rank="place", remaining=REMAINING, chunk_bits=3, **options)
        return sorted(map(tuple, out.collect()), key=repr)

    whole, before = swept(), tables(spark)
    assert swept(events_at_once=1) == whole
    assert len(tables(spark) - before) == 1 + 6  # level -1, and one per digit of about 300 / 8 chunks
    assert any(r[-1] for r in whole)


def test_sweeps_hold_every_level_once():
    assert state._sweeps(100, 5, 4, 10**6) == [[-1, 0, 1, 2, 3]]
    assert state._sweeps(100, 5, 4, 1) == [[-1], [0], [1], [2], [3]]
    assert state._sweeps(100, 5, 4, 300) == [[-1], [0, 1], [2, 3]]
    assert state._sweeps(0, 5, 0, 1) == [[-1]]


class Fixed:
    """Predicts 2 a + b."""

    def transform(self, df):
        x = vector_to_array("features")
        return df.withColumn("prediction", 2 * F.get(x, F.lit(0)) + F.get(x, F.lit(1)))


@pytest.mark.parametrize("rows, repeats", [(1, 3), (3, 10), (22, 10), (23, 10), (32, 4)])
def test_permutation_importance_against_brute_force(spark, rows, repeats):
    rnd = random.Random(rows)
    x = [(rnd.random(), float(rnd.randrange(5)), rnd.random()) for _ in range(rows)]
    y = [2 * a + b + c for a, b, c in x]
    df = spark.createDataFrame([(i, *x[i], y[i]) for i in range(rows)], "job_id bigint, a double, b double, c double, y double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    order = sorted(range(rows), key=lambda i: (hashlib.md5(f"{i}_{prep.SEED}".encode()).hexdigest(), i))
    placed, true = np.array([x[i] for i in order]), np.array([y[i] for i in order])

    def r2(values):
        squares, spread = ((true - 2 * values[:, 0] - values[:, 1]) ** 2).sum(), ((true - true.mean()) ** 2).sum()
        return 1 - squares / spread if spread > 0 else float(squares == 0)

    expected = {}
    for f, name in enumerate("abc"):
        drops = []
        for r in range(repeats):
            mixed = placed.copy()
            mixed[:, f] = np.roll(placed[:, f], -((r + 1) * rows // (repeats + 1)))
            drops.append(r2(placed) - r2(mixed))
        expected[name] = np.mean(drops)
    found = training.permutation_importance(Fixed(), df, ["a", "b", "c"], "y", "regression", repeats=repeats)
    assert {r.feature: r.value for r in found.collect()} == pytest.approx(expected, abs=1e-9)


def test_permutation_importance_scores_the_rows_as_they_are_by_themselves(spark):
    """One join with the offsets of the row numbers, none by donor; the first score does not mix any row."""
    df = spark.range(200).selectExpr("id AS job_id", "CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("y", 2 * F.col("a")))
    seen = []

    class Seen(Fixed):
        def transform(self, df):
            seen.append(df)
            return super().transform(df)

    training.permutation_importance(Seen(), df, ["a", "b"], "y", "regression")
    assert [d.count() for d in seen] == [200, 200 * 10 * 2]
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
