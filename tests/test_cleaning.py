"""Cleaning steps and resource columns on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from queuescope.functions import cleaning, resources
from queuescope.sources.datasets import create_datasets, get_partition, read_queue, select_queues

SCHEMA = """Account bigint, UID bigint, ReservationId bigint, JobIDRaw bigint, Priority bigint, Partition string,
State string, Submit timestamp, Eligible timestamp, Start timestamp, End timestamp, ElapsedRaw bigint,
TimelimitRaw bigint, AllocTRES string"""
T0 = dt.datetime(2024, 5, 3, 10, 0, 0)


def raw(spark, *changes):
    base = dict(
        Account=1, UID=2, ReservationId=None, JobIDRaw=10, Priority=5, Partition="small", State="COMPLETED", Submit=T0,
        Eligible=T0, Start=T0 + dt.timedelta(seconds=150), End=T0 + dt.timedelta(hours=1), ElapsedRaw=3450,
        TimelimitRaw=120, AllocTRES="billing=8,cpu=8,mem=64G,node=1",
    )
    rows = [{**base, **c} for c in changes]
    return spark.createDataFrame([tuple(r[k] for k in base) for r in rows], SCHEMA)


def test_parse_input_drops_duplicates_nulls_and_unknown_queues(spark):
    df = raw(spark, {}, {}, {"JobIDRaw": 11, "Start": None}, {"JobIDRaw": 12, "Partition": "debug"},
             {"JobIDRaw": 13, "Account": None}, {"JobIDRaw": 14, "AllocTRES": None})
    kept = cleaning.parse_input(df)
    assert sorted(r.job_id for r in kept.collect()) == [10, 13]
    assert kept.columns == list(cleaning.COLUMN_NAMES.values())


def test_target_rounds_half_to_even_and_drops_negative_waits(spark):
    waits = [0, 29, 30, 89, 90, 150, 299, 300, 115_199, 115_200, -1]
    df = raw(spark, *[{"JobIDRaw": i, "Start": T0 + dt.timedelta(seconds=w)} for i, w in enumerate(waits)])
    rows = cleaning.add_target(cleaning.parse_input(df)).orderBy("job_id").collect()
    assert [r.wait_time_seconds for r in rows] == waits[:-1]
    assert [r.wait_time_minutes for r in rows] == [0, 0, 0, 1, 2, 2, 5, 5, 1920, 1920]
    assert [r.wait_time_bin for r in rows] == [0, 0, 0, 0, 0, 0, 0, 1, 8, 9]


def test_state_and_calendar(spark):
    df = cleaning.parse_input(raw(spark, {"State": "CANCELLED by 77"}))
    row = df.transform(cleaning.handle_cancellations).transform(cleaning.add_calendar_keys).first()
    assert (row.state, row.year_month, row.year_month_id, row.year_id, row.day_id) == (
        "CANCELLED", "2024-05", 202405, 2024, 20240503)
    assert row.allocated_timelimit_seconds == 7200


def unpacked(spark, text, **options):
    df = spark.createDataFrame([(text,)], "allocated_resources string")
    return resources.unpack(df, **options).first().asDict()


def test_unpack_units_and_first_entry(spark):
    row = unpacked(spark, "billing=8,cpu=4,mem=2T,gres/gpu:mi250=8,gres/gpu=4,energy=7")
    assert row == {"consumed_billing": 8.0, "allocated_cpu": 4.0, "consumed_energy": 7.0, "allocated_gpu": 8.0,
                   "allocated_mem": 2048.0, "allocated_node": None}
    assert unpacked(spark, "mem=512M")["allocated_mem"] == 0.5
    assert unpacked(spark, "xmem=3,mem=64G,mem=1G")["allocated_mem"] == 64.0
    assert unpacked(spark, "")["allocated_cpu"] is None


def test_unpack_bad_number(spark):
    assert unpacked(spark, "cpu=12K", strict=False)["allocated_cpu"] is None
    with pytest.raises(PySparkException):
        unpacked(spark, "cpu=12K")


def test_discovered_keys_and_long_form_agree(spark):
    df = spark.createDataFrame(
        [(1, "cpu=1,mem=2G"), (2, "cpu=3,fs=a=b"), (3, "node=2,,gres/x=1")], "job_id int, allocated_resources string"
    )
    assert resources.discover_keys(df) == ["cpu", "fs", "gpu", "mem", "node"]
    wide = resources.unpack(df, keys=None, strict=False).orderBy("job_id").collect()
    long = resources.pivot_entries(resources.entries(df, strict=False), ["job_id"], ["cpu", "gpu", "mem", "node"])
    for a, b in zip(wide, long.orderBy("job_id").collect()):
        assert [a.allocated_cpu, a.allocated_gpu, a.allocated_mem, a.allocated_node] == [b.cpu, b.gpu, b.mem, b.node]


def test_fill_leaves_consumed_alone(spark):
    df = spark.createDataFrame([(None, float("nan"), None)], "allocated_a bigint, allocated_b double, consumed_c double")
    assert tuple(cleaning.fill_empty_allocations(df).first()) == (1, 1.0, None)


def test_queue_selection(spark):
    df = raw(spark, {}, {"JobIDRaw": 11, "Partition": "standard"}, {"JobIDRaw": 12, "Partition": "lumid"})
    assert select_queues(df).count() == 3
    assert select_queues(df, "standard").count() == 1
    with pytest.raises(ValueError):
        select_queues(df, "lumid")


def test_queue_filter_reaches_the_scan(spark, tmp_path):
    raw(spark, {}, {"JobIDRaw": 11, "Partition": "standard"}).write.parquet(f"{tmp_path}/raw")
    plan = get_partition(spark, f"{tmp_path}/raw", "standard", "preprocess")._jdf.queryExecution().toString()
    assert "EqualTo(Partition,standard)" in plan


def test_create_datasets_writes_one_folder_per_queue(spark, tmp_path):
    start = T0 + dt.timedelta(minutes=30)
    raw(spark, {}, {"JobIDRaw": 11, "Partition": "standard", "Start": start}, {"JobIDRaw": 12, "Partition": "standard"}
        ).write.parquet(f"{tmp_path}/raw")
    paths = create_datasets(spark, ["small", "standard"], f"{tmp_path}/raw", f"{tmp_path}/out", min_wait_minutes=10)
    assert [spark.read.parquet(p).count() for p in paths] == [0, 1]  # no job of the first queue waited that long
    row = read_queue(spark, f"{tmp_path}/out", "standard").select("job_id", "queued_node", "partition").collect()
    # Job 12 left the table by its short wait but was still seen; its removal happens at its own start.
    assert [(r.job_id, r.partition) for r in row] == [(11, "standard")]


def test_rows_keep_their_features_when_short_waits_are_removed(spark):
    from queuescope.plans.features import add_features

    long_wait = {"JobIDRaw": 12, "Start": T0 + dt.timedelta(minutes=40), "Submit": T0 + dt.timedelta(seconds=2),
                 "Eligible": T0 + dt.timedelta(seconds=2)}
    jobs = add_features(cleaning.preprocess(raw(spark, {}, long_wait)))
    kept = cleaning.at_least_minutes(jobs, 10).collect()
    assert [(r.job_id, r.queued_cpu, r.queued_mem) for r in kept] == [(12, 8.0, 64.0)]
    assert not [c for c in jobs.columns if c.startswith(("_", "allocated_count"))]
    assert jobs.where(F.col("count_user_submitted_jobs_7d") == 1).count() == 1


def test_reruns_replace_with_nothing_and_failed_ones_change_nothing(spark, tmp_path):
    from queuescope.sources import versions
    from queuescope.sources.datasets import read_dataset

    raw(spark, {}, {"JobIDRaw": 11, "Partition": "standard"}).write.parquet(f"{tmp_path}/raw")
    out = f"{tmp_path}/out"
    create_datasets(spark, ["small", "standard"], f"{tmp_path}/raw", out, level="preprocess")
    assert read_dataset(spark, out).count() == 2
    paths = create_datasets(spark, ["small"], f"{tmp_path}/raw", out, level="preprocess", min_wait_minutes=10**6)
    assert spark.read.parquet(paths[0]).count() == 0
    assert [r.partition for r in read_dataset(spark, out).collect()] == ["standard"]
    assert read_queue(spark, out, "small").count() == 0 and "job_id" in read_queue(spark, out, "small").columns

    before = versions.manifest(spark, out)
    broken = read_dataset(spark, out).withColumn("job_id", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        versions.write_parts(broken, out, ["partition"])
    assert versions.manifest(spark, out) == before
    (tmp_path / "out/manifests/0000000009.json").write_text('{"parts": [')  # a writer that was lost while it committed
    assert read_dataset(spark, out).count() == 1
    versions.write_parts(read_dataset(spark, out).withColumn("extra", F.lit(1)).withColumn("partition", F.lit("a/b=c %")), out, ["partition"])
    assert versions.manifest(spark, out)[0] == 10
    assert sorted((r.partition, r.extra) for r in read_dataset(spark, out).collect()) == [("a/b=c %", 1), ("standard", None)]
    assert versions.remove_old(spark, out) == 2  # the first version still holds the standard queue
    assert read_dataset(spark, out).count() == 2


def test_keys_of_many_shapes_are_found(spark):
    texts = [",".join(f"k{i}={i}" for i in range(1000)), "cpu=1,gres/gpu:a=2,gres=1", "", "plain,x==1,=5", None]
    rows = spark.createDataFrame([(t,) for t in texts], "allocated_resources string")
    assert set(resources.discover_keys(rows)) == {*(f"k{i}" for i in range(1000)), "cpu", "gpu", "plain", "x", ""}
