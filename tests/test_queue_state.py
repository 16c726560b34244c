"""Active, remaining and queued sums: golden tables and random tables full of ties against brute force."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from queuescope.operators.dominance import add_queue_rank, add_queued
from queuescope.operators.intervals import REMAINING, add_active, add_rolling_count, rolling_counts
from queuescope.operators.queue_state import queue_state
from queuescope.operators.running import asof_join

COLUMNS = (
    "submit_ts eligible_start_ts start_ts end_ts priority allocated_mem allocated_cpu allocated_gpu".split()
)


def golden(spark, rows):
    return spark.createDataFrame(
        [(e, e, s, d, p, 10 * i, i, 0) for i, (e, s, d, p) in enumerate(rows, 1)],
        " bigint, ".join(COLUMNS) + " bigint",
    )


def column(df, name):
    return [r[0] for r in df.orderBy("eligible_start_ts").select(name).collect()]


def test_active_golden(spark):
    df = golden(spark, [(0, 10, 50, 1), (5, 15, 40, 1), (15, 15, 30, 1), (25, 35, 60, 1), (40, 45, 55, 1)])
    out = add_active(df)
    assert column(out, "active_mem") == [0, 0, 30, 60, 50]
    assert column(out, "active_cpu") == [0, 0, 3, 6, 5]


def test_queued_golden(spark):
    df = golden(spark, [(0, 20, 100, 5), (2, 15, 50, 5), (4, 15, 40, 7), (6, 12, 25, 7), (8, 30, 60, 4)])
    out = add_queued(add_active(df))
    assert column(out, "queued_mem") == [0, 10, 0, 30, 100]
    assert column(out, "queued_cpu") == [0, 1, 0, 3, 10]


def tie_table(seed, per_queue=400, nulls=False):
    rnd = random.Random(seed)
    rows = []
    for queue in "ab":
        for _ in range(per_queue):
            submit = rnd.randrange(30)
            eligible = submit + rnd.randrange(3)
            start = eligible + rnd.choice([0, 0, 1, 5, 9])
            end = start + rnd.choice([0, 1, 4, 12])
            rows.append(
                (len(rows), queue, submit, eligible, start, end, rnd.randrange(4), rnd.randrange(1, 9),
                 rnd.randrange(0, 14))
            )
    names = "job_id partition submit_ts eligible_start_ts start_ts end_ts priority allocated_cpu limit".split()
    pdf = pd.DataFrame(rows, columns=names)
    pdf["allocated_mem"] = pdf["allocated_cpu"] / 4
    pdf["allocated_timelimit_seconds"] = pdf.pop("limit")
    pdf["allocated_elapsed_seconds"] = pdf["end_ts"] - pdf["start_ts"]
    return pdf


BRUTE = """
SELECT j.job_id,
  sum(CASE WHEN i.job_id <> j.job_id AND i.start_ts <= j.eligible_start_ts AND j.eligible_start_ts < i.end_ts
      THEN i.allocated_cpu ELSE 0 END)::BIGINT AS active_cpu,
  sum(CASE WHEN i.job_id <> j.job_id AND i.start_ts <= j.eligible_start_ts AND j.eligible_start_ts < i.end_ts
      THEN i.allocated_mem ELSE 0 END) AS active_mem,
  sum(CASE WHEN i.job_id <> j.job_id AND i.start_ts <= j.eligible_start_ts
        AND j.eligible_start_ts < least(i.end_ts, i.start_ts + i.allocated_timelimit_seconds)
      THEN least(i.end_ts, i.start_ts + i.allocated_timelimit_seconds) - j.eligible_start_ts ELSE 0 END)::BIGINT
    AS active_timelimit_seconds_remaining,
  sum(CASE WHEN i.job_id <> j.job_id AND i.start_ts <= j.eligible_start_ts AND j.eligible_start_ts < i.end_ts
      THEN i.end_ts - j.eligible_start_ts ELSE 0 END)::BIGINT AS active_elapsed_seconds_remaining,
  sum(CASE WHEN i.eligible_start_ts <= j.eligible_start_ts AND j.eligible_start_ts < i.start_ts
        AND (i.priority > j.priority OR i.priority = j.priority AND (i.submit_ts, i.job_id) < (j.submit_ts, j.job_id))
      THEN i.allocated_cpu ELSE 0 END)::DOUBLE AS queued_cpu,
  sum(CASE WHEN i.eligible_start_ts <= j.eligible_start_ts AND j.eligible_start_ts < i.start_ts
        AND (i.priority > j.priority OR i.priority = j.priority AND (i.submit_ts, i.job_id) < (j.submit_ts, j.job_id))
      THEN i.allocated_mem ELSE 0 END) AS queued_mem
FROM pdf j JOIN pdf i ON i.partition = j.partition GROUP BY j.job_id ORDER BY j.job_id
"""


@pytest.mark.parametrize("seed,chunk_bits,width", [(1, 16, 86_400), (2, 4, 7), (3, 1, [3, 12]), (4, 6, [1, 5, 10])])
@pytest.mark.parametrize("stamps", [False, True])
def test_ties_against_brute_force(spark, seed, chunk_bits, width, stamps):
    pdf = tie_table(seed)
    expected = duckdb.sql(BRUTE).df()
    df = spark.createDataFrame(pdf)
    if stamps:
        df = df.withColumns({c: F.timestamp_seconds(F.col(c) + 1_700_000_000) for c in df.columns if c.endswith("_ts")})
        width = [w * 1_000_000 for w in ([width] if isinstance(width, int) else width)]
    out = add_active(df, keys=["partition"], remaining=REMAINING, width=width)
    out = add_queued(out, keys=["partition"], tie_break=["job_id"], chunk_bits=chunk_bits, width=width)
    got = out.orderBy("job_id").select(*expected.columns).toPandas()
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)


def test_queue_state_of_empty_input_has_all_columns(spark):
    df = spark.createDataFrame(tie_table(1)).limit(0)
    out = add_queued(add_active(df, keys=["partition"], remaining=REMAINING), keys=["partition"])
    assert {"active_cpu", "active_mem", "queued_cpu", "active_elapsed_seconds_remaining"} <= set(out.columns)
    assert out.count() == 0


@pytest.mark.parametrize("seed, chunk_bits, scale", [(1, 16, None), (2, 1, 1_000_000), (3, 3, 370_001), (4, 5, 1)])
def test_fused_sweep_against_brute_force(spark, seed, chunk_bits, scale):
    """Numbers, whole seconds, and times that are no whole seconds (whose durations are then whole by chance only)."""
    pdf = tie_table(seed)
    if scale == 370_001:
        pdf[["allocated_timelimit_seconds"]] = 1_000_000  # in seconds: no limit at all
    expected = duckdb.sql(BRUTE).df()
    df = spark.createDataFrame(pdf)
    if scale:
        at = {c: F.timestamp_micros(F.col(c) * scale + 1_700_000_000_000_000) for c in df.columns if c.endswith("_ts")}
        df = df.withColumns(at)
    resources = ["allocated_cpu", "allocated_mem"]
    ranked = add_queue_rank(df, keys=["partition"], tie_break=["job_id"], out="place")
    out = queue_state(ranked, resources, keys=["partition"], rank="place", remaining=REMAINING, chunk_bits=chunk_bits)
    got = ranked.select("job_id", "partition", "place").join(out, ["partition", "place"]).orderBy("job_id")
    wanted = list(expected.columns)
    if scale in (1, 370_001):  # seconds to run are those of the stamps
        wanted = [c for c in wanted if not c.endswith("remaining")]
    pd.testing.assert_frame_equal(got.select(*wanted).toPandas(), expected[wanted], check_dtype=False)


def test_fused_sweep_of_no_rows(spark):
    df = spark.createDataFrame(tie_table(1)).withColumn("place", F.lit(0).cast("bigint")).limit(0)
    out = queue_state(df, ["allocated_cpu"], keys=["partition"], rank="place", remaining=REMAINING)
    assert out.count() == 0 and {"active_cpu", "queued_cpu", *REMAINING.values()} <= set(out.columns)


def test_stacked_counts_equal_single_ones(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice("ab"), rnd.choice([1, 1, 1, 2, None]), rnd.choice([1, None, 7]), rnd.randrange(40) * 43_200) for i in range(500)]
    df = spark.createDataFrame(rows, "job_id bigint, queue string, user_id bigint, account_id bigint, submit_ts bigint")
    got = rolling_counts(df, ["queue"], ["queue", "job_id"], {"user_id": "u", "account_id": "a"}, "submit_ts")
    one = add_rolling_count(df, ["queue", "user_id"], "submit_ts", "u")
    both = add_rolling_count(one, ["queue", "account_id"], "submit_ts", "a")
    columns = ["job_id", "queue", "u", "a"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, both.select(*columns).collect()))


def test_one_moment_holding_a_third_of_all_rows(spark):
    pdf = tie_table(9)
    hot = pdf["job_id"] % 3 == 0
    pdf.loc[hot, ["submit_ts", "eligible_start_ts", "start_ts", "end_ts", "priority"]] = [10, 10, 14, 20, 2]
    expected = duckdb.sql(BRUTE).df()
    df = spark.createDataFrame(pdf)
    out = add_active(df, keys=["partition"], remaining=REMAINING, width=4)
    out = add_queued(out, keys=["partition"], tie_break=["job_id"], chunk_bits=5, width=4)
    got = out.orderBy("job_id").select("job_id", "active_cpu", "queued_cpu", "queued_mem").toPandas()
    pd.testing.assert_frame_equal(got, expected[got.columns], check_dtype=False)


def test_rolling_count_against_range_window(spark):
    rnd = random.Random(5)
    day = 86_400
    pdf = pd.DataFrame(
        [(i, rnd.choice([1, 1, 1, 2, None]), rnd.randrange(0, 40) * day // 2) for i in range(600)],
        columns=["job_id", "user_id", "submit_ts"],
    ).astype({"user_id": "Int64"})
    expected = duckdb.sql(
        """SELECT job_id, count(*) OVER (PARTITION BY user_id ORDER BY submit_ts
           RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)::INT AS recent FROM pdf ORDER BY job_id"""
    ).df()
    df = spark.createDataFrame(
        [tuple(None if pd.isna(v) else int(v) for v in r) for r in pdf.itertuples(index=False)],
        "job_id bigint, user_id bigint, submit_ts bigint",
    )
    got = add_rolling_count(df, ["user_id"], "submit_ts", "recent").orderBy("job_id").select("job_id", "recent")
    pd.testing.assert_frame_equal(got.toPandas(), expected, check_dtype=False)


def test_asof_with_ties_and_several_widths(spark):
    rnd = random.Random(8)
    left = pd.DataFrame([(i, rnd.randrange(2), rnd.randrange(-50, 50)) for i in range(300)], columns=["id", "k", "t"])
    right = pd.DataFrame([(i, rnd.randrange(2), rnd.randrange(-40, 60)) for i in range(60)], columns=["rid", "k", "t"])
    expected = duckdb.sql(
        """SELECT l.id, r.rid FROM left l ASOF LEFT JOIN (SELECT k, t, max(rid) AS rid FROM right GROUP BY ALL) r
           ON l.k = r.k AND l.t >= r.t ORDER BY l.id""".replace("FROM left", 'FROM "left"').replace("FROM right", 'FROM "right"')
    ).df()
    for width in (7, [2, 10], [3, 6, 30]):
        got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", {"rid": "rid"},
                        tie_break=["rid"], width=width).orderBy("id").select("id", "rid")
        pd.testing.assert_frame_equal(got.toPandas(), expected, check_dtype=False)
