"""Queries for joins, aggregates, windows, set operators and reshaping on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuescope.functions.cleaning import select_renamed
from queuescope.operators import relational
from queuescope.operators.running import (
    asof_join,
    average_ranks,
    exact_quantiles,
    row_numbers,
    running_total,
    sorted_totals,
    value_counts,
)
from registry.tables import CTE_RAW, raw_jobs, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def cents(column: str):
    """Money as exact whole cents, so that sums do not depend on the order of rows."""
    return F.floor(F.col(column) * 100 + 0.5).cast("bigint")


CENTS = "CAST(floor({} * 100 + 0.5) AS BIGINT)"


def p1_running_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("cents", cents("o_totalprice"))
    total = running_total(orders, ["o_orderpriority"], "o_orderdate", {"running_cents": "cents"})
    return total.select("o_orderkey", "running_cents")


def p1_sorted_total(spark, sf_dir):
    """Running total in an order of several columns, with every row counted by itself."""
    orders = table(spark, sf_dir, "orders").withColumn("cents", cents("o_totalprice"))
    total = sorted_totals(
        orders.select("o_orderstatus", "o_totalprice", "o_orderkey", "cents"), ["o_orderstatus"],
        [F.desc("o_totalprice"), "o_orderkey"], {"running_cents": "cents"},
    )
    return total.select("o_orderkey", "running_cents")


def p2_row_number(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    numbered = row_numbers(lines, [], order)
    return numbered.select("row_number", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def p2_row_number_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return row_numbers(
        orders, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], count="n"
    ).select("o_orderkey", "row_number", "n")


def j1_inner(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select("o_orderkey", "c_name", "n_name")


def j2_left(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = customers.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", "c_mktsegment", "o_orderkey")


def j3_asof(spark, sf_dir):
    """Each purchase with the latest click of the same user at or before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicked = events.where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    found = asof_join(
        bought, clicked, ["user_id"], "ts", "ts", {"click_id": "event_id", "click_value": "value"},
        tie_break=["event_id"],
    )
    return found.select("event_id", "click_id", "click_value")


def j3_asof_global(spark, sf_dir):
    """Each event with the latest error event of anybody."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("event_id", "ts")
    found = asof_join(events, errors, [], "ts", "ts", {"error_id": "event_id"}, tie_break=["event_id"])
    return found.select("event_id", "error_id")


def a1_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.groupBy("l_orderkey").agg(
        F.min_by("l_partkey", order).alias("first_part"),
        F.min_by("l_quantity", F.when(F.col("l_returnflag") == "R", order)).alias("first_returned"),
    )


def a2_pivot(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    return relational.pivot_first(counts, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"])


def a3_pivot_fill(spark, sf_dir):
    counts = (
        table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    )
    wide = relational.pivot_first(counts, ["o_custkey"], "o_orderpriority", "n", PRIORITIES, fill=0)
    return wide.withColumnsRenamed({p: "p" + p[0] for p in PRIORITIES})


def a4_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def a5_quantiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    linear = exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p90": 0.9}, "linear")
    return linear.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("median", "p90")])


def a6_null_counts(spark, sf_dir):
    jobs = select_renamed(raw_jobs(spark, sf_dir)).select("partition", "reservation_id", "start_ts", "state")
    return relational.null_counts(jobs, ["partition"])


def a7_value_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "lineitem"), [], "l_quantity").withColumnRenamed("_n", "n")


def a7_value_counts_null(spark, sf_dir):
    return value_counts(raw_jobs(spark, sf_dir), ["Partition"], "ReservationId").withColumnRenamed("_n", "n")


def a8_aggregates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("cents", cents("l_extendedprice"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.min("cents").alias("lowest"), F.max("cents").alias("highest"), F.sum("cents").alias("total"),
        F.round(F.avg("cents"), 4).alias("mean"), F.count(F.lit(1)).alias("n"),
    )


def w3_share(spark, sf_dir):
    totals = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", "o_orderstatus")
        .agg(F.sum(cents("o_totalprice")).alias("cents"))
    )
    shares = relational.share_of_total(totals, ["o_orderpriority"], "cents", "share")
    return shares.select("o_orderpriority", "o_orderstatus", F.round("share", 9).alias("share"))


def w4_avg_rank(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return average_ranks(lines, ["l_returnflag"], "l_quantity")


def o1_sort(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    return orders.orderBy("o_orderpriority", "o_orderdate", "o_orderkey")


def o2_sort(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    order = ["n", "c_nationkey"]
    return counts.orderBy(*[F.desc(c) for c in order])


def o4_topk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return relational.top_k(orders, "o_totalprice", 25, ["o_orderkey"])


def u1_union(spark, sf_dir):
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(
        suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    )


def u2_diagonal(spark, sf_dir):
    """Union of tables with partly different columns, and one column that differs in type."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("code"), "c_mktsegment"
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("code"), F.col("s_nationkey").cast("bigint").alias("nation")
    )
    return relational.union_relaxed([customers, suppliers])


def u3_columns(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem")
    named = {c: c.removeprefix("l_") for c in relational.columns_with(parts, ["l_ship", "l_order", "l_quan"])}
    named.pop("l_shipdate", None)
    return parts.select(*[F.col(c).alias(n) for c, n in named.items()])


def t1_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").agg(
        F.min("l_quantity").alias("min_quantity"), F.max("l_quantity").alias("max_quantity"),
        F.count(F.lit(1)).alias("rows"),
    )
    return relational.to_rows(wide)


def t3_prefix(spark, sf_dir):
    return relational.without_prefixes(table(spark, sf_dir, "orders"), ["o_order", "o_total"])


def t4_drop_null_columns(spark, sf_dir):
    jobs = select_renamed(raw_jobs(spark, sf_dir))
    return relational.without_null_columns(
        jobs.select("job_id", "user_id", "reservation_id", "start_ts", "priority", "state")
    )


def t5_combinations(spark, sf_dir):
    """Every combination of dimensions that occurs, instead of a product of their values."""
    return (
        table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    )


QUERIES = {
    f.__name__: f
    for f in [
        p1_running_total, p1_sorted_total, p2_row_number, p2_row_number_by_key, j1_inner, j2_left, j3_asof,
        j3_asof_global, a1_first, a2_pivot, a3_pivot_fill, a4_distinct, a5_quantiles, a6_null_counts, a7_value_counts, a7_value_counts_null,
        a8_aggregates, w3_share, w4_avg_rank, o1_sort, o2_sort, o4_topk, u1_union, u2_diagonal, u3_columns, t1_unpivot,
        t3_prefix, t4_drop_null_columns, t5_combinations,
    ]
}

_PRICE = CENTS.format("o_totalprice")
_LINE = CENTS.format("l_extendedprice")
_LINE_ORDER = "(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
SQL = {
    "p1_running_total": f"""SELECT o_orderkey, sum({_PRICE}) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running_cents FROM orders""",
    "p1_sorted_total": f"""SELECT o_orderkey, sum({_PRICE}) OVER (PARTITION BY o_orderstatus
        ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT
        AS running_cents FROM orders""",
    "p2_row_number": """SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice) - 1 AS row_number, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    "p2_row_number_by_key": """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority
        ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_number, count(*) OVER (PARTITION BY o_orderpriority) AS n
        FROM orders""",
    "j1_inner": """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    "j2_left": """SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
    "j3_asof": """WITH clicks AS (SELECT user_id, ts, max(event_id) AS click_id, arg_max(value, event_id) AS click_value
          FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
        SELECT e.event_id, c.click_id, c.click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
        ASOF LEFT JOIN clicks c ON e.user_id = c.user_id AND e.ts >= c.ts""",
    "j3_asof_global": """WITH errors AS (SELECT ts, max(event_id) AS error_id FROM events WHERE event_type = 'error'
          GROUP BY ts) SELECT e.event_id, x.error_id FROM events e ASOF LEFT JOIN errors x ON e.ts >= x.ts""",
    "a1_first": f"""SELECT l_orderkey, first(l_partkey ORDER BY {_LINE_ORDER}) AS first_part,
        first(l_quantity ORDER BY {_LINE_ORDER}) FILTER (WHERE l_returnflag = 'R') AS first_returned
        FROM lineitem GROUP BY l_orderkey""",
    "a2_pivot": """SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F",
        nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O",
        nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS "P" FROM orders GROUP BY o_orderpriority""",
    "a3_pivot_fill": "SELECT o_custkey, "
    + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS p{p[0]}" for p in PRIORITIES)
    + " FROM orders GROUP BY o_custkey",
    "a4_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "a5_quantiles": """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
        round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag""",
    "a6_null_counts": f"""{CTE_RAW} SELECT "Partition" AS partition,
        count(*) FILTER (WHERE "ReservationId" IS NULL) AS reservation_id,
        count(*) FILTER (WHERE "Start" IS NULL) AS start_ts, count(*) FILTER (WHERE "State" IS NULL) AS state
        FROM raw GROUP BY "Partition" """,
    "a7_value_counts_null": f"""{CTE_RAW} SELECT "Partition", "ReservationId", count(*) AS n FROM raw
        GROUP BY "Partition", "ReservationId\"""",
    "a7_value_counts": "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity",
    "a8_aggregates": f"""SELECT l_returnflag, l_linestatus, min({_LINE}) AS lowest, max({_LINE}) AS highest,
        sum({_LINE})::BIGINT AS total, round(avg({_LINE}), 4) AS mean, count(*) AS n FROM lineitem
        GROUP BY l_returnflag, l_linestatus""",
    "w3_share": f"""WITH totals AS (SELECT o_orderpriority, o_orderstatus, sum({_PRICE})::DOUBLE AS cents FROM orders
        GROUP BY o_orderpriority, o_orderstatus) SELECT o_orderpriority, o_orderstatus,
        round(cents / sum(cents) OVER (PARTITION BY o_orderpriority), 9) AS share FROM totals""",
    "w4_avg_rank": """WITH ranked AS (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag
          ORDER BY l_quantity) AS r FROM lineitem)
        SELECT l_returnflag, l_quantity, count(*) AS n_tied, min(r) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank
        FROM ranked GROUP BY l_returnflag, l_quantity""",
    "o1_sort": """SELECT o_orderpriority, o_orderdate, o_orderkey, o_totalprice FROM orders
        ORDER BY o_orderpriority, o_orderdate, o_orderkey""",
    "o2_sort": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey DESC",
    "o4_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "u1_union": """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL
        SELECT s_suppkey, s_name FROM supplier""",
    "u2_diagonal": """SELECT c_custkey AS id, c_nationkey::VARCHAR AS code, c_mktsegment, NULL::BIGINT AS nation
        FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""",
    "u3_columns": "SELECT l_orderkey AS orderkey, l_quantity AS quantity FROM lineitem",
    "t1_unpivot": """SELECT 'min_quantity' AS metric, min(l_quantity)::DOUBLE AS value FROM lineitem UNION ALL
        SELECT 'max_quantity', max(l_quantity) FROM lineitem UNION ALL SELECT 'rows', count(*) FROM lineitem""",
    "t3_prefix": "SELECT o_custkey FROM orders",
    "t4_drop_null_columns": f"""{CTE_RAW} SELECT "JobIDRaw" AS job_id, "UID" AS user_id, "Priority" AS priority,
        "State" AS state FROM raw""",
    "t5_combinations": """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
        GROUP BY o_orderstatus, o_orderpriority""",
}
