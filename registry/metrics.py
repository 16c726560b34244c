"""Queries for metrics and reports over deterministic predictions: the time limit and the run time as guesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuescope.operators.relational import to_rows
from queuescope.plans import metrics, prep, reports
from registry.tables import CTE_JOBS, clean_jobs

def predictions(spark, sf_dir):
    """Two models (limit, run) with two feature sets (minimal, full); the fuller set guesses half as much."""
    guesses = [
        (m, s, f"{source} {divide}")
        for m, source in [("limit", "allocated_timelimit_seconds"), ("run", "allocated_elapsed_seconds")]
        for s, divide in [("minimal", "/ 1.0D"), ("full", "/ 2.0D")]
    ]
    structs = ", ".join(f"struct('{m}' AS model, '{s}' AS feature_set, {g} AS y_pred)" for m, s, g in guesses)
    return clean_jobs(spark, sf_dir).selectExpr(
        "job_id", "partition", "wait_time_minutes", "wait_time_seconds AS y_true", f"inline(array({structs}))"
    )


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def guessed(spark, sf_dir):
    return clean_jobs(spark, sf_dir).withColumn("guess", F.col("allocated_timelimit_seconds").cast("double"))


def e1_metrics(spark, sf_dir):
    long = metrics.regression_metrics(guessed(spark, sf_dir), "wait_time_seconds", "guess", ["partition"])
    return _rounded(long.where(~F.col("metric").startswith("perc")), "value", digits=4)


def e1_metrics_of_all(spark, sf_dir):
    long = metrics.regression_metrics(guessed(spark, sf_dir), "wait_time_seconds", "guess")
    return _rounded(long, "value", digits=4)


def e2_within(spark, sf_dir):
    jobs = guessed(spark, sf_dir).withColumn("minutes", F.col("guess") / 60)
    wide = jobs.groupBy("partition").agg(
        *[a.alias(n) for n, a in metrics.within_aggregates("wait_time_minutes", "minutes", "wait_time_minutes").items()]
    )
    return _rounded(to_rows(wide, ["partition"]), "value")


def classed(spark, sf_dir):
    """True class, predicted class and six class scores that follow from priority and request."""
    jobs = prep.bin_target(clean_jobs(spark, sf_dir), "simple").selectExpr(
        "job_id", "partition", "wait_time_bin AS y", "CAST((priority + allocated_cpu) % 6 AS INT) AS y_pred",
        *[f"CAST((priority * {c + 3} + CAST(allocated_cpu AS INT)) % 11 AS DOUBLE) / 11 AS p{c}" for c in range(6)],
    )
    return jobs.withColumn("p", F.array(*[f"p{c}" for c in range(6)]))


def e3_f1(spark, sf_dir):
    table = metrics.label_metrics(classed(spark, sf_dir), "y", "y_pred", ["partition"])
    return _rounded(table, "f1", "balanced_accuracy")


def e4_auc(spark, sf_dir):
    areas = metrics.auc_metrics(classed(spark, sf_dir), "y", "p", 6, ["partition"])
    return _rounded(areas, *[c for c in areas.columns if c != "partition"])


def e4_auc_binary(spark, sf_dir):
    jobs = classed(spark, sf_dir).withColumn("y", (F.col("y") > 2).cast("int"))
    return _rounded(metrics.auc_metrics(jobs, "y", "p", 2, ["partition"]), "roc_auc")


def e5_binned(spark, sf_dir):
    wide = metrics.metrics_by_wait(guessed(spark, sf_dir), y_pred="guess", keys=["partition"])
    return _rounded(wide, *[c for c in wide.columns if c.startswith("value")], digits=4)


def e6_attach(spark, sf_dir):
    jobs = clean_jobs(spark, sf_dir).select("job_id", "wait_time_seconds")
    return reports.attach_predictions(jobs, predictions(spark, sf_dir))


def e7_errors(spark, sf_dir):
    return reports.add_errors(e6_attach(spark, sf_dir)).select(
        "job_id", "limit_minimal_err", "limit_full_err", "run_minimal_err", "run_full_err"
    )


def named_accuracy(spark, sf_dir):
    wide = predictions(spark, sf_dir).groupBy("partition", "model", "feature_set").agg(
        *[a.alias(n) for n, a in metrics.within_aggregates("y_true", "y_pred", "wait_time_seconds").items()],
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mean_ae"),
    )
    return to_rows(wide, reports.DIMENSIONS)


def e8_combine(spark, sf_dir):
    """Results of single runs put together, each under its name."""
    named = named_accuracy(spark, sf_dir).withColumn(
        "result_name", F.concat_ws("_", F.lit("res"), "partition", "model", "feature_set")
    )
    return _rounded(named.select("result_name", "metric", "value"), "value")


def e9_names(spark, sf_dir):
    named = reports.split_result_name(e8_combine(spark, sf_dir))
    pred = e8_combine(spark, sf_dir).select(
        F.regexp_replace("result_name", "^res_[^_]*", "y_pred").alias("metric"), "value"
    )
    again = reports.split_prediction_name(pred).withColumn("partition", F.lit(None).cast("string"))
    return named.drop("metric").unionByName(again)


def e10_format(spark, sf_dir):
    return reports.format_accuracy(_rounded(named_accuracy(spark, sf_dir), "value", digits=8))


def e11_compare(spark, sf_dir):
    return reports.accuracy_report(_rounded(named_accuracy(spark, sf_dir), "value"), "model")


def e11_compare_sets(spark, sf_dir):
    return reports.accuracy_report(_rounded(named_accuracy(spark, sf_dir), "value"), "feature_set")


def e13_importance(spark, sf_dir):
    """Share of each feature's F score, with a set of three and a set of five features."""
    jobs = clean_jobs(spark, sf_dir)
    x = ["allocated_cpu", "allocated_mem", "allocated_timelimit_seconds", "priority", "allocated_node"]
    scores = [
        prep.feature_scores(jobs, "wait_time_seconds", x[:k], keys=["partition"]).select(
            "partition", F.lit("f").alias("model"), F.lit(name).alias("feature_set"), "feature",
            F.col("score").alias("value"),
        )
        for name, k in [("minimal", 3), ("full", 5)]
    ]
    return _rounded(reports.importance_report(scores[0].unionByName(scores[1])), "minimal", "full")


def e14_granular(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    report = reports.granular_report(rows.drop("wait_time_minutes"), clean_jobs(spark, sf_dir))
    return _rounded(report, *[c for c in report.columns if c.startswith("value")])


def e16_hist(spark, sf_dir):
    return reports.prediction_histogram(predictions(spark, sf_dir), per_decade=4)


QUERIES = {
    f.__name__: f
    for f in [
        e1_metrics, e1_metrics_of_all, e2_within, e3_f1, e4_auc, e4_auc_binary, e5_binned, e6_attach, e7_errors,
        e8_combine, e9_names, e10_format, e11_compare, e11_compare_sets, e13_importance, e14_granular, e16_hist,
    ]
}

_GUESSED = f"""{CTE_JOBS}, g AS (SELECT *, wait_time_seconds::DOUBLE AS y, allocated_timelimit_seconds::DOUBLE AS p,
    abs(wait_time_seconds - allocated_timelimit_seconds)::DOUBLE AS err FROM jobs)"""
_METRICS = {
    "rmse": "sqrt(avg(err * err))",
    "mape": "avg(err / greatest(abs(y), 2.220446049250313e-16))",
    "r2": "1 - sum(err * err) / (var_pop(y) * count(*))",
    "median_ae": "median(err)",
    "mean_ae": "avg(err)",
    "max_error": "max(err)",
} | {f"perc_err_under_{m}min": f"avg((err <= {m * 60})::INT)" for m in metrics.WITHIN_MINUTES}


def _long(group: str, names, rows: str, digits: int, keep: str = "") -> str:
    by = f"GROUP BY {group}" if group else ""
    lead = f"{group}, " if group else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{n}' AS metric, round({_METRICS[n]}, {digits})::DOUBLE AS value FROM {rows} {by}" for n in names
    )


_BIN = """CASE WHEN wait_time_minutes >= 240 THEN '240+' WHEN wait_time_minutes >= 120 THEN '120_240'
  WHEN wait_time_minutes >= 60 THEN '60_120' WHEN wait_time_minutes >= 30 THEN '30_60' ELSE '0_30' END"""
_BINS = metrics.bin_names([0, 30, 60, 120, 240])
_CLASSED = f"""{CTE_JOBS}, c AS (SELECT job_id, partition, CASE WHEN wait_time_minutes < 15 THEN 0
    WHEN wait_time_minutes < 60 THEN 1 WHEN wait_time_minutes < 120 THEN 2 WHEN wait_time_minutes < 240 THEN 3
    WHEN wait_time_minutes < 480 THEN 4 ELSE 5 END AS y, ((priority + allocated_cpu) % 6)::INT AS y_pred,
    {", ".join(f"((priority * {c + 3} + allocated_cpu::INT) % 11)::DOUBLE / 11 AS p{c}" for c in range(6))} FROM jobs)"""
_LABELS = "(VALUES (0), (1), (2), (3), (4), (5)) l(k)"


def _auc_sql() -> str:
    long = " UNION ALL ".join(f"SELECT partition, y, {c} AS k, p{c} AS score FROM c" for c in range(6))
    area = """sum(a.n * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE
      / sum(a.n * b.n)"""
    return f"""{_CLASSED}, s AS (SELECT partition, y, k, score, count(*) AS n FROM ({long}) GROUP BY ALL),
      size AS (SELECT partition, y, count(*) AS n FROM c GROUP BY ALL),
      rest AS (SELECT a.partition, a.k, {area} AS auc FROM s a JOIN s b ON a.partition = b.partition AND a.k = b.k
        WHERE a.y = a.k AND b.y <> b.k GROUP BY ALL),
      pairs AS (SELECT a.partition, a.k, b.y AS o, {area} AS auc FROM s a JOIN s b
        ON a.partition = b.partition AND a.k = b.k WHERE a.y = a.k AND b.y <> b.k GROUP BY ALL),
      duo AS (SELECT partition, least(k, o) AS x, greatest(k, o) AS z, avg(auc) AS auc FROM pairs GROUP BY ALL),
      ovr AS (SELECT partition, avg(auc) AS roc_auc_macro_ovr, sum(auc * n) / sum(n) AS roc_auc_weighted_ovr
        FROM rest JOIN size USING (partition) WHERE size.y = rest.k GROUP BY partition),
      ovo AS (SELECT duo.partition, avg(auc) AS roc_auc_macro_ovo,
          sum(auc * (u.n + v.n)) / sum(u.n + v.n) AS roc_auc_weighted_ovo FROM duo
        JOIN size u ON u.partition = duo.partition AND u.y = x JOIN size v ON v.partition = duo.partition AND v.y = z
        GROUP BY duo.partition)
      SELECT partition, {", ".join(f"round({c}, 6) AS {c}" for c in ("roc_auc_macro_ovr", "roc_auc_weighted_ovr",
                                                                   "roc_auc_macro_ovo", "roc_auc_weighted_ovo"))}
      FROM ovr JOIN ovo USING (partition)"""


_PREDICTIONS = f"""{CTE_JOBS}, pred AS ({" UNION ALL ".join(
    f"SELECT job_id, partition, wait_time_minutes, wait_time_seconds AS y_true, '{m}' AS model, '{s}' AS feature_set, "
    f"{source} / {d}::DOUBLE AS y_pred FROM jobs"
    for m, source in [("limit", "allocated_timelimit_seconds"), ("run", "allocated_elapsed_seconds")]
    for s, d in [("minimal", 1), ("full", 2)])}),
  acc AS ({" UNION ALL ".join(
    f"SELECT partition, model, feature_set, '{n}' AS metric, {e} AS value FROM pred GROUP BY ALL"
    for n, e in [("mean_ae", "avg(abs(y_true - y_pred))")]
    + [(f"perc_err_under_{m}min", f"avg((abs(y_true - y_pred) <= {m * 60})::INT)") for m in metrics.WITHIN_MINUTES])})"""


def _wide(column: str, names, value="value", table="acc", digits=6, group="") -> str:
    picks = ", ".join(f"round(max({value}) FILTER (WHERE {column} = '{n}'), {digits}) AS \"{n}\"" for n in names)
    return f"SELECT {group}, {picks} FROM {table} GROUP BY {group}"


def _attached(select: str) -> str:
    pick = ", ".join(
        f"max(y_pred) FILTER (WHERE model = '{m}' AND feature_set = '{s}') AS y_pred_{m}_{s}"
        for m in ("limit", "run") for s in ("minimal", "full")
    )
    return f"{_PREDICTIONS}, w AS (SELECT job_id, max(y_true) AS wait_time_seconds, {pick} FROM pred GROUP BY job_id) {select}"


def _two_decimals(x: str) -> str:
    """Half-to-even text with the shortest form, as the other engine prints doubles."""
    return f"(round_even({x}, 2)::DOUBLE)::VARCHAR"


_X = ["allocated_cpu", "allocated_mem", "allocated_timelimit_seconds", "priority", "allocated_node"]


def _f_score(x: str) -> str:
    r2 = f"pow(corr({x}, wait_time_seconds), 2)"
    return f"SELECT partition, '{x}' AS feature, {r2} / (1 - {r2}) * (count(*) - 2) AS value FROM jobs GROUP BY partition"


SQL = {
    "e1_metrics": f"{_GUESSED} {_long('partition', metrics.REGRESSION_METRICS[:6], 'g', 4)}",
    "e1_metrics_of_all": f"{_GUESSED} {_long('', metrics.REGRESSION_METRICS, 'g', 4)}",
    "e2_within": f"""{CTE_JOBS}, g AS (SELECT partition, abs(wait_time_minutes * 60 - allocated_timelimit_seconds) AS err
        FROM jobs) {_long('partition', metrics.REGRESSION_METRICS[6:], 'g', 6)}""",
    "e3_f1": f"""{_CLASSED}, q AS (SELECT DISTINCT partition FROM c),
        per AS (SELECT q.partition, k, (SELECT count(*) FROM c WHERE c.partition = q.partition AND y = k) AS seen,
          (SELECT count(*) FROM c WHERE c.partition = q.partition AND y_pred = k) AS said,
          (SELECT count(*) FROM c WHERE c.partition = q.partition AND y = k AND y_pred = k) AS hit
          FROM q CROSS JOIN {_LABELS})
        SELECT partition, round(avg(2 * hit / (seen + said)) FILTER (WHERE seen + said > 0), 6) AS f1,
          round(avg(hit / seen) FILTER (WHERE seen > 0), 6) AS balanced_accuracy FROM per GROUP BY partition""",
    "e4_auc": _auc_sql(),
    "e4_auc_binary": f"""{_CLASSED}, s AS (SELECT partition, y > 2 AS hit, p1 AS score, count(*) AS n FROM c GROUP BY ALL)
        SELECT a.partition, round(sum(a.n * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5
          ELSE 0 END)::DOUBLE / sum(a.n * b.n), 6) AS roc_auc FROM s a JOIN s b ON a.partition = b.partition
        WHERE a.hit AND NOT b.hit GROUP BY a.partition""",
    "e5_binned": f"""{_GUESSED}, b AS (SELECT *, {_BIN} AS bin FROM g),
        m AS ({_long('partition, bin', metrics.REGRESSION_METRICS[:10], 'b', 4)})
        SELECT partition, metric, {", ".join(f"max(value) FILTER (WHERE bin = '{n}') AS \"value_{n}\"" for n in _BINS)}
        FROM m GROUP BY partition, metric""",
    "e6_attach": _attached("SELECT * FROM w"),
    "e7_errors": _attached(
        "SELECT job_id, "
        + ", ".join(f"wait_time_seconds - y_pred_{m}_{s} AS {m}_{s}_err" for m in ("limit", "run") for s in ("minimal", "full"))
        + " FROM w"
    ),
    "e8_combine": f"""{_PREDICTIONS} SELECT concat('res_', partition, '_', model, '_', feature_set) AS result_name, metric,
        round(value, 6) AS value FROM acc""",
    "e9_names": f"""{_PREDICTIONS} SELECT partition, model, feature_set, round(value, 6) AS value FROM acc UNION ALL
        SELECT NULL, model, feature_set, round(value, 6) FROM acc""",
    "e10_format": f"""{_PREDICTIONS} SELECT partition, model, feature_set, metric, CASE WHEN metric LIKE 'perc%'
        THEN concat({_two_decimals('round(value, 8) * 100')}, '%') ELSE {_two_decimals('round(value, 8)')} END AS value
        FROM acc""",
    "e11_compare": f"{_PREDICTIONS} {_wide('model', ['limit', 'run'], group='partition, feature_set, metric')}",
    "e11_compare_sets": f"{_PREDICTIONS} {_wide('feature_set', ['full', 'minimal'], group='partition, model, metric')}",
    "e13_importance": f"""{CTE_JOBS}, f AS ({" UNION ALL ".join(_f_score(x) for x in _X)}),
        small AS (SELECT partition, sum(value) AS total FROM f WHERE feature IN ('{_X[0]}', '{_X[1]}', '{_X[2]}')
                  GROUP BY partition)
        SELECT f.partition, 'f' AS model, feature, round(CASE WHEN feature IN ('{_X[0]}', '{_X[1]}', '{_X[2]}')
          THEN value / total ELSE 0 END, 6) AS minimal,
          round(value / sum(value) OVER (PARTITION BY f.partition), 6) AS "full" FROM f JOIN small USING (partition)""",
    "e14_granular": f"""{_PREDICTIONS}, b AS (SELECT *, {_BIN} AS bin FROM pred)
        SELECT partition, model, feature_set, 'perc_err_under_10min' AS metric, {", ".join(
            f"round(avg((abs(y_true - y_pred) <= 600)::INT) FILTER (WHERE bin = '{n}'), 6) AS \"value_{n}\""
            for n in _BINS)} FROM b GROUP BY partition, model, feature_set""",
    "e16_hist": f"""{_PREDICTIONS} SELECT model, feature_set, floor(log10(y_pred) * 4)::INT AS log_bin, count(*) AS n
        FROM pred WHERE y_pred > 0 GROUP BY ALL""",
}
