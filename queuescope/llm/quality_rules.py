"""Document quality rules whose cutoffs are chosen under risk control, in DataFrame expressions only.

Each rule rejects a document if a measure exceeds the cutoff of its stratum. A cutoff may be used only if the exact binomial
(Clopper-Pearson) upper bound of its false rejection rate, from the labelled good documents of the stratum, is within
``MAX_FALSE_REJECTION``. The bounds hold together with probability 1 - ``ERROR``: the error is divided by the number of
(stratum, rule) pairs, and within a pair the cutoffs are tested from the loosest on, up to the first that fails. Of the
certified cutoffs the one with the most rejected bad documents, less ten times the good ones, is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queuescope.llm.common import WORD_SPACE
from queuescope.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_FALSE_REJECTION = 0.01
ERROR = 0.05
GOOD_WEIGHT = 10
STRATUM = "lang"
CUTOFFS = [0.02, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0]
#: Share of symbols per word, of repeated lines, of words in repeated windows, and of capitals among the characters.
RULES = {
    "symbols": "n_symbols / n_words",
    "lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "capitals": "n_capitals / word_chars",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows(words: Column) -> Column:
    """Three-word windows of a text; words hold no space, so equal joins mean equal windows."""
    return F.when(
        F.size(words) > 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def measured(docs: DataFrame, prefix: str = "_rule_") -> DataFrame:
    """``docs`` with the measures of the whole text as further columns, all named with ``prefix``."""
    p = prefix

    def c(name: str) -> Column:
        return F.col(p + name)

    return (
        docs.withColumn(p + "text", F.coalesce("text", F.lit("")))
        .withColumns({
            p + "words": F.filter(F.split(c("text"), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""),
            p + "lines": F.filter(F.split(c("text"), "\n"), lambda t: F.btrim(t, F.lit(WORD_SPACE)) != ""),
        })
        .withColumns({
            p + "joined": F.concat_ws("", c("words")),
            p + "windows": _windows(c("words")),
            p + "n_words": F.size(c("words")).cast("long"),
            p + "n_lines": F.size(c("lines")).cast("long"),
            p + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        })
        .withColumns({
            p + "word_chars": F.length(c("joined")).cast("long"),
            p + "n_symbols": (F.length(c("joined")) - F.length(F.translate(c("joined"), SYMBOLS, ""))).cast("long"),
            p + "n_capitals": F.length(F.regexp_replace(c("joined"), r"\P{Lu}+", "")).cast("long"),
            # Windows in sorted order with their places; only a text with a repeated window needs them.
            p + "sorted": F.when(
                F.size(F.array_distinct(c("windows"))) < F.size(c("windows")),
                F.sort_array(F.transform(c("windows"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
            ),
        })
        .withColumn(
            p + "places",
            F.sort_array(
                F.filter(
                    F.transform(
                        c("sorted"),
                        lambda x, i: F.when(
                            (x["w"] == F.get(c("sorted"), i - 1)["w"]) | (x["w"] == F.get(c("sorted"), i + 1)["w"]),
                            x["i"],
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        .withColumn(  # each place covers three words, less what the next one covers as well
            p + "n_repeat_words",
            F.coalesce(
                F.aggregate(
                    F.transform(
                        c("places"), lambda x, i: F.least(F.lit(3), F.coalesce(F.get(c("places"), i + 1) - x, F.lit(3)))
                    ),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
                F.lit(0).cast("long"),
            ),
        )
        .drop(*[p + name for name in ("text", "words", "lines", "joined", "windows", "sorted", "places")])
    )


def measure_of(rule: str, prefix: str = "_rule_") -> Column:
    top, bottom = RULES[rule].split(" / ")
    return F.col(prefix + top) / F.greatest(F.col(prefix + bottom), F.lit(1))


def base_failed(prefix: str = "_rule_") -> Column:
    return (F.col(prefix + "n_words") < MIN_WORDS) | (
        100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words")
    )


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, exact to about 1e-13."""
    x = n + F.lit(8.0)
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    shift = sum((F.log(n + F.lit(float(k))) for k in range(2, 9)), F.log(n + F.lit(1.0)))
    return (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial with n draws, for k below n * rate; summed downwards from the term of k."""
    log_term = (
        log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    )
    odds = (1 - rate) / rate
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(
        F.array().cast("array<long>")
    )
    return F.exp(log_term) * F.aggregate(steps, start, add)["total"]


def certified_cutoffs(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, cutoffs: map of rule to cutoff) from all labelled documents that pass the base rule.

    ``measures`` needs doc_id, stratum and the measures. A stratum or rule without a certified useful cutoff has none, so
    nothing is rejected by it. A key with contradicting labels counts as good.
    """
    marked = (
        labels.select("doc_id", F.col("quality").cast("int").alias("good"))
        .where(F.col("good").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("good").alias("good"))
    )
    bins = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"),
            sum(((measure_of(rule) > cut).cast("int") for cut in CUTOFFS), F.lit(0)).alias("above"),  # how many cutoffs the document exceeds
        )
        for rule in RULES
    ])
    counts = (
        measures.where(~base_failed()).select("doc_id", "stratum", bins.alias("bins"))
        .join(marked, "doc_id")
        .select("stratum", "good", F.explode("bins").alias("b"))
        .groupBy("stratum", F.col("b.rule").alias("rule"), F.col("b.above").alias("above"))
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    counts = materialize(counts)  # at most strata x rules x (cutoffs + 1) rows
    pairs = counts.select("stratum").distinct().count() * len(RULES)
    level = ERROR / max(pairs, 1)
    cuts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("cutoff")) for i, c in enumerate(CUTOFFS)])
    tried = (
        counts.select("*", F.inline(cuts))
        .groupBy("stratum", "rule", "place", "cutoff")
        .agg(
            F.sum("good").alias("n"),
            F.sum(F.when(F.col("above") > F.col("place"), F.col("good")).otherwise(0)).alias("k"),
            F.sum(F.when(F.col("above") > F.col("place"), F.col("bad")).otherwise(0)).alias("hits"),
        )
        .where("n > 0")
    )
    passes = F.when(F.col("k") >= F.col("n") * MAX_FALSE_REJECTION, False).otherwise(
        binomial_tail(F.col("k"), F.col("n"), MAX_FALSE_REJECTION) <= level
    )
    loosest_first = W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    worth = F.col("hits") - GOOD_WEIGHT * F.col("k")
    return (
        tried.withColumn("passes", passes)
        .withColumn("certified", F.min("passes").over(loosest_first))
        .where("certified").withColumn("worth", worth).where("worth > 0")
        .groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("worth", "cutoff")).alias("cutoff"))
        .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.col(STRATUM).cast("string"), F.lit("")) if STRATUM in docs.columns else F.lit("")


def _kept(cutoffs: str) -> Column:
    broken = [F.coalesce(measure_of(rule) > F.col(cutoffs)[rule], F.lit(False)) for rule in RULES]
    rejected = broken[0]
    for rule in broken[1:]:
        rejected = rejected | rule
    return ~base_failed() & ~rejected


def _judged(docs: DataFrame, labels: DataFrame, *unused: str) -> DataFrame:
    """``docs`` without ``unused``, its measures, and the cutoffs of each row's stratum.

    The measures are worked out once and written: a filter on them would else be pushed below and repeat them all.
    """
    measures = materialize(measured(docs.withColumn("_rule_stratum", _stratum(docs))).drop(*unused))
    plain = measures.select("doc_id", F.col("_rule_stratum").alias("stratum"), *_measure_columns(measures))
    cutoffs = materialize(certified_cutoffs(plain, labels)).withColumnsRenamed(
        {"stratum": "_rule_of", "cutoffs": "_rule_cutoffs"}
    )
    return measures.join(cutoffs, F.col("_rule_stratum") == F.col("_rule_of"), "left")


def _measure_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_rule_") and c != "_rule_stratum"]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, the base measures, base_failed, kept.

    Null texts count as empty and fail the base rule. Only doc_id, text and the stratum column are read. Repeated rows are
    judged like any other; rows without a doc_id never count as labelled.
    """
    stratum = [STRATUM] if STRATUM in docs.columns else []
    judged = _judged(docs.select("doc_id", "text", *stratum), labels, "text")
    return judged.select(
        "doc_id",
        *[F.col(f"_rule_{m}").alias(m) for m in MEASURES],
        base_failed().alias("base_failed"),
        _kept("_rule_cutoffs").alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the rules keep, with the columns they came with."""
    return _judged(docs, labels).where(_kept("_rule_cutoffs")).select(*[F.col(f"`{c}`") for c in docs.columns])
