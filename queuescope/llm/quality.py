"""Quality by compressed size: dictionaries of good and of bad text, and the normalised difference of the sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import held_out, labelled_sample
from queuescope.llm.compression import SizeModel, train_sizes

FOLD = (5, 0)  # rows whose crc32(doc_id as text) mod 5 is 0 are held out
SAMPLE = {1: 3000, 0: 3000}  # labelled documents per class that training takes at most
SAMPLE_CHARS = 20_000  # characters of one training text
THRESHOLD = 0.3
UNTRAINED_SCORE = 0.5


def train(docs: DataFrame, labels: DataFrame) -> SizeModel | None:
    """Model from the labelled rows outside the held-out fold; None if one of the classes is missing there."""
    return train_sizes(labelled_sample(docs, labels, "quality", *FOLD, SAMPLE, SAMPLE_CHARS))


def score_column(model: SizeModel | None, text: Column) -> Column:
    """Score of whole texts in 0..1. Null and empty texts have size 0 and get the model's score of no difference."""
    if model is None:
        return F.lit(UNTRAINED_SCORE)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for batch in batches:
            yield pd.Series([model.score(compressors, t) for t in batch], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Only doc_id and text are read, so other columns never clash. Repeated rows and rows without a key are scored like any
    other (a null key is not held out). Without labelled rows of both classes every score is 0.5 and all are kept.
    """
    model = train(docs, labels)
    return docs.select(
        "doc_id", held_out("doc_id", *FOLD).alias("held_out"), score_column(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
