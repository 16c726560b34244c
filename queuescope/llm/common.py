"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = " \t\n\x0b\f\r"  # the characters that separate words: space and \x09-\x0D
BATCH_ROWS = 1000  # rows of an Arrow batch; texts of 100 kB then make batches of 100 MB


def configure(spark: SparkSession) -> SparkSession:
    """Session settings these operators need: small Arrow batches, because one text can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def key_crc(key: Column | str) -> Column:
    """crc32 of an integer key as text; null keys have none."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether a row is in the held-out fold; a null key is not."""
    return F.coalesce(key_crc(key) % modulus == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    remainder: int,
    per_class: dict[int, int],
    max_chars: int,
) -> list[tuple[int, str]]:
    """(label, text) of a bounded sample of labelled rows outside the held-out fold.

    Of each class the ``per_class`` documents with the smallest key hashes are taken, of each text ``max_chars``
    characters at most, from a place given by the hash. These bounds hold for training only; scoring reads whole texts.
    A key with contradicting labels counts as the larger one; a key with several rows gives its largest text. Null keys,
    null texts and other labels are left out.
    """
    marked = (
        labels.select(F.col("doc_id").alias("_key"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_key").isNotNull() & F.col("_label").isin(*per_class))
        .where(~held_out("_key", modulus, remainder))
        .groupBy("_key")
        .agg(F.max("_label").alias("_label"))
        .withColumn("_hash", F.xxhash64("_key"))
    )
    chosen = None
    for value, most in per_class.items():
        part = marked.where(F.col("_label") == value).orderBy("_hash", "_key").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    start = F.lit(1) + F.pmod("_hash", F.greatest(F.length("text") - max_chars, F.lit(1)))
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_key"))  # sum(per_class) rows at most
        .select("_key", "_label", F.substring("text", start.cast("int"), F.lit(max_chars)).alias("_text"))
        .groupBy("_key", "_label")
        .agg(F.max("_text").alias("_text"))
        .toArrow()
        .sort_by("_key")
    )
    return list(zip(rows["_label"].to_pylist(), rows["_text"].to_pylist()))


def cut_words(data: np.ndarray, inside: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of a text given as bytes, and where each begins; ``inside`` says which bytes belong to words."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    letters = np.ascontiguousarray(data[inside])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers), starts
