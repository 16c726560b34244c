"""Mixing sources to target weights: word blocks drawn through per-source index permutations.

A source's texts follow each other by doc_id and are packed into blocks of ``BLOCK_WORDS`` words. Each output shard draws
how many of its slots every source gets (multinomial). A source's slots are numbered through all shards; slot i takes block
permutation(i mod blocks) of pass i div blocks, so a block comes up once in each pass. Blocks and slots meet in a join by index.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuescope.operators.running import sorted_totals
from queuescope.session import materialize

WEIGHTS = (3, 1, 2)  # weights of the sources in code point order, repeating; a null source is the last
SHARE = 1.5  # words of the mix, as a share of all words
MOST_PASSES = 2  # times a text may be taken
BLOCK_WORDS = 16
SHARD_SLOTS = 8192
SEED = 20
MOST_SOURCES = 1_000_000  # sources are a short list; more than this is refused rather than cut

_WORD = re.compile(r"[^ \t-\r]+")


@F.pandas_udf(T.LongType())
def _word_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len(t.encode("utf-8", "replace").split()) if t else 0 for t in texts], dtype="int64")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST_PASSES) -> list[float]:
    """Words of each source: ``share`` of all words by weight, none above ``most`` times its size.

    What a source cannot take is shared again by weight among those below their limit, until none is above.
    """
    given = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                given[i] = unit * weights[i]
            break
        for i in full:
            given[i] = float(most * sizes[i])
            left -= given[i]
        open_ -= set(full)
    return given


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Image of each index under a pseudorandom permutation of range(size): a Feistel network walked back into range."""
    if size <= 1:
        return np.zeros_like(index)
    half = np.uint64((int(size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << int(half)) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for step in range(4):
            mixed = (right + np.uint64((key * 0x9E3779B97F4A7C15 + step * 0xBF58476D1CE4E5B9) % 2**64)) * np.uint64(
                0xD6E8FEB86659FD93
            )
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed >> np.uint64(29)) & low)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        outside = np.flatnonzero(out >= size)
        while len(outside):
            out[outside] = once(out[outside])
            outside = outside[out[outside] >= size]
    return out.astype(np.int64)


def _draws(seed: int, slots: int, shares: np.ndarray):
    """Multinomial source counts of each output shard; the same whatever task draws them."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, numbers, counts = [], [], []
            for shard in batch.column(0).to_pylist():
                size = min(SHARD_SLOTS, slots - shard * SHARD_SLOTS)
                found = np.random.default_rng([seed, shard]).multinomial(size, shares)
                at = np.flatnonzero(found)
                shards.append(np.full(len(at), shard))
                numbers.append(at)
                counts.append(found[at])
            if shards:
                yield pa.record_batch({
                    "shard": np.concatenate(shards).astype("int64"),
                    "source_no": np.concatenate(numbers).astype("int64"),
                    "n": np.concatenate(counts).astype("int64"),
                })

    return draw


def _slots(seed: int, blocks: Sequence[int], keys: Sequence[int]):
    """A row per slot: the block it takes. Slots beyond the last allowed pass take none."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, upto, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                size = blocks[number]
                index = np.arange(upto - n, min(upto, MOST_PASSES * size))
                for turn in np.unique(index // size) if len(index) else ():
                    own = index[index // size == turn] - turn * size
                    block = permuted(own, size, keys[number] * 31 + int(turn) + seed)
                    yield pa.record_batch({"source_no": np.full(len(block), number, dtype="int64"), "block": block})

    return expand


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (source, size, doc_id, tie, ...) in their source's order, with `_upto` words so far and `source_size`."""
    placed = sorted_totals(rows, ["source"], ["doc_id", "tie"], {"_upto": "size"}, totals={"source_size": "size"})
    return materialize(placed)


def _plan(placed: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with source_no and target, taken pieces (source_no, _upto, block, words, times), sources)."""
    spark = placed.sparkSession
    found = placed.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    blocks = [-(-size // BLOCK_WORDS) for size in sizes]
    draws = np.array([t * b / s if s else 0.0 for t, b, s in zip(wanted, blocks, sizes)])  # slots that give the target
    total = int(round(draws.sum()))
    keys = [zlib.crc32(b"-" if r["source"] is None else b"+" + r["source"].encode()) for r in found]
    sources = spark.createDataFrame(
        [(i, r["source"], t) for i, (r, t) in enumerate(zip(found, wanted))],
        "source_no long, _source string, target double",
    )
    rows = placed.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    shards = -(-total // SHARD_SLOTS)
    per_task = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    counts = spark.range(0, shards, 1, per_task).mapInArrow(
        _draws(seed, total, draws / draws.sum() if total else draws), "shard long, source_no long, n long"
    )
    counts = sorted_totals(counts, ["source_no"], ["shard"], {"upto": "n"})
    spread = counts.select("source_no", "upto", "n").repartition(per_task, "source_no", "upto")
    taken = spread.mapInArrow(_slots(seed, blocks, keys), "source_no long, block long").groupBy("source_no", "block").agg(
        F.count(F.lit(1)).cast("int").alias("times")
    )
    begin = F.col("_upto") - F.col("size")
    pieces = (
        rows.where("size > 0")
        .select(
            "source_no", "_upto", "size",
            F.expr(f"explode(sequence((_upto - size) div {BLOCK_WORDS}, (_upto - 1) div {BLOCK_WORDS}))").alias("block"),
        )
        .withColumn("words", F.least("_upto", (F.col("block") + 1) * BLOCK_WORDS)
                    - F.greatest(begin, F.col("block") * BLOCK_WORDS))
    )
    return rows, pieces.join(taken, ["source_no", "block"]), sources


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        "doc_id", source.alias("source"), _word_count(F.col("text")).alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), *more,
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target (of its source), taken (words, repeats counted).

    Null and empty texts have no words and are never taken. A null source is a source of its own, the last. Rows that
    repeat a doc_id are documents of their own. Only doc_id, source and text are read. The same rows give the same mix.
    """
    rows, pieces, _ = _plan(_numbered(_sized(docs)), seed)
    taken = pieces.groupBy("source_no", "_upto").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # A row without words ends where the one before it ends, so it must not meet that one's words.
    key = F.when(F.col("size") > 0, F.col("_upto"))
    joined = rows.withColumn("_end", key).join(
        taken.withColumnsRenamed({"source_no": "_no", "_upto": "_at"}),
        (F.col("source_no") == F.col("_no")) & (F.col("_end") == F.col("_at")), "left",
    )
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _assembled(text: str, start: int, blocks: Sequence[int], times: Sequence[int]) -> str:
    """The taken pieces of a text in order, once for each pass; a piece keeps the white space that follows it."""
    begins = [m.start() for m in _WORD.finditer(text)]
    begins[0] = 0
    begins.append(len(text))
    out = []
    for turn in range(1, max(times) + 1):
        parts = []
        for block, n in sorted(zip(blocks, times)):
            if n >= turn:
                first = max(0, block * BLOCK_WORDS - start)
                last = min(len(begins) - 1, (block + 1) * BLOCK_WORDS - start)
                parts.append(text[begins[first] : begins[last]])
        out.append("".join(parts))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def _assemble(texts: pd.Series, starts: pd.Series, blocks: pd.Series, times: pd.Series) -> pd.Series:
    return pd.Series([_assembled(*row) for row in zip(texts, starts, blocks, times)], dtype=object)


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns they came with: the text is what was taken of it, n_chars its length.

    Documents of which nothing is taken are gone. Rows with the same doc_id and text are one document here.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    tie = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie")
    slim = _sized(docs, key).dropDuplicates(["_key", "tie"])
    rows, pieces, _ = _plan(_numbered(slim), seed)
    per_text = pieces.groupBy("source_no", "_upto").agg(F.collect_list(F.struct("block", "times")).alias("_parts"))
    recipe = rows.where("size > 0").join(per_text, ["source_no", "_upto"]).select(
        F.col("_key").alias("_mix_key"), F.col("tie").alias("_mix_tie"),
        (F.col("_upto") - F.col("size")).alias("_mix_start"), F.col("_parts").alias("_mix_parts"),
    )
    texts = docs.withColumns({"_mix_key": key, "_mix_tie": tie}).dropDuplicates(["_mix_key", "_mix_tie"])
    made = texts.join(recipe, ["_mix_key", "_mix_tie"]).withColumn(
        "text", _assemble("text", "_mix_start", "_mix_parts.block", "_mix_parts.times")
    )
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])
