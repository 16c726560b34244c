"""Exact top-k inner products: tiles of candidates against blocks of queries as matrix products, top lists merged in a tree.

A block of queries has a fixed largest size and is sent to all tasks; each task multiplies it with its tiles, keeps the best
k per query of every tile, and hands on one list per query. Lists are merged in groups, level by level, so no task ever sees
more than ``FAN_IN`` lists of a query. Blocks are worked off one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queuescope.session import materialize

K = 5
SCALE = 256
EVERY = 50  # rows whose vec_id is divisible by this are queries
BLOCK_QUERIES = 4096  # largest number of queries in a block
TILE_ROWS = 2048
FAN_IN = 32
_EXACT = 2.0**53  # sums of products below this are exact in doubles
_LONG = 2**63


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, parts): vectors scaled and floored, without null keys, null vectors and null or non-finite components.

    Empty vectors are usable: their products are 0. Components are kept as whole-numbered doubles.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    return (
        vectors.select("vec_id", parts.alias("_x"))
        .where(F.col("vec_id").isNotNull() & F.col("_x").isNotNull() & F.forall("_x", finite))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            # Spark's floor gives a long; above 2^52 every double is whole anyway.
            F.transform("_x", lambda x: F.when(F.abs(x * SCALE) < 2.0**52, F.floor(x * SCALE).cast("double"))
                        .otherwise(x * SCALE)).alias("parts"),
        )
    )


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer inner products (int64) of two matrices of whole-numbered doubles; beyond 64 bits they saturate."""
    if not queries.size or not tile.size:
        return np.zeros((len(queries), len(tile)), dtype=np.int64)
    if queries.shape[1] * np.abs(queries).max() * np.abs(tile).max() < _EXACT:
        return (queries @ tile.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    exact = whole(queries).dot(whole(tile).T)
    return np.array([[min(max(v, -_LONG), _LONG - 1) for v in row] for row in exact], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k highest scores of each row, ties to the smaller id, without the query's own id."""
    allowed = ids[None, :] != own[:, None]
    rows, cols = scores.shape
    if cols > k:
        # The k-th highest allowed score bounds what can be in the list; ties at the bound are sorted out below.
        ranked = np.where(allowed, scores, np.iinfo(np.int64).min)
        bound = np.partition(ranked, cols - k, axis=1)[:, cols - k]
        allowed &= scores >= bound[:, None]
    at, col = np.nonzero(allowed)
    return _first(at, ids[col], scores[at, col], k)


def _first(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each query row by falling score, then id. ~s = -s-1 turns the order without overflow."""
    order = np.lexsort((ids, ~scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], scores[keep]


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)


def _search(block, k: int):
    """Partial lists of one task: (query_id, task, vec_id, score)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            values, sizes = _matrix(batch.column("parts"))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            for size, (query_ids, matrix) in block.value.items():
                rows = np.flatnonzero(sizes == size)  # only vectors of the same length have a product
                for i in range(0, len(rows), TILE_ROWS):
                    part = rows[i : i + TILE_ROWS]
                    tile = values[(starts[part][:, None] + np.arange(size)[None, :])]
                    at, vec, score = best(products(matrix, tile), ids[part], query_ids, k)
                    held = lists.get(size)
                    if held is not None:
                        at, vec, score = _first(*(np.concatenate(p) for p in zip(held, (at, vec, score))), k)
                    lists[size] = [at, vec, score]
        task = TaskContext.get().partitionId()
        for size, (at, vec, score) in lists.items():
            yield pa.record_batch({
                "query_id": block.value[size][0][at],
                "task": np.full(len(at), task, dtype=np.int64),
                "vec_id": vec,
                "score": score,
            })

    return search


def _merge(lists: DataFrame, tasks: int, k: int) -> DataFrame:
    """Top lists of all tasks, merged ``FAN_IN`` at a time; the last level leaves one list per query."""
    order = [F.desc("score"), F.asc("vec_id")]
    while True:
        tasks = -(-tasks // FAN_IN)
        lists = lists.withColumn("task", F.expr(f"task div {FAN_IN}"))
        ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "task").orderBy(*order)))
        lists = ranked.where(F.col("rank") <= k)
        if tasks <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = K, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with all candidates but its own id.

    Both tables are (vec_id, parts) as :func:`usable` makes them. Ties go to the smaller vec_id. A query id with several
    rows is searched once, with its largest vector; candidate rows that share an id are candidates each. Vectors of other
    lengths have no product with a query. A query without candidates has no rows.
    """
    spark = candidates.sparkSession
    queries = materialize(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.max("parts").alias("parts")))
    count = queries.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count:
        return spark.createDataFrame([], schema)
    # Hashed blocks of about half the largest size; one that is larger all the same is cut when it is read.
    n_blocks = -(-2 * count // block_queries) if count > block_queries else 1
    placed = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    tasks = candidates.rdd.getNumPartitions()
    found = []
    for number in range(n_blocks):
        rows = placed.where(F.col("block") == number).select("query_id", "parts").toArrow()
        for begin in range(0, rows.num_rows, block_queries):
            part = rows.slice(begin, block_queries).combine_chunks()
            ids = part["query_id"].combine_chunks().to_numpy(zero_copy_only=False)
            values, sizes = _matrix(part["parts"].combine_chunks())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            by_size = {
                int(s): (ids[sizes == s], values[starts[sizes == s][:, None] + np.arange(s)[None, :]])
                for s in np.unique(sizes)
            }
            block = spark.sparkContext.broadcast(by_size)
            lists = candidates.mapInArrow(_search(block, k), "query_id long, task long, vec_id long, score long")
            found.append(materialize(_merge(lists, tasks, k)))
            block.unpersist()
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Top lists of the rows whose vec_id is divisible by ``every``, against all rows."""
    rows = usable(vectors)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
