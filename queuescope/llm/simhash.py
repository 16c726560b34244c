"""SimHash near-duplicates by the generalised pigeonhole principle.

If the bits are cut into m partitions with thresholds t_i >= -1 that sum to t - m + 1, two fingerprints that differ in at
most t bits differ in at most t_i bits of some partition i. Correlated bits share a partition; the thresholds come from a
dynamic programme over candidate counts taken from all fingerprints. Candidates meet in buckets and are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuescope.llm.components import components
from queuescope.session import materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
BUCKET_ROWS = 2048  # larger buckets are cut into tiles of this many rows
SMALL_ROWS = 50_000  # most rows of a table that is broadcast
PROBE_COST = 200  # cost of a shuffled signature, in comparisons


def fingerprint(text: str | None) -> int:
    """Fingerprint of a whole text as a signed 64-bit integer; 0 if it has no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])),
            dtype=np.uint64,
            count=len(words) - SHINGLE + 1,
        )
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 16_384):
        part = hashes[i : i + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


# ------------------------------------------------------------------------------------------------------------ planning


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """What a fingerprint's own bits are flipped by to get its signatures.

        Up to t/2 flips on both sides reach every pair within t; for odd t the larger half is probed by both.
        """
        half = (self.threshold + 1) // 2
        return [sum(1 << b for b in chosen) for k in range(half + 1) for chosen in combinations(self.bits, k)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _signature_count(width: int, threshold: int) -> int:
    half, total, term = (threshold + 1) // 2, 1, 1
    for k in range(1, half + 1):
        term = term * (width - k + 1) // k
        total += term
    return total


def group_bits(correlation: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of nearly equal size: each starts with the strongest free pair and takes what goes with it most."""
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = (BITS - sum(map(len, groups)) + m - g - 1) // (m - g)
        left = sorted(free)
        strength = correlation[np.ix_(left, left)].copy()
        np.fill_diagonal(strength, -1)
        group = [left[int(np.argmax(strength.max(axis=1)))]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(correlation[np.ix_(rest, group)].mean(axis=1)))])
        free -= set(group)
        groups.append(tuple(sorted(group)))
    return groups


def allocate(widths: list[int], pairs: list[float], rows: int, distance: int) -> tuple[float, list[int]]:
    """Cheapest thresholds (cost, list) whose sum is distance - m + 1, by dynamic programming.

    ``pairs`` holds the pairs that agree in a whole partition; with s signatures per row a bucket is s times as full.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, equal in zip(widths, pairs):
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units in range(distance + 2 - used):
                signatures = _signature_count(width, units - 1) if units else 0
                total = cost + PROBE_COST * rows * signatures + equal * signatures**2
                if used + units not in following or total < following[used + units][0]:
                    following[used + units] = (total, [*chosen, units - 1])
        best = following
    return best[distance + 1]


def _bit_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    i, j = np.triu_indices(BITS)
    yield pa.record_batch({"i": i.astype("int32"), "j": j.astype("int32"), "n": total[i, j]})


def _as_key(mask: int) -> Column:
    return F.lit(_signed(mask)).cast("long")


def choose_partitions(prints: DataFrame, distance: int = DISTANCE) -> list[Partition]:
    """Partitions and thresholds for a table of distinct fingerprints (column fp); all of them are counted."""
    products = prints.select("fp").mapInArrow(_bit_products, "i int, j int, n double")
    sums = products.groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # 2,080 rows whatever the input
    if not sums.num_rows:
        return []
    both = np.zeros((BITS, BITS))
    both[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["n"].to_numpy()
    both = np.maximum(both, both.T)
    rows = prints.count()
    share = both.diagonal() / max(rows, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    correlation = np.abs((both / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread))
    plans = {m: group_bits(correlation, m) for m in range(1, distance + 2)}
    slots = [(m, g, sum(1 << b for b in group)) for m, groups in plans.items() for g, group in enumerate(groups)]
    keys = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(g).alias("g"), F.col("fp").bitwiseAND(_as_key(mask)).alias("key"))
        for m, g, mask in slots
    ])
    equal = (
        prints.select(F.explode(keys).alias("s")).groupBy("s").count()
        .groupBy("s.m", "s.g").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("n"))
    )
    pairs = {(r["m"], r["g"]): float(r["n"]) for r in equal.collect()}  # one row per partition of a plan
    cost, m, thresholds = min(
        (cost, m, chosen)
        for m, groups in plans.items()
        for cost, chosen in [allocate([len(g) for g in groups], [pairs.get((m, g), 0.0) for g in range(m)], rows, distance)]
    )
    return [Partition(bits, t) for bits, t in zip(plans[m], thresholds) if t >= 0]


# ------------------------------------------------------------------------------------------------- probing, verifying


def _linked(distance: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges that connect what is within the distance inside each bucket: at most one per row and bucket."""
        for batch in batches:
            column = batch.column(0)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(column.offsets.to_numpy())
            group = np.repeat(np.arange(len(sizes)), sizes)
            label = np.arange(len(values))
            lefts, rights = [], []
            for lag in range(1, int(sizes.max(initial=1))):
                near = np.flatnonzero(group[lag:] == group[:-lag])
                if len(near) == 0:
                    break
                differ = np.bitwise_count((values[near] ^ values[near + lag]).view(np.uint64))
                hit = near[differ <= distance]
                lefts.append(hit)
                rights.append(hit + lag)
                if sum(map(len, lefts)) > 1_000_000:
                    label = _hook(label, np.concatenate(lefts), np.concatenate(rights))
                    lefts, rights = [], []
            if lefts:
                label = _hook(label, np.concatenate(lefts), np.concatenate(rights))
            moved = np.flatnonzero(label != np.arange(len(label)))
            a, b = values[label[moved]], values[moved]
            keep = a != b
            yield pa.record_batch({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return linked


def _hook(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the given links and those already in ``label``."""
    label = label.copy()
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def links(prints: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what is linked by steps within the distance.

    A bucket beyond ``bucket_rows`` is cut by a salt; every pair of its salts meets in a tile, so no pair is left out and
    no task holds a whole hot bucket. Only spanning edges leave a bucket.
    """
    spark = prints.sparkSession
    plan = choose_partitions(prints, distance)
    empty = spark.createDataFrame([], "a long, b long")
    if not plan:
        return empty
    signatures = F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_as_key(p.mask)).bitwiseXOR(_as_key(f)).alias("key"))
        for i, p in enumerate(plan)
        for f in p.flips()
    ])
    rows = prints.select("fp", F.explode(signatures).alias("s")).select("fp", "s.part", "s.key")
    hot = materialize(rows.groupBy("part", "key").count().where(F.col("count") > bucket_rows))
    tiles = F.ceil(F.col("count") * 2 / bucket_rows).cast("int")
    hot = hot.select("part", "key", tiles.alias("tiles"))
    n_hot = hot.count()
    if n_hot:
        salted = rows.join(F.broadcast(hot) if n_hot <= SMALL_ROWS else hot, ["part", "key"], "left")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int"))
        other = F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)
        tile = F.transform(other, lambda o: F.struct(F.least("salt", o).alias("x"), F.greatest("salt", o).alias("y")))
        rows = salted.withColumn("tile", F.explode(tile))
    else:
        rows = rows.withColumn("tile", F.lit(0))
    buckets = rows.groupBy("part", "key", "tile").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return buckets.select("fps").mapInArrow(_linked(distance), "a long, b long")


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp"))


def _rooted(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, first, root) of each fingerprint in ``rows`` (doc_id, fp): its smallest doc_id and the root of its component."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), distance))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document row: doc_id, fingerprint, component_id (the smallest doc_id it is linked to).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give repeated results. Rows
    without a doc_id take part; a component without any doc_id has a null id. Other columns are not read.
    """
    rows = materialize(fingerprints(docs))
    labelled = _rooted(rows, distance)
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with the columns it came with: the one with the smallest doc_id, rows without one last.

    Of these the smallest fingerprint counts. Rows that repeat a doc_id with another text are documents of their own, and rows
    without a doc_id stay if no named row is near.
    """
    rooted = _rooted(materialize(fingerprints(docs)), distance)
    least = F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "fp")).alias("least")
    kept = materialize(rooted.groupBy("root").agg(least).select(
        F.col("least.first").alias("_kept"), F.col("least.fp").alias("_kept_fp")
    ))
    marked = docs.withColumn("_fp", fingerprint_column(F.col("text")))
    # A plain equality would add a filter on _fp, and that a second fingerprint of every text in a Python worker of its own.
    found = marked.join(
        kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & F.col("_fp").eqNullSafe(F.col("_kept_fp"))
    )
    return found.dropDuplicates(["doc_id", "_fp"]).drop("_fp", "_kept", "_kept_fp")
