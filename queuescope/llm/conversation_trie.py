"""Trie of conversation prefixes by a splitter skeleton.

A rebuilt conversation is a path of turn digests. The paths are sorted by range partitioning, so a shard holds a stretch of the
order, and every node of the trie is a stretch of paths. A node lies in one shard alone unless it is on the path that
the shard shares with its neighbour across their splitter. What the neighbours share is the skeleton: it is sent
to all tasks as the depth of each splitter's path, which a shard reads off its own first and last path. Shards finish all
other nodes by themselves. Of skeleton nodes they give partial aggregates, which one ordered pass over the splitters
reduces; these rows are bounded by the number of splitters and the depth of their paths, not by the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from queuescope.session import materialize

FAMILY = 5  # conversations of one family share the beginning of its first
HEADS = 9  # a beginning has fewer turns than this
SHARD_TURNS = 200_000  # turns of the paths of a shard, about
DIGEST = 16  # bytes of a turn's digest in a path
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
_PART = f"{_NODE}, shard long, above long, seq long, own boolean, begun boolean, bytes long, ends string"


def _digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; the length of the role keeps (role, text) apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 2 * DIGEST)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests one after the other), bytes (of each turn's text) of every rebuilt conversation.

    Turns are ordered by turn (null first), and equal ones by role and text. A conversation c becomes the first
    h = crc32(c) % 9 original turns of conversation c - c % 5, then its own turns after its first h. Null role or text is
    empty. Rows without a conv_id belong to no conversation. A conversation's digests, not its texts, are held in one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("_role"), text.alias("_text"))
    # Only turns of one number need their texts to be told apart; the texts of all others stay where they are.
    same = rows.groupBy("conv_id", "turn").count().where("count > 1").select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t")
    )
    tied = rows.join(same, F.expr("conv_id = _c AND turn <=> _t"), "left")
    slim = tied.select(
        "conv_id",
        F.struct(
            "turn", F.when(F.col("_c").isNotNull(), F.col("_role")).alias("role"),
            F.when(F.col("_c").isNotNull(), F.col("_text")).alias("text"),
            _digest(F.col("_role"), F.col("_text")).alias("d"), F.octet_length("_text").cast("long").alias("b"),
        ).alias("_turn"),
    )
    own = slim.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("_turn")), lambda t: F.struct(t.d.alias("d"), t.b.alias("b"))).alias("_own")
    )
    own = materialize(own)
    base = own.select(F.col("conv_id").alias("_base"), F.slice("_own", 1, HEADS - 1).alias("_first"))
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    rest = F.slice("_own", head.cast("int") + 1, F.greatest(F.size("_own"), F.lit(1)))
    joined = own.join(base, F.col("_base") == F.col("conv_id") - F.col("conv_id") % FAMILY, "left")
    first = F.slice(F.coalesce("_first", F.array().cast("array<struct<d:string,b:bigint>>")), 1, head.cast("int"))
    whole = joined.select("conv_id", F.concat(first, rest).alias("_path"))
    return whole.select(
        "conv_id", F.unhex(F.array_join(F.col("_path.d"), "")).alias("path"), F.col("_path.b").alias("bytes")
    )


def shared_depth(a: bytes, b: bytes) -> int:
    """How many leading digests two paths share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


@F.udf(T.IntegerType())
def _shared(a, b):
    return None if a is None or b is None else shared_depth(bytes(a), bytes(b))


def sorted_shards(rebuilt: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """(paths in order with their shard, splitters): splitters have (shard, left, right), the depth shared with each neighbour.

    Equal paths are ordered by conv_id, so copies of one conversation spread over as many shards as they fill.
    """
    turns = rebuilt.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0
    rows = rebuilt.repartitionByRange(max(1, -(-turns // shard_turns)), "path", "conv_id")
    rows = rows.withColumn("shard", F.spark_partition_id().cast("long")).sortWithinPartitions("path", "conv_id")
    rows = materialize(rows)
    ends = rows.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    by_shard = W.orderBy("shard")  # one row per shard
    ends = ends.withColumn("left", _shared(F.lag("last").over(by_shard), "first"))
    return rows, ends.select("shard", F.coalesce("left", F.lit(-1)).alias("left"),
                             F.coalesce(F.lead("left").over(by_shard), F.lit(-1)).alias("right"))


class _Shard:
    """The part of the trie that a shard's sorted paths span, node by node in preorder."""

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right
        self.depth, self.parent, self.bytes, self.skeleton = [0], [-1], [0], [True]
        self.begun = [left >= 0]  # whether an earlier shard has a part of the node
        self.ends: list[list[int]] = [[]]
        self.open, self.path = [0], b""
        self.started = False

    def add(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        keep = shared_depth(self.path, path)
        del self.open[keep + 1 :]
        for depth in range(keep, len(path) // DIGEST):
            self.parent.append(self.open[-1])
            self.open.append(len(self.depth))
            self.depth.append(depth + 1)
            self.bytes.append(sizes[depth])
            self.begun.append(not self.started and depth < self.left)
            self.skeleton.append(self.begun[-1])
            self.ends.append([])
        self.ends[self.open[-1]].append(conv_id)
        self.path, self.started = path, True

    def rows(self, shard: int) -> Iterator[tuple]:
        """Finished nodes, and partial aggregates of skeleton nodes (own = false) in the order the reduction takes them."""
        for node in self.open[: self.right + 1]:
            self.skeleton[node] = True
        n = len(self.depth)
        convs, least = [len(e) for e in self.ends], [min(e, default=None) for e in self.ends]
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for node in range(n - 1, -1, -1):  # children come after their parent
            if not self.skeleton[node]:
                leaves[node] += not children[node]
                saved[node] += (convs[node] - 1) * self.bytes[node]
            above = self.parent[node]
            if above >= 0:
                convs[above] += convs[node]
                least[above] = least[node] if least[above] is None else min(least[above], least[node])
                if not self.skeleton[node]:  # the reduction adds what is below skeleton nodes
                    children[above] += 1
                    leaves[above] += leaves[node]
                    saved[above] += saved[node]
        seq = {}
        for node in range(n):
            above, own = self.parent[node], not self.skeleton[node]
            ends = ",".join(map(str, self.ends[node]))
            if not own:
                seq[node] = len(seq)
            digest = hashlib.sha256(ends.encode()).hexdigest() if own else None
            known = own and not self.skeleton[above]
            yield (
                least[node], self.depth[node], least[above] if known else None, convs[node], children[node], leaves[node],
                saved[node], digest, shard, seq[above] if own and not known else None, seq.get(node), own, self.begun[node], self.bytes[node],
                None if own else ends,
            )


def _skeleton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial aggregates of all shards in order to (finished node, and the (shard, seq) of each of its parts)."""
    out: list[tuple] = []
    stack: list[dict] = []

    def close() -> None:
        node = stack.pop()
        leaf = not node["children"]
        node["leaves"] += leaf
        node["saved"] += (node["convs"] - 1) * node["bytes"]
        node["parent"] = None
        if stack:
            above = stack[-1]
            above["children"] += 1
            above["leaves"] += node["leaves"]
            above["saved"] += node["saved"]
            above["below"].append(node)
        for child in node.pop("below"):
            child["parent"] = node["conv"]
            emit(child)
        if not stack:
            emit(node)

    def emit(node: dict) -> None:
        values = (node["conv"], node["depth"], node["parent"], node["convs"], node["children"], node["leaves"],
                  node["saved"], node["sha"].hexdigest())
        out.extend((*values, shard, seq, first) for first, (shard, seq) in zip([True] + [False] * len(node["parts"]), node["parts"]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(_FINISHED)
        out.clear()
        return pa.record_batch({n: pa.array(c, t) for (n, t), c in zip(_FINISHED.items(), columns)})

    shard = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                shard = row["shard"]
                while len(stack) > row["left"] + 1:
                    close()
            depth = row["depth"]
            if not row["begun"]:
                while len(stack) > depth:
                    close()
                stack.append({
                    "conv": row["conv_id"], "depth": depth, "bytes": row["bytes"], "convs": 0, "children": 0, "leaves": 0,
                    "saved": 0, "sha": hashlib.sha256(), "none": True, "parts": [], "below": [],
                })
            node = stack[depth]
            node["conv"] = min(node["conv"], row["conv_id"])
            for name, column in (("convs", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")):
                node[name] += row[column]
            if row["ends"]:
                node["sha"].update(row["ends"].encode() if node["none"] else b"," + row["ends"].encode())
                node["none"] = False
            node["parts"].append((row["shard"], row["seq"]))
        if len(out) > 10_000:
            yield flush()
    while stack:
        close()
    yield flush()


_FINISHED = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "at_shard": pa.int64(), "at_seq": pa.int64(),
    "first": pa.bool_(),
}


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``paths``), the textless root included.

    conv_id is the smallest conversation below a node, parent_conv_id that of its parent (root: null), n_convs their number,
    n_children the children, n_leaves the childless nodes of the subtree, saved_tokens the sum over the subtree of
    (n_convs - 1) times the bytes of a node's text, ends_sha256 the digest of the ids of the conversations that end here.
    No conversation gives no node. Repeated rows are turns of their own. Other columns are not read.
    """
    spark = turns.sparkSession
    rows, splitters = sorted_shards(paths(turns), shard_turns)
    splitters = materialize(splitters)
    depths = {r["shard"]: (r["left"], r["right"]) for r in splitters.collect()}  # two numbers per shard
    skeleton = spark.sparkContext.broadcast(depths)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None

        def finished() -> Iterator[pa.RecordBatch]:
            found = part.rows(at)
            while some := list(islice(found, 50_000)):
                yield pa.record_batch({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), zip(*some))})

        for batch in batches:
            for conv_id, path, sizes, shard in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != at:
                    if part is not None:
                        yield from finished()
                    at, part = shard, _Shard(*skeleton.value[shard])
                part.add(conv_id, path, sizes)
        if part is not None:
            yield from finished()

    kinds = {f.split()[0]: {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in _PART.split(", ")}
    # A shard's rows stay together and in order: it is dealt to one task by its number.
    dealt = rows.select("conv_id", "path", "bytes", "shard").repartition(max(1, len(depths)), "shard")
    parts = materialize(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(nodes, _PART))
    on_skeleton = parts.where("NOT own").join(splitters.select("shard", "left"), "shard")
    reduced = (
        on_skeleton.repartition(1).sortWithinPartitions("shard", "seq")
        .mapInArrow(_skeleton, f"{_NODE}, at_shard long, at_seq long, first boolean")
    )
    reduced = materialize(reduced)
    columns = [c.split()[0] for c in _NODE.split(", ")]
    parent = reduced.select("at_shard", "at_seq", F.col("conv_id").alias("_parent"))
    own = parts.where("own").join(parent, F.expr("shard = at_shard AND above = at_seq"), "left")
    own = own.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return own.select(columns).unionByName(reduced.where("first").select(columns))
