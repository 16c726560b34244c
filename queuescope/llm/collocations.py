"""Phrase collocations from exact counts, made by a HAT-trie of word ids in every task.

A task numbers the words it meets and keeps a shallow trie of these ids: below its first word, a phrase is a key of a hash
container; a container that grows too large bursts into a node with one container per second word. When the trie holds
``TRIE_ENTRIES`` phrases, whole subtrees are spilled, the largest first, each cut by prefix partition (the first two
words) into sorted runs. A prefix partition merges the runs of all tasks and keeps the phrases that are frequent enough.

Phrases of two words come first. A phrase of three words can only be frequent if both pairs in it are, so the second pass
counts those that pass a filter of the frequent pairs. The filter has a fixed largest size and may let others pass,
which are counted for nothing; it never stops a frequent one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queuescope.llm.common import cut_words
from queuescope.session import materialize

MIN_COUNT = 10
TOP = 2000
UNKNOWN = "und"
TRIE_ENTRIES = 1_000_000  # phrases a task keeps before it spills
BURST = 4096  # keys of a container below the first word
BLOCK_BYTES = 2 << 20  # text that is cut into words at once, unless one text is longer
WORD_BYTES = 64 << 20  # words a task keeps numbered
PART_BYTES = 32 << 20  # text per prefix partition
PARTS = 32, 16_384  # fewest and most prefix partitions
FILTER_BITS = 1 << 20, 1 << 29  # smallest and largest filter; 64 MB at most
_SEP = b"\xff"  # no byte of UTF-8; id 0 stands for it
_TEXT = bytes(
    b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # odd multipliers of the words
_RUN = "part int, lang string, run binary"
_COUNT = "lang string, phrase string, size int, f long"


def _mixed(lang: int | np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of (lang, two words) from the hashes of each."""
    lang = np.atleast_1d(np.asarray(lang, np.uint64))  # arrays wrap around, which is what a hash wants
    h = lang * _K[0] + first * _K[1] + second * _K[2]
    h = (h ^ (h >> np.uint64(32))) * _K[1]
    return h ^ (h >> np.uint64(29))


def _hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """64-bit hashes of words: a polynomial of the bytes, mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    begin, length = offsets[:-1] - offsets[0], np.diff(offsets)
    power = np.cumprod(np.full(int(length.max(initial=1)), _K[2]))
    value = (letters + np.uint64(1)) * power[np.arange(len(letters)) - np.repeat(begin, length)]
    total = np.concatenate(([np.uint64(0)], np.cumsum(value, dtype=np.uint64)))  # sums wrap around
    h = total[begin + length] - total[begin]
    return (h ^ (h >> np.uint64(31))) * _K[0]


def _hash_of(word: str) -> np.uint64:
    return _hashes(pa.array([word.encode()], pa.large_binary()))[0]


class _Words:
    """Numbers of words, from 1 on, given as they come, with their texts and hashes. Number 0 is no word."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.texts = [pa.array([b""], pa.large_binary())]
        self.hashes = np.zeros(1, np.uint64)
        self.size = 0

    def ids(self, data: bytes) -> np.ndarray:
        """Numbers of the words of a text in order, with 0 before the first piece, between pieces and after the last."""
        letters = np.frombuffer(data.translate(_TEXT), np.uint8)
        words, starts = cut_words(letters, (letters != 32) & (letters != 255))
        coded = words.dictionary_encode()
        known, number = self.number, []
        fresh = []
        for place, word in enumerate(coded.dictionary.to_numpy(zero_copy_only=False).tolist()):
            n = known.get(word)
            if n is None:
                n = known[word] = len(known) + 1
                fresh.append(place)
            number.append(n)
        if fresh:
            new = coded.dictionary.take(pa.array(fresh))
            self.texts.append(new)
            self.hashes = np.concatenate((self.hashes, _hashes(new)))
            self.size += new.nbytes + 100 * len(fresh)
        numbers = np.array(number, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        piece = np.searchsorted(np.flatnonzero(letters == 255), starts)
        place = np.arange(1, len(starts) + 1) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
        out = np.zeros(place[-1] + 2 if len(place) else 1, np.int64)
        out[place] = numbers
        return out

    def texts_of(self, ids: np.ndarray) -> pa.LargeBinaryArray:
        self.texts = [pa.concat_arrays(self.texts)]
        return self.texts[0].take(pa.array(ids))


class HatTrie:
    """Counts of phrases as paths of word ids, for one language.

    ``plain`` holds one hash container per first word. A container that grew too large has burst into ``burst``: a node with
    one container per second word. A container's keys are the ids below it; two ids are one number, second << 32 | third.
    """

    def __init__(self):
        self.plain: dict[int, dict[int, int]] = {}
        self.burst: dict[int, dict[int, dict[int, int]]] = {}
        self.most = 0  # at least as many as there are phrases

    def add_pairs(self, ids: np.ndarray) -> None:
        """Count every word by the one that follows it; id 0 follows the last word of a piece."""
        first, second = ids[:-1], ids[1:]
        order = np.argsort(first, kind="stable")
        order = order[np.count_nonzero(first == 0) :]
        self.most += len(order)
        _add(self.plain, first[order], second[order].tolist())

    def add_triples(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> None:
        """Count phrases of three words."""
        order = np.lexsort((second, first))
        first, second, third = first[order], second[order], third[order]
        self.most += len(order)
        apart = np.isin(first, np.fromiter(self.burst, np.int64, len(self.burst)))
        for word, begin, end in _groups(first[apart]):
            _add(self.burst[word], second[apart][begin:end], third[apart][begin:end].tolist())
        first = first[~apart]
        _add(self.plain, first, (second[~apart] << 32 | third[~apart]).tolist())
        for word, *_ in _groups(first):
            if len(self.plain[word]) > BURST:
                node = self.burst[word] = {}
                for suffix, n in self.plain.pop(word).items():
                    node.setdefault(suffix >> 32, {})[suffix & 0xFFFFFFFF] = n

    def entries(self) -> int:
        below = sum(sum(map(len, node.values())) for node in self.burst.values())
        self.most = sum(map(len, self.plain.values())) + below
        return self.most

    def take(self, at_least: int) -> list[tuple[int, int, dict[int, int]]]:
        """Remove the largest subtrees, until they hold ``at_least`` phrases: (first word, second << 32, container)."""
        words = [*self.plain, *self.burst]
        sizes = [*map(len, self.plain.values()), *(sum(map(len, n.values())) for n in self.burst.values())]
        order = np.argsort(sizes)[::-1]
        cut = int(np.searchsorted(np.cumsum(np.array(sizes, np.int64)[order]), at_least)) + 1
        taken = []
        for place in order[:cut].tolist():
            word = words[place]
            if word in self.burst:
                taken += [(word, below << 32, container) for below, container in self.burst.pop(word).items()]
            else:
                taken.append((word, 0, self.plain.pop(word)))
        return taken


def _add(node: dict[int, dict[int, int]], words: np.ndarray, below: list[int]) -> None:
    """Count keys in the containers of sorted words."""
    for word, begin, end in _groups(words):
        container = node.get(word)
        if container is None:
            container = node[word] = {}
        for key in below[begin:end]:
            container[key] = container.get(key, 0) + 1


def _groups(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    begins = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(values[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(values)])


def _flat(subtrees: list[tuple[int, int, dict[int, int]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of whole subtrees: one row per phrase, id 0 where it has fewer words than columns."""
    lengths = np.array([len(c) for *_, c in subtrees], np.int64)
    single, prefix = (np.array([t[i] for t in subtrees], np.int64) for i in (0, 1))
    suffixes = np.fromiter(chain.from_iterable(c for *_, c in subtrees), np.int64, int(lengths.sum()))
    counts = np.fromiter(chain.from_iterable(c.values() for *_, c in subtrees), np.int64, int(lengths.sum()))
    first = np.repeat(single, lengths)
    if size == 3:
        suffixes |= np.repeat(prefix, lengths)
        return np.stack([first, suffixes >> 32, suffixes & 0xFFFFFFFF]), counts
    # A word occurs as often as something follows it.
    alone = np.add.reduceat(counts, np.cumsum(lengths) - lengths)
    pair = suffixes > 0
    words = np.concatenate((np.stack([single, np.zeros_like(single)]), np.stack([first[pair], suffixes[pair]])), axis=1)
    return words, np.concatenate((alone, counts[pair]))


def _runs(lang: str, subtrees: list[tuple[int, int, dict[int, int]]], size: int, words: _Words, parts: int) -> pa.RecordBatch:
    """The phrases of some subtrees as one sorted run per prefix partition."""
    ids, counts = _flat(subtrees, size)
    used = np.flatnonzero(np.bincount(ids.ravel(), minlength=1))
    place = np.zeros(used[-1] + 1, np.int64)
    place[used] = np.arange(len(used))
    place = place[ids]
    texts, hashes = words.texts_of(used), words.hashes[used]
    part = (_mixed(_hash_of(lang), hashes[place[0]], hashes[place[1]]) >> np.uint64(33)).astype(np.int64) % parts
    rank = np.empty(len(used), np.int64)  # numbers sort faster than texts
    rank[pc.sort_indices(texts).to_numpy()] = np.arange(len(used))
    ranks = [rank[column] for column in place]
    order = np.argsort((part << 48) | (ranks[0] << 24) | ranks[1]) if size == 2 else np.lexsort([*ranks[::-1], part])
    part, counts, place = part[order], counts[order], place[:, order]
    key, filled = texts.take(pa.array(place[0])), ids[:, order] > 0
    for column, has in zip(place[1:], filled[1:]):
        longer = pc.binary_join_element_wise(key, texts.take(pa.array(column)), pa.scalar(b" ", pa.large_binary()))
        key = longer if has.all() else pc.if_else(pa.array(has), longer, key)
    columns = {"phrase": key.cast(pa.binary()), "size": pa.array(filled.sum(axis=0).astype(np.int8)), "f": pa.array(counts.astype(np.int32))}
    table = pa.record_batch(columns)
    pack, rows = zstd.ZstdCompressor(level=1).compress, []
    for at, begin, end in _groups(part):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_batch(table.slice(begin, end - begin))
        rows.append((at, pack(sink.getvalue())))
    return pa.record_batch({
        "part": pa.array([at for at, _ in rows], pa.int32()), "lang": pa.array([lang] * len(rows), pa.string()),
        "run": pa.array([run for _, run in rows], pa.binary()),
    })


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by separators) of about a block each."""
    texts, sizes = defaultdict(list), defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, data = lang.as_py(), text.as_py()
            texts[lang].append(data)
            sizes[lang] += len(data)
            if sizes[lang] >= BLOCK_BYTES:
                yield lang, _SEP.join([b"", *texts.pop(lang), b""])
                del sizes[lang]
        if len(texts) > 64:  # very many languages: do not let their blocks pile up
            for lang in list(texts):
                yield lang, _SEP.join([b"", *texts.pop(lang), b""])
                del sizes[lang]
    for lang in texts:
        yield lang, _SEP.join([b"", *texts[lang], b""])


def _counting(size: int, parts: int, pairs=None):
    """mapInArrow function: texts to runs of phrases of one and two words, or of three that pass the filter ``pairs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tries = _Words(), defaultdict(HatTrie)
        bits = None if pairs is None else np.frombuffer(pairs.value, np.uint64)
        for lang, data in _blocks(batches):
            ids = words.ids(data)
            if bits is None:
                tries[lang].add_pairs(ids)
            else:
                known = words.hashes[ids]
                may = _may_hold(bits, _mixed(_hash_of(lang), known[:-1], known[1:]))
                may &= (ids[:-1] > 0) & (ids[1:] > 0)
                at = np.flatnonzero(may[:-1] & may[1:])
                tries[lang].add_triples(ids[at], ids[at + 1], ids[at + 2])
            if sum(t.most for t in tries.values()) > TRIE_ENTRIES:
                held = sum(t.entries() for t in tries.values())
                for name in sorted(tries, key=lambda x: -tries[x].most):
                    if held <= TRIE_ENTRIES // 2:
                        break
                    yield _runs(name, tries[name].take(min(held - TRIE_ENTRIES // 2, tries[name].most)), size, words, parts)
                    held = sum(t.entries() for t in tries.values())
            if words.size > WORD_BYTES or len(tries) > 64:
                for name, trie in tries.items():
                    if trie.entries():
                        yield _runs(name, trie.take(trie.entries()), size, words, parts)
                words, tries = _Words(), defaultdict(HatTrie)
        for name, trie in tries.items():
            if trie.entries():
                yield _runs(name, trie.take(trie.entries()), size, words, parts)

    return count


def _merging(min_count: int):
    """mapInArrow function: runs in order of their partition to the phrases with ``min_count``, and (size 0) word totals."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        rows, limit, at = 0, 1_000_000, None

        def compact() -> None:
            nonlocal kept, rows, limit
            table = pa.concat_tables(kept).group_by("phrase", use_threads=False).aggregate([("size", "min"), ("f", "sum")])
            kept = [table.select(["phrase", "size_min", "f_sum"]).rename_columns(names).cast(schema)]
            rows, limit = table.num_rows, max(limit, 2 * table.num_rows)

        def frequent() -> pa.RecordBatch:
            compact()
            (table,) = kept
            total = pc.sum(table["f"].filter(pc.equal(table["size"], 1))).as_py() or 0
            table = table.filter(pc.greater_equal(table["f"], min_count)).combine_chunks()
            n = table.num_rows + 1
            return pa.record_batch({
                "lang": pa.array([at[1]] * n, pa.string()),
                "phrase": pa.array([*(p.decode() for p in table["phrase"].to_pylist()), None], pa.string()),
                "size": pa.array([*table["size"].to_pylist(), 0], pa.int32()),
                "f": pa.array([*table["f"].to_pylist(), total], pa.int64()),
            })

        names, unpack = ["phrase", "size", "f"], zstd.ZstdDecompressor().decompress
        schema = pa.schema([("phrase", pa.large_binary()), ("size", pa.int8()), ("f", pa.int64())])
        for batch in batches:
            for part, lang, run in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at is not None and (part, lang) != at:
                    yield frequent()
                    kept, rows, limit = [], 0, 1_000_000
                at = part, lang
                with pa.ipc.open_stream(unpack(run)) as source:
                    kept.append(source.read_all().cast(schema))
                rows += kept[-1].num_rows
                if rows > limit:
                    compact()
        if kept:
            yield frequent()

    return merge


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    mask = np.uint64(64 * len(bits) - 1)
    found = np.ones(len(h), bool)
    for place in (h & mask, (h >> np.uint64(32)) & mask):
        found &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return found


def _filter_of(pairs: DataFrame):
    """Broadcast bits in which every pair of ``pairs`` has two; their number is bounded whatever the data."""
    wanted, (least, most) = 16 * pairs.count(), FILTER_BITS
    n_bits = min(most, max(least, 1 << (wanted - 1).bit_length() if wanted else least))
    mask = np.uint64(n_bits - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = _mixed(*(_hashes(c.cast(pa.large_binary())) for c in batch.columns))
            place = np.concatenate((h & mask, (h >> np.uint64(32)) & mask))
            yield pa.record_batch({
                "at": pa.array((place >> np.uint64(6)).astype(np.int64)),
                "bits": pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64)),
            })

    rows = pairs.select("lang", *(F.split("phrase", " ")[i] for i in (0, 1))).mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()  # n_bits / 64 rows at most
    bits = np.zeros(n_bits // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(bits.tobytes())


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, size, f: phrases of one to three words with f of ``min_count`` or more; size 0: all words of a lang.

    Words are counted per language (null: ``und``) within the pieces between punctuation and line breaks, overlaps included.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    size = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = min(PARTS[1], max(PARTS[0], size // PART_BYTES))

    def merged(n_words: int, pairs=None) -> DataFrame:
        runs = texts.mapInArrow(_counting(n_words, parts, pairs), _RUN)
        dealt = runs.repartition(parts, "part").sortWithinPartitions("part", "lang")
        return materialize(dealt.mapInArrow(_merging(min_count), _COUNT))

    short = merged(2)
    triples = merged(3, _filter_of(short.where("size = 2")))
    return short.unionByName(triples.where("size = 3"))


def _quotient(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of 38 digits: exact for counts below 10**15."""
    wide = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in (a, left, right)}
    return F.expr(f"(1000000BD * {wide[a]} * {wide[a]}) div ({wide[left]} * {wide[right]})")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    Candidates are phrases of two or three words with f of ``min_count`` or more. Of the cuts of a phrase the one of the
    lowest score counts, at equal scores the first. A phrase of two words is left out if one of three that holds it has at
    least half its count. Null texts are empty; null languages are ``und``; repeated rows count each; empty tables give no
    rows. Columns other than lang and text are not read.
    """
    counts = materialize(count_phrases(docs, min_count))
    totals = counts.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))

    def part(name: str, size: int, value: str) -> DataFrame:
        return counts.where(F.col("size") == size).select("lang", F.col("phrase").alias(name), F.col("f").alias(value))

    word = F.split("phrase", " ")
    pairs = counts.where("size = 2").select(
        "lang", "phrase", F.col("f").alias("a"), word[0].alias("w1"), word[1].alias("w2")
    )
    triples = counts.where("size = 3").select(
        "lang", "phrase", F.col("f").alias("a"), word[0].alias("w1"), word[2].alias("w3"),
        F.concat_ws(" ", word[0], word[1]).alias("p1"), F.concat_ws(" ", word[1], word[2]).alias("p2"),
    )
    held = triples.select("lang", "a", F.explode(F.array("p1", "p2")).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    scored = (
        pairs.join(held, ["lang", "phrase"], "left").where("_longer IS NULL OR 100 * _longer < 50 * a")
        .join(part("w1", 1, "l"), ["lang", "w1"]).join(part("w2", 1, "r"), ["lang", "w2"])
        .select("lang", "phrase", "a", "l", "r", _quotient("a", "l", "r").alias("score"))
    )
    cuts = (
        triples.join(part("w1", 1, "l1"), ["lang", "w1"]).join(part("p2", 2, "r1"), ["lang", "p2"])
        .join(part("p1", 2, "l2"), ["lang", "p1"]).join(part("w3", 1, "r2"), ["lang", "w3"])
        .select("*", _quotient("a", "l1", "r1").alias("s1"), _quotient("a", "l2", "r2").alias("s2"))
    )
    first = F.col("s1") <= F.col("s2")
    longer = cuts.select("lang", "phrase", "a", *[
        F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(n) for c, n in (("l", "l"), ("r", "r"), ("s", "score"))
    ])
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.unionByName(longer).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
