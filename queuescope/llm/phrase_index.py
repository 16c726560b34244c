"""Positional inverted index of texts, cut by documents, and exact phrase and proximity search of test items in it.

The texts of a task are cut into shards of bounded size. For every shard and word the index keeps one row: how often the word
occurs, and its positions in the shard, as gaps of variable length. A shard has one more row without a word, which lists
its documents. All postings of a shard stand in one numbering of positions, so lists of different words can be
intersected by subtracting their offsets; a word that is in every text has a list per shard and no long list anywhere.

A window of test words is sent, by a join on its rarest word, to the shards that have that word. There its lists
are intersected from the rarest one of the shard, so the candidates shrink fastest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuescope.llm.common import cut_words
from queuescope.session import materialize

WINDOW = 10
SLACK = 5  # words a stretch may hold besides those of the window, for a match by proximity
SHARD_BYTES = 16 << 20  # texts of a shard, unless one text alone is longer
SHARD_DOCS = 50_000
WINDOWS_A_TASK = 200_000  # windows that meet a shard in one task; more are dealt over several
CANDIDATES = 1 << 21  # places looked at together
_KEPT = bytes(  # A-Z become a-z, every other character below \x80 but 0-9 and a-z becomes a space
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """array<string> of the words of a text (null: none)."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPLIT)
    return F.filter(cut, lambda w: w != "")


# --------------------------------------------------------------------------------------------------------- postings


def pack(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers below 2**35 in seven bits a byte, lowest first: (bytes, end of each number)."""
    n_bytes = 1 + sum((gaps >= (1 << (7 * i))).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(n_bytes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(n_bytes.max(initial=0))):
        has = n_bytes > i
        more = (n_bytes[has] > i + 1).astype(np.uint8) << 7
        out[ends[has] - n_bytes[has] + i] = ((gaps[has] >> (7 * i)) & 127).astype(np.uint8) | more
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers that ``pack`` wrote."""
    last = data < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    lengths, out = ends - starts, np.zeros(len(ends), np.int64)
    for i in range(int(lengths.max(initial=0))):
        has = lengths > i
        out[has] |= (data[starts[has] + i].astype(np.int64) & 127) << (7 * i)
    return out


def _words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of some texts one after the other, and how many each text has."""
    data = np.frombuffer(b" ".join(texts).translate(_KEPT) + b" ", np.uint8)
    words, starts = cut_words(data, data != 32)
    borders = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, borders, "left"), prepend=0)


def _shard_rows(shard: int, ids: pa.Array, texts: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    words, counts = _words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = codes << 33
    order |= np.arange(len(codes))
    order.sort()
    term, place = order >> 33, order & ((1 << 33) - 1)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    data, ends = pack(gaps)
    n = np.diff(np.append(first, len(term)))
    cuts = np.concatenate(([0], ends[first + n - 1])) if len(first) else np.zeros(1, np.int64)
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    rows, none = len(first), pa.nulls
    columns = [
        pa.array(np.full(rows + 1, shard)),
        pa.concat_arrays([coded.dictionary.cast(pa.string()), none(1, pa.string())]),
        pa.array(np.append(n, len(texts)).astype(np.int64)),
        pa.concat_arrays([lists, none(1, pa.binary())]),
        pa.concat_arrays([none(rows, pa.list_(ids.type)), pa.ListArray.from_arrays([0, len(ids)], ids)]),
        pa.concat_arrays([none(rows, pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]),
    ]
    return pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def build_index(docs: DataFrame, id_column: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of whole texts: shard, term, n, postings; and where term is null, the shard's ids and word counts.

    Null texts count as empty; every row is listed, also rows that repeat an id or have none. Other columns are not read.
    """
    id_type = docs.schema[id_column].dataType
    fields = [
        T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("postings", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        kept, texts, size, schema = [], [], 0, None
        for batch in batches:
            ids = batch.column(0)
            schema = schema or pa.schema([
                ("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("postings", pa.binary()),
                ("ids", pa.list_(ids.type)), ("counts", pa.list_(pa.int64())),
            ])
            begin = 0
            for row, text in enumerate(batch.column(1)):
                data = text.as_py() or b""
                if texts and (size + len(data) > shard_bytes or len(texts) >= SHARD_DOCS):
                    kept.append(ids.slice(begin, row - begin))
                    yield _shard_rows(shard, pa.concat_arrays(kept), texts, schema)
                    shard, kept, texts, size, begin = shard + 1, [], [], 0, row
                texts.append(data)
                size += len(data)
            kept.append(ids.slice(begin))
        if texts:
            yield _shard_rows(shard, pa.concat_arrays(kept), texts, schema)

    slim = docs.select(F.col(id_column).alias("_id"), F.col("text").cast("binary").alias("_text"))
    return materialize(slim.mapInArrow(shards, T.StructType(fields)))


def documents_of(index: DataFrame) -> DataFrame:
    """shard, place, doc_id, n_words of every document row of the index."""
    listed = index.where("term IS NULL").select("shard", F.posexplode(F.arrays_zip("ids", "counts")).alias("place", "_d"))
    return listed.select("shard", "place", F.col("_d.ids").alias("doc_id"), F.col("_d.counts").alias("n_words"))


# ----------------------------------------------------------------------------------------------------------- windows


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, items of windows): (wid, words) of every distinct window, and (wid, item_id).

    An item with fewer words than a window is one window; one without words has none. Rows of equal item_id are one item.
    """
    words = items.select(F.col("item_id"), words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.size("_w") - window + 1, F.lit(1))
    cut = words.select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("_w", i, window))).alias("words")
    )
    pairs = materialize(cut.distinct())
    windows = materialize(
        pairs.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words")
    )
    return windows, pairs.join(windows, "words").select("wid", "item_id")


def _by_rarity(index: DataFrame, windows: DataFrame) -> DataFrame:
    """wid, words, rarest of the windows whose words all occur in the index."""
    words = windows.select("wid", F.explode(F.array_distinct("words")).alias("term"))
    terms = words.select("term").distinct()
    frequency = (
        index.select("term", "n").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    )
    rarest = words.join(frequency, "term").groupBy("wid").agg(
        F.min(F.struct("n", "term")).alias("_rare"), F.count(F.lit(1)).alias("_found")
    )
    full = windows.join(rarest, "wid").where(F.size(F.array_distinct("words")) == F.col("_found"))
    return full.select("wid", "words", F.col("_rare.term").alias("rarest"))


class _Shard:
    """The lists of a shard's words as one sorted column of (word, position) keys."""

    def __init__(self, terms: pa.Array, n: np.ndarray, postings: pa.Array, counts: np.ndarray):
        self.terms, self.n = terms, n
        raw = pa.concat_arrays([postings]) if postings.offset else postings
        bounds = np.frombuffer(raw.buffers()[1], np.int32)[: len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(raw) else np.zeros(0, np.uint8)
        gaps = unpack(data)
        self.first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.zeros(0, np.int64)
        total = np.cumsum(gaps)
        before = total[self.first] - gaps[self.first]
        self.places = total - np.repeat(before, n)
        self.keys = (np.repeat(np.arange(len(n)), n) << 33) | self.places
        self.starts = np.concatenate(([0], np.cumsum(counts)))  # first position of every document

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def next_at(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first position of a word at or after a place; a large number if there is none."""
        at = np.searchsorted(self.keys, (term << 33) | np.maximum(place, 0))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (found >> 33 == term), found & ((1 << 33) - 1), 1 << 40)

    def windows(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, words, lengths) of the windows all of whose words the shard has, words padded with -1."""
        codes = pc.fill_null(pc.index_in(words.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        column = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        table = np.full((len(lengths), max(1, int(lengths.max(initial=0)))), -1, np.int64)
        table[row, column] = codes
        have = np.bincount(row, codes >= 0, len(lengths)) == lengths
        return np.flatnonzero(have), table[have], lengths[have]

    def candidates(self, table: np.ndarray, rarest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest word), for some windows at a time."""
        term = table[np.arange(len(table)), rarest]
        n = self.n[term]
        begin = 0
        for end in [*(np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1), len(n)]:
            some = n[begin:end]
            window = np.repeat(np.arange(begin, end), some)
            inside = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            yield window, self.places[np.repeat(self.first[term[begin:end]], some) + inside]
            begin = end

    def phrases(self, table: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of all exact occurrences: lists intersected at their offsets, the rarest first."""
        amount = np.where(table >= 0, self.n[table], 1 << 40)
        order = np.argsort(amount, axis=1, kind="stable")
        for window, place in self.candidates(table, order[:, 0]):
            start = place - order[window, 0]
            whole = (start >= 0) & (start + lengths[window] <= self.starts[-1])
            window, start = window[whole], start[whole]
            inside = self.document(start) == self.document(start + lengths[window] - 1)
            window, start = window[inside], start[inside]
            for step in range(1, table.shape[1]):
                offset = order[window, step]
                used = step < lengths[window]
                place = start + offset
                fits = ~used | (self.next_at(np.where(used, table[window, offset], 0), place) == place)
                window, start = window[fits], start[fits]
                if not len(window):
                    break
            yield window, start

    def spans(self, table: np.ndarray, lengths: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, first, end) of stretches of at most ``slack`` more words than the window that hold all its words."""
        rarest = np.argmin(np.where(table >= 0, self.n[table], 1 << 40), axis=1)
        for window, place in self.candidates(table, rarest):
            document = self.document(place)
            low, high = self.starts[document], self.starts[document + 1]
            longest = lengths[window] + slack
            open_ = np.ones(len(window), bool)
            for column in range(table.shape[1]):  # every word has to stand near the rarest one at all
                row = np.flatnonzero(open_)
                term = table[window[row], column]
                at = self.next_at(np.maximum(term, 0), np.maximum(place[row] - longest[row] + 1, low[row]))
                open_[row] = (term < 0) | (at < np.minimum(place[row] + longest[row], high[row]))
            for back in range(int(longest.max(initial=0))):  # a stretch starts at most so many words before the rarest
                row = np.flatnonzero(open_ & (back < longest) & (place - back >= low))
                first = place[row] - back
                end, limit = first + 1, np.minimum(first + longest[row], high[row])
                alive = np.ones(len(row), bool)
                for column in range(table.shape[1]):
                    term = table[window[row], column]
                    at = self.next_at(np.maximum(term, 0), first)
                    alive &= (term < 0) | (at < limit)
                    end = np.where(term < 0, end, np.maximum(end, at + 1))
                open_[row[alive]] = False
                yield window[row[alive]], first[alive], end[alive]


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches as one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(new[1:], True)]


_FOUND = "shard long, place int, wids array<long>, starts array<long>, ends array<long>, near array<long>"


def occurrences(index: DataFrame, windows: DataFrame, slack: int = SLACK) -> DataFrame:
    """shard, place, wids, starts, ends, near: per document the windows that occur in it, and the stretches they cover.

    ``wids`` are the windows whose words follow one another in the document, ``starts`` and ``ends`` the words they cover. ``near``
    are those all of whose words stand, in any order, in a stretch of at most ``slack`` more words than the window. Where
    there are very many windows, a document may have several rows.
    """
    ordered = materialize(_by_rarity(index, windows))
    tasks = max(1, -(-ordered.count() // WINDOWS_A_TASK))
    block = F.pmod(F.xxhash64("wid"), F.lit(tasks)).cast("int").alias("to_block")
    has = index.select(F.col("shard").alias("to_shard"), F.col("term").alias("rarest"))
    sent = ordered.join(has, "rarest").select("to_shard", block, "wid", "words")
    terms = ordered.select(F.explode("words").alias("term")).distinct()
    lists = (
        index.where("term IS NOT NULL").select("shard", "term", "n", "postings").join(terms, "term", "left_semi")
        .unionByName(index.where("term IS NULL").select("shard", "term", "n", "postings", "counts"), allowMissingColumns=True)
    )
    lists = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("block"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        left, right = left.combine_chunks(), right.combine_chunks()
        if right.num_rows:
            is_list = pc.is_valid(left["term"])
            head, own = left.filter(pc.invert(is_list)), left.filter(is_list).combine_chunks()
            one = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (own["term"], own["postings"])]
            shard = _Shard(one[0], own["n"].to_numpy(), one[1], np.array(head["counts"][0].as_py(), np.int64))
            asked, table, lengths = shard.windows(right["words"].chunk(0))
            wids = right["wid"].to_numpy()[asked]
            if len(asked):
                exact = [(w, s, s + lengths[w]) for w, s in shard.phrases(table, lengths)]
                window, first, end = (np.concatenate(c) for c in zip(*exact))
                near_window, near_first, _ = (np.concatenate(c) for c in zip(*shard.spans(table, lengths, slack)))
                order, near_order = np.argsort(first, kind="stable"), np.argsort(near_first, kind="stable")
                window, first, end = window[order], first[order], end[order]
                near_window, near_first = near_window[near_order], near_first[near_order]
                for place in np.union1d(shard.document(first), shard.document(near_first)):
                    begin, limit = shard.starts[place], shard.starts[place + 1]
                    at = slice(*np.searchsorted(first, (begin, limit)))
                    starts, ends = _merged(first[at] - begin, end[at] - begin)
                    near = np.unique(wids[near_window[slice(*np.searchsorted(near_first, (begin, limit)))]])
                    rows.append((key[0].as_py(), int(place), np.unique(wids[window[at]]), starts, ends, near))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4]
        return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(_FOUND.split(", "), columns, kinds)})

    return lists.groupBy("shard", "block").cogroup(sent.groupBy("to_shard", "to_block")).applyInArrow(search, _FOUND)


def _covered(spans: Column) -> Column:
    """How many words sorted stretches cover."""
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a.reach, s.ends).alias("reach"),
        (a.n + F.greatest(s.ends - F.greatest(a.reach, s.starts), F.lit(0))).alias("n"),
    ), lambda a: a.n)


def contaminated(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items of every document row of the index.

    ``n_hit`` are the words inside occurrences of windows, ``n_items`` the items with such windows, and the digest is that of
    their ids, sorted as strings and joined by commas; ``n_near_items`` are the items with a window whose words stand together
    in any order. Equal item_ids are one item; a null one counts and is written as an empty string. A window that many
    documents share, or a text of many rows, is only more rows of the same small size.
    """
    windows, item_of = windows_of(items, window)
    found = materialize(occurrences(index, windows, slack))
    spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    hits = found.groupBy("shard", "place").agg(spans.alias("_s")).select("shard", "place", _covered(F.col("_s")).alias("n_hit"))
    both = found.select("shard", "place", F.explode("wids").alias("wid"), F.lit(True).alias("exact")).unionByName(
        found.select("shard", "place", F.explode("near").alias("wid"), F.lit(False).alias("exact"))
    )
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    names = both.join(item_of, "wid").groupBy("shard", "place").agg(
        F.collect_set(F.when(F.col("exact"), name)).alias("_i"), F.count_distinct(F.when(~F.col("exact"), name)).alias("_near")
    )
    rows = documents_of(index).join(hits, ["shard", "place"], "left").join(names, ["shard", "place"], "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("_i", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(listed), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("_near", F.lit(0).cast("long")).alias("n_near_items"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Index the documents and report, for each row, what of the items' windows occurs in it (see ``contaminated``).

    Null texts have no words. Rows that repeat a doc_id are judged each by their own text. Empty tables give no rows, or rows
    without hits. Other columns are not read.
    """
    return contaminated(build_index(docs), items, window)
