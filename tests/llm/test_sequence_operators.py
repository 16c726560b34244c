"""Collocations, conversation trie and positional index against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from queuescope.llm import collocations, conversation_trie, phrase_index

SMALL = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}

ODD = [
    (0, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, "word", "en"), (4, "Word", "en"), (4, "word", None),
    (None, "no key at all here, no key at all", "en"), (5, "x" * 30_000, None), (6, "tail end " * 6000, "c%\n"),
    (7, "ÄÖ é <|endoftext|> 日本 🎉 q\x00r\x1cs", "de"), (8, "a b c a b c. a b c;a b c\na\tb c  a b c " * 4, "en"),
    (9, "# * $ % & | < > ! 0 9 Z", "z"), (10, "of the cat of the cat of the dog " * 5, "en"), (11, "of the " * 11, "und"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, g, "w", 7, 0.5, "x", 1, 2) for k, t, g in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, words string, n long, score double, phrase string, shard int, place int"
    )


def none_of(spark, df):
    return spark.createDataFrame([], df.schema)


# ---------------------------------------------------------------------------------------------------- collocations (11)


def plain_collocations(rows, min_count, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= min_count}
        ranked = []
        for p, a in candidates.items():
            if len(p) == 2 and any(2 * c >= a and p in (q[:2], q[1:]) for q, c in candidates.items() if len(q) == 3):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(found)


@pytest.mark.parametrize("entries, burst, min_count", [(1_000_000, 4096, 10), (50, 3, 2)])
def test_collocations_equal_brute_force(spark, odd, monkeypatch, entries, burst, min_count):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    # Functions are sent with the values their module has in the worker, so small tries are tried in this process.
    for docs in (documents, odd):
        rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
        got = sorted(map(tuple, collocations.collocations(docs, min_count).collect()))
        assert got == plain_collocations(rows, min_count, 2000)
    monkeypatch.setattr(collocations, "TRIE_ENTRIES", entries)
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 1000)
    assert counted(documents) == plain_counts(documents)


def counted(docs):
    """Counts of phrases as the functions that run in tasks make them, in this process."""
    rows = docs.select(F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit("")).cast("binary")).toArrow()
    total = Counter()
    for size, pairs in ((2, None), (3, type("All", (), {"value": np.full(1 << 14, -1, np.int64).tobytes()}))):
        runs = [r for b in collocations._counting(size, 7, pairs)(iter(rows.to_batches(max_chunksize=50))) for r in b.to_pylist()]
        assert all(0 <= r["part"] < 7 for r in runs)
        runs.sort(key=lambda r: (r["part"], r["lang"]))
        table = pa.RecordBatch.from_pylist(runs, pa.schema([("part", pa.int32()), ("lang", pa.string()), ("run", pa.binary())]))
        for merged in collocations._merging(1)(iter([table])):
            for row in merged.to_pylist():
                if row["size"]:
                    assert (row["lang"], row["phrase"]) not in total
                    total[row["lang"], row["phrase"]] = row["f"]
    return total


def plain_counts(docs):
    total = Counter()
    for text, lang in docs.select("text", F.coalesce("lang", F.lit("und"))).collect():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total.update((lang, " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    return total


def test_no_documents_give_no_collocations(spark, odd):
    assert collocations.collocations(none_of(spark, odd)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 123_456_789_012_345, 323_456_789_012_345, 423_456_789_012_347
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._quotient("a", "l", "r")).first()
    assert row[0] == 10**6 * a * a // (l * r)


# ------------------------------------------------------------------------------------------------ conversation trie (12)


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(int(c / 5) * 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = defaultdict(lambda: [0, 0, 0])
    for node in members:
        if node:
            below[node[:-1]][0] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][1] += not below[node][0]
            below[node[:d]][2] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), *below[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def trie_rows(turns, shard_turns):
    rows = conversation_trie.prefix_trie(turns, shard_turns).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


CHATS = (
    [(c, t, "user", f"turn {t} of {c % 3}") for c in range(40) for t in range(c % 7)]
    + [(c, t, "user", f"the same {t}") for c in range(100, 160) for t in range(12)]  # copies that fill several shards
    + [(7, None, None, None), (7, None, "user", ""), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "b"), (7, 2, "é", "ÄÖ 日本")]
    + [(None, 1, "user", "nobody"), (-8, 1, "user", "below zero"), (-5, 1, "user", "x"), (3_000_000_000, 0, "a", "b" * 50_000)]
    + [(999, t, "user", "long") for t in range(300)] + [(996, 0, "a", ""), (12, 0, "ab", "c"), (13, 0, "a", "bc")]
)


@pytest.mark.parametrize("shard_turns", [4, 60, 200_000])
def test_prefix_trie_equals_brute_force(spark, shard_turns):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    turns = turns.withColumn("bytes", F.lit("x")).withColumn("shard", F.lit("y"))
    assert trie_rows(turns, shard_turns) == plain_trie(CHATS)


def test_prefix_trie_of_the_table_in_small_shards(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(turns, 20) == plain_trie(rows)
    assert conversation_trie.prefix_trie(none_of(spark, turns)).count() == 0


# --------------------------------------------------------------------------------------------------- positional index (13)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(docs, items, slack):
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add("" if item is None else str(item))
    found = []
    for doc, text in docs:
        words, hit, which, near = plain_words(text), set(), set(), set()
        for window, names in windows.items():
            n = len(window)
            at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == window]
            hit.update(i + k for i in at for k in range(n))
            which |= names if at else set()
            if set(window) <= set(words) and any(set(window) <= set(words[i : i + n + slack]) for i in range(len(words))):
                near |= names
        digest = hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()
        found.append((-1 if doc is None else doc, len(words), len(hit), len(which), digest, bool(hit), len(near)))
    return sorted(found)


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and then sleeps all day"), (2, "Lazy-Dog"), (3, None), (4, " ,. "),
    (5, "one two one two one two one two one two one two"), (None, "ÄÖ é 日本 7"), (1, "a second row of the first item"),
    (10, "the quick brown fox jumps over the lazy dog and then wakes"), (6, "never seen words zzyzx"),
]
TEXTS = [
    (0, None), (1, ""), (2, "THE QUICK brown_fox jumps, over the lazy dog... and then sleeps!"), (2, "lazy dog lazy dog"),
    (3, "one two " * 3000), (4, "dog lazy the over jumps fox brown quick and and the"), (None, "ÄÖ é 日本 7 ÄÖ é 日本 7"),
    (5, "x" * 30_000 + " lazy dog"), (6, "lazy"), (7, "dog"), (8, "quick brown fox jumps over the lazy dog and then sleeps all day"),
    (9, "a second row of the first item" + " filler" * 200 + " lazy extra dog"), (10, "\x00lazy\x1fdog\x7f"), (4, "lazy dog"),
]


@pytest.mark.parametrize("shard_bytes, windows_a_task", [(200, 3), (16 << 20, 200_000)])
def test_index_finds_what_brute_force_finds(spark, monkeypatch, shard_bytes, windows_a_task):
    monkeypatch.setattr(phrase_index, "WINDOWS_A_TASK", windows_a_task)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("term", F.lit("t")).withColumn("n", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("t"))
    index = phrase_index.build_index(docs.repartition(3), shard_bytes=shard_bytes)
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in phrase_index.contaminated(index, items).collect())
    assert got == plain_hits(TEXTS, ITEMS, phrase_index.SLACK)


def test_index_of_the_table(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, phrase_index.decontaminate(docs, items).collect()))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]
    assert got == plain_hits(*rows, phrase_index.SLACK)
    assert phrase_index.decontaminate(none_of(spark, docs), items).count() == 0
    assert phrase_index.decontaminate(docs, none_of(spark, items)).where("contaminated").count() == 0


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**33 - 1, 5])
    data, ends = phrase_index.pack(numbers)
    assert phrase_index.unpack(data).tolist() == numbers.tolist() and ends[-1] == len(data)
    assert len(phrase_index.unpack(np.zeros(0, np.uint8))) == 0
