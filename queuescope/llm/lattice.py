"""Language-model scores: the marginal probability of a text over all its segmentations into pieces of a given vocabulary.

The vocabulary's own scores weight the pieces at first; expectation maximisation over the distinct words of the training texts
turns them into a unigram distribution. A piece never crosses white space, so the probability of a text is the product of those
of its words, each summed over all segmentations by a forward recursion in log space, and of one end token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import held_out
from queuescope.session import materialize

VOCABULARY = "piece_bpe_32k.model"
FOLD = (5, 1)  # rows whose crc32(doc_id as text) mod 5 is 1 are held out
ROUNDS = 2  # of expectation maximisation
PRIOR = 1000.0  # pseudo-counts that the vocabulary's own scores are worth
HOT_WORDS = 200_000  # most frequent words whose counts and scores are sent to all tasks; all others are joined
FLUSH_WORDS = 200_000  # distinct words a task counts before it hands them on
LONG_WORD = 64  # characters from which sums are kept in log space throughout
_SPACE = "▁"
_LN10 = math.log(10)


def words_of(text: str | None) -> list[str]:
    """Words of a text with A-Z in lower case."""
    return [w.decode("utf-8") for w in (text or "").encode("utf-8", "replace").lower().split()]


class Lattice:
    """Pieces with natural log weights. ``find`` maps every prefix of a piece to the piece's number, or to -1."""

    def __init__(self, pieces: list[str], byte_ids: list[int], weights: np.ndarray):
        self.weights = weights.tolist()
        self.linear = np.exp(weights).tolist()
        self.byte_ids = byte_ids
        self.end = len(pieces)
        self.find: dict[str, int] = {}
        bytes_ = set(byte_ids)
        for number, piece in enumerate(pieces):
            if number in bytes_:
                continue
            for size in range(1, len(piece)):
                self.find.setdefault(piece[:size], -1)
            self.find[piece] = number

    def edges(self, text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, pieces) of every way a stretch can be one piece; letters without a piece are spelt in bytes."""
        find = self.find.get
        for i, letter in enumerate(text):
            number = find(letter)
            if number is None or number < 0:
                yield i, i + 1, tuple(self.byte_ids[b] for b in letter.encode("utf-8", "replace"))
            size = 1
            while number is not None:
                if number >= 0:
                    yield i, i + size, (number,)
                size += 1
                if i + size > len(text):
                    break
                number = find(text[i : i + size])

    def log_probability(self, word: str) -> float:
        """Natural log of the word's probability: forward recursion, every sum taken in log space."""
        text, weights, find = _SPACE + word, self.weights, self.find.get
        size = len(text)
        arriving: list[list[float]] = [[] for _ in range(size + 1)]
        arriving[0].append(0.0)
        for i in range(size):
            here = _log_sum(arriving[i])
            arriving[i] = []
            number = find(text[i])
            if number is None or number < 0:
                arriving[i + 1].append(here + sum(weights[self.byte_ids[b]] for b in text[i].encode("utf-8", "replace")))
            j = i + 1
            while number is not None:
                if number >= 0:
                    arriving[j].append(here + weights[number])
                if j == size:
                    break
                j += 1
                number = find(text[i:j])
        return _log_sum(arriving[size])

    def expect(self, word: str, times: float, counts: list[float]) -> None:
        """Add ``times`` the expected number of uses of each piece in the word to ``counts``."""
        text = _SPACE + word
        size = len(text)
        if size > LONG_WORD or not self._expect_short(text, size, times, counts):
            self._expect_long(text, size, times, counts)

    def _expect_short(self, text: str, size: int, times: float, counts: list[float]) -> bool:
        """Forward and backward sums of plain probabilities; False if they are too small for that."""
        linear, find = self.linear, self.find.get
        ahead = [0.0] * (size + 1)
        ahead[0] = 1.0
        edges = []  # start, end, piece (-1: bytes), probability of everything up to its end
        for i in range(size):
            here = ahead[i]
            number = find(text[i])
            if number is None or number < 0:
                reached = here * math.prod(linear[self.byte_ids[b]] for b in text[i].encode("utf-8", "replace"))
                ahead[i + 1] += reached
                edges.append((i, i + 1, -1, reached))
            j = i + 1
            while number is not None:
                if number >= 0:
                    reached = here * linear[number]
                    ahead[j] += reached
                    edges.append((i, j, number, reached))
                if j == size:
                    break
                j += 1
                number = find(text[i:j])
        if ahead[size] < 1e-250:
            return False
        scale = times / ahead[size]
        behind = [0.0] * (size + 1)
        behind[size] = 1.0
        for i, j, number, reached in reversed(edges):
            share = reached * behind[j]
            behind[i] += share / ahead[i]
            if number >= 0:
                counts[number] += share * scale
            else:
                for b in text[i].encode("utf-8", "replace"):
                    counts[self.byte_ids[b]] += share * scale
        return True

    def _expect_long(self, text: str, size: int, times: float, counts: list[float]) -> None:
        edges = list(self.edges(text))
        costs = [sum(self.weights[x] for x in n) for _, _, n in edges]
        ahead, behind = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
        ahead[0] = behind[size] = 0.0
        for (i, j, _), c in zip(edges, costs):
            ahead[j] = _log_sum((ahead[j], ahead[i] + c))
        for (i, j, _), c in zip(reversed(edges), reversed(costs)):
            behind[i] = _log_sum((behind[i], behind[j] + c))
        for (i, j, numbers), c in zip(edges, costs):
            share = times * math.exp(ahead[i] + c + behind[j] - ahead[size])
            for n in numbers:
                counts[n] += share


def _log_sum(values) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    if top == -math.inf:
        return top
    return top + math.log(sum(math.exp(v - top) for v in values))


def read_vocabulary(path: str | None = None) -> tuple[list[str], list[int], np.ndarray]:
    """(pieces, number of each byte's piece, probabilities by the vocabulary's scores; the last entry is the end token).

    The scores of a BPE vocabulary are negative ranks, so they weight pieces as Zipf's law does: 1 / (rank + 10).
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    raw = np.array([1 / (10 - model.get_score(i)) for i in range(size)] + [1.0])
    raw[byte_ids] = 1e-4
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.get_score(i) < -1e8:
            raw[i], pieces[i] = 1e-12, f"\x00{i}"  # never part of a word
    return pieces, byte_ids, raw / raw.sum()


# ------------------------------------------------------------------------------------------------------------ training


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch({
            "word": pa.array([w.decode("utf-8") for w in counts], type=pa.string()),
            "c": pa.array(counts.values(), type=pa.int64()),
        })
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update((text or "").encode("utf-8", "replace").lower().split())
            if len(counts) > FLUSH_WORDS:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of the training rows, counted in tasks first."""
    texts = docs.where(~held_out("doc_id", *FOLD)).select("text")
    return texts.mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _expected(vocabulary, weights: np.ndarray):
    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, byte_ids = vocabulary.value
        lattice = Lattice(pieces, byte_ids, weights)
        counts = [0.0] * len(weights)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(word, c, counts)
        found = np.flatnonzero(counts)
        yield pa.record_batch({"piece": found.astype("int32"), "n": np.array(counts)[found]})

    return expected


def train(words: DataFrame, n_docs: int, path: str | None = None, rounds: int = ROUNDS):
    """(vocabulary broadcast, natural log weights) learnt from the counted words and ``n_docs`` end tokens."""
    pieces, byte_ids, prior = read_vocabulary(path)
    vocabulary = words.sparkSession.sparkContext.broadcast((pieces, byte_ids))
    weights = np.log(prior)
    for _ in range(rounds):
        sums = words.mapInArrow(_expected(vocabulary, weights), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        found = sums.orderBy("piece").toArrow()  # one row per piece of the vocabulary at most
        counts = PRIOR * prior
        counts[found["piece"].to_numpy()] += found["n"].to_numpy()
        counts[-1] += n_docs
        weights = np.log(counts / counts.sum())
    return vocabulary, weights


# ------------------------------------------------------------------------------------------------------------- scoring


def _frequent(words: DataFrame, most: int) -> dict[str, tuple[int, float]]:
    """Counts and scores of the most frequent words, ``most`` at most: the lowest count comes from a histogram of logarithms."""
    level = F.floor(F.log2("c") * 8)
    histogram = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # 512 rows at most
    lowest, used = math.inf, 0
    for row in sorted(histogram, key=lambda r: -r["level"]):
        used += row["n"]
        if used > most:
            break
        lowest = row["level"]
    if lowest == math.inf:
        return {}
    top = words.where(level >= lowest).toArrow()
    return dict(zip(top["word"].to_pylist(), zip(top["c"].to_pylist(), top["p"].to_pylist())))


def _word_scores(vocabulary, weights: np.ndarray):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*vocabulary.value, weights)
        for batch in batches:
            p = [lattice.log_probability(w) / _LN10 for w in batch.column(0).to_pylist()]
            yield pa.record_batch({"word": batch.column(0), "c": batch.column(1), "p": pa.array(p, type=pa.float64())})

    return scores


def _unseen_scores(vocabulary, weights: np.ndarray):
    """Column function: log10 probability of a word; null stays null."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(*vocabulary.value, weights)
        for batch in batches:
            found = {w: lattice.log_probability(w) / _LN10 for w in batch.dropna().unique()}
            yield batch.map(found).astype("float64")

    return scores


_ROW = """doc_id long, held_out boolean, row long, n_tokens long, hot_known long, hot_base double, hot_score double,
    rest array<struct<word string, n int>>"""


def _scored(hot, end_known: int, end_base: float, end_score: float, below: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (math.log10((c + 0.5) / below), p) for w, (c, p) in hot.value.items()}
        names = ["n_tokens", "hot_known", "hot_base", "hot_score"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            rest_words, rest_counts, offsets = [], [], [0]
            for text in batch.column(3).to_pylist():
                tokens = words_of(text)
                hot_known, base, score = end_known, end_base, end_score
                for word, n in Counter(tokens).items():
                    values = known.get(word)
                    if values is None:
                        rest_words.append(word)
                        rest_counts.append(n)
                    else:
                        hot_known += n
                        base += n * values[0]
                        score += n * values[1]
                for column, value in zip(columns, (len(tokens) + 1, hot_known, base, score)):
                    column.append(value)
                offsets.append(len(rest_words))
            rest = pa.ListArray.from_arrays(
                pa.array(offsets, type=pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(rest_words, type=pa.string()), pa.array(rest_counts, type=pa.int32())], ["word", "n"]
                ),
            )
            yield pa.record_batch(
                {"doc_id": batch.column(0), "held_out": batch.column(1), "row": batch.column(2)}
                | {name: pa.array(values, type=kind) for name, values, kind in zip(names, columns, kinds)}
                | {"rest": rest}
            )

    return scored


def score(docs: DataFrame, path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 values).

    Null and empty texts are the end token alone. A null doc_id is not held out. Repeated rows are counted and scored as
    documents of their own. Without training rows no token is known and the vocabulary's own weights score. Only doc_id
    and text are read. Every distinct training word is scored once; counts and scores of the most frequent ones go to all
    tasks (``hot_words`` at most), a text's other words are joined, one row per text and distinct word.
    """
    spark = docs.sparkSession
    words = materialize(word_counts(docs))
    n_docs = docs.where(~held_out("doc_id", *FOLD)).count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens = total + n_docs
    below = train_tokens + 0.5 * (distinct + int(n_docs > 0) + 1)
    vocabulary, weights = train(words, n_docs, path)
    words = materialize(words.mapInArrow(_word_scores(vocabulary, weights), "word string, c long, p double"))
    hot = spark.sparkContext.broadcast(_frequent(words, hot_words))
    end = int(n_docs > 0), math.log10((n_docs + 0.5) / below), float(weights[-1]) / _LN10
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", *FOLD).alias("held_out"),
        F.monotonically_increasing_id().alias("row"), "text",
    )
    rows = materialize(rows.mapInArrow(_scored(hot, *end, below), _ROW))
    joined = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n").join(words, "word", "left")
    unseen = _unseen_scores(vocabulary, weights)(F.when(F.col("c").isNull(), F.col("word")))
    base = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))
    rest = joined.select("row", "n", "c", base.alias("base"), F.coalesce("p", unseen).alias("p")).groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("n") * F.col("base")).alias("rest_base"),
        F.sum(F.col("n") * F.col("p")).alias("rest_score"),
    )
    return rows.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
        (F.col("hot_score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )
