"""Byte-level BPE by prefix sharing: the encodings of all prefixes of a batch's distinct words form a trie of last tokens.

The encoding of a prefix is the encoding of a shorter prefix and one more token, its *last token*. A token t ends the
encoding of p + t exactly if t encodes to itself and merging cannot cross the border between p's last token and t. So one
token per trie node holds the whole encoding, and a prefix that many words share is worked out once.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

VOCABULARY = "byte_bpe_50k.json"
GROUP_CHARS = 500_000  # texts are encoded in groups of about this many characters, so memory is bounded
OUTPUT_ROWS = 100  # rows whose ids are handed to Spark together
KEPT_WORDS = 320_000  # encodings a worker keeps: about 50 MB
KEPT_BYTES = 64  # longest word that is kept
KEPT_BORDERS = 300_000  # checked token pairs a worker keeps: about 30 MB
_IDS = 1 << 32  # more than any token id
# Letters of scripts that every Unicode version classes alike; texts with others are cut by the library itself.
USUAL = re.compile(r"[\x00-\u052f\u2000-\u2bff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]*")


def byte_letters() -> dict[str, int]:
    """The letter a byte-level vocabulary writes for each byte: printable ones stand for themselves, the rest follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _forget_half(kept: dict) -> None:
    """Leave the younger half of what was kept."""
    for key in list(islice(kept, len(kept) // 2)):
        del kept[key]


class BytePairEncoder:
    """Encoder and decoder of a byte-level BPE vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocabulary = data["model"]["vocab"]
        self.id_of = {raw(token): number for token, number in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {number: token for token, number in self.id_of.items()}
        self.bytes_of |= {number: content.encode() for content, number in self.special.items()}
        self.text_of = {number: str(number) for number in self.bytes_of}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.merge = {
            (vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.longest = max(map(len, self.id_of))
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        names = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.parts = re.compile(f"({names})") if names else None
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.borders: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}  # packed: a tuple would take twice the memory

    # -------------------------------------------------------------------------------------------------------- words

    def _merged(self, data: bytes) -> list[int]:
        """Encoding by merging the pair of lowest rank, for checks on one or two tokens only."""
        ids = [self.byte_ids[b] for b in data]
        merge = self.merge.get
        while True:
            lowest, place = None, 0
            for i in range(len(ids) - 1):
                found = merge((ids[i], ids[i + 1]))
                if found is not None and (lowest is None or found < lowest):
                    lowest, place = found, i
            if lowest is None:
                return ids
            ids[place : place + 2] = [lowest[1]]

    def _ends(self, left: int, token: int) -> bool:
        """Whether ``token`` follows ``left`` in an encoding (left -1: whether it stands alone); kept for the next time."""
        known = (self.bytes_of[left] if left >= 0 else b"") + self.bytes_of[token]
        if len(self.borders) > KEPT_BORDERS:
            _forget_half(self.borders)
        fits = self._merged(known) == ([left, token] if left >= 0 else [token])
        self.borders[left * _IDS + token] = fits
        return fits

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Encodings of distinct words. Sorted words visit their trie depth first; ``last`` is the path to the node."""
        token_of, known, longest = self.id_of.get, self.borders.get, self.longest
        path, last, before = b"", [-1], [0]  # last token and start of it, for each prefix on the path
        for data, word in sorted((w.encode("utf-8", "replace"), w) for w in words):
            shared, limit = 0, min(len(path), len(data))
            while shared < limit and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :], before[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = token_of(data[start:end])
                    if token is None:
                        continue
                    fits = known(last[start] * _IDS + token)
                    if fits is None:
                        fits = self._ends(last[start], token)
                    if fits:
                        last.append(token)
                        before.append(start)
                        break
            path = data
            ids, end = [], len(data)
            while end:
                ids.append(last[end])
                end = before[end]
            yield word, tuple(reversed(ids))

    # -------------------------------------------------------------------------------------------------------- texts

    def _split(self, text: str) -> Iterator[str]:
        """Pieces of a text in order; special tokens are pieces of their own."""
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                yield part
            elif not USUAL.fullmatch(part):
                for _, (start, end) in self.library.pre_tokenize_str(part):
                    yield part[start:end]
            elif len(part) <= GROUP_CHARS:
                yield from self.pieces.findall(part)
            else:
                for found in self.pieces.finditer(part):
                    yield found.group()

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Keeps the encodings of the pieces; those of long ones are returned instead."""
        words = set(pieces)
        new = words.difference(self.kept)
        if len(self.kept) + len(new) > KEPT_WORDS:
            used = {w: self.kept[w] for w in words if w in self.kept}
            _forget_half(self.kept)
            self.kept.update(used)
        long = {}
        for word, ids in self.encode_words(w for w in new if w not in self.special):
            (self.kept if len(word) <= KEPT_BYTES else long)[word] = array("i", ids).tobytes()
        self.kept.update({s: array("i", [number]).tobytes() for s, number in self.special.items()})
        return long

    def _ids(self, pieces: list[str], long: dict[str, bytes]) -> array:
        if long:
            return array("i", b"".join([self.kept.get(p) or long[p] for p in pieces]))
        return array("i", b"".join(map(self.kept.__getitem__, pieces)))

    def encode(self, texts: Iterable[str | None]) -> Iterator[array]:
        """Token ids of each whole text as an array of C ints; null counts as empty."""
        group: list[list[str]] = []
        size = 0

        def flush() -> Iterator[array]:
            long = self._learn(set(chain.from_iterable(group)))
            for pieces in group:
                yield self._ids(pieces, long)
            group.clear()

        for text in texts:
            text = text or ""
            if len(text) > GROUP_CHARS:
                yield from flush()
                size, ids, pieces = 0, array("i"), self._split(text)
                while part := list(islice(pieces, 200_000)):
                    ids += self._ids(part, self._learn(part))
                yield ids
                continue
            group.append(list(self._split(text)))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from flush()
                size = 0
        yield from flush()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder_of(spec: str) -> BytePairEncoder:
    """One encoder per worker process, so that what it has learnt serves its later tasks as well."""
    return BytePairEncoder(spec)


def vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file's text, sent to the executors once; its size does not depend on the data."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_column(spec, text: Column) -> Column:
    """array<int> of token ids of whole texts (null: none)."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            encoded = encoder.encode(batch)
            while part := [np.frombuffer(ids, "i") for ids in islice(encoded, OUTPUT_ROWS)]:
                yield pd.Series(part, dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def decode_column(spec, ids: Column) -> Column:
    """Text of token ids (null: empty)."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            yield pd.Series([encoder.decode(i if i is not None else ()) for i in batch], dtype=object)

    return decode(ids)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of every document row. Only doc_id and text are read; repeated rows give repeated results."""
    spec = vocabulary(docs.sparkSession, path)
    rows = docs.select("doc_id", encode_column(spec, F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded, in one pass.

    The digests are taken next to the text, so ids and decoded texts of all documents never have to leave the task. Null
    texts count as empty (no tokens, digests of nothing). Other columns are not read.
    """
    spec = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            rows = [
                (
                    len(ids),
                    hashlib.sha256(encoder.joined(ids).encode()).hexdigest(),
                    hashlib.sha256(encoder.decode(ids).encode()).hexdigest(),
                )
                for ids in encoder.encode(batch)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.coalesce("text", F.lit(""))).alias("_d")).select("doc_id", "_d.*")
