"""Text classes told apart by how well zstandard dictionaries of each class compress a text.

Pure functions on bounded samples (training, on the driver) and on single texts (scoring, in tasks).
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard as zstd

_FRAME = dict(
    write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS
)


def logistic_fit(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton's method; ``share`` is label 1's weight."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -600.0), 600.0)))


# ------------------------------------------------------------------------------------------------------- word windows

# Every window stands between two byte runs that both dictionaries end with. A frame then always holds sequences, so no
# window falls back to a stored block, and a match may reach the window's last byte.
_HEAD = bytes(range(1, 9)) + bytes(range(14, 32))
_TAIL = bytes(range(128, 160))
_LOOK = zstd.ZstdCompressionParameters(
    window_log=17, min_match=4, strategy=zstd.STRATEGY_BTLAZY2, search_log=9, hash_log=17, chain_log=17,
    target_length=64, **_FRAME,
)
_SHORTEST, _LONGEST = 5, 9  # bytes of the runs whose counts in both classes are compared
_SUPPORT = 4  # times that a run occurs in marked texts, as counted by surroundings, at least
_RATIO = 10  # times a run has to be as frequent in marked texts as in ordinary ones
_EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))  # ASCII marks
_MAX_GAIN = 8
_THRESHOLD, _FALSE_ALARMS = 0.7, 0.005  # ordinary training texts that may reach this score, by halves unseen


def windows_of(text: str) -> list[bytes]:
    """A window is one word, lower-cased; the text's words are whitespace runs' complements, whole and in order."""
    return text.lower().encode("utf-8", "replace").split()


def _unlikely(n: np.ndarray | float, o: float, share: float) -> float:
    """Log likelihood ratio of n hits in marked and o in ordinary texts against the marked texts' share."""
    expected = (n + o) * share
    if n <= expected:
        return 0.0
    return n * math.log(n / expected) + (o * math.log(o / ((n + o) * (1 - share))) if o else 0.0)


def _runs(word: bytes, length: int) -> set[bytes]:
    framed = b" " + word + b" "
    return {framed[i : i + length] for i in range(len(framed) - length + 1)}


def _mixed(columns: Iterable[np.ndarray]) -> np.ndarray:
    """One 64-bit hash per row."""
    result = np.uint64(0)
    for c in columns:
        result = (c ^ result) * np.uint64(0x9E3779B97F4A7C15)
        result ^= result >> np.uint64(29)
    return result


def surroundings(*classes: Sequence[list[bytes]]) -> list[Counter]:
    """Per class of texts, in how many texts each word (without the marks at its edges) occurs between other neighbours.

    A passage that many texts of a class share, as near copies do, counts once: texts that have a word between the same two
    neighbours count as one. Where another class has the passage with other words in that place (two neighbours on either
    side are compared), each text counts, as then the word is what tells the classes apart.
    """
    ids: dict[bytes, int] = {}
    rows = []  # per class: word numbers, two zeros around each text
    for texts in classes:
        row = array("I", (0, 0))
        for windows in texts:
            row.extend(ids.setdefault(w.strip(_EDGES), len(ids) + 1) for w in windows)
            row.extend((0, 0))
        rows.append(np.frombuffer(row, dtype=np.uint32))

    def sides(row: np.ndarray, *places: int) -> np.ndarray:
        return _mixed([row[2 + p : len(row) - 2 + p] for p in places])

    known = [np.unique(sides(row, -2, -1, 1, 2)) for row in rows]
    found = []
    for number, row in enumerate(rows):
        words, wide = row[2:-2], sides(row, -2, -1, 1, 2)
        shared = np.zeros(len(words), dtype=bool)
        for other, places in enumerate(known):
            if other != number and len(places):
                shared |= places[np.minimum(np.searchsorted(places, wide), len(places) - 1)] == wide
        del wide
        text = np.cumsum(words == 0, dtype=np.uint32)
        place = np.where(shared, _mixed([text]), sides(row, -1, 1))
        times = None
        for key in (text, place):  # a text counts once, however often it has the word
            order = np.lexsort((key, words))
            w, k = words[order], key[order]
            first = np.ones(len(w), dtype=bool)
            first[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
            n = np.bincount(w[first], minlength=len(ids) + 1)
            times = n if times is None else np.minimum(times, n)
        found.append(Counter({w: int(times[i]) for w, i in ids.items() if w and times[i]}))
    return found


def telling_runs(in_marked: Counter, in_ordinary: Counter) -> set[bytes]:
    """Byte runs of words that stand out in marked texts; counts are different surroundings per word.

    A run that is frequent but does not tell yet grows by a byte, as a longer one may tell: the first bytes of a marked
    stem begin many ordinary words too.
    """
    n, o = max(1, in_marked.total()), max(1, in_ordinary.total())
    share = n / (n + o)
    telling: set[bytes] = set()
    undecided = None
    for length in range(_SHORTEST, _LONGEST + 1):
        counts, others = Counter(), Counter()
        for w, c in in_marked.items():
            for r in _runs(w, length):
                if undecided is None or (r[1:] in undecided and r[:-1] in undecided):
                    counts[r] += c
        frequent = {r for r, c in counts.items() if c >= _SUPPORT}
        if not frequent:
            break
        for w, c in in_ordinary.items():
            for r in frequent & _runs(w, length):
                others[r] += c
        # Chance alone reaches the logarithm of the number of runs; beyond it by ln 100, one in a hundred times.
        least = math.log(100 * len(counts))
        found = {
            r for r in frequent
            if counts[r] / n >= _RATIO * others[r] / o and _unlikely(counts[r], others[r], share) >= least
        }
        telling |= found
        undecided = frequent - found
    return telling


def _stretches(word: bytes, telling: set[bytes], lengths: Sequence[int]) -> list[bytes]:
    """The longest stretches of a word that telling runs cover."""
    framed, begin, covered, found = b" " + word + b" ", 0, 0, []
    for i in range(len(framed)):
        reach = max((i + k for k in lengths if framed[i : i + k] in telling), default=0)
        if reach and i >= covered:
            if covered:
                found.append(framed[begin:covered])
            begin = i
        covered = max(covered, reach)
    if covered:
        found.append(framed[begin:covered])
    return found


def word_dictionaries(marked: Sequence[list[bytes]], ordinary: Sequence[list[bytes]], size: int) -> tuple[bytes, bytes]:
    """Dictionary contents (ordinary, marked) from the windows of both classes.

    The ordinary one holds the windows most ordinary texts have. The marked one holds the same, so that ordinary windows
    cost the same under both, and the stretches of windows whose byte runs stand out in the marked texts.
    """
    in_marked, in_ordinary = surroundings(marked, ordinary)
    telling = telling_runs(in_marked, in_ordinary)
    lengths = sorted({len(r) for r in telling})
    stretches = Counter()
    for w, c in in_marked.items():
        for s in _stretches(w, telling, lengths):
            stretches[s] += c
    special = b"\n".join(s for s, _ in sorted(stretches.most_common(size // 8), key=lambda x: (x[1], x[0])))[-size:]
    plain, used = [], 0
    for w, _ in sorted(in_ordinary.items(), key=lambda x: (-x[1], x[0])):
        if any(r in telling for k in lengths for r in _runs(w, k)):
            continue
        used += len(w) + 1
        if used > size:
            break
        plain.append(w)
    base = b" ".join(reversed(plain)) + b" "
    end = _HEAD + b"  " + _TAIL
    return base + end, base + special + end


class _Gains(dict):
    """Bytes saved by the marked dictionary per window; worked out once per window and kept up to a bound."""

    def __init__(self, ordinary: bytes, marked: bytes, most: int = 300_000):
        super().__init__()
        self.most = most
        self.ordinary, self.marked = (
            zstd.ZstdCompressor(
                dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT),
                compression_params=_LOOK,
            ).compress
            for content in (ordinary, marked)
        )

    def __missing__(self, window: bytes) -> int:
        framed = b"".join((_HEAD, b" ", window, b" ", _TAIL))
        gain = min(max(len(self.ordinary(framed)) - len(self.marked(framed)), -1), _MAX_GAIN)
        if len(window) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[window] = gain
        return gain

    def histogram(self, windows: Iterable[bytes]) -> np.ndarray:
        """Windows per saving; one that a text repeats counts 1 + ln(times), or a repeated line would decide alone."""
        counts = Counter(windows)
        saved = np.fromiter(map(self.__getitem__, counts), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=float, count=len(counts))
        return np.bincount(saved + 1, weights=1 + np.log(times), minlength=_MAX_GAIN + 2)


@dataclass(frozen=True)
class WindowModel:
    """Two dictionaries, the weight of each saving, and the calibration of a text's sum."""

    ordinary: bytes
    marked: bytes
    weights: tuple[float, ...]
    slope: float
    intercept: float

    def gains(self) -> _Gains:
        return _Gains(self.ordinary, self.marked)

    def score(self, gains: _Gains, text: str) -> float:
        found = gains.histogram(windows_of(text))
        return sigmoid(self.slope * _evidence(found, np.array(self.weights)) + self.intercept)


def _evidence(found: np.ndarray, weights: np.ndarray) -> float:
    """Log likelihood ratio of a text's savings; the root of the number of windows takes out length."""
    return float(found @ weights) / math.sqrt(1 + found.sum() / 100)


def train_windows(sample: Sequence[tuple[int, str]], size: int = 24_000) -> WindowModel | None:
    """Model of label 1 against 0, or None if a class is missing.

    Weights and calibration come from texts that the dictionaries they are scored with have not seen (two halves).
    """
    seen: dict[str, int] = {}
    for label, text in sample:
        seen[text] = max(label, seen.get(text, 0))
    same: dict[bytes, bytes] = {}  # one object per distinct window, so the sample takes little of the driver's memory
    texts = [(label, [same.setdefault(w, w) for w in windows_of(text)]) for text, label in seen.items()]
    marked = [w for label, w in texts if label == 1]
    ordinary = [w for label, w in texts if label == 0]
    if len(marked) < 2 or len(ordinary) < 2:
        return None
    found, truth = [], []
    for half in (0, 1):
        gains = _Gains(*word_dictionaries(marked[half::2], ordinary[half::2], size))
        for label, group in ((1, marked[1 - half :: 2]), (0, ordinary[1 - half :: 2])):
            found += [gains.histogram(w) for w in group]
            truth += [label] * len(group)
    found, truth = np.array(found), np.array(truth)
    totals = [found[truth == label].sum(axis=0) + 0.5 for label in (1, 0)]
    weights = np.log(totals[0] / totals[0].sum()) - np.log(totals[1] / totals[1].sum())
    weights = np.clip(weights, -4, 4)
    weights[2:] = np.maximum.accumulate(np.maximum(weights[2:], 0))  # a larger saving never speaks against label 1
    evidence = np.array([_evidence(f, weights) for f in found])
    slope, intercept = logistic_fit(evidence[:, None], truth, 0.4)
    slope = max(slope, 0.0)
    # The evidence that all but a share of the ordinary texts stay below gets the threshold's score at most.
    limit = float(np.quantile(evidence[truth == 0], 1 - _FALSE_ALARMS, method="higher"))
    intercept = min(intercept, math.log(_THRESHOLD / (1 - _THRESHOLD)) - slope * limit - 1e-6)
    return WindowModel(*word_dictionaries(marked, ordinary, size), tuple(weights), slope, intercept)


# ------------------------------------------------------------------------------------------------------ text windows


@dataclass(frozen=True)
class SizeModel:
    """Two trained dictionaries and the calibration of the normalised difference of compressed sizes."""

    good: bytes
    bad: bytes
    window: int
    beta: tuple[float, ...]

    def compressors(self) -> tuple:
        return tuple(_trained(d) for d in (self.good, self.bad))

    def score(self, compressors: tuple, text: str) -> float:
        return sigmoid(float(np.append(size_features(compressors, text, self.window), 1.0) @ np.array(self.beta)))


def _trained(dictionary: bytes):
    data = zstd.ZstdCompressionDict(dictionary)
    return zstd.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False,
                               write_dict_id=False).compress


def cut(text: str, window: int) -> list[bytes]:
    """The whole text in windows of at most ``window`` bytes; the last two share what is left."""
    data = text.encode("utf-8", "replace")
    parts = max(1, -(-len(data) // window))
    step = -(-len(data) // parts) or 1
    return [data[i : i + step] for i in range(0, len(data), step)]


def size_features(compressors: tuple, text: str, window: int) -> np.ndarray:
    """Normalised size difference of the whole text, summed over its windows, and the logarithm of its length."""
    good, bad = compressors
    saved = size = 0
    for w in cut(text, window):
        saved += len(bad(w)) - len(good(w))
        size += len(w)
    return np.array([10 * saved / (size + 16), math.log1p(size) / 10])


def _dictionary(texts: Sequence[str], others: Sequence[str], window: int, size: int) -> bytes:
    """Dictionary of the lines of ``texts``, each once, without those of the other class.

    A passage that many texts share would else fill a dictionary and mark every text that quotes it.
    """
    known = {line for t in others for line in t.split("\n")}
    lines = dict.fromkeys(line for t in texts for line in t.split("\n") if line and line not in known)
    parts = [w for line in lines for w in cut(line, window)]
    size = min(size, sum(map(len, parts)) // 8)
    try:
        return zstd.train_dictionary(size, parts, level=3).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-max(size, 256):]


def train_sizes(sample: Sequence[tuple[int, str]], window: int = 256, size: int = 48_000) -> SizeModel | None:
    """Model of label 1 (good) against 0 (bad), or None if a class is missing; calibrated on unseen halves."""
    seen: dict[str, int] = {}
    for label, text in sample:
        seen[text] = max(label, seen.get(text, 0))
    good = [t for t, label in seen.items() if label == 1]
    bad = [t for t, label in seen.items() if label == 0]
    if len(good) < 2 or len(bad) < 2:
        return None
    rows, truth = [], []
    for half in (0, 1):
        halves = good[half::2], bad[half::2]
        pair = tuple(_trained(_dictionary(*p, window, size)) for p in (halves, halves[::-1]))
        for label, group in ((1, good[1 - half :: 2]), (0, bad[1 - half :: 2])):
            rows += [size_features(pair, t, window) for t in group]
            truth += [label] * len(group)
    beta = logistic_fit(np.array(rows), np.array(truth), 0.5, ridge=0.1)
    dictionaries = _dictionary(good, bad, window, size), _dictionary(bad, good, window, size)
    return SizeModel(*dictionaries, window, tuple(beta))
