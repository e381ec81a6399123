"""Word shingles of many texts at once, in numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: A word is a run of bytes other than a blank and U+0009..U+000D; A-Z are read as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_GAP = _BREAK.tobytes()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte, A-Z as a-z; a word's hash weighs it by another one for its place, so no two texts collide by their structure.
_OF_BYTE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _BASE)


def place_weights(n: int) -> np.ndarray:
    """Odd pseudo-random weights of the first ``n`` places of a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _MIX1) | np.uint64(1)


#: So many bytes of words are read place by place, those behind them word by word; what each byte adds at each of these places.
_PLACES = 24
_AT_PLACE = place_weights(_PLACES)[:, None] * _OF_BYTE


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a line break after each, and the first byte of each (n + 1 numbers)."""
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    return np.frombuffer(b"\n".join(raw) + b"\n" * bool(raw), np.uint8), np.r_[0, np.cumsum(size)]


def _word_edges(data: np.ndarray) -> np.ndarray:
    """First byte of every word and last + 1 byte, by turns, in bytes that end with a break."""
    gap = np.frombuffer(data.tobytes().translate(_GAP), bool)
    return np.flatnonzero(np.r_[True, gap[:-1]][: len(gap)] != gap)


def word_starts(data: np.ndarray) -> np.ndarray:
    """First byte of every word in bytes that end with a break."""
    return _word_edges(data)[::2]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last + 1 byte of every word in bytes that end with a break."""
    edges = _word_edges(data)
    start, stop = edges[::2].copy(), edges[1::2].copy()
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    length = stop - start
    order = np.argsort(np.minimum(length, _PLACES + 1).astype(np.uint8), kind="stable")
    longer = len(order) - np.cumsum(np.bincount(np.minimum(length, _PLACES + 1), minlength=_PLACES + 2))  # words of more than 0, 1, 2 ... bytes
    at, part = start[order], np.zeros(len(start), np.uint64)
    for place in range(min(int(length.max()), _PLACES)):  # the longest words are last
        n = int(longer[place])
        at, rest = at[len(at) - n :], part[len(part) - n :]
        rest += _AT_PLACE[place][data[at]]
        at += 1
    rest = order[len(order) - int(longer[_PLACES]) :]
    if len(rest):
        size = length[rest] - _PLACES
        first = np.cumsum(size) - size
        within = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        byte = data[np.repeat(start[rest] + _PLACES, size) + within]
        part[len(part) - len(rest) :] += np.add.reduceat(_OF_BYTE[byte] * place_weights(int(size.max()) + _PLACES)[within + _PLACES], first)
    value = np.empty(len(start), np.uint64)
    value[order] = part
    return mix(value + length.astype(np.uint64) * _MIX2), start, stop


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, words before each text (n + 1 numbers), and each word's first and last + 1 byte in its text."""
    data, begin = joined(texts)
    word, start, stop = word_spans(data)
    before = np.searchsorted(start, begin)
    own = np.repeat(begin[:-1], np.diff(before))
    return word, before, start - own, stop - own


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words (a shorter text: of all its words) in order, and the runs before each text."""
    word, before, _, _ = words(texts)
    count = np.diff(before)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    ends = np.r_[0, np.cumsum(runs)]
    first = np.repeat(before[:-1] - ends[:-1], runs) + np.arange(ends[-1])
    wide = np.r_[word, np.zeros(n, np.uint64)]
    inside = np.repeat(before[1:], runs)
    value = np.zeros(len(first), np.uint64)
    factor = 1
    for i in range(n):
        value += np.where(first + i < inside, wide[first + i], np.uint64(0)) * np.uint64(factor)
        factor = factor * int(_BASE) % 2**64
    value += np.minimum(np.repeat(count, runs), n).astype(np.uint64) * _MIX1
    return mix(value), ends


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and the hashes before each text."""
    value, ends = shingles(texts, n)
    parts = [np.unique(value[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.r_[0, np.cumsum(size)]
