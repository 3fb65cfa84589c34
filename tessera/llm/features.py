"""Hashed text features and the sparse linear algebra shared by the trained text models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.words import IS_WORD, BYTE_CODE, Prefix, mix, runs, words_of

BITS = 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(data: np.ndarray, offsets: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number): hashed words, runs of symbols and, if ``pairs``, neighbouring words."""
    w = words_of(data, offsets)
    n = len(data)
    is_symbol = ~(IS_WORD[data] | _SPACE[data])
    before = np.zeros(n, dtype=bool)
    before[1:] = is_symbol[:-1]
    before[offsets[offsets < n]] = False
    start = np.flatnonzero(is_symbol & ~before)
    stop = np.ones(n + 1, dtype=bool)
    stop[:n] = ~is_symbol
    stop[offsets] = True
    end = np.flatnonzero(stop[1:] & is_symbol) + 1
    symbols = mix(Prefix(data, BYTE_CODE).of(start, end) + (end - start).astype(np.uint64) + np.uint64(977))
    parts = [(w.hash, w.doc), (symbols, np.searchsorted(offsets, start, "right") - 1)]
    if pairs:
        h, valid = w.shingles(2)
        parts.append((h[valid], w.doc[valid]))
    return np.concatenate([h for h, _ in parts]), np.concatenate([d for _, d in parts])


def hashed(texts: pa.Array, bits: int = BITS, pairs: bool = False):
    """Yield (first, last, text number from 0, feature, count): the distinct features of runs of texts, in order of text."""
    for lo, hi, data, offsets in runs(texts):
        h, doc = tokens(data, offsets, pairs)
        key, count = np.unique((doc.astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        yield lo, hi, key >> bits, key & ((1 << bits) - 1), count


def _stems_of(w, bits: int, spread) -> tuple[np.ndarray, np.ndarray]:
    """(unit, feature): the distinct stems of each unit; ``spread`` gives (stem's number, unit) from the word of each stem."""
    prefix, longer = Prefix(w.data), np.flatnonzero(w.end - w.start > 5)
    five = mix(prefix.of(w.start, np.minimum(w.end, w.start + 5)) + np.uint64(5))
    seven = mix(prefix.of(w.start[longer], np.minimum(w.end[longer], w.start[longer] + 7)) + np.uint64(7))
    feature = (np.concatenate([five, seven]) >> np.uint64(64 - bits)).astype(np.int64)
    at, unit = spread(np.concatenate([np.arange(len(w.hash)), longer]))
    key, count = np.unique((unit << bits) | feature[at], return_counts=True)
    mask = (1 << bits) - 1
    often = [(key[count >= n] & ~mask) | ((key[count >= n] & mask) * 40503 + 977 * n) & mask for n in (2, 4)]
    key = np.unique(np.concatenate([key, *often]))
    return key >> bits, key & mask


def stems(texts: pa.Array, bits: int):
    """The same for the first 5 and 7 bytes of words, each again as another feature if a text has it twice, and four times."""
    for lo, hi, data, offsets in runs(texts):
        w = words_of(data, offsets)
        doc, feature = _stems_of(w, bits, lambda word: (slice(None), w.doc[word].astype(np.int64)))
        yield lo, hi, doc, feature, np.ones(len(doc), dtype=np.int64)


def window_stems(texts: pa.Array, bits: int, half: int):
    """Yield (first, last, first window of each text, number of windows of each, window, feature): the stems of windows of ``2 * half`` words, one every ``half`` words.

    A text has one window at least, and every word is in one at least; what counts twice or four times does so in one window.
    """
    for lo, hi, data, offsets in runs(texts):
        w = words_of(data, offsets)
        n = np.maximum((np.diff(w.first) - 1) // half, 1)
        first = np.r_[0, np.cumsum(n)[:-1]]

        def spread(word):
            doc = w.doc[word]
            step = (word - w.first[doc]) // half
            own, before = np.flatnonzero(step < n[doc]), np.flatnonzero(step >= 1)
            return np.concatenate([own, before]), np.concatenate([(first[doc] + step)[own], (first[doc] + step)[before] - 1])

        yield lo, hi, first, n, *_stems_of(w, bits, spread)


def row_sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, minlength=n)


class Adam:
    """The Adam update for one array of parameters."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.rate, self.t = np.zeros(shape), np.zeros(shape), rate, 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=float)))
