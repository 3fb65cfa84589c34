"""Vectorised text kernels: words, their hashes and shingles of a whole batch of texts at once.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, that is digits, a-z and every
character from U+0080 on. In UTF-8 this is a rule on single bytes, so a batch is handled as one byte array.

Hashes are polynomials modulo 2**64 over prefix sums: ``S[j] - S[i]`` times the inverse power of the start
is the hash of bytes i..j, whichever text it stands in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in runs of about this many bytes; a longer text is a run of its own, hashed in pieces of this size.
RUN_BYTES = 400_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_CODE = BYTE_CODE[LOWER]
_BASE = int(_rng.integers(2**62, 2**63)) | 5
_WORD_BASE = int(_rng.integers(2**62, 2**63)) | 5
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Prefix:
    """Prefix polynomial hashes of a byte array."""

    def __init__(self, data: np.ndarray, code: np.ndarray = BYTE_CODE, base: int = _BASE):
        self.base, n = base, len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(code[data] * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


@dataclass
class Words:
    """Words of ``n`` texts: ``start``/``end`` bytes in ``data``, ``doc`` (text number), ``hash``; ``first[d]..first[d+1]`` are text d's."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.first) - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k words from each word on; valid where all lie in one text."""
        n = len(self.hash)
        out, valid = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        if n >= k:
            for i in range(k):
                out[: n - k + 1] += self.hash[i : n - k + 1 + i] * U(pow(_WORD_BASE, i, 2**64))
            valid[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return mix(out), valid

    def doc_shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every k-word shingle; a text of fewer words, but not none, is one shingle."""
        h, valid = self.shingles(k)
        counts = np.diff(self.first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            whole = np.array([shingle_hash(self.hash[self.first[d] : self.first[d + 1]]) for d in short], dtype=np.uint64)
            doc = np.concatenate([self.doc[valid], short])
            order = np.argsort(doc, kind="stable")
            return np.concatenate([h[valid], whole])[order], doc[order]
        return h[valid], self.doc[valid]


def shingle_hash(words: np.ndarray) -> int:
    """The hash that ``Words.shingles`` gives a run of words."""
    return int(mix((words * np.array([pow(_WORD_BASE, i, 2**64) for i in range(len(words))], dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True))[0])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without copying; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(texts: pa.Array, most: int = RUN_BYTES):
    """Yield (first, last, bytes, offsets) of consecutive texts with about ``most`` bytes together."""
    data, offsets = text_bytes(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of the texts in one byte array."""
    n = len(data)
    lowered = LOWER[data]
    is_word = IS_WORD[lowered]
    edge = np.zeros(n + 1, dtype=bool)  # a word may start here, as the byte before is none of a word or of another text
    edge[0] = True
    edge[1:] = True
    edge[1:n] = ~is_word[:-1] if n else True
    edge[offsets[(offsets < n)]] = True
    start = np.flatnonzero(is_word & edge[:n])
    stop = np.ones(n + 1, dtype=bool)
    stop[:n] = ~is_word
    stop[offsets] = True
    end = np.flatnonzero(stop[1:] & is_word) + 1
    hashes, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):  # word hashes do not depend on the place, so no more than a piece is expanded at once
        j = max(i + 1, int(np.searchsorted(start, start[i] + RUN_BYTES)))
        prefix = Prefix(data[start[i] : end[j - 1]], LOWER_CODE)
        hashes[i:j] = prefix.of(start[i:j] - start[i], end[i:j] - start[i])
        i = j
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(lowered, offsets, start, end, doc, mix(hashes + (end - start).astype(np.uint64)), first)
