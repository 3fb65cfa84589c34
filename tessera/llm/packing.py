"""Packing documents into sequences along a Hilbert curve.

Each document becomes token ids and, from its ids hashed into buckets, a point of a few dimensions by a random
projection. The place of that point on a Hilbert curve is the key of a range sort, so that neighbours on the curve
resemble each other; along it documents are laid end to end and cut into sequences of a fixed length. What is left
at the end of a partition is cut into lengths that are powers of two, so nothing is ever padded.

Null text is an empty document: the closing id alone. Documents that repeat are packed each. Ties on the curve go by
doc_id; a null doc_id sorts first. An empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

LENGTH, CLOSING = 2048, 1
DIMS, DIM_BITS, BUCKETS = 4, 12, 1024
#: Distinct words whose ids a generation keeps, two of which a Python worker holds while a task runs.
KEPT_WORDS = 300_000
#: Bytes of token ids of a partition along the curve: a 2000th of them all between these bounds.
LEAST_PARTITION, MOST_PARTITION = 16_000_000, 512_000_000

_state: dict = {}


#: Words whose pieces are plain: letters that stay letters in lower case, then ASCII marks that never join with them (an apostrophe may).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class _Kept(dict):
    """Words and their ids; a word that is missing comes from the older generation or is encoded."""

    def __init__(self, encode, older: dict):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordIds:
    """Token ids by word. The vocabulary splits text at white space before anything else, so words are encoded once.

    Plain words go straight to the tokenizer's model, as lower-casing and byte letters are all that its other steps do
    to them; all others take every step. Whether that gives the tokenizer's own ids is tried when it is loaded; if not,
    every word takes every step. Kept words are of two generations: when the younger is full, the older goes, and
    words met again move up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.marks = Tokenizer.from_file(path), {}
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: "".join(x for x, _ in as_bytes.pre_tokenize_str(chr(c))) for c in [*range(97, 123), *range(0xDF, 0x100)]}
        self.encode, self.plain = self._word, _PLAIN.fullmatch
        self.kept = _Kept(self.encode, {})
        trial = ["Hello,", "plain", "naïve", "ÉCOLE!?", "straße.", "a", "Łódź", "übermäßig;", "x$$$", "y|_<"]
        if not all(self._word(w) == self._encode(w) for w in trial):
            self.encode = self._encode
            self.kept = _Kept(self.encode, {})

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        m = self.plain(word)
        return self._short(m) if m else self._encode(word)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _short(self, match: re.Match) -> bytes:
        letters, marks = match.groups()
        lower = letters.lower()
        if not marks and lower == letters:
            if not lower.isascii():
                lower = lower.translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(lower)]).tobytes()
        if not marks:
            return self.kept[lower]
        if marks not in self.marks:
            self.marks[marks] = self._encode(marks)
        return self.kept[lower] + self.marks[marks]

    def forget(self) -> None:
        """Start with no words: workers are used again by other operators and should not keep what they do not need."""
        self.kept = _Kept(self.encode, {})

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for t in texts:
            if len(self.kept) > KEPT_WORDS:
                self.kept.older = {}
                self.kept = _Kept(self.encode, self.kept)
            out.append(b"".join(map(self.kept.__getitem__, t.replace("\n", " ").split(" "))))
        return out


def tokenizer_at(path: str) -> WordIds:
    if _state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state.update(path=path, words=WordIds(path))
    return _state["words"]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points, one row each (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document, from the mean of its ids' projections."""
    directions = np.random.default_rng(11).standard_normal((BUCKETS, DIMS))
    out = np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        if len(x):
            count = np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS)
            v = np.log1p(count)
            out[i] = (v @ directions) / max(np.sqrt(v @ v), 1e-9)
    return hilbert(np.clip((np.tanh(out / 2) + 1) / 2 * (1 << DIM_BITS), 0, (1 << DIM_BITS) - 1), DIM_BITS)


def tokenize(docs: DataFrame, path: str, closing: int = CLOSING) -> DataFrame:
    """doc_id, key, ids (little-endian 32-bit, with the closing id)."""
    end = np.array([closing], dtype="<u4").tobytes()

    def encode(batches):
        words = tokenizer_at(path)
        words.forget()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = words.ids([t or "" for t in part.column(1).to_pylist()])
                keys = curve_keys([np.frombuffer(x, "<u4") for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "key", "ids"])
        words.forget()

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, key long, ids binary")


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _piece_packer(length: int):
    def pack(batches):
        partition = TaskContext.get().partitionId()
        number, filled, waiting, rows = partition << 33, 0, [], []

        def close(size: int):
            """Move the first ``size`` ids that wait into a sequence."""
            nonlocal number, filled, waiting
            offset, rest = 0, []
            for doc, start, ids, total in waiting:
                room = (size - offset) * 4
                if room > 0:
                    part, left = ids[:room], ids[room:]
                    rows.append((doc, start, len(part) // 4, part, total, number, offset))
                    offset += len(part) // 4
                    start += len(part) // 4
                else:
                    left = ids
                if len(left):
                    rest.append((doc, start, left, total))
            number, filled, waiting = number + 1, filled - size, rest

        def batch_of():
            nonlocal rows
            out, rows = rows, []
            doc, start, n, ids, total, sequence, offset = zip(*out) if out else [()] * 7
            big = [pa.array(x, pa.int64()) for x in (doc, start, n, total, sequence, offset)]
            return pa.RecordBatch.from_arrays([big[0], big[1], big[2], pa.array([bytes(x) for x in ids], pa.binary()), *big[3:]], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, total, view = 0, len(ids) // 4, memoryview(ids)
                while at < total:
                    take = min(length - filled, total - at)
                    waiting.append((doc, at, view[4 * at : 4 * (at + take)], total))
                    filled, at = filled + take, at + take
                    if filled == length:
                        close(length)
            if len(rows) >= 2000:
                yield batch_of()
        while filled:
            close(1 << (filled.bit_length() - 1))
        yield batch_of()

    return pack


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (bytes), doc_tokens, sequence_id, offset.

    The result reads tables of ``scratch``, which its owner may drop once the result is written.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    tokens = scratch.table(tokenize(docs, path, closing), "tokens")
    size = tokens.agg(F.sum(F.octet_length("ids"))).head()[0] or 0
    many = max(1, -(-size // min(max(size // 2000, LEAST_PARTITION), MOST_PARTITION)))
    along = tokens.repartitionByRange(many, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return along.select("doc_id", "ids").mapInArrow(_piece_packer(length), _PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
