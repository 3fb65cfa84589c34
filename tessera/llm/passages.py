"""Passages of words that stand in several documents: every stretch of ``words`` words that ``documents`` documents share.

Words are those of ``words``: runs of digits, letters and characters from U+0080 on, A-Z lower-cased, so case, marks and white
space between them do not matter. A passage of so many words may be shorter than the strings ``suffix_dedup`` looks for.

1. Runs. In each window of words the gram of 17 words with the smallest hash is its anchor, so equal windows have equal anchors.
   Consecutive windows with one anchor are a run. The documents that have an anchor are counted; those of fewer than asked for have no
   window to find. Where all runs of an anchor are equal by two 64-bit hashes of their words, as in copies, these documents share
   each of its windows, and a run is one row.
2. Windows. Only the runs of the other anchors are taken apart. Their windows are counted by two such hashes,
   once for each document. Both kinds of anchors are known by Bloom tables (32 MB each at most, put together in Spark), in one
   reading of the texts; what these let pass by mistake finds no anchor to join, or too few partners.

Counts are by partial sums and joins are of tables that Spark can split, so no key's rows have to meet in one task. Matches do not
cross documents, and a window that one document repeats counts once. Rows with equal id and text count as one document: where an
id repeats, only one of each is read. Null and empty texts have no words. The words of one text are held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.decontam import make_bloom
from tessera.llm.scratch import Scratch
from tessera.llm.suffix_dedup import keyed, signed, sliding_min
from tessera.llm.words import Prefix, U, Words, mix, runs, words_of

#: Over 50 words.
WORDS, GRAM = 51, 17
#: Windows of a long text that are looked at together.
TOGETHER = 1 << 17
_PLACE_BITS = U(20)
_SALTS = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def anchors(w: Words, words: int = WORDS, gram: int = GRAM, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first windows, windows, anchor hashes) of runs of consecutive windows that share an anchor and a text; a window is named by its first word."""
    n = len(w.hash)
    if n < words:
        return
    grams = w.shingles(gram)[0]
    for lo in range(0, n - words + 1, together):
        hi = min(lo + together, n - words + 1)
        part = grams[lo : hi + words - gram]
        order = (part >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(part)).astype(U)  # ties go to the first place
        at = (sliding_min(order, words - gram + 1) & ((U(1) << _PLACE_BITS) - U(1))).astype(np.int64)
        p = lo + np.flatnonzero(w.doc[lo:hi] == w.doc[lo + words - 1 : hi + words - 1])
        if len(p):
            at, doc = at[p - lo], w.doc[p]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (p[1:] != p[:-1] + 1)])
            yield p[new], np.diff(np.r_[new, len(p)]), part[at[new]]


def joined(w: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(words lo..hi with a space after each, where each begins; the end last)."""
    size = w.end[lo:hi] - w.start[lo:hi] + 1
    begin = np.r_[0, np.cumsum(size)]
    data = w.data[np.minimum(np.arange(begin[-1]) + np.repeat(w.start[lo:hi] - begin[:-1], size), len(w.data) - 1)]
    data[begin[1:] - 1] = 32
    return data, begin


def first_of(*columns: np.ndarray) -> np.ndarray:
    """Marks one of the places that agree in all columns."""
    order = np.lexsort(columns)
    differ = [c[order][1:] != c[order][:-1] for c in columns]
    out = np.zeros(len(order), dtype=bool)
    out[order[np.flatnonzero(np.r_[True, np.logical_or.reduce(differ)])] if len(order) else order] = True
    return out


def hashes_of(w: Words, p: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words p..stop, whose own hashes are spread in two ways; p and stop ascend."""
    lo, hi = p[0], stop[-1]
    two = (Prefix(np.arange(hi - lo), mix(w.hash[lo:hi] ^ salt)) for salt in _SALTS)
    w1, w2 = (mix(prefix.of(p - lo, stop - lo) + (stop - p).astype(U)) for prefix in two)
    return w1, w2


def anchor_kinds(texts: DataFrame, words: int, gram: int) -> DataFrame:
    """key (the hash), n: how many texts have each anchor, mixed: whether its runs differ."""

    def emit(batches):
        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                w = words_of(data, offsets)
                found = [(w.doc[p], key, *hashes_of(w, p, p + many - 1 + words)) for p, many, key in anchors(w, words, gram)]
                if found:
                    doc, key, w1, w2 = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([signed(key), signed(w1), signed(w2), pa.array(first_of(doc, key).astype("i1"))], names=["key", "w1", "w2", "fresh"])

    mixed = (F.min("w1") != F.max("w1")) | (F.min("w2") != F.max("w2"))
    return texts.select("text").mapInArrow(emit, "key long, w1 long, w2 long, fresh byte").groupBy("key").agg(F.sum("fresh").alias("n"), mixed.alias("mixed"))


def placed(texts: DataFrame, kinds: DataFrame, words: int, gram: int) -> DataFrame:
    """did, h, s, stop (bytes) of the runs whose anchor may not be mixed (w1: its hash, w2: null) and of the windows whose anchor may be (w1, w2: its hashes; fresh: one of each in a text)."""

    def bloom(some: str):
        wanted = kinds.where(some).select(F.col("key").alias("s"))
        return texts.sparkSession.sparkContext.broadcast(make_bloom(wanted, wanted.count(), None))

    alike, mixed = bloom("not mixed"), bloom("mixed")

    def places(w: Words):
        for p, many, key in anchors(w, words, gram):
            hit = alike.value.places(key, np.arange(len(key)))
            yield p[hit], (p + many - 1 + words)[hit], key[hit], key[hit], np.zeros(len(hit), dtype=bool)
            hit = mixed.value.places(key, np.arange(len(key)))
            if len(hit):
                p, many = p[hit], many[hit]
                p = np.repeat(p - (np.cumsum(many) - many), many) + np.arange(many.sum())
                yield p, p + words, *hashes_of(w, p, p + words), np.ones(len(p), dtype=bool)

    def emit(batches):
        for batch in batches:
            for lo, _, data, offsets in runs(batch.column(2)):
                w = words_of(data, offsets)
                found = list(places(w))
                if found:
                    p, stop, w1, w2, window = (np.concatenate(x) for x in zip(*found))
                    doc = w.doc[p]
                    row = pa.array(lo + doc)
                    second = pa.array(w2.view(np.int64), mask=~window)
                    columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(w.start[p] - offsets[doc]), pa.array(w.end[stop - 1] - offsets[doc]), signed(w1), second, pa.array(window & first_of(doc, w1, w2, window))]
                    yield pa.RecordBatch.from_arrays(columns, names=["did", "h", "s", "stop", "w1", "w2", "fresh"])

    return texts.select("did", "h", "text").mapInArrow(emit, "did long, h long, s long, stop long, w1 long, w2 long, fresh boolean")


def shared_passages(docs: DataFrame, scratch: Scratch, documents: int = 2, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """did, h (see ``suffix_dedup.keyed``), s, stop: maximal stretches of bytes covered by windows that ``documents`` documents or more share; documents: how many share the commonest of these."""
    texts = keyed(docs).where(F.octet_length("text") >= 2 * words - 1)
    if docs.groupBy("doc_id").count().where("count > 1").head(1):
        texts = scratch.table(texts.dropDuplicates(["did", "h"]), "passage_texts")
    kinds = scratch.table(anchor_kinds(texts, words, gram).where(F.col("n") >= documents), "anchors")
    places = scratch.table(placed(texts, kinds, words, gram), "places")
    alike = places.where("w2 is null").join(kinds.where("not mixed").select(F.col("key").alias("w1"), "n"), "w1").select("did", "h", "s", "stop", "n")
    windows = places.where("w2 is not null")
    many = windows.where("fresh").groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= documents)
    found = alike.unionByName(windows.join(many, ["w1", "w2"]).select("did", "h", "s", "stop", "n"))
    in_text = Window.partitionBy("did", "h").orderBy("s", "stop")
    apart = F.coalesce(F.col("s") > F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    found = found.withColumn("new", apart.cast("int")).withColumn("stretch", F.sum("new").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = scratch.table(found.groupBy("did", "h", "stretch").agg(F.min("s").alias("s"), F.max("stop").alias("stop"), F.max("n").alias("documents")).drop("stretch"), "passages")
    scratch.drop("passage_texts", "anchors", "places")
    return spans


def passage_counts(docs: DataFrame, scratch: Scratch, **sizes) -> DataFrame:
    """did, h, n_passages, n_passage_bytes (stretches of ``shared_passages`` and their bytes), passage_documents (how many share the commonest window) of each text that has any."""
    found = shared_passages(docs, scratch, **sizes).groupBy("did", "h")
    return found.agg(F.count("*").alias("n_passages"), F.sum(F.col("stop") - F.col("s")).alias("n_passage_bytes"), F.max("documents").alias("passage_documents"))
