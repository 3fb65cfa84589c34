"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A window is ten consecutive words of an item (the whole item if it has fewer, but some). Its shingles (five words, or the
whole window if that is shorter) are ordered by rarity, counted over all documents. As containment must be complete, one
shingle, the rarest, is each window's necessary prefix; a window with a shingle that no document holds can occur nowhere
and leaves the join. Documents give a candidate for each place of a prefix shingle, with the words around it. Candidates
and windows are joined on the shingle; the length bound (words enough on either side) and the positional bound (where the
shingle stands in the window fixes where the window starts) come next, then the words themselves are compared.

Benchmark and documents are joined in Spark, so neither passes through the driver. What is broadcast is a Bloom table of
shingles, at most ``MOST_CELLS`` bits at any size of the benchmark; false positives of it find no partner in the join.
Texts are told apart by two 64-bit hashes, so texts that repeat are matched once; hot shingles and texts are salted.

Whole texts count. Null texts and items have no words; items without words match nothing; items that repeat an item_id
count once in ``n_items``, and a null item_id is not listed. Documents that repeat give a row each, an empty table gives
none, and without items nothing is hit. Columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.words import U, Words, mix, runs, words_of

WINDOW, SHINGLE = 10, 5
#: Bloom table: cells for each shingle, and the most cells of all (bits; 32 MB).
CELLS_EACH, MOST_CELLS, PROBES = 256, 1 << 28, 3
#: Parts over which the rows of one hot shingle or text are dealt.
SALTS = 16
#: Windows in a batch of rows, shingles whose counts a task holds, and cells that are sent as one row.
BATCH_WINDOWS, HELD, SLAB = 20_000, 200_000, 1 << 16
#: Up to this many texts (16 bytes each) that go are broadcast; more are joined by a shuffle.
BROADCAST_GONE = 500_000


def _as_words(texts: list[str]) -> Words:
    (_, _, data, offsets), *_ = [*runs(pa.array(texts, pa.string()), most=1 << 62)]
    return words_of(data, offsets)


def _spread(w: Words, i: int, j: int) -> bytes:
    return b" ".join(bytes(w.data[s:e]) for s, e in zip(w.start[i:j], w.end[i:j]))


def _spans(w: Words, d: int, size: int = WINDOW) -> list[tuple[int, int]]:
    """First word and end of each window of text d."""
    lo, hi = int(w.first[d]), int(w.first[d + 1])
    return [(i, min(i + size, hi)) for i in range(lo, max(lo, hi - size) + 1 if hi > lo else lo)]


def windows(items: list[tuple], size: int = WINDOW) -> dict[bytes, set]:
    """window (words joined by spaces) -> ids of the items that have it."""
    out: dict[bytes, set] = {}
    if items:
        w = _as_words([t for _, t in items])
        for d, (item, _) in enumerate(items):
            for i, j in _spans(w, d, size):
                out.setdefault(_spread(w, i, j), set()).add(item)
    return out


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the k words from each word on; shingles of different widths have different hashes."""
    h, valid = w.shingles(k)
    return mix(h ^ U(k)), valid


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """words (joined by spaces), n (how many), width and shingles of each different window, items that have it (no null)."""

    def emit(batches):
        def batch_of(rows):
            item, words, n, width, held = zip(*rows) if rows else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int32()), pa.array(width, pa.int32()), pa.array(held, pa.list_(pa.int64()))], names=["item", "words", "n", "width", "shingles"])

        for batch in batches:
            items, rows = batch.column(0).to_pylist(), []
            for lo, hi, data, offsets in runs(batch.column(1)):
                w, hashes = words_of(data, offsets), {}
                for d in range(hi - lo):
                    for i, j in _spans(w, d):
                        k = min(SHINGLE, j - i)
                        if k not in hashes:
                            hashes[k] = shingles(w, k)[0].view(np.int64)
                        rows.append((items[lo + d], _spread(w, i, j).decode(), j - i, k, hashes[k][i : j - k + 1].tolist()))
                        if len(rows) >= BATCH_WINDOWS:
                            yield batch_of(rows)
                            rows = []
            yield batch_of(rows)

    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    each = texts.mapInArrow(emit, "item string, words string, n int, width int, shingles array<long>")
    return each.groupBy("words").agg(F.first("n").alias("n"), F.first("width").alias("width"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))


class Bloom:
    """Shingles that may be among those wanted: a table of bits, ``PROBES`` looked up for each."""

    def __init__(self, cells: int):
        self.cells, self.bits = cells, np.zeros((cells + 7) // 8, dtype=np.uint8)

    def cell(self, h: np.ndarray, probe: int) -> np.ndarray:
        return (mix(h + U(0x9E3779B97F4A7C15 * (probe + 1) % 2**64)) % U(self.cells)).astype(np.int64)

    def places(self, h: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of the places ``among`` in h may hold a wanted shingle."""
        for probe in range(PROBES):
            cell = self.cell(h[among], probe)
            among = among[(self.bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
        return among


def make_bloom(wanted: DataFrame, shingles_at_most: int, cells: int | None) -> Bloom:
    """The table of the hashes in ``wanted`` (column s), put together in slabs by the executors."""
    bloom = Bloom(cells or min(MOST_CELLS, max(SLAB, 1 << (CELLS_EACH * shingles_at_most).bit_length())))

    def slabs(held: dict):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slab", "bits"])

    def mark(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            cell = np.unique(np.concatenate([bloom.cell(h, probe) for probe in range(PROBES)]))
            for slab in np.unique(cell // SLAB):
                at = cell[cell // SLAB == slab] % SLAB
                np.bitwise_or.at(held.setdefault(int(slab), np.zeros(SLAB // 8, dtype=np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield slabs(held)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(bits, dtype=np.uint8)
                held[slab] = held[slab] | got if slab in held else got
        yield slabs(held)

    schema = "slab int, bits binary"
    for row in wanted.select("s").mapInArrow(mark, schema).repartition("slab").mapInArrow(merge, schema).toLocalIterator():
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        lo = row["slab"] * SLAB // 8
        bloom.bits[lo : lo + SLAB // 8] |= part[: len(bloom.bits) - lo]
    return bloom


def count_shingles(docs: DataFrame, bloom: Bloom, widths: list[int]) -> DataFrame:
    """s, often: how often each shingle of the table stands in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def count(batches):
        held = [(np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))]

        def merged():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([c for _, c in held]), len(h)).astype(np.int64)

        def rows(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["s", "n"])

        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                w = words_of(data, offsets)
                for k in widths:
                    h, valid = shingles(w, k)
                    held.append(np.unique(h[shared.value.places(h, np.flatnonzero(valid))], return_counts=True))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(*held[0])
                        held = [(np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))]
        yield rows(*merged())

    counts = docs.select("text").where("text is not null").mapInArrow(count, "s long, n long")
    return counts.groupBy("s").agg(F.sum("n").alias("often"))


def choose_prefixes(held: DataFrame, counts: DataFrame) -> DataFrame:
    """s (its rarest shingle), place of that in the window, words, n, items of each window all of whose shingles occur."""
    each = held.select("words", F.size("shingles").alias("all"), F.posexplode("shingles").alias("place", "s")).join(counts, "s")
    rarest = each.groupBy("words").agg(F.first("all").alias("all"), F.count("*").alias("found"), F.min(F.struct("often", "place", "s")).alias("rarest")).where("found = all")
    return rarest.join(held.select("words", "n", "items"), "words").select(F.col("rarest.s").alias("s"), F.col("rarest.place").alias("place"), "words", "n", "items")


_CANDIDATE = "array<struct<s: long, words: string, before: int, places: array<int>>>"
_CANDIDATE_ARROW = pa.list_(pa.struct([("s", pa.int64()), ("words", pa.string()), ("before", pa.int32()), ("places", pa.list_(pa.int32()))]))


def _candidates(docs: DataFrame, bloom: Bloom, widths: list[int]) -> DataFrame:
    """doc_id, k1, k2 (of the text), n_words, candidates: shingles of the table with the words around them, and all their places."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def emit(batches):
        for batch in batches:
            for lo, hi, data, offsets in runs(batch.column(3)):
                w = words_of(data, offsets)
                got: list[dict] = [{} for _ in range(hi - lo)]
                for k in widths:
                    h, valid = shingles(w, k)
                    signed, around = h.view(np.int64), WINDOW - k if k == SHINGLE else 0
                    for at in shared.value.places(h, np.flatnonzero(valid)).tolist():
                        d = int(w.doc[at])
                        first = max(int(w.first[d]), at - around)
                        words = _spread(w, first, min(int(w.first[d + 1]), at + k + around))
                        got[d].setdefault((int(signed[at]), words.decode(), at - first), []).append(at - int(w.first[d]))
                rows = [[{"s": s, "words": words, "before": before, "places": places} for (s, words, before), places in x.items()] for x in got]
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(w.first).astype(np.int64)), pa.array(rows, _CANDIDATE_ARROW)], names=["doc_id", "k1", "k2", "n_words", "candidates"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys("k1", "k2"), "text")
    return rows_in.mapInArrow(emit, f"doc_id long, k1 long, k2 long, n_words long, candidates {_CANDIDATE}")


def _text_keys(first: str, second: str) -> list:
    return [F.xxhash64("text").alias(first), F.xxhash64(F.lit(1), "text").alias(second)]  # (null texts are never hit)


def _salted(df: DataFrame) -> DataFrame:
    """df once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _hits(described: DataFrame, prefixes: DataFrame) -> DataFrame:
    """k1, k2, start, stop, items of each occurrence of a window, once for equal texts."""
    texts = described.where(F.size("candidates") > 0).select("k1", "k2", F.explode("candidates").alias("c")).select("k1", "k2", "c.s", "c.words", "c.before", "c.places")
    seen = texts.groupBy("k1", "k2", "s", "words", "before").agg(F.first("places").alias("places")).withColumnRenamed("words", "around")
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("k1", "around"), F.lit(SALTS)).cast("int"))
    pairs = seen.join(_salted(prefixes), ["s", "salt"])
    around, begin = F.split("around", " "), F.col("before") - F.col("place")
    pairs = pairs.where((begin >= 0) & (begin + F.col("n") <= F.size(around)))
    pairs = pairs.where(F.array_join(F.slice(around, F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ") == F.col("words"))
    start = pairs.select("k1", "k2", "n", "items", F.explode(F.transform("places", lambda p: p - F.col("place"))).alias("start"))
    return start.select("k1", "k2", "start", (F.col("start") + F.col("n")).alias("stop"), "items")


def _find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, cells: int | None) -> tuple[DataFrame, DataFrame]:
    """Written tables: the documents with their candidates, and the hits."""
    held = scratch.table(benchmark_windows(benchmark), "windows")
    known = held.agg(F.sum(F.size("shingles")).alias("n"), F.collect_set("width").alias("widths")).first()  # at most five widths
    widths, n = sorted(known["widths"]), known["n"] or 0
    every = make_bloom(held.select(F.explode("shingles").alias("s")), n, cells)
    prefixes = scratch.table(choose_prefixes(held, count_shingles(docs, every, widths)), "prefixes")
    described = scratch.table(_candidates(docs, make_bloom(prefixes, prefixes.count(), cells), widths), "described")
    return described, scratch.table(_hits(described, prefixes), "hits")


def match_benchmark(docs: DataFrame, benchmark: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs. ``cells``: bits of the Bloom table (by the benchmark's size if None)."""
    scratch = Scratch(docs.sparkSession, "decontam")
    described, hits = _find(docs, benchmark, scratch, cells)
    # words under the union of a text's intervals: what each adds beyond the furthest end before it
    before = Window.partitionBy("k1", "k2").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(before), F.lit(0))
    words = hits.select("k1", "k2", "start", "stop").distinct().withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach)))
    words = words.groupBy("k1", "k2").agg(F.sum("new").cast("long").alias("n_hit"))
    items = hits.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    items = items.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    found = scratch.table(words.join(items, ["k1", "k2"]), "found")
    none = [F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(hashlib.sha256(b"").hexdigest()).alias("items_sha256"), F.lit(False).alias("contaminated")]
    clean = described.where(F.size("candidates") == 0).select("doc_id", "n_words", *none)
    rest = described.where(F.size("candidates") > 0).select("doc_id", "n_words", "k1", "k2").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rest = rest.join(_salted(found), ["k1", "k2", "salt"], "left")
    rest = rest.select("doc_id", "n_words", F.coalesce("n_hit", none[0]).alias("n_hit"), F.coalesce("n_items", none[1]).alias("n_items"), F.coalesce("items_sha256", none[2]).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
    return clean.unionByName(rest)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cells: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The rows that hold no window of the benchmark, with all their columns.

    The result reads tables of ``scratch``, which its owner may drop once the result is written.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    _, hits = _find(docs, benchmark, scratch, cells)
    gone = scratch.table(hits.select("k1", "k2").distinct(), "gone")
    scratch.drop("windows", "prefixes", "described", "hits")
    if gone.count() <= BROADCAST_GONE:
        gone = F.broadcast(gone)
    k1, k2 = _text_keys("k1", "k2")
    return docs.join(gone, (k1 == gone["k1"]) & (k2 == gone["k2"]), "left_anti")
