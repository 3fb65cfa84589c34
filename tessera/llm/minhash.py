"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

Five-word shingles weigh their count in the text times the logarithm of their rarity, ``ln(1 + 1/share)`` for the share of
all documents that hold the shingle. Shares are exact down to one in 2000, below which all weigh as if at that share, so that
weights and similarities do not drift as a corpus grows. Improved consistent weighted sampling (Ioffe, 2010) draws from each text a signature whose
entries agree with the probability of the weighted Jaccard similarity; entries are banded.

Texts with equal words are one class from the start. In each band's bucket every class is verified against one
representative, chosen anew per bucket. What a bucket then still holds in different components is compared exactly in
tasks, in pairs of blocks if there is much of it, so no link between the classes of a bucket is left out; by the triangle inequality
of the Jaccard distance only those pairs are compared that can be similar enough. Verified links give connected components.

Texts without words (null, empty, symbols only) are each a group of their own. Texts of fewer than five words, but some, are one
shingle. Rows that repeat a document belong to one group. A group is named after its smallest doc_id, null if all are null. An
empty table gives no rows. Columns other than doc_id and text are not read (``near_duplicates``) or carried along (``drop_near_duplicates``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.scratch import Scratch
from tessera.llm.words import U, mix, runs, words_of

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 10, 3
#: Share of the documents under which shingles weigh alike.
RAREST = 1 / 2000
#: Cells in which shingles are counted to find the common ones, and the rows in which a task sends its cells.
CELL_BITS, SLAB_BITS = 22, 16
#: Classes of one bucket that a task compares, and bytes of their compressed texts.
BLOCK, BLOCK_BYTES = 400, 4_000_000
#: Up to this many rows (16 bytes each) that go are broadcast; more are joined by a shuffle.
BROADCAST_GONE = 500_000

_rng = np.random.default_rng(7)
_R, _LOG_C = _rng.gamma(2.0, 1.0, 4096), np.log(_rng.gamma(2.0, 1.0, 4096))
_INVERSE_R = 1 / _R
_SEEDS = _rng.integers(1, 2**63, 512, dtype=np.uint64)


@dataclass
class Rarity:
    """Weights by rarity: ``weight`` of the ``common`` shingles (sorted hashes), ``rest`` of all others."""

    common: np.ndarray
    weight: np.ndarray
    rest: float

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(shingles), self.rest)
        at = np.searchsorted(self.common, shingles).clip(max=len(self.common) - 1)
        return np.where(self.common[at] == shingles, self.weight[at], self.rest)


def distinct_shingles(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text number, count) of the distinct shingles of each text, in order of text and hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)
    return h[new], doc[new], np.diff(np.r_[new, len(h)])


def hot_cells(texts: DataFrame, least: int) -> np.ndarray:
    """Which cells hold shingles of at least ``least`` documents together (so every shingle of so many is in one)."""

    def count(batches):
        total = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                h, _, _ = distinct_shingles(*words_of(data, offsets).doc_shingles(SHINGLE))
                np.add.at(total, (h >> U(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
        squeeze, slabs = zstandard.ZstdCompressor(level=1), total.reshape(-1, 1 << SLAB_BITS)
        some = np.flatnonzero(slabs.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array([squeeze.compress(slabs[i].astype("<u4").tobytes()) for i in some], pa.binary())], names=["slab", "counts"])

    def add(batches):
        unpack, total = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for slab, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(unpack.decompress(counts.as_buffer()), "<u4").astype(np.int64)
                total[slab] = total[slab] + got if slab in total else got
        hot = [(slab << SLAB_BITS) + np.flatnonzero(n >= least) for slab, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hot or [np.zeros(0, np.int64)]))], names=["cell"])

    cells = texts.mapInArrow(count, "slab int, counts binary").repartition("slab").mapInArrow(add, "cell long").toPandas()["cell"].to_numpy(dtype=np.int64)
    out = np.zeros(1 << CELL_BITS, dtype=bool)
    out[cells] = True
    return out


def count_rarity(docs: DataFrame) -> Rarity:
    """Document frequencies over all documents, exact for every shingle of more than ``RAREST`` of them.

    First cells are counted, then the shingles of the cells that may hold a common one. Common ones are at most the mean
    number of shingles of a document divided by ``RAREST``, at any size of the corpus.
    """
    n, texts = max(docs.count(), 1), docs.select("text").where("text is not null")
    least = max(2, int(np.ceil(RAREST * n)))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(hot_cells(texts, least)))

    def count(batches):
        hot, kept = np.unpackbits(shared.value).astype(bool), [(np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))]

        def merged():
            h, at = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([c for _, c in kept]), len(h)).astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                h, _, _ = distinct_shingles(*words_of(data, offsets).doc_shingles(SHINGLE))
                kept.append(np.unique(h[hot[(h >> U(64 - CELL_BITS)).astype(np.int64)]], return_counts=True))
                if sum(len(x) for x, _ in kept[1:]) > 200_000:
                    kept = [merged()]
                    if len(kept[0][0]) > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(kept[0][0].view(np.int64)), pa.array(kept[0][1])], names=["shingle", "n"])
                        kept = [(np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))]
        h, c = merged()
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["shingle", "n"])

    counts = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    common, df = counts["shingle"].to_numpy(dtype=np.int64).view(U), counts["n"].to_numpy(dtype=float)
    order = np.argsort(common)
    return Rarity(common[order], np.log1p(n / np.maximum(df[order], RAREST * n)), float(np.log1p(n / max(1.0, RAREST * n))))


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, entries: int) -> np.ndarray:
    """(n, entries) samples by improved consistent weighted sampling; rows of texts without shingles stay 0."""
    out = np.zeros((n, entries), dtype=np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    each, log_w = np.diff(np.r_[first, len(h)]), np.log(weight)
    for k in range(entries):
        u = mix(h ^ _SEEDS[k])
        ri = (u & U(4095)).astype(np.int64)
        beta = ((u >> U(24)) & U((1 << 40) - 1)).astype(float) * 2.0**-40
        t = np.floor(log_w * _INVERSE_R[ri] + beta)
        a = _LOG_C[((u >> U(12)) & U(4095)).astype(np.int64)] - _R[ri] * (t - beta + 1)
        least = np.minimum.reduceat(a, first)
        at = np.flatnonzero(a == np.repeat(least, each))
        at = at[np.r_[True, doc[at][1:] != doc[at][:-1]]]
        out[doc[at], k] = mix(h[at] + t[at].astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15))
    return out


def describe(docs: DataFrame, rarity: Rarity, bands: int, rows: int) -> DataFrame:
    """did, h (identity of the row), f (of its words), keys (of its bands; empty without words), text (compressed)."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def emit(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo, hi, data, offsets in runs(batch.column(2)):
                w = words_of(data, offsets)
                h, doc, count = distinct_shingles(*w.doc_shingles(SHINGLE))
                sig = signatures(h, doc, count * shared.value.of(h), hi - lo, bands * rows)
                keys = np.zeros((hi - lo, bands), dtype=np.uint64)
                for i in range(bands):
                    x = np.full(hi - lo, _SEEDS[-1 - i])
                    for j in range(rows):
                        x = mix(x ^ sig[:, i * rows + j])
                    keys[:, i] = x
                place = mix((np.arange(len(w.hash)) - w.first[w.doc]).astype(U))
                sums = np.r_[U(0), np.cumsum(mix(w.hash ^ place), dtype=U)]
                f = mix(sums[w.first[1:]] - sums[w.first[:-1]] + np.diff(w.first).astype(U))
                some = np.diff(w.first) > 0
                text = [squeeze.compress(data[offsets[i] : offsets[i + 1]].tobytes()) if some[i] else None for i in range(hi - lo)]
                lists = [keys[i].view(np.int64) if some[i] else [] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(f.view(np.int64), mask=~some), pa.array(lists, pa.list_(pa.int64())), pa.array(text, pa.binary())], names=["did", "h", "f", "keys", "text"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return rows_in.mapInArrow(emit, "did long, h long, f long, keys array<long>, text binary")


class Texts:
    """Shingles, counts and weights of texts, kept for the few that a batch meets again and again."""

    def __init__(self, rarity: Rarity):
        self.rarity, self.kept, self.unpack, self.size = rarity, {}, zstandard.ZstdDecompressor(), 0

    def of(self, f: int, packed: bytes):
        got = self.kept.get(f)
        if got is None:
            raw = np.frombuffer(self.unpack.decompress(packed), dtype=np.uint8)
            h, _, count = distinct_shingles(*words_of(raw, np.array([0, len(raw)])).doc_shingles(SHINGLE))
            weight = count * self.rarity.of(h)
            got = h, weight, float(weight.sum())
            self.size += len(h)
            if self.size > 2_000_000:
                self.kept.clear()
                self.size = len(h)
            self.kept[f] = got
        return got


def similarity(x, y) -> float:
    """Weighted Jaccard similarity of two texts."""
    (hx, wx, sx), (hy, wy, sy) = (x, y) if len(x[0]) < len(y[0]) else (y, x)
    at = np.searchsorted(hy, hx).clip(max=len(hy) - 1)
    same = hy[at] == hx
    both = float(np.minimum(wx[same], wy[at[same]]).sum())
    return both / (sx + sy - both)


def verify(pairs: DataFrame, texts: DataFrame, rarity: Rarity) -> DataFrame:
    """x, y, similarity of pairs of classes, exactly."""
    shared = pairs.sparkSession.sparkContext.broadcast(rarity)
    left = texts.select(F.col("f").alias("x"), F.col("text").alias("text_x"))
    right = texts.select(F.col("f").alias("y"), F.col("text").alias("text_y"))

    def emit(batches):
        texts = Texts(shared.value)
        for batch in batches:
            x, y, tx, ty = (c for c in batch.columns)
            out = []
            for a, b, i, j in zip(x.to_pylist(), y.to_pylist(), tx, ty):
                out.append(similarity(texts.of(a, i.as_py()), texts.of(b, j.as_py())))
            yield pa.RecordBatch.from_arrays([x, y, pa.array(out, pa.float64())], names=["x", "y", "similarity"])

    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "text_x", "text_y")
    return joined.mapInArrow(emit, "x long, y long, similarity double")


def compare_rest(rest: DataFrame, texts: DataFrame, rarity: Rarity, scratch: Scratch, least: float, block: int) -> DataFrame:
    """u, v: links between classes of one bucket in different components. ``rest``: key, f, component, similarity (to the bucket's representative)."""
    shared = rest.sparkSession.sparkContext.broadcast(rarity)
    rest = rest.join(texts.select("f", F.octet_length("text").alias("bytes")), "f")
    sizes = rest.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rest.join(scratch.table(sizes, "sizes"), "key").withColumn("mine", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "f", "component", "similarity")
    rows = dealt.join(texts.select("f", "text"), "f").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "f")

    def links_of(rows: list[dict], texts: Texts) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out, across = [], rows[0]["a"] != rows[0]["b"]
        data = [texts.of(r["f"], r["text"]) for r in rows]
        for i, r in enumerate(rows):
            for j in range(i):
                q = rows[j]
                if across and r["mine"] == q["mine"] or root(r["component"]) == root(q["component"]):
                    continue
                # d(r, q) >= |d(r, rep) - d(q, rep)|, and totals bound the similarity from above
                if abs(r["similarity"] - q["similarity"]) > 1 - least + 1e-9 or min(data[i][2], data[j][2]) < least * max(data[i][2], data[j][2]) - 1e-9:
                    continue
                if similarity(data[i], data[j]) >= least:
                    out.append((r["f"], q["f"]))
                    parent[root(r["component"])] = root(q["component"])
        return out

    def emit(batches):
        texts = Texts(shared.value)
        kept: list[dict] = []
        place = None

        def result():
            u, v = zip(*got) if (got := links_of(kept, texts) if len(kept) > 1 else []) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["key"], r["a"], r["b"]) != place:
                    yield result()
                    kept, place = [], (r["key"], r["a"], r["b"])
                kept.append(r)
        yield result()

    return rows.mapInArrow(emit, "u long, v long")


def groups(docs: DataFrame, scratch: Scratch, least: float, bands: int, rows: int, block: int) -> DataFrame:
    """did, h, group (smallest did), leader (did and h of the one that stays) of each row with words; leader is null for rows without."""
    rarity = count_rarity(docs)
    described = scratch.table(describe(docs, rarity, bands, rows), "described")
    classes = scratch.table(described.where("f is not null").groupBy("f").agg(F.min(F.struct("did", "h")).alias("leader"), F.min("did").alias("did"), F.first("keys").alias("keys")), "classes")
    entries = classes.select("f", F.explode("keys").alias("key"))
    chosen = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("f", "key").alias("order"), "f")).alias("rep")).where("n > 1").select("key", F.col("rep.f").alias("rep"))
    members = scratch.table(entries.join(scratch.table(chosen, "chosen"), "key"), "members")
    pairs = scratch.table(members.where("f <> rep").select(F.greatest("f", "rep").alias("x"), F.least("f", "rep").alias("y")).distinct(), "pairs")
    needed = members.select("f").distinct().join(classes.select("f", "leader"), "f")
    texts = needed.join(described.select("did", "h", "text", F.col("f").alias("g")), (F.col("f") == F.col("g")) & F.struct("did", "h").eqNullSafe(F.col("leader"))).select("f", "text").dropDuplicates(["f"])
    texts = scratch.table(texts, "texts")
    described = scratch.table(described.select("did", "h", "f"), "ids")
    scratch.drop("described", "chosen")
    verified = scratch.table(verify(pairs, texts, rarity), "verified")
    scratch.drop("pairs")
    links = verified.where(F.col("similarity") >= least).select(F.col("x").alias("u"), F.col("y").alias("v"))
    component = scratch.table(connected_components(links, scratch), "component")

    # buckets whose members are not yet in one component
    placed = members.join(component, F.col("f") == F.col("node"), "left").select("key", "f", "rep", F.coalesce("component", "f").alias("component"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("n"), (F.min("component") != F.max("component")).alias("open")).where("open and n > 2").select("key")
    placed = scratch.table(placed, "placed")
    rest = placed.join(scratch.table(open_keys, "open_keys"), "key")
    with_similarity = rest.withColumn("x", F.greatest("f", "rep")).withColumn("y", F.least("f", "rep")).join(verified, ["x", "y"], "left").select("key", "f", "component", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    more = scratch.table(compare_rest(with_similarity.where("similarity < 1"), texts, rarity, scratch, least, block), "more")
    if more.head(1):
        component = scratch.table(connected_components(links.unionByName(more), scratch), "component2")

    of_class = scratch.table(classes.join(component, F.col("f") == F.col("node"), "left").select("f", F.coalesce("component", "f").alias("component"), "leader", "did"), "of_class")
    best = of_class.groupBy("component").agg(F.min(F.when(F.col("did").isNotNull(), F.struct("did", "leader"))).alias("best"), F.min("leader").alias("any"))
    named = of_class.select("f", "component").join(scratch.table(best, "best"), "component").select("f", F.col("best.did").alias("group"), F.coalesce("best.leader", "any").alias("leader"))
    out = described.select("did", "h", "f").join(scratch.table(named, "named"), "f", "left").select("did", "h", F.when(F.col("f").isNull(), F.col("did")).otherwise(F.col("group")).alias("group"), "leader")
    out = scratch.table(out, "groups")
    scratch.drop("ids", "classes", "members", "texts", "verified", "component", "component2", "placed", "open_keys", "sizes", "more", "of_class", "best", "named", "edges0", "edges1")
    return out


def near_duplicates(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, group_id (smallest doc_id of its group), kept (it is the one that stays) for each row of docs."""
    found = groups(docs, Scratch(docs.sparkSession, "minhash"), least, bands, rows, block)
    return found.select(F.col("did").alias("doc_id"), F.col("group").alias("group_id"), (F.col("leader").isNull() | F.col("leader").eqNullSafe(F.struct("did", "h"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch | None = None, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """docs with one document of each group; a document whose row repeats stays once, rows without words all stay.

    The result reads tables of ``scratch``, which its owner may drop once the result is written.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    found = groups(docs, scratch, least, bands, rows, block)
    gone = found.where(F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.struct("did", "h"))).select(F.col("did").alias("__did"), F.col("h").alias("__h")).distinct()
    keyed = docs.withColumn("__did", F.col("doc_id").cast("long")).withColumn("__h", F.xxhash64("doc_id", "text"))
    again = found.where("leader is not null").groupBy("did", "h").count().where("count > 1").select(F.col("did").alias("__did"), F.col("h").alias("__h"))
    gone, again = scratch.table(gone, "gone"), scratch.table(again, "again")
    scratch.drop("groups")
    if gone.count() <= BROADCAST_GONE:
        gone = F.broadcast(gone)
    same = lambda x: keyed["__did"].eqNullSafe(x["__did"]) & (keyed["__h"] == x["__h"])
    if not again.head(1):
        return keyed.join(gone, same(gone), "left_anti").select(*docs.columns)
    keyed = keyed.join(gone, same(gone), "left_anti")
    once = keyed.join(again, same(again), "left_semi").dropDuplicates(["__did", "__h"])
    return keyed.join(again, same(again), "left_anti").unionByName(once).select(*docs.columns)
