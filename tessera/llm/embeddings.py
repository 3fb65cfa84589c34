"""Near-duplicate vectors through a pivot-permutation index.

Pivots are a spread sample of the vectors, chosen for each length of vectors by itself; their number grows with the square root of the rows, up
to 4096, so that inverted lists stay short. A vector is described by its nearest pivots in order of nearness;
close vectors have nearly the same order. Inverted lists are keyed by pairs of pivots, so that two vectors meet exactly
if they share at least two of their nearest pivots; where they meet, their cosine is computed in double precision. A pair counts once,
in the smallest list both are in. Vectors that are equal in all components are compared as one and counted with their number.

Lists longer than a task should hold are dealt out in blocks, and every pair of blocks is compared in a task of its own,
so no pair is left out. Tasks return per vector the number of links and enough edges to span what they linked.

Vectors that are null, of no length, zero, or hold null or non-finite components link with nothing. Vectors of different lengths never link,
but each length is compared within itself; more than 100 different lengths are an error. Rows
that repeat a vec_id count as vectors with one id. A null vec_id gets a row without component. An empty table gives no rows.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.scratch import Scratch

LEAST_COSINE = 0.95
#: Least and most pivots, vectors sampled per pivot to choose from (in so many bytes at most), how many of the nearest describe a vector at the least pivots, and vectors in a block.
PIVOTS, MOST_PIVOTS, SAMPLE_PER_PIVOT, SAMPLE_BYTES, NEAREST, BLOCK = 256, 16384, 4, 256_000_000, 5, 1000
MOST_LENGTHS = 100


def pivots_for(rows: int) -> int:
    """With the square root of the rows, so that pairs of pivots, and with them inverted lists, grow as the rows do."""
    return int(np.clip(np.ceil(np.sqrt(rows / 5)), PIVOTS, MOST_PIVOTS))


def nearest_for(pivots: int) -> int:
    """One more for every four times the pivots: with more of them a pair of near vectors shares fewer of its nearest."""
    return NEAREST + max(0, int(np.floor(np.log2(pivots / PIVOTS) / 2)))


def usable(docs: DataFrame) -> DataFrame:
    """vec_id, v (doubles of unit length) of vectors that can link."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return docs.where(sound).select("vec_id", v.alias("v"))


def choose_pivots(classes: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Unit vectors far from each other, of a bounded sample by hash: each next one is the farthest from all so far."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v.values, dtype="<f8").tobytes() for v in batch.column(0)], pa.binary())], names=["v"])

    first = classes.orderBy(F.xxhash64("v"), "cls").limit(sample).select("v").mapInArrow(pack, "v binary").collect()
    got = np.stack([np.frombuffer(r["v"], "<f8") for r in first])
    got = got / np.linalg.norm(got, axis=1, keepdims=True)
    near, chosen = got @ got[0], [0]
    while len(chosen) < min(pivots, len(got)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, got @ got[chosen[-1]])
    return got[chosen]


def index(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int | None) -> DataFrame:
    """list (length and two pivots), cls, n, near (the nearest pivots), v: one row per inverted list that a vector is in."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def describe(batches):
        for whole in batches:
            lengths = whole.column(2).value_lengths().to_numpy()
            for length in np.unique(lengths):
                batch, own = whole.take(pa.array(np.flatnonzero(lengths == length))), shared.value[int(length)]
                v = batch.column(2).flatten().to_numpy().reshape(-1, length)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                take = min(nearest or nearest_for(len(own)), len(own))
                order = np.argsort(-(v @ own.T), axis=1, kind="stable")[:, :take].astype(np.int64)
                near = np.sort(order, axis=1)
                pairs = list(itertools.combinations(range(take), 2)) or [(0, 0)]
                lists = np.stack([(int(length) << 32) + (near[:, i] << 16) + near[:, j] for i, j in pairs], 1)
                row = np.repeat(np.arange(len(v)), len(pairs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.ravel()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(list(near[row].astype("<i4")), pa.list_(pa.int32())), pa.array([x.astype("<f8").tobytes() for x in v], pa.binary()).take(pa.array(row))],
                    names=["list", "cls", "n", "near", "v"],
                )

    return classes.select("cls", "n", "v").mapInArrow(describe, "list long, cls long, n long, near array<int>, v binary")


def dealt(rows: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """The rows with the task (list, a, b) they go to: block a against block b, once for every pair of blocks of a list."""
    sizes = rows.groupBy("list").count().where("count > 1")
    blocks = F.ceil(F.col("count") / block).cast("int")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    with_size = rows.join(scratch.table(sizes.select("list", blocks.alias("blocks")), "sizes"), "list").withColumn("mine", mine)
    return with_size.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other")).drop("other")


def _compare(rows: list[dict], least: float):
    """(cls, links, to) of one task: how many vectors each class links here, and edges that span what was linked."""
    a, b = rows[0]["a"], rows[0]["b"]
    left = [r for r in rows if r["mine"] == a]
    right = left if a == b else [r for r in rows if r["mine"] == b]
    if not left or not right:
        return
    one, two = (np.stack([np.frombuffer(r["v"], "<f8") for r in x]) for x in (left, right))
    near_two = np.array([r["near"] for r in right])
    n_left, n_right = np.array([r["n"] for r in left]), np.array([r["n"] for r in right])
    links, back = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
    near_one = np.array([r["near"] for r in left])
    this = rows[0]["list"] & 0xFFFFFFFF
    ids, node = np.unique([r["cls"] for r in left + right], return_inverse=True)
    node_left, node_right = node[: len(left)], node[len(left) :]
    parent = np.arange(len(ids))
    for lo in range(0, len(left), 256):
        cosine = one[lo : lo + 256] @ two.T
        i, j = np.nonzero(cosine >= least)
        i += lo
        if a == b:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        # of the lists that both are in, the smallest counts the pair: its pivots are the two smallest that both share
        equal = near_one[i][:, :, None] == near_two[j][:, None, :]
        common = np.where(equal.any(2), near_one[i], 1 << 30)
        common.sort(axis=1)
        first = common[:, 0].astype(np.int64) * 65536 + (common[:, 1] if common.shape[1] > 1 else common[:, 0])
        i, j = i[first == this], j[first == this]
        np.add.at(links, i, n_right[j])
        np.add.at(back, j, n_left[i])
        i, j = node_left[i], node_right[j]
        while True:  # union of all pairs at once: larger roots under smaller ones, then shorten the paths
            x, y = parent[i], parent[j]
            if (x == y).all():
                break
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent != parent[parent]).any():
                parent = parent[parent]
    for part, count in ((node_left, links), (node_right, back)):
        for x, c in zip(part, count):
            if c:
                yield int(ids[x]), int(c), int(ids[parent[x]])


def links(classes: DataFrame, lengths: dict[int, int], scratch: Scratch, least: float, pivots: int | None, nearest: int | None, block: int) -> DataFrame:
    """cls, links, to: sums of links and spanning edges of classes of equal vectors. ``lengths``: vectors by length."""
    many = {d: pivots or pivots_for(n) for d, n in lengths.items()}
    chosen = {d: choose_pivots(classes.where(F.size("v") == d), k, max(PIVOTS, min(SAMPLE_PER_PIVOT * max(k, PIVOTS), SAMPLE_BYTES // (8 * d)))) for d, k in many.items()}
    rows = scratch.table(index(classes, chosen, nearest), "index")

    def compare(batches):
        kept: list[dict] = []
        place = None

        def result(rows):
            got = list(_compare(rows, least))
            c, n, to = zip(*got) if got else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(to, pa.int64())], names=["cls", "links", "to"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["list"], r["a"], r["b"]) != place:
                    if len(kept) > 1:
                        yield result(kept)
                    kept, place = [], (r["list"], r["a"], r["b"])
                kept.append(r)
        if len(kept) > 1:
            yield result(kept)

    together = dealt(rows, scratch, block).repartition("list", "a", "b").sortWithinPartitions("list", "a", "b")
    return scratch.table(together.mapInArrow(compare, "cls long, links long, to long"), "links")


def near_duplicates(docs: DataFrame, least: float = LEAST_COSINE, pivots: int | None = None, nearest: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of docs; the number of pivots follows from the rows, that of the nearest from the pivots, if none is given."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "embeddings")
    vectors = usable(docs)
    lengths = {r["d"]: r["count"] for r in vectors.groupBy(F.size("v").alias("d")).count().limit(MOST_LENGTHS + 1).collect()}
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    every = docs.select("vec_id")
    if not lengths:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    vectors = scratch.table(vectors.select("vec_id", "v", F.xxhash64("v").alias("k")), "vectors")
    classes = scratch.table(vectors.groupBy("k", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")), "classes")
    # two vectors that share an id but differ could both be their class's smallest: such classes are one node of the graph
    found = links(classes.select("cls", "n", "v"), lengths, scratch, least, pivots, nearest, block)
    component = scratch.table(connected_components(found.select(F.col("cls").alias("u"), F.col("to").alias("v")), scratch), "component")
    of_class = found.groupBy("cls").agg(F.sum("links").alias("links"))
    by_class = classes.select("cls", "n", "k", "v").join(of_class, "cls", "left").join(component, F.col("cls") == F.col("node"), "left")
    by_class = scratch.table(by_class.select("k", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id")), "by_class")
    linked = vectors.join(by_class, ["k", "v"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
