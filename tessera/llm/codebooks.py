"""Vector codes by product quantisation in whole numbers: codebooks are learned in Spark rounds, nearest entries found in kd-trees.

Each component x becomes floor(4096 * x); a vector is cut into eight equal consecutive parts with a codebook of 16 entries each. A round
broadcasts one kd-tree per codebook (16 entries, so its size depends on the length of a vector alone), finds the nearest entry of each part by
branch and bound, and replaces every entry by the floor of the mean of its parts, from sums that Spark adds up. Subtrees whose bound equals the best
distance so far are visited too, so of equally near entries the one with the smallest index is always found.

Rows with a null vector or a null or non-finite component are left out. Entries start from the 16 rows with the smallest ids (null ids
last; rows that repeat an id each count, ordered by vector), fewer where there are fewer rows; an empty table gives an empty one. Vectors of several
lengths, of a length that 8 does not divide, or of components so large that a squared distance passes 63 bits are a ValueError. Labels may be null, and one label may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums of this many labels are broadcast to the rows, about 4 MB; more are joined by a shuffle, salted for labels with many rows.
BROADCAST_LABELS, SALTS = 100_000, 64
LEAF = 2


class KdTree:
    """Entries (rows of whole numbers) split at medians of their widest dimension; every node keeps the box of its entries."""

    def __init__(self, entries: np.ndarray, which: np.ndarray | None = None):
        self.entries = entries
        self.which = np.arange(len(entries)) if which is None else which
        mine = entries[self.which]
        self.low, self.high = mine.min(0), mine.max(0)
        self.sides: tuple[KdTree, KdTree] | None = None
        if len(self.which) > LEAF:
            order = self.which[np.argsort(mine[:, int(np.argmax(self.high - self.low))] if entries.shape[1] else self.which, kind="stable")]
            half = len(order) // 2
            self.sides = KdTree(entries, np.sort(order[:half])), KdTree(entries, np.sort(order[half:]))

    def bound(self, points: np.ndarray) -> np.ndarray:
        """No entry below is nearer than this squared distance."""
        out = np.maximum(self.low - points, points - self.high)
        np.maximum(out, 0, out=out)
        return np.einsum("ij,ij->i", out, out)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point; ties to the lower index."""
        index, best = np.full(len(points), len(self.entries), dtype=np.int64), np.full(len(points), np.iinfo(np.int64).max)
        self._visit(points, np.arange(len(points)), index, best)
        return index, best

    def _visit(self, points: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        if self.sides is None:
            for k in self.which.tolist():
                off = points[rows] - self.entries[k]
                far = np.einsum("ij,ij->i", off, off)
                nearer = (far < best[rows]) | (far == best[rows]) & (k < index[rows])
                index[rows[nearer]], best[rows[nearer]] = k, far[nearer]
            return
        bounds = [side.bound(points[rows]) for side in self.sides]
        left = bounds[0] <= bounds[1]
        for first, second, mine in ((0, 1, left), (1, 0, ~left)):
            near = rows[mine]
            self.sides[first]._visit(points, near, index, best)
            self.sides[second]._visit(points, near[bounds[second][mine] <= best[near]], index, best)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _summing(trees, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: sums and numbers of the parts nearest to each entry, one row per entry and position."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, step = trees.value, width // PARTS
        sums, counts = np.zeros((PARTS, ENTRIES, step), dtype=object), np.zeros((PARTS, ENTRIES), dtype=np.int64)
        for batch in batches:
            points = _matrix(batch.column(0), width)
            for p, tree in enumerate(books):
                part = points[:, p * step : (p + 1) * step]
                index, _ = tree.nearest(part)
                for k in np.unique(index).tolist():
                    mine = part[index == k]
                    sums[p, k] += mine.sum(0)  # a batch is small enough for 64 bits, a task need not be
                    counts[p, k] += len(mine)
        rows = [(p * ENTRIES + k, j, str(sums[p, k, j]), int(counts[p, k])) for p in range(PARTS) for k in range(ENTRIES) if counts[p, k] for j in range(step)]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("slot", pa.int32()), ("at", pa.int32()), ("total", pa.string()), ("n", pa.int64())))})

    return add


def _coding(trees, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, step = trees.value, width // PARTS
        for batch in batches:
            points = _matrix(batch.column(0), width)
            codes, error = np.zeros((len(points), PARTS), dtype=np.uint8), np.zeros(len(points), dtype=np.int64)
            for p, tree in enumerate(books):
                index, far = tree.nearest(points[:, p * step : (p + 1) * step])
                codes[:, p] = index
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([row.tobytes().hex() for row in codes]), pa.array(error)], ["id", "label", "code", "error"])

    return code


def learn_codebooks(vectors: DataFrame, width: int) -> np.ndarray:
    """Entries (part, entry, position) after all rounds over ``vectors`` (column ``v``: whole numbers, ``width`` each), which must be a table that can be read again and again."""
    spark = vectors.sparkSession
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        trees = spark.sparkContext.broadcast([KdTree(book) for book in books])
        parts = vectors.select("v").mapInArrow(_summing(trees, width), "slot int, at int, total string, n bigint")
        summed = parts.groupBy("slot", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for row in summed.collect():  # at most 16 rows for each position of a vector
            books[row["slot"] // ENTRIES, row["slot"] % ENTRIES, row["at"]] = int(row["total"]) // row["n"]
        trees.unpersist()
    return books


def whole_numbers(vectors: DataFrame, vector: str, id: str, label: str) -> DataFrame:
    """id, label, v (floor(4096 * x) of each component) of the rows whose vectors are whole and finite."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(good).select(F.col(id).alias("id"), F.col(label).alias("label"), F.transform(x, lambda c: F.floor(F.least(F.greatest(c, F.lit(-1e12)), F.lit(1e12)) * SCALE)).alias("v"))


def compress(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error of every kept row; the final codebooks as whole numbers by part, entry and position)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codebooks")
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id, label)}
    kept = scratch.table(whole_numbers(vectors, vector, id, label), "whole")
    found = kept.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.count("*")).head()
    shortest, width, largest, n = found
    if not n:
        return kept.select(F.col("id").alias(id), F.col("label").alias(label), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), np.zeros((PARTS, 0, 0), dtype=np.int64)
    if shortest != width or width % PARTS:
        raise ValueError(f"vectors must have one length that {PARTS} divides, found {shortest} to {width}")
    if width * (2 * (largest or 0) + 2) ** 2 >= 2**63:
        raise ValueError(f"components up to {largest / SCALE} are too large for squared distances of 63 bits")
    books = learn_codebooks(kept, width)
    trees = spark.sparkContext.broadcast([KdTree(book) for book in books])
    coded = scratch.table(kept.select("v", "id", "label").mapInArrow(_coding(trees, width), f"id {kinds[id]}, label {kinds[label]}, code string, error bigint"), "coded")
    trees.unpersist()
    scratch.drop("whole")
    sums = scratch.table(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    if sums.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(sums.withColumnRenamed("label", "l")), F.col("label").eqNullSafe(F.col("l")))
    else:
        salted = sums.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        joined = coded.join(salted, F.col("label").eqNullSafe(F.col("l")) & (F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)) == F.col("s")))
    return joined.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error"), books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def oracle_sql() -> str:
    """The same in DuckDB SQL: the rounds written out one after the other."""
    nearest = """near{r} AS MATERIALIZED (
        SELECT row, p, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + e) AS best
        FROM part JOIN book{r} USING (p) GROUP BY row, p)"""
    update = """sums{r} AS MATERIALIZED (
        SELECT p, best % 16 AS e, j, sum(x[j]) AS s, count(*) AS n FROM near{r} JOIN part USING (row, p), unnest(range(1, len(x) + 1)) AS t(j) GROUP BY ALL),
    book{s} AS MATERIALIZED (
        SELECT p, e, coalesce(m, c) AS c FROM book{r} LEFT JOIN (
            SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM sums{r} GROUP BY p, e) USING (p, e))"""
    steps = [part.format(r=r, s=r + 1) for r in range(ROUNDS) for part in (nearest, update)] + [nearest.format(r=ROUNDS)]
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    part AS MATERIALIZED (SELECT row, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, range({PARTS}) AS t(p)),
    book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM part WHERE row <= {ENTRIES}),
    {", ".join(steps)},
    coded AS (
        SELECT row, string_agg(lpad(lower(to_hex(best % 16)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (row), digest"""
