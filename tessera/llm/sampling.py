"""Bounded, repeatable training samples of labelled documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.features import BITS, hashed


def held_out(doc_id: Column) -> Column:
    """True for the third of documents kept from learning; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def first_by_hash(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct rows, those with the smallest hash of their doc_id: the same at every run."""
    order = F.xxhash64("doc_id", F.lit(seed))
    return rows.orderBy(order, "doc_id").limit(most)


def sample_features(docs: DataFrame, chosen: DataFrame, extract=hashed, bits: int = BITS) -> list:
    """(tag..., indices, counts) of the chosen documents, brought to the driver: ``chosen`` is bounded, and so is this.

    ``chosen`` has a doc_id and further integer columns; of rows that repeat a doc_id each counts.
    """
    tags = [c for c in chosen.columns if c != "doc_id"]
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select(*tags, "text")

    def features(batches):
        for batch in batches:
            for lo, hi, doc, feature, count in extract(batch.column(len(tags)), bits):
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                index, counts = feature.astype("<i4"), np.minimum(count, 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(tags))]
                    + [pa.array([index[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()), pa.array([counts[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())],
                    names=[*tags, "features", "counts"],
                )

    schema = ", ".join([f"{t} int" for t in tags] + ["features binary", "counts binary"])
    return [(*r[: len(tags)], np.frombuffer(r[-2], "<i4"), np.frombuffer(r[-1], "<u2")) for r in joined.mapInArrow(features, schema).collect()]


def stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, feature, count) of rows of features."""
    n = [len(f) for f, _ in rows]
    row = np.repeat(np.arange(len(rows)), n)
    return row, np.concatenate([f for f, _ in rows] or [np.zeros(0, "<i4")]).astype(np.int64), np.concatenate([c for _, c in rows] or [np.zeros(0, "<u2")]).astype(float)
