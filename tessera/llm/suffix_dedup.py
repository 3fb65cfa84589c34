"""Removal of every byte that a repeated string of 400 bytes covers, by hash-compared suffix sorting.

All suffixes of a corpus fit in no task, so suffixes that may be equal are first brought together by content. What brings
them together never decides: every removed byte belongs to a window whose equal was found by the suffix sort and
compared byte by byte, or to a copy of such a piece of text by a 128-bit digest (BLAKE2) of all its bytes.

1. Runs. In each window of 400 bytes the 100-byte gram with the smallest hash is its anchor, so equal windows have
   equal anchors. Consecutive windows with one anchor are a run. Runs whose anchor occurs once have no equal and stay where
   they are. The others form classes by digest; of each class with several members two are sorted and compared.
2. Blocks. One run of each class whose anchor has other classes too is cut into blocks of 32 windows, at the same distances
   from the anchor everywhere. Blocks form classes by the bytes that all their windows share and by digest, treated alike.
3. Different blocks that share these bytes go to one task, which sorts the suffixes at all their windows. A group of more
   blocks than a task should hold is cut further, into single windows, whose classes are treated as before: then only
   equal windows have to meet, two of each class.

The sort is a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes; neighbours
with a common extension of 400 bytes are compared byte by byte. Counting is by partial sums and joins are of tables
that Spark can split, so no key's rows meet in one task. Long texts are read in overlapping pieces.

Strings are judged on the input; matches do not cross documents; texts under 400 bytes, empty and null ones keep
everything. Rows that repeat are documents each, so both lose what they share. A null doc_id is a value like others.
An empty table gives no rows. Columns other than doc_id and text are carried along (``remove_repeats``) or not read (``removal_report``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.words import Prefix, U, mix, runs

LENGTH, GRAM, BLOCK = 400, 100, 32
#: Blocks of one group that a task sorts together; groups of more are cut into windows. Suffixes a task sorts at once.
MOST_TOGETHER, MOST_SUFFIXES = 2000, 60_000
#: Bytes of texts that are expanded at once.
PIECE = 1 << 18
_PLACE_BITS = U(20)
_SEED = U(0xD6E8FEB86659FD93)
_ROWS = "key long, r1 long, r2 long, did long, h long, s long, n int, o int"


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the bytes start..end and of a 64-bit shape."""
    view, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    raw = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    two = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
    return two[:, 0] ^ mix(shape.astype(U) + _SEED), two[:, 1].copy()


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i with a full window (van Herk and Gil-Werman)."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of_windows(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text number, first window, windows, anchor's offset from the first, anchor hash, digest) of runs; windows by their start within the text."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none.astype(U), none.astype(U), none.astype(U)
    first = Prefix(data)
    at = np.arange(n - gram + 1)
    grams = mix(first.of(at, at + gram))
    order = (grams >> _PLACE_BITS << _PLACE_BITS) | at.astype(U)  # ties go to the first place
    anchor = (sliding_min(order, length - gram + 1) & ((U(1) << _PLACE_BITS) - U(1))).astype(np.int64)
    mark = np.zeros(n + 1, dtype=np.int32)  # windows that lie in one text
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(mark, offsets[long], 1)
    np.add.at(mark, offsets[long + 1] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(mark) > 0)
    if not len(p):
        return none, none, none, none, none.astype(U), none.astype(U), none.astype(U)
    a, doc = anchor[p], np.searchsorted(offsets, p, "right") - 1
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
    s, e, a, doc = p[new], p[np.r_[new[1:], len(p)] - 1], a[new], doc[new]
    r1, r2 = digests(data, s, e + length, (a - s << 32) | (e - s))
    return doc, s - offsets[doc], e - s + 1, a - s, mix(grams[a] ^ _SEED), r1, r2


def pieces(texts: pa.Array, length: int, piece: int = PIECE):
    """(first text, bytes, offsets, bytes of the text before) of runs of texts; a long text comes in pieces that share ``length - 1`` bytes."""
    for lo, _, data, offsets in runs(texts, piece):
        if len(data) <= 2 * piece:
            yield lo, data, offsets, 0
        else:
            for at in range(0, len(data) - length + 1, piece):
                part = data[at : at + piece + length - 1]
                yield lo, part, np.array([0, len(part)]), at


def run_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of windows of each text: n windows from s on, their anchor (hash: key) at s + o; r1, r2: the digest."""

    def emit(batches):
        for batch in batches:
            for lo, data, offsets, before in pieces(batch.column(2), length):
                doc, s, n, o, key, r1, r2 = runs_of_windows(data, offsets, length, gram)
                rows = pa.array(lo + doc)
                columns = [signed(key), signed(r1), signed(r2), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s + before), pa.array(n.astype("i4")), pa.array(o.astype("i4"))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "r1", "r2", "did", "h", "s", "n", "o"])

    return texts.select("did", "h", "text").mapInArrow(emit, _ROWS)


def classify(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key repeats, their classes): a class has its key, digest, n, o, size, its first and last place, and whether its key is mixed."""
    differ = (F.min("r1") != F.max("r1")) | (F.min("r2") != F.max("r2")) | (F.min("n") != F.max("n")) | (F.min("o") != F.max("o"))
    keys = rows.groupBy("key").agg(F.count("*").alias("n_key"), differ.alias("mixed")).where("n_key > 1")
    members = scratch.table(rows.join(scratch.table(keys, f"{name}_keys"), "key").drop("n_key"), f"{name}_members")
    place = F.struct("did", "h", "s")
    classes = members.groupBy("key", "r1", "r2", "n", "o").agg(F.count("*").alias("size"), F.min(place).alias("first"), F.max(place).alias("last"), F.max("mixed").alias("mixed"))
    return members, scratch.table(classes, f"{name}_classes")


_CLASS = ["key", "r1", "r2", "n", "o"]


def witnesses(classes: DataFrame) -> DataFrame:
    """The places whose bytes are needed: did, h, s, the class, pair (one of two to be compared) and open (to be compared with other classes)."""
    apart = (F.col("size") > 1) & (F.col("first") != F.col("last"))
    first = classes.where(apart | F.col("mixed")).select("first.*", *_CLASS, apart.alias("pair"), F.col("mixed").alias("open"))
    return first.unionByName(classes.where(apart).select("last.*", *_CLASS, F.lit(True).alias("pair"), F.lit(False).alias("open")))


def keyed(docs: DataFrame) -> DataFrame:
    """did, h, text: the identity of a text with its document."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("did"), F.xxhash64("doc_id", "text").alias("h"), "text")


def compressed(rows: DataFrame) -> DataFrame:
    """The rows with their text compressed, to halve what a shuffle moves; null stays null."""
    at = rows.columns.index("text")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = [squeeze.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(at)]
            yield batch.set_column(at, "text", pa.array(text, pa.binary()))

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(pack, schema)


def cut_from_texts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The wanted places with their bytes (content)."""
    fields = [c for c in wanted.columns if c not in ("did", "h")]
    by_text = wanted.groupBy("did", "h").agg(F.collect_list(F.struct(*fields)).alias("places"))
    joined = compressed(texts).dropDuplicates(["did", "h"]).join(by_text, ["did", "h"]).select("did", "h", "text", "places")
    one = joined.schema["places"].dataType.elementType
    schema = "did long, h long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one) + ", content binary"

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                raw, places = unpack.decompress(batch.column(2)[i].as_buffer()), batch.column(3)[i].values
                s, n = places.field("s").to_pylist(), places.field("n").to_pylist()
                content = pa.array([raw[a : a + k - 1 + length] for a, k in zip(s, n)], pa.binary())
                row = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(places.field(c) for c in fields), content], names=["did", "h", *fields, "content"])

    return joined.mapInArrow(cut, schema)


def block_rows(runs_with_bytes: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of runs, cut by distance from the anchor; the key hashes the bytes that all windows of a block share.

    With blocks of one window these are the window's own bytes.
    """

    def emit(batches):
        for batch in batches:
            did, h, s, n, o = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            for lo, hi, data, offsets in runs(batch.column(5), PIECE):
                first = Prefix(data)
                least, most = (o - n + 1)[lo:hi], o[lo:hi]  # the anchor's distance from the last and the first window
                each = most // block - least // block + 1
                row = np.repeat(np.arange(hi - lo), each)
                low = (least[row] // block + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * block
                far, near = np.minimum(low + block - 1, most[row]), np.maximum(low, least[row])
                anchor = offsets[row] + o[lo:hi][row]
                key = mix(first.of(anchor - low, anchor - low - block + 1 + length) + _SEED)
                r1, r2 = digests(data, anchor - far, anchor - near + length, (far - low << 32) | (far - near))
                row += lo
                columns = [signed(key), signed(r1), signed(r2), pa.array(did[row]), pa.array(h[row]), pa.array(s[row] + o[row] - far), pa.array((far - near + 1).astype("i4")), pa.array((far - low).astype("i4"))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "r1", "r2", "did", "h", "s", "n", "o"])

    return runs_with_bytes.select("did", "h", "s", "n", "o", "content").mapInArrow(emit, _ROWS)


def cut_from_runs(wanted: DataFrame, runs_with_bytes: DataFrame, length: int) -> DataFrame:
    """The wanted places with their bytes, from pieces of texts that hold them."""
    fields = [c for c in wanted.columns if c not in ("did", "h")]
    by_text = wanted.groupBy("did", "h").agg(F.collect_list(F.struct(*fields)).alias("places"))
    holds = F.filter("places", lambda b: (b["s"] >= F.col("from")) & (b["s"] < F.col("from") + F.col("many")))
    held = runs_with_bytes.select("did", "h", F.col("s").alias("from"), F.col("n").alias("many"), F.col("content").alias("bytes"))
    joined = held.join(by_text, ["did", "h"]).select("did", "h", "from", "bytes", F.explode(holds).alias("b"))
    return joined.select("did", "h", "b.*", F.expr(f"substring(bytes, cast(b.s - `from` + 1 as int), b.n - 1 + {length})").alias("content"))


def compare(prefix: Prefix, data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(common extension up to ``length``, whether suffix a sorts before b), by binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), dtype=np.int64), np.full(len(a), length)
    for _ in range(int(length).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = prefix.of(a, a + mid) == prefix.of(b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, np.minimum(mid - 1, hi))
        hi = np.maximum(hi, lo)
    open_ = lo < length
    return lo, open_ & (data[a + np.where(open_, lo, 0)] < data[b + np.where(open_, lo, 0)])


def sort_suffixes(prefix: Prefix, data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of suffixes within ascending groups: a bottom-up mergesort of all groups at once.

    At each level every element finds by binary search how many elements of the neighbouring run precede it.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1] if n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[first, n])
    base, many = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while n and width < size.max():
        index = np.arange(n) - base
        live = np.flatnonzero(many > width)
        own = index[live] // width
        other = own ^ 1
        begin = np.minimum(other * width, many[live])
        stop = np.minimum(begin + width, many[live])
        lo, hi = begin.copy(), stop.copy()
        mine = starts[order[live]]
        right = own & 1 == 1  # elements of the right run let equal ones of the left run go first
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) >> 1
            theirs = starts[order[base[live[todo]] + mid]]
            same, less = compare(prefix, data, theirs, mine[todo], length)
            go = less | (right[todo] & (same >= length))
            lo[todo] = np.where(go, mid + 1, lo[todo])
            hi[todo] = np.where(go, hi[todo], mid)
        to = np.minimum(own, other) * width + (index[live] - own * width) + (lo - begin)
        new = order.copy()
        new[base[live] + to] = order[live]
        order = new
        width *= 2
    return order


def repeated_windows(blocks: list[bytes], key: np.ndarray, n: np.ndarray, o: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) repeated window of each block, or -1: suffixes as far from the anchor in blocks with the same key are compared."""
    data = np.frombuffer(b"".join(blocks), dtype=np.uint8)
    start = np.r_[0, np.cumsum([len(b) for b in blocks])[:-1]]
    block = np.repeat(np.arange(len(blocks)), n)
    place = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
    group = np.unique(key, return_inverse=True)[1][block] * (int(o.max()) + int(n.max()) + 1) + o[block] - place + int(n.max())
    at = np.argsort(group, kind="stable")
    prefix = Prefix(data)
    starts, group, block, place = (start[block] + place)[at], group[at], block[at], place[at]
    order = sort_suffixes(prefix, data, starts, group, length)
    starts, block, place = starts[order], block[order], place[order]
    pair = np.flatnonzero(group[1:] == group[:-1])
    equal = pair[prefix.of(starts[pair], starts[pair] + length) == prefix.of(starts[pair + 1], starts[pair + 1] + length)]
    real, view = np.zeros(len(equal), dtype=bool), np.lib.stride_tricks.sliding_window_view(data, length)
    for lo in range(0, len(equal), 2000):  # equal hashes may be a collision: compare the bytes
        i = equal[lo : lo + 2000]
        real[lo : lo + 2000] = (view[starts[i]] == view[starts[i + 1]]).all(1)
    hit = np.unique(np.r_[equal[real], equal[real] + 1])
    first, last = np.full(len(blocks), 1 << 40), np.full(len(blocks), -1)
    np.minimum.at(first, block[hit], place[hit])
    np.maximum.at(last, block[hit], place[hit])
    return np.where(last < 0, -1, first), last


def sorted_rows(rows: DataFrame, together: str, length: int) -> DataFrame:
    """The rows (without content) that hold repeated windows, with the first and last of them; rows with the same ``together`` are compared."""
    names = ["did", "h", "s", *_CLASS]

    def emit(batches):
        kept: list[pa.RecordBatch] = []
        suffixes = 0

        def flush(table: pa.Table):
            n, o = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "o"))
            first, last = repeated_windows(table.column("content").to_pylist(), table.column("together").to_numpy(), n, o, length)
            hit = pa.array(np.flatnonzero(last >= 0))
            columns = [table.column(c).take(hit).combine_chunks() for c in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(first).take(hit), pa.array(last).take(hit)], names=[*names, "from", "to"])

        for batch in batches:
            key, n, lo = batch.column(0).to_numpy(), batch.column(names.index("n") + 1).to_numpy().astype(np.int64), 0
            changes = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            if kept and kept[-1].column(0)[-1].as_py() == key[0]:
                changes = changes[1:]  # the group began in the batch before
            for at in changes:
                if suffixes + n[lo:at].sum() >= MOST_SUFFIXES:
                    yield flush(pa.Table.from_batches([*kept, batch.slice(lo, at - lo)]))
                    kept, suffixes, lo = [], 0, at
            kept.append(batch.slice(lo))
            suffixes += int(n[lo:].sum())
        if suffixes:
            yield flush(pa.Table.from_batches(kept))

    dealt = rows.withColumn("together", F.expr(together)).select("together", *names, "content").repartition("together").sortWithinPartitions("together")
    return dealt.mapInArrow(emit, "did long, h long, s long, key long, r1 long, r2 long, n int, o int, `from` long, `to` long")


def spans_of_classes(members: DataFrame, classes: DataFrame, rows: DataFrame, length: int, scratch: Scratch, name: str) -> DataFrame:
    """did, h, s, stop: members of classes of which two were sorted together and found equal throughout.

    Where all members of a class are one row that repeats, there is nothing to compare.
    """
    found = sorted_rows(rows.where("pair"), "xxhash64(key, r1, r2, n, o)", length).where("`from` = 0 and `to` = n - 1").select(*_CLASS).distinct()
    same = classes.where((F.col("size") > 1) & (F.col("first") == F.col("last"))).select(*_CLASS)
    sure = scratch.table(found.unionByName(same), f"{name}_sure")
    return members.join(sure, _CLASS, "left_semi").select("did", "h", "s", (F.col("s") + F.col("n") - 1 + length).alias("stop"))


def removal(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, most_together: int = MOST_TOGETHER) -> DataFrame:
    """did, h, spans (start and stop of what to remove, maybe overlapping) of each text that loses something."""
    texts = keyed(docs).where(F.octet_length("text") >= length)
    members, classes = classify(scratch.table(run_rows(texts, length, gram), "runs"), scratch, "run")
    scratch.drop("runs", "run_keys")
    held = scratch.table(cut_from_texts(witnesses(classes), texts, length), "held")
    found = scratch.table(spans_of_classes(members, classes, held, length, scratch, "run"), "found")
    scratch.drop("run_members", "run_classes", "run_sure")

    members, classes = classify(scratch.table(block_rows(held.where("open"), length, block), "blocks"), scratch, "block")
    wide = scratch.table(classes.groupBy("key").agg((F.count("*") > most_together).alias("wide")), "wide")
    content = scratch.table(cut_from_runs(witnesses(classes).join(wide, "key"), held.where("open"), length), "content")
    found = found.unionByName(scratch.table(spans_of_classes(members, classes, content, length, scratch, "block"), "found"))
    scratch.drop("held", "blocks", "block_keys", "block_members", "block_classes", "block_sure", "wide")
    spans = sorted_rows(content.where("open and not wide"), "key", length).select("did", "h", (F.col("s") + F.col("from")).alias("s"), (F.col("s") + F.col("to") + length).alias("stop"))
    found = found.unionByName(spans)

    wide_blocks = content.where("open and wide")
    if wide_blocks.head(1):
        members, classes = classify(scratch.table(block_rows(wide_blocks, length, 1), "windows"), scratch, "window")
        content_w = scratch.table(cut_from_runs(witnesses(classes), wide_blocks, length), "content_w")
        found = found.unionByName(scratch.table(spans_of_classes(members, classes, content_w, length, scratch, "window"), "found"))
        scratch.drop("windows", "window_keys", "window_members", "window_classes", "window_sure", "content_w")
    spans = scratch.table(found.groupBy("did", "h").agg(F.sort_array(F.collect_set(F.struct("s", "stop"))).alias("spans")), "spans")
    scratch.drop("found", "content")
    return spans


def merge(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of sorted, maybe overlapping or touching spans."""
    out: list[list[int]] = []
    for s, stop in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([s, stop])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, scratch: Scratch | None, also: DataFrame | None = None, beside: DataFrame | None = None, **sizes) -> DataFrame:
    """docs (text compressed) with a column of spans, last; ``also``: further spans (did, h, s, stop); ``beside``: did, h and columns that come before the spans."""
    spans = removal(docs, scratch or Scratch(docs.sparkSession, "suffix"), **sizes)
    if also is not None:
        spans = spans.select("did", "h", F.explode("spans").alias("span")).unionByName(also.select("did", "h", F.struct("s", "stop").alias("span")))
        spans = spans.groupBy("did", "h").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    spans = spans.select(F.col("did").alias("__did"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__did", F.coalesce("doc_id", F.lit(0)).cast("long")).withColumn("__h", F.xxhash64("doc_id", "text"))
    rows, more = compressed(rows).join(spans, ["__did", "__h"], "left"), []
    if beside is not None:
        rows, more = rows.join(beside.withColumnsRenamed({"did": "__did", "h": "__h"}), ["__did", "__h"], "left"), beside.columns[2:]
    return rows.select(*docs.columns, *more, "__spans")


def _pieces(text: pa.Scalar, spans: pa.Scalar, unpack) -> tuple[bytes, list[tuple[int, int]], int]:
    raw = unpack.decompress(text.as_buffer()) if text.is_valid else b""
    cut = merge([(r["s"], r["stop"]) for r in spans.as_py() or []])
    edges = [0, *(x for c in cut for x in c), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), cut, len(raw)


def removal_report(docs: DataFrame, scratch: Scratch | None = None, beside: DataFrame | None = None, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, changed (bytes were removed) for each row of docs.

    ``beside``: did, h (see ``keyed``) and counts that follow, as ``passages.passage_counts`` gives them; 0 for texts without a row there. They change nothing else.
    """
    rows = _with_spans(docs.select("doc_id", "text"), scratch, beside=beside, **sizes)
    more = rows.columns[2:-1]

    def report(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(batch.num_columns - 1)):
                kept, cut, n = _pieces(text, spans, unpack)
                out.append((n, n - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            n, gone, cuts, sha = zip(*out) if out else [()] * 4
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, cuts)), pa.array(sha, pa.string()), pa.array([x > 0 for x in gone], pa.bool_())]
            columns += [c.fill_null(0) for c in batch.columns[2:-1]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "changed", *more])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, changed boolean" + "".join(f", {c} long" for c in more)
    return rows.mapInArrow(report, schema)


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, also: DataFrame | None = None, **sizes) -> DataFrame:
    """docs with the repeated bytes gone from text; a character cut in two goes as well, null stays null, n_chars (if there) is counted anew.

    ``also``: further bytes to remove, as ``passages.shared_passages`` gives them. The result reads tables of ``scratch``, which its owner may drop once the result is written.
    """
    rows = _with_spans(docs, scratch, also, **sizes)
    names, at, chars = list(docs.columns), docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            text = [_pieces(t, spans, unpack)[0].decode(errors="ignore") if t.is_valid else None for t, spans in zip(batch.column(at), batch.column(batch.num_columns - 1))]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(text, pa.string())
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in text], batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, docs.schema)
