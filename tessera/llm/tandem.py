"""Stretches of words that repeat with a period, found by the linear-time method of Gusfield and Stoye for tandem repeats.

A square is a word sequence twice in a row. For each text: Lempel-Ziv blocks and longest common extensions at their edges
give squares that cover the leftmost occurrences of all kinds of square; these are marked in a suffix tree. From each mark
a walk along suffix links (drop the first word, append it again) marks every further kind that occurs, until a rotation is
missing or marked already. Then every start of a text reads the marks above its leaf, and starts that follow one another
with one period merge into runs. Squares whose half is itself a power are left out at once: a run of period q is covered
by squares of q, and a start has only logarithmically many squares with primitive halves, so nothing grows quadratically.

All words of a run of at least 12 words and two periods lie in windows of six words that occur twice in the text, so trees are
built for the stretches that such windows cover, each by itself; no run reaches over their edges. Windows are compared by
64-bit hashes; an accidental match only makes a stretch longer.

Null texts count as empty. Rows that repeat are treated row by row. Ids are passed through, null or not. Columns other than
the id and the text are not read. A text is handled whole, with memory that grows with its longest periodic stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import bounded_batches

#: Runs of fewer words are not reported.
SHORTEST = 12
WINDOW = 6

_MULT = np.random.default_rng(20240817).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


class SuffixTree:
    """Suffix tree with suffix links of a list of word numbers (0 and up), built online; a unique last word is added.

    Per node: ``parent``, ``depth`` (words from the root), ``start`` of its edge's label in ``words``, ``link``. A label is
    always taken from the leftmost occurrence, so ``first(v)`` is the smallest place at which v's path occurs.
    """

    def __init__(self, words: list[int]):
        self.n = len(words)
        self.words = s = [*words, max(words, default=-1) + 1]
        self.wide = wide = s[-1] + 1
        self.start, self.parent, self.depth, self.link, self.leaf = start, parent, depth, link, leaf = [0], [0], [0], [0], []
        self.child = child = {}
        size, node, edge, length, left = len(s), 0, 0, 0, 0
        for i, word in enumerate(s):
            left += 1
            pending = 0
            while left:
                if not length:
                    edge = i
                key = node * wide + s[edge]
                below = child.get(key)
                if below is None:
                    leaf.append(len(start))
                    child[key] = len(start)
                    start.append(i)
                    parent.append(node)
                    depth.append(size - len(leaf) + 1)
                    link.append(0)
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    along = depth[below] - depth[node]
                    if length >= along:
                        edge, length, node = edge + along, length - along, below
                        continue
                    at = start[below]
                    if s[at + length] == word:
                        if pending:
                            link[pending] = node
                        length += 1
                        break
                    mid = len(start)
                    start += (at, i)
                    parent += (node, mid)
                    leaf.append(mid + 1)
                    depth += (depth[node] + length, size - len(leaf) + 1)
                    link += (0, 0)
                    child[key] = mid
                    child[mid * wide + word] = mid + 1
                    start[below], parent[below] = at + length, mid
                    child[mid * wide + s[at + length]] = below
                    if pending:
                        link[pending] = mid
                    pending = mid
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1

    def first(self, v: int) -> int:
        return self.start[v] - self.depth[self.parent[v]]

    def below(self, node: int, at: int, length: int) -> int:
        """The node at or next below the end of the ``length`` words from place ``at`` on, which are known to occur, from an ancestor on (skip and count)."""
        child, depth, wide, s = self.child, self.depth, self.wide, self.words
        while depth[node] < length:
            node = child[node * wide + s[at + depth[node]]]
        return node

    def blocks(self) -> list[int]:
        """Starts of the Lempel-Ziv blocks, and the end: each is the longest prefix that occurs further left (it may overlap), or one new word."""
        child, depth, wide, s, starts, i = self.child, self.depth, self.wide, self.words, [], 0
        while i < self.n:
            starts.append(i)
            node = 0
            while (v := child[node * wide + s[i + depth[node]]]) and self.first(v) < i:
                node = v
            i += max(1, depth[node])
        return [*starts, self.n]


class Extensions:
    """Longest common extensions of many pairs of places at once, from names of all windows of 1, 2, 4, 8, ... words (equal names, equal words)."""

    def __init__(self, words: np.ndarray):
        self.n, self.names = len(words), [words.astype(np.int64)]
        while (size := 2 << (len(self.names) - 1)) <= self.n:
            last = self.names[-1]
            pairs = last[: self.n - size + 1] * (self.n + 1) + last[size // 2 :]
            self.names.append(np.unique(pairs, return_inverse=True)[1])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a on equal those from places b on."""
        return self._steps(a, b, True)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words back from places a, themselves included, equal those back from places b."""
        return self._steps(a, b, False)

    def _steps(self, a: np.ndarray, b: np.ndarray, on: bool) -> np.ndarray:
        far = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            x, y = (a + far, b + far) if on else (a - far - size + 1, b - far - size + 1)
            fits = np.flatnonzero((x >= 0) & (y >= 0) & (x < len(names)) & (y < len(names)))
            far[fits[names[x[fits]] == names[y[fits]]]] += size
        return far


def _prime_factors(k: int) -> list[int]:
    found, p = [], 2
    while p * p <= k:
        if k % p == 0:
            found.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return found + [k] * (k > 1)


def covering_squares(words: np.ndarray, blocks: list[int], extend: Extensions) -> list[tuple[int, int]]:
    """(place, half length) of squares with primitive halves: rotating them to the right reaches the leftmost occurrence of every kind of square."""
    n, edges = len(words), np.array(blocks, dtype=np.int64)
    size = np.diff(edges)
    # the right half starts in the block and reaches over its end
    half, end = _counted(size), np.repeat(edges[1:], size)
    keep = end < n
    half, end = half[keep], end[keep]
    at = end - half
    keep = words[end] == words[at]
    half, end, at = half[keep], end[keep], at[keep]
    ahead, behind = extend.ahead(end, at), extend.behind(end - 1, at - 1)
    keep = ahead + behind >= half
    found = [(np.maximum(at - behind, at - half + 1)[keep], half[keep])]
    # the left half starts before the block, the right half starts in it (and, as it occurred before, ends in the next block at the latest)
    reach = size + np.append(size[1:], 0)
    half, begin = _counted(reach), np.repeat(edges[:-1], reach)
    at = begin + half
    keep = (begin > 0) & (at < n)
    half, begin, at = half[keep], begin[keep], at[keep]
    keep = words[begin - 1] == words[at - 1]
    half, begin, at = half[keep], begin[keep], at[keep]
    ahead, behind = extend.ahead(begin, at), extend.behind(begin - 1, at - 1)
    keep = ahead + behind >= half
    found.append((np.maximum(begin - behind, begin - half)[keep], half[keep]))

    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
    at, half = pairs[:, 0], pairs[:, 1]
    factors = {k: _prime_factors(k) for k in np.unique(half).tolist()}
    whole = np.ones(len(at), dtype=bool)
    for nth in range(max(map(len, factors.values()), default=0)):
        prime = np.array([f[nth] if nth < len(f) else 0 for f in map(factors.get, half.tolist())], dtype=np.int64)
        some = np.flatnonzero(prime)
        period = half[some] // prime[some]
        whole[some[extend.ahead(at[some], at[some] + period) >= 2 * half[some] - period]] = False
    return list(zip(at[whole].tolist(), half[whole].tolist()))


def _counted(sizes: np.ndarray) -> np.ndarray:
    """1..sizes[0], 1..sizes[1], ..."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def all_squares(tree: SuffixTree, covering: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Marks of all kinds of square with primitive halves: node at or below whose edge the square ends -> its half lengths."""
    marks: dict[int, list[int]] = {}
    child, depth, parent, link, wide, s = tree.child, tree.depth, tree.parent, tree.link, tree.wide, tree.words
    for at, half in covering:
        length = 2 * half
        v = tree.below(0, at, length)
        while half not in (have := marks.setdefault(v, [])):
            have.append(half)
            at = tree.first(v)  # any occurrence of the square
            up = parent[v]
            v = tree.below(link[up], at + 1, length - 1)
            if depth[v] >= length:
                if s[tree.first(v) + length - 1] != s[at]:
                    break
            elif (v := child.get(v * wide + s[at])) is None:
                break
    return marks


def _starts(tree: SuffixTree, marks: dict[int, list[int]]) -> tuple[list[int], list[int]]:
    """(place, half length) of every occurrence of the marked squares."""
    parent, near = tree.parent, [0] * len(tree.parent)
    for v in np.argsort(tree.depth, kind="stable").tolist():
        near[v] = v if marks.get(v) else near[parent[v]]
    places, halves = [], []
    for at in range(tree.n):
        v = near[tree.leaf[at]]
        while v:
            for half in marks[v]:
                places.append(at)
                halves.append(half)
            v = near[parent[v]]
    return places, halves


def runs_of_stretch(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of at least two periods, of whatever length, in one sequence of word numbers."""
    tree = SuffixTree(words.tolist())
    covering = covering_squares(words, tree.blocks(), Extensions(words))
    if not covering:
        return np.zeros((0, 3), dtype=np.int64)
    places, halves = (np.array(x, dtype=np.int64) for x in _starts(tree, all_squares(tree, covering)))
    order = np.lexsort((places, halves))
    places, halves = places[order], halves[order]
    new = np.flatnonzero(np.append(True, (np.diff(halves) != 0) | (np.diff(places) != 1)))
    last = np.append(new[1:], len(places)) - 1
    return np.stack([places[new], places[last] - places[new] + 2 * halves[new], halves[new]], axis=1)


def periodic_stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches covered by windows of six words that occur twice; each run of 12 words or more lies in one of them."""
    n = len(words)
    if n < SHORTEST:
        return []
    hashes = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        hashes += (words[j : n - WINDOW + 1 + j] + 1).astype(np.uint64) * _MULT[j]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    change = np.zeros(n + 1, dtype=np.int64)
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change[: len(hashes)] += twice
    change[WINDOW : WINDOW + len(hashes)] -= twice
    covered = np.diff(np.concatenate([[False], np.cumsum(change[:n]) > 0, [False]]).astype(np.int8))
    spans = zip(np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist())
    return [(a, b) for a, b in spans if b - a >= SHORTEST]


def runs_of_words(words: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``shortest`` (12 or more) words and two periods, by start, then period."""
    if shortest < SHORTEST:
        raise ValueError(f"runs of fewer than {SHORTEST} words are not looked for")
    found = [np.zeros((0, 3), dtype=np.int64)]
    for a, b in periodic_stretches(words):
        found.append(runs_of_stretch(np.unique(words[a:b], return_inverse=True)[1]) + [a, 0, 0])
    out = np.concatenate(found)
    out = out[out[:, 1] >= shortest]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def dropped_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def _find(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, rows, collapsed = [], [np.zeros((0, 3), dtype=np.int64)], []
        ends = [0]
        for text in batch.column(1):
            words = (text.as_py() or "").encode().split()  # splits at exactly U+0020 and U+0009 to U+000D
            number: dict[bytes, int] = {}
            found = runs_of_words(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64), shortest)
            if len(found):
                gone = dropped_words(len(words), found).tolist()
                words_left = [w for w, x in zip(words, gone) if not x]
            else:
                words_left = words
            counts.append(len(words))
            rows.append(found)
            ends.append(ends[-1] + len(found))
            collapsed.append(b" ".join(words_left).decode())
        flat = np.concatenate(rows)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", id: str = "doc_id", shortest: int = SHORTEST) -> DataFrame:
    """Per row of ``docs``: the id, n_words, runs (array of start, length, period in words, by start, then period), collapsed (the words left when each run keeps its first period, joined by a space).

    Words are ``[^\\x20\\x09-\\x0D]+``. One pass over the rows without a shuffle; a null text has no words, an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda batches: _find(batches, shortest), f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id)


def run_digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests of what ``find_runs`` returns; four nulls where there is no run."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    others = [c for c in found.columns if c not in ("n_words", "runs", "collapsed")]
    return (
        found.withColumn("best", best)
        .select(
            *others, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
            F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        )
    )


def with_cycles(docs: DataFrame) -> DataFrame:
    """``doc_id`` and text, where every tenth text by h = crc32(doc_id) repeats: with n words, g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i >= a becomes word a + (i - a) % p.

    Null ids and texts without words stay as they are.
    """
    whole = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    dealt = whole.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))).withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long")))
    dealt = dealt.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    cycle = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p) + 1)), 1, int(n - a))")
    return dealt.select("doc_id", F.when(F.col("n").isNotNull(), F.concat_ws(" ", F.expr("slice(w, 1, a)"), cycle)).otherwise(F.col("text")).alias("text"))
