"""Order-dependent grouping of short texts: each joins the group of the most similar earlier text, or founds one."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import work_folder

THRESHOLD = 0.55
#: Words of subject lines that say nothing of the matter.
STOP = frozenset("re fw fwd the a an of to for and in on at is are be with by from".split())
_TOKEN = "[a-z0-9]+|[一-鿿]"
#: Texts of a block at most, and characters for each of them on average; blocks of fewer texts there are, so that many tasks have work; texts of one
#: such block alone at most (twice the blocks for four times as many); texts read at once, and texts whose candidates are bounded at once.
BLOCK, LONG, FEW_BLOCKS, SMALL, CHUNK = 131_072, 256, 12, 8192, 1024
#: Pairs that wait to be compared by characters, at most (and those of one text).
WAITING = 1_000_000
#: A word that one text in so many has is added as a whole column. Kinds of characters.
_COMMON, _CHAR_KINDS = 100, 32
_KIND = np.array([1 if chr(c).isdigit() else c - 94 if "a" <= chr(c) <= "z" else 0 if c == 32 else 2 for c in range(128)])


def tokens(subject: Column) -> Column:
    """Distinct runs of letters and digits and single ideographs, without stop words, in lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(subject, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*map(F.lit, sorted(STOP))))))


def _words(low: str) -> set[str]:
    return {t for t in re.findall(_TOKEN, low) if t not in STOP}


def similarity(new: str, old: str) -> float:
    """Of a text to an earlier one: half Jaccard similarity of tokens, half ratio of matching characters (which depends on the order)."""
    a, b = _words(new.lower()), _words(old.lower())
    return _scored(len(a & b) / len(a | b) if a or b else 0.0, new.lower(), old.lower())


def _scored(share: float, new: str, old: str) -> float:
    return round(0.5 * share + 0.5 * SequenceMatcher(None, new, old).ratio(), 3)


def _in_order(new: str, old: str) -> int:
    """Length of the longest common subsequence, which no sum of matching stretches exceeds. Each bit is a place in the older text."""
    at: dict[str, int] = {}
    for i, c in enumerate(old):
        at[c] = at.get(c, 0) | 1 << i
    full = free = (1 << len(old)) - 1
    for c in new:
        if c in at:
            taken = free & at[c]
            free = (free + taken | free - taken) & full
    return len(old) - free.bit_count()


def _numbered(low: list[str], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct words each text has, and their numbers, text by text. Many texts are read at once, parted by line breaks."""
    sizes, words = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(low), CHUNK):
        part = low[lo : lo + CHUNK]
        found, kinds = pd.factorize(np.array(re.findall(f"{_TOKEN}|\n", "\n".join(t.replace("\n", " ") for t in part)), dtype=object))
        number = np.array([-2 if w == "\n" else -1 if w in STOP else numbers.setdefault(w, len(numbers)) for w in kinds], dtype=np.int64)[found]
        one = np.unique((np.cumsum(number == -2) << 32 | number)[number >= 0])
        sizes.append(np.bincount(one >> 32, minlength=len(part)))
        words.append(one & 0xFFFFFFFF)
    return np.concatenate(sizes), np.concatenate(words)


class _Side:
    """Texts of a block: their words by number (``words`` from ``starts`` on), number of words and characters, counts of kinds of characters."""

    def __init__(self, low: list[str], size: np.ndarray, words: np.ndarray):
        n = len(low)
        self.size, self.words, self.starts = size, words, np.concatenate([[0], np.cumsum(size)])
        self.chars = np.array([len(t) for t in low], dtype=np.int64)
        self.kinds = np.zeros((n, _CHAR_KINDS), dtype=np.int32)
        for lo in range(0, n, CHUNK):
            part = self.chars[lo : lo + CHUNK]
            points = np.frombuffer("".join(low[lo : lo + CHUNK]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            kinds = np.where(points < 128, _KIND[np.minimum(points, 127)], 29 + points % 3)
            at = np.repeat(np.arange(len(part)), part) * _CHAR_KINDS + kinds
            self.kinds[lo : lo + CHUNK] = np.bincount(at, minlength=len(part) * _CHAR_KINDS).reshape(len(part), -1)

    def texts_of_words(self, kinds: int) -> list[np.ndarray]:
        order = np.argsort(self.words, kind="stable")
        return np.split(np.repeat(np.arange(len(self.size)), self.size)[order], np.cumsum(np.bincount(self.words, minlength=kinds))[:-1])


def _candidates(here: _Side, there: _Side, kinds: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text here the texts there that have enough words in common with it to reach ``least`` (twice the similarity) at their lengths, and the
    share of common words. Of a block with itself only pairs in this order.

    Common words are counted by the texts of each word, so texts without a common word cost nothing.
    """
    texts, n, alone = there.texts_of_words(kinds), -(-len(there.size) // 8) * 8, here is there
    dtype = np.min_scalar_type(int(max(here.size.max(), there.size.max())) + 1)
    columns = {w: np.bincount(t, minlength=n).astype(dtype) for w, t in enumerate(texts) if len(t) * _COMMON > n and len(t) > 1000}
    sorts, sort = np.unique(np.stack([there.chars, there.size]), axis=1, return_inverse=True)
    sort, common, one, none, last = sort.ravel(), np.zeros(n, dtype), dtype.type(1), np.zeros(0, dtype=np.int64), None
    need = np.full(n, np.iinfo(dtype).max, dtype)
    for i, (chars, size) in enumerate(zip(here.chars.tolist(), here.size.tolist())):
        if last != (chars, size):  # the least number of common words, for each sort of length and number of words
            share = least - 2 * np.minimum(chars, sorts[0]) / np.maximum(chars + sorts[0], 1)
            enough = np.ceil(share * (size + sorts[1]) / (1 + share) - 1e-9)
            may = enough <= np.minimum(size, sorts[1])
            need[: len(sort)] = np.where(may, np.maximum(enough, 1), np.iinfo(dtype).max).astype(dtype)[sort]
            lo, hi = np.searchsorted(there.chars, sorts[0][may][[0, -1]] + [0, 1]) if may.any() else (0, 0)
            hi, last = -(-hi // 8) * 8, (chars, size)
        first = (max(lo, i + 1) if alone else lo) // 8 * 8
        if first >= hi:
            continue
        words = here.words[here.starts[i] : here.starts[i + 1]].tolist()
        common[:] = 0
        np.add.at(common, np.concatenate([none, *(texts[w] for w in words if w not in columns)]), one)
        for w in words:
            if w in columns:
                common[first:hi] += columns[w][first:hi]
        enough = common[first:hi] >= need[first:hi]
        eights = np.flatnonzero(enough.view(np.uint64) != 0)  # few are left, which is faster seen eight at a time
        k, j = np.nonzero(enough.reshape(-1, 8)[eights])
        j += first + 8 * eights[k]
        if alone:
            j = j[j > i]
        if len(j):
            yield i, j, common[j] / (size + there.size[j] - common[j])


def _best_of_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """x, y, similarity: for each text of two blocks (or of one, with itself) the earlier texts there that are most similar to it, if they reach the threshold."""
    low = [t.lower() for t in rows["subject"]]
    numbers: dict[str, int] = {}
    size, words = _numbered(low, numbers)
    order = np.lexsort((size, [len(t) for t in low]))
    starts = (np.cumsum(size) - size)[order]
    place, own, size, low = rows["place"].to_numpy()[order], rows["own"].to_numpy()[order], size[order], [low[i] for i in order]
    late = np.argsort(np.argsort(place, kind="stable"), kind="stable")
    sides, least = [np.flatnonzero(own == b) for b in np.unique(own)], 2 * (THRESHOLD - 0.001) - 1e-4
    best, found = np.zeros(len(rows)), {}
    alone = rows["own"].iloc[0] == rows["other"].iloc[0]
    if not alone and len(sides) == 1:
        return pd.DataFrame({"x": place[:0], "y": place[:0], "similarity": best[:0]})
    filled = [_Side([low[i] for i in side], size[side], words[np.repeat(starts[side] - np.cumsum(size[side]) + size[side], size[side]) + np.arange(size[side].sum())]) for side in sides]
    del words
    here, there = filled[0], filled[-1]
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, ...]] = []

    def bound() -> None:
        i, j, share = (np.concatenate(c) for c in zip(*near))
        near.clear()
        for lo in range(0, len(i), WAITING // 16 + 1):
            at = slice(lo, lo + WAITING // 16 + 1)
            p, q, s = i[at], j[at], share[at]
            most = s + 2 * np.minimum(here.kinds[p], there.kinds[q]).sum(axis=1) / (here.chars[p] + there.chars[q])
            a, b = sides[0][p], sides[-1][q]
            later = late[a] > late[b]
            new, old = np.where(later, a, b), np.where(later, b, a)
            open_ = (most >= least) & (most / 2 + 0.001 >= best[new])
            waiting.append((new[open_], old[open_], s[open_], most[open_]))

    def settle() -> None:
        new, old, share, most = (np.concatenate(c) for c in zip(*waiting))
        waiting.clear()
        order = np.argsort(-most, kind="stable")  # likely ones first: what can't reach the best so far is not compared
        for y, x, s, top in zip(new[order].tolist(), old[order].tolist(), share[order].tolist(), most[order].tolist()):
            if top / 2 + 0.001 < best[y]:
                continue
            top = s + 2 * _in_order(low[y], low[x]) / (len(low[y]) + len(low[x]))
            if top >= least and top / 2 + 0.001 >= best[y]:
                score = _scored(s, low[y], low[x])
                if score >= THRESHOLD and score >= best[y]:
                    found[y] = [*(found[y] if score == best[y] else []), x]
                    best[y] = score

    done = many = 0
    for i, j, share in _candidates(here, there, len(numbers), least):
        near.append((np.full(len(j), i), j, share))
        many += len(j)
        if many >= WAITING or i >= done + CHUNK:
            bound()
            done, many = i, 0
            if sum(len(w[0]) for w in waiting) >= WAITING:
                settle()
    if near:
        bound()
    if waiting:
        settle()
    pairs = [(x, y) for y, xs in found.items() for x in xs]
    x, y = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    return pd.DataFrame({"x": place[x], "y": place[y], "similarity": best[y]})


def _most_similar(firsts: DataFrame) -> DataFrame:
    """x, y, similarity: the earlier texts most similar to each within every pair of blocks, if they reach the threshold.

    Texts are dealt into blocks and each pair of blocks is a task's, which counts common words and compares only what they leave; no pair
    is shuffled but those found, and the texts only as often as there are blocks.
    """
    n, chars = firsts.agg(F.count("*"), F.coalesce(F.sum(F.length("subject")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK), -(-chars // (BLOCK * LONG)), min(FEW_BLOCKS, math.ceil(math.sqrt(n / SMALL))), 1)
    own, other = F.col("own"), F.col("other")
    dealt = firsts.select("place", "subject", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("own"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).withColumn("task", F.least(own, other) * blocks + F.greatest(own, other))
    place = firsts.schema["place"].dataType.simpleString()
    return pairs.repartition(2 * blocks * (blocks + 1), "task").groupBy("task").applyInPandas(_best_of_blocks, f"x {place}, y {place}, similarity double")


def _founders(links: DataFrame, folder: str) -> DataFrame:
    """item, founder: every item that links to earlier ones gets the smallest founder among theirs. ``links``: y, x (earlier).

    Items with one link are pointers, and links to them are moved on to where they point, which doubles the reach each round;
    items whose links all end at founders keep the smallest. Rounds grow with the logarithm of the longest chain.
    """
    spark, turn = links.sparkSession, 0

    def written(df: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        df.write.parquet(f"{folder}/links-{turn}")
        return spark.read.parquet(f"{folder}/links-{turn}")

    now = written(links.select("y", "x").distinct())
    while True:
        kinds = now.groupBy("y").agg(F.count("*").alias("n"), F.min("x").alias("to")).withColumnRenamed("y", "at")
        marked = now.join(kinds, F.col("x") == F.col("at"), "left")  # n is null where x is a founder
        moved = marked.select("y", F.when(F.col("n") == 1, F.col("to")).otherwise(F.col("x")).alias("x"), (F.col("n") == 1).alias("was_pointer"), F.col("n").isNull().alias("founder"))
        ends = moved.groupBy("y").agg(F.min("founder").alias("all_founders"), F.min("x").alias("least"), F.collect_set("x").alias("xs"))
        after = written(ends.select("y", F.explode(F.when(F.col("all_founders"), F.array("least")).otherwise(F.col("xs"))).alias("x")))
        if not after.join(after.select(F.col("y").alias("x")).distinct(), "x", "left_semi").head(1):
            return after.groupBy("y").agg(F.min("x").alias("founder")).withColumnRenamed("y", "item")
        now = after


def greedy_groups(items: DataFrame, place: str, subject: str) -> DataFrame:
    """place, subject, founder (place of the text that founded the group), similarity (to the most similar earlier text; 1.0 for founders).

    ``place`` orders the texts and is unique. A text joins the group of the most similar earlier one if their similarity is at least 0.55
    (of several, the group founded first), else it founds a group. Texts that are equal but for case join the first of them; texts without tokens
    reach 0.5 at most and stand alone. Null subjects are empty texts.
    """
    folder = work_folder(items.sparkSession, "groups")
    rows = items.select(F.col(place).alias("place"), F.coalesce(F.col(subject), F.lit("")).alias("subject")).withColumn("tokens", tokens(F.col("subject"))).withColumn("low", F.lower("subject"))
    firsts = rows.where(F.size("tokens") > 0).groupBy("low").agg(F.min(F.struct("place", "subject")).alias("f"))
    firsts = firsts.select("low", "f.*")
    firsts.write.parquet(f"{folder}/firsts")
    firsts = items.sparkSession.read.parquet(f"{folder}/firsts")
    _most_similar(firsts).write.parquet(f"{folder}/scored")
    scored = items.sparkSession.read.parquet(f"{folder}/scored")
    best = scored.groupBy("y").agg(F.max("similarity").alias("similarity"))
    founders = _founders(scored.join(best, ["y", "similarity"]).select("y", "x"), folder)
    of_first = firsts.select("low", F.col("place").alias("item")).join(founders, "item", "left").join(best.withColumnRenamed("y", "item"), "item", "left")
    out = rows.join(of_first, "low", "left")
    later = F.col("item").isNotNull() & (F.col("place") != F.col("item"))
    return out.select(F.col("place").alias(place), F.col("subject").alias(subject), F.coalesce("founder", "item", "place").alias("founder"), F.when(later, 1.0).otherwise(F.coalesce("similarity", F.lit(1.0))).alias("similarity"))


def group_names(grouped: DataFrame, subject: str, most: int = 3) -> DataFrame:
    """founder, n_members, name: the tokens of two characters and more (or ideographs) that most members have, ties by token; the founder's first 20 characters if there is none."""
    spread = grouped.select("founder", F.explode(tokens(F.col(subject))).alias("token")).where((F.length("token") >= 2) | F.col("token").between("一", "鿿"))
    counts = spread.groupBy("founder", "token").count()
    rank = F.row_number().over(Window.partitionBy("founder").orderBy(F.desc("count"), "token"))
    named = counts.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("founder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda r: r["token"]), " · ").alias("name"))
    first = grouped.groupBy("founder").agg(F.count("*").alias("n_members"), F.min(F.when(F.col("similarity") == 1.0, F.substring(subject, 1, 20))).alias("first"))
    return first.join(named, "founder", "left").select("founder", "n_members", F.coalesce("name", "first").alias("name"))
