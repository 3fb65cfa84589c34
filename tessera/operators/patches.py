"""Text patches: claims on stretches of a text, their overlaps resolved by priority, and patches that can be applied, logged, undone and replayed.

A claim or patch has ``start`` and ``end`` (characters from 0, end excluded) in the text as it is before. All work is in expressions within a row,
but for finding and resolving claims, which are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PATCH = "struct<start:int,end:int,before:string,after:string>"


#: Set around matches, to find their places in one pass; a character that texts do not have as a rule.
MARK = "\uffff"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (gap, found): each match and the number of characters between it and the one before."""

    def paired(parts: Column) -> Column:  # what stands between the matches, and the matches, in turn
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(F.length(F.get(parts, i - 1)).alias("gap"), F.get(parts, i).alias("found"))))

    twice = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    apart = F.transform(F.filter(twice, lambda p: p["found"].isNotNull()), lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["found"].alias("found")))
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)
    return F.when(F.contains(text, F.lit(MARK)), apart).otherwise(let(marked, paired))


def find_claims(texts: DataFrame, id: str, text: str, patterns: list[tuple[str, int, str]]) -> DataFrame:
    """id, kind, priority, start, end, found: all matches of each (kind, priority, regular expression) in every text; null texts have none.

    Texts are read once and their matches brought together by id once, so what follows by id needs no shuffle.
    """
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), _matches(F.col(text), pattern).alias("matches")) for kind, priority, pattern in patterns])
    rows = texts.select(F.col(id), F.posexplode(each).alias("of", "x")).select(id, "of", "x.kind", "x.priority", F.posexplode("x.matches").alias("k", "m"))
    upto = Window.partitionBy(id, "of").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(id, "of", "kind", "priority", "k", "m.*").repartition(id).withColumn("end", F.sum(F.col("gap") + F.length("found")).over(upto).cast("int"))
    return rows.select(id, "kind", "priority", (F.col("end") - F.length("found")).alias("start"), "end", "found")


def resolve_claims(claims: DataFrame, id: str) -> DataFrame:
    """The claims that keep their place: by priority, then start, then length (longest first), each that overlaps none kept before it.

    Claims of a text that overlap, directly or through others, form an island; only islands are gathered. Ties beyond that go to the smallest other columns.
    """
    others = [c for c in claims.columns if c not in (id, "priority", "start", "end")]
    along = Window.partitionBy(id).orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = claims.withColumn("new", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("priority", "start", (F.col("start") - F.col("end")).alias("shorter"), "end", *others)))
    gathered = islands.groupBy(id, "island").agg(ordered.alias("all"))
    kind = gathered.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.array().cast(kind), lambda kept, c: F.when(F.exists(kept, lambda k: (c["start"] < k["end"]) & (c["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(c))))
    return gathered.select(id, F.explode(kept).alias("c")).select(id, *(F.col(f"c.{c}").alias(c) for c in claims.columns if c != id))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named inside, also in functions on elements."""
    return F.transform(F.array(value), use)[0]


def wide(text: Column) -> Column:
    """Four bytes a character: any stretch is found at once, where a string is read from its start. The text must be valid UTF-8."""
    return F.encode(text, "UTF-32")


def stretch(of: Column, start: Column, n: Column) -> Column:
    """n characters of a wide text, wide."""
    return F.substring(of, 4 * start + 1, 4 * n)


def narrow(of: Column) -> Column:
    """The string; the mark put before is taken off by decoding, so one that the text begins with stays."""
    return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), of), "UTF-32")


def in_order(patches: Column) -> Column:
    return F.array_sort(patches)


def problem(text: Column, patches: Column) -> Column:
    """Why patches (sorted) do not fit a text: ``span`` (beyond its end, or before its start), ``before`` (another text stands there), ``overlap``; null if they do."""
    n = F.length(text)
    other = let(wide(text), lambda w: F.exists(patches, lambda p: stretch(w, p["start"], p["end"] - p["start"]) != wide(p["before"])))
    starts = F.transform(patches, lambda p: p["start"])
    ends = F.transform(patches, lambda p: p["end"])
    crossed = F.exists(F.arrays_zip(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))).alias("s"), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))).alias("e")), lambda x: x["s"] < x["e"])
    return (
        F.when(let(n, lambda n: F.exists(patches, lambda p: (p["start"] < 0) | (p["end"] > n) | (p["end"] < p["start"]))), "span")
        .when(other, "before")
        .when(crossed, "overlap")
    )


def applied(text: Column, patches: Column) -> Column:
    """The text after patches (sorted, without a problem): what stands between them, and what each puts in its place, joined once."""
    froms = F.concat(F.array(F.lit(0)), F.transform(patches, lambda p: p["end"]))

    def joined(w: Column, froms: Column) -> Column:
        before = F.transform(F.arrays_zip(patches.alias("p"), F.slice(froms, 1, F.size(patches)).alias("f")), lambda x: F.concat(narrow(stretch(w, x["f"], x["p"]["start"] - x["f"])), x["p"]["after"]))
        return F.concat(F.array_join(before, ""), narrow(F.substring(w, 4 * F.element_at(froms, -1) + 1, F.length(w))))

    return let(wide(text), lambda w: let(froms, lambda froms: joined(w, froms)))


_SUMMED = 64


def inverse(patches: Column) -> Column:
    """Patches (sorted) that undo these: places move by what the patches before have added (summed by 64 and then within)."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    before = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, 1, i)))
    of_blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / _SUMMED).cast("int")), lambda b: total(F.slice(xs, b * _SUMMED + 1, _SUMMED)))
    added = lambda xs, bs, i: F.get(bs, F.floor(i / _SUMMED).cast("int")) + total(F.slice(xs, i - i % _SUMMED + 1, i % _SUMMED))
    grown = F.transform(patches, lambda p: F.length(p["after"]) - (p["end"] - p["start"]))
    moved = let(grown, lambda xs: let(let(of_blocks(xs), before), lambda bs: F.transform(patches, lambda p, i: p["start"] + added(xs, bs, i))))
    return F.transform(F.arrays_zip(patches.alias("p"), moved.alias("s")), lambda x: F.struct(x["s"].cast("int").alias("start"), (x["s"] + F.length(x["p"]["after"])).cast("int").alias("end"), x["p"]["after"].alias("before"), x["p"]["before"].alias("after")))


def commit(revisions: Column, stage: str, text: Column, patches: Column, invariant: Column) -> Column:
    """``revisions`` with one more: the stage's patches if they fit and ``invariant`` holds, else none of them and the reason.

    A stage that breaks something is undone whole, as its other patches are no longer to be trusted either.
    """
    ordered = in_order(patches)
    why = F.coalesce(problem(text, ordered), F.when(~F.coalesce(invariant, F.lit(False)), "invariant"))
    kept = lambda why: F.when(why.isNull(), ordered).otherwise(F.array().cast(f"array<{PATCH}>"))
    revision = lambda why: F.struct((F.size(revisions) + 1).alias("rev"), F.lit(stage).alias("stage"), kept(why).alias("patches"), F.size(patches).alias("proposed"), why.alias("rolled_back"))
    return F.concat(revisions, F.array(let(why, revision)))


def replay(text: Column, revisions: Column, upto: Column) -> Column:
    """The text after all revisions up to a number, from the text before the first."""
    return F.aggregate(F.filter(revisions, lambda r: r["rev"] <= upto), text, lambda now, r: applied(now, r["patches"]))


def revert(text: Column, revisions: Column, downto: Column) -> Column:
    """The text as of a revision, from the text after the last: inverse patches, latest first."""
    return F.aggregate(F.reverse(F.filter(revisions, lambda r: r["rev"] > downto)), text, lambda now, r: applied(now, inverse(r["patches"])))
