"""Repair of ragged tables: rows of cells get one width, torn cells are put together again, headers are told from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: In the order in which they win where several are equally frequent.
DELIMITERS = (",", "\t", ";", "|")
#: Rows at the top of a text in which delimiters are counted.
HEAD = 10
NUMERIC = r"^[-+]?[0-9,.]+%?$"


def delimiter(lines: Column) -> Column:
    """The delimiter found most often in the first lines of an array; a comma if there is none."""
    head = F.array_join(F.slice(lines, 1, HEAD), "\n")
    counts = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    return F.greatest(*counts)["d"]


def cells_of_lines(texts: DataFrame, id: str, text: str) -> DataFrame:
    """id, line (from 0, blank lines left out but counted), cells of every line of every text; null texts have none."""
    split = texts.select(id, F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n").alias("lines")).withColumn("d", delimiter(F.col("lines")))
    rows = split.select(id, "d", F.posexplode("lines").alias("line", "row")).where(F.regexp_replace("row", r"[\x20\x09-\x0D]", "") != "")
    bare = F.transform(F.split("row", F.concat(F.lit("\\Q"), F.col("d"), F.lit("\\E"))), lambda c: F.trim(_strip(c), F.lit('"')))
    return rows.select(id, "line", bare.alias("cells"))


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\x0b\x0c\r"))


def repair_tables(rows: DataFrame, id: str, line: str, cells: str) -> DataFrame:
    """id, row (from 1), is_header, cells, padded, merged: each table's rows at its most frequent width.

    The width of most rows (of several, that met first) is the table's. A row that is narrower and has no more than a third of it (at
    least one cell) continues the last cell of the row before; other narrow rows are filled with empty cells; what a wide row
    has beyond is joined into the last cell. The first row is a header unless half of its cells or more (at least one) are numbers.
    ``padded`` counts filled cells, ``merged`` continuation lines. Lines of one table are put together by id, so its size bounds a task.
    """
    sized = rows.select(F.col(id).alias("id"), F.col(line).alias("line"), F.col(cells).alias("cells"), F.size(cells).alias("n"))
    widths = sized.groupBy("id", "n").agg(F.count("*").alias("often"), F.min("line").alias("first"))
    width = widths.groupBy("id").agg(F.max(F.struct("often", (-F.col("first")).alias("order"), F.col("n").alias("width"))).alias("w")).select("id", F.col("w.width").alias("width"))
    along = Window.partitionBy("id").orderBy("line")
    torn = (F.col("n") < F.col("width")) & (F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("width") / 3))) & (F.row_number().over(along) > 1)
    placed = sized.join(width, "id").withColumn("torn", torn).withColumn("row", F.sum((~F.col("torn")).cast("int")).over(along))
    gathered = placed.groupBy("id", "row", "width").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("lines"))
    own, w = F.col("lines")[0]["cells"], F.col("width")
    tail = F.array_join(F.filter(F.slice(own, w, F.greatest(F.size(own) - w + 1, F.lit(0))), lambda c: c != ""), " ")
    full = F.when(F.size(own) > w, F.concat(F.slice(own, 1, w - 1), F.array(tail))).otherwise(F.concat(own, F.array_repeat(F.lit(""), w - F.size(own))))
    more = F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.array_join(x["cells"], " "))
    fixed = gathered.withColumn("full", full).withColumn("more", more)
    last = F.aggregate("more", F.element_at("full", -1), lambda a, x: _strip(F.concat(a, F.lit(" "), x)))
    fixed = fixed.withColumn("fixed", F.when(F.size("more") > 0, F.concat(F.slice("full", 1, w - 1), F.array(last))).otherwise(F.col("full")))
    numbers = F.size(F.filter("fixed", lambda c: _strip(c).rlike(NUMERIC)))
    header = (F.col("row") == 1) & (numbers < F.greatest(F.lit(1), F.floor(w / 2)))
    return fixed.select(F.col("id").alias(id), F.col("row"), header.alias("is_header"), F.col("fixed").alias("cells"), F.greatest(w - F.size(own), F.lit(0)).alias("padded"), F.size("more").alias("merged"))


def column_places(words: DataFrame, id: str, start: str, end: str, gap: int = 2) -> DataFrame:
    """id, column (from 1), first, last: the columns of a page of fixed-width text, as intervals of places that its words cover.

    Words lie in one column if a chain of words leads from one to the other whose intervals are less than ``gap`` places apart:
    one-dimensional clustering by single linkage, as islands along the places. Equal intervals count once, so a page sends no more rows than it has distinct ones.
    """
    spans = words.select(F.col(id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    along = Window.partitionBy("id").orderBy("s", "e")
    reach = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("s") >= reach + gap)).cast("int")
    marked = spans.withColumn("new", new).withColumn("column", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("id", "column").agg(F.min("s").alias("first"), F.max("e").alias("last")).withColumnRenamed("id", id)


def grid_cells(words: DataFrame, columns: DataFrame, id: str, line: str, start: str, word: str) -> DataFrame:
    """id, line, column, cell: the words of each line in each column, in order, joined by a space."""
    held = (words[id] == columns[id]) & words[start].between(columns["first"], columns["last"])
    placed = words.join(columns, held).select(words[id], line, "column", F.struct(F.col(start), F.col(word)).alias("w"))
    return placed.groupBy(id, line, "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w[word]), " ").alias("cell"))


def period_header(cells: Column, pattern: str) -> Column:
    """Distinct periods of a row's cells in order, or null where fewer than two are found."""
    found = F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))
    return F.when(F.size(found) >= 2, F.array_distinct(found))


def restore_values(rows: DataFrame, id: str, row: str, cells: str, pattern: str = r"(?:19|20)[0-9]{2}[AEF]?|[1-4]Q[0-9]{2}", top: int = 3) -> DataFrame:
    """id, row, label, period, text: the cells below a table's period header, one row each, by label and period.

    The header is the first of the top three rows with two periods or more; its distinct periods name the cells after the label
    in order, and cells beyond them (or all, without a header) are named ``col0``, ``col1``, ... Rows without a label, and repeated headers, are left out.
    """
    read = rows.select(F.col(id).alias("id"), F.col(row).alias("row"), F.col(cells).alias("cells"))
    heads = read.where(F.col("row") <= top).withColumn("periods", period_header(F.col("cells"), pattern)).where("periods is not null")
    head = heads.groupBy("id").agg(F.min(F.struct("row", "periods")).alias("h")).select("id", F.col("h.row").alias("head"), F.col("h.periods").alias("periods"))
    label = F.regexp_replace(_strip(F.col("cells")[0]), r"[\x20\x09-\x0D]+", " ")
    body = read.join(head, "id", "left").where(F.col("head").isNull() | (F.col("row") > F.col("head"))).withColumn("label", label)
    body = body.where((F.col("label") != "") & ~F.col("label").rlike(rf"^(?:(?:{pattern})\s*)+$"))
    each = body.select("id", "row", "label", "periods", F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias("at", "text"))
    period = F.when(F.col("at") < F.coalesce(F.size("periods"), F.lit(0)), F.expr("get(periods, at)")).otherwise(F.concat(F.lit("col"), F.col("at").cast("string")))
    return each.select(F.col("id").alias(id), F.col("row").alias(row), "label", period.alias("period"), _strip(F.col("text")).alias("text"))


def zip_and_vote(first: DataFrame, second: DataFrame, page: str, order: str, cells: str, near: float = 1.2) -> DataFrame:
    """page, place, engine, verdict, order, cells: the tables that two engines found on a page, paired by place, one kept of each pair.

    A table without a partner is ``solo``; if the numbers of cells differ by a fifth or less the first engine's is ``confirmed``, else the
    one with more cells is ``larger`` (the first of equals). An empty table counts as one cell in the comparison.
    """
    place = F.row_number().over(Window.partitionBy(page).orderBy(order))
    a, b = (x.select(F.col(page).alias("page"), place.alias("place"), F.struct(F.col(order).alias("order"), F.col(cells).alias("cells")).alias(s)) for x, s in ((first, "a"), (second, "b")))
    m, n = F.col("a.cells"), F.col("b.cells")
    agree = F.greatest(m, n) / F.greatest(F.least(m, n), F.lit(1)) <= near
    own = F.col("b").isNull() | F.col("a").isNotNull() & (agree | (m >= n))
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), "solo").when(agree, "confirmed").otherwise("larger")
    kept = F.when(own, F.col("a")).otherwise(F.col("b"))
    both = a.join(b, ["page", "place"], "full").select("page", "place", F.when(own, "first").otherwise("second").alias("engine"), verdict.alias("verdict"), kept.alias("t"))
    return both.select(F.col("page").alias(page), "place", "engine", "verdict", F.col("t.order").alias(order), F.col("t.cells").alias(cells))


# What is noise in a line of a page, lines that are labels of an axis, and the end of a sentence.
NOISE = r"\{.*?\}|[\x00-\x08\x0b\x0c\x0e-\x1f]|^[-+]? *[0-9]+ *- *$"
AXIS = r"^[-+]?[0-9\s,.]+%?$|^(?:[0-9]+[OBoS]+|[sS]o+|JO+|I+)$"
SENTENCE_END = "[。！？.!?]$"
#: Shorter lines are titles; lines that agree in so many characters are repeats.
TITLE, SAME = 20, 80


def repair_blocks(blocks: DataFrame, id: str, line: str, text: str) -> DataFrame:
    """id, block (from 1), text, lines: lines of a page cleaned of noise, axis labels, stubs and repeats (the first stays), and joined to the ends of their sentences.

    A title stands alone and ends what comes before it. What no sentence end follows is a block too. Lines of one page are ordered in one task.
    """
    spaced = F.replace(F.replace(_strip(F.regexp_replace(text, NOISE, " ")), F.lit("\u3000"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    bare = F.regexp_replace(F.regexp_replace(spaced, "(?<=[一-龥])\\s+(?=[一-龥])", ""), " {2,}", " ")
    cleaned = blocks.select(F.col(id).alias("id"), F.col(line).alias("line"), F.explode(F.array(bare)).alias("text"))  # an element is worked out once, a column at each use
    rows = cleaned.where((F.length("text") >= 2) & ~_strip(F.col("text")).rlike(AXIS)).repartition("id")
    again = F.row_number().over(Window.partitionBy("id", F.substring("text", 1, SAME)).orderBy("line", "text"))
    first = rows.withColumn("again", again).where("again = 1").drop("again")
    along = Window.partitionBy("id").orderBy("line")
    title, ends = F.length("text") < TITLE, _strip(F.col("text")).rlike(SENTENCE_END)
    marked = first.withColumn("title", title).withColumn("stop", title | ends)
    opens = F.col("title") | F.coalesce(F.lag("stop").over(along), F.lit(True))
    numbered = marked.withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return joined.select(F.col("id").alias(id), "block", _strip(F.array_join(F.transform("lines", lambda x: x["text"]), "")).alias("text"), F.size("lines").alias("lines"))
