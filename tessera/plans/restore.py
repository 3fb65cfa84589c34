"""Texts put in order: subject groups, ragged and fixed-width tables, claims, patches and revisions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import grouping, patches, tables
from tessera.plans.registry import Tables, query


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^[^.!?\n]*", 0))


@query()
def subject_groups(t: Tables) -> DataFrame:
    """TX-31: every turn's first sentence as a subject line, in the order of conversations and turns."""
    items = t.conversations.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("place"), first_sentence(F.col("text")).alias("subject"))
    found = grouping.greedy_groups(items, "place", "subject")
    return found.join(grouping.group_names(found, "subject"), "founder").select("place", "founder", "similarity", "n_members", "name")


_WS = "[\\x20\\x09-\\x0D]"
_STRIP = f"regexp_replace({{}}, '^{_WS}+|{_WS}+$', '', 'g')"
_HEAD = "array_to_string(list_slice(lines, 1, 10), chr(10))"
_CELLS = f"""
    split AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    counted AS (SELECT doc_id, lines, [length({_HEAD}) - length(replace({_HEAD}, d, '')) FOR d IN [',', chr(9), ';', '|']] AS n FROM split),
    told AS (SELECT doc_id, lines, [',', chr(9), ';', '|'][list_position(n, list_max(n))] AS d FROM counted),
    cut AS (SELECT doc_id, d, i - 1 AS line, lines[i] AS row FROM told, unnest(range(1, len(lines) + 1)) AS u(i)),
    sized AS (
        SELECT doc_id, line, list_transform(string_split(row, d), lambda c: trim({_STRIP.format("c")}, '"')) AS cells, len(string_split(row, d)) AS n
        FROM cut WHERE regexp_replace(row, '{_WS}', '', 'g') <> '')"""


@query(f"""
    WITH {_CELLS},
    wide AS (
        SELECT doc_id, n AS w FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(line)) AS k FROM sized GROUP BY doc_id, n) WHERE k = 1),
    torn AS (SELECT *, n < w AND n <= greatest(1, w // 3) AND row_number() OVER (PARTITION BY doc_id ORDER BY line) > 1 AS torn FROM sized JOIN wide USING (doc_id)),
    placed AS (SELECT *, sum(CASE WHEN torn THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS row FROM torn),
    own AS (
        SELECT doc_id, row, w, n, CASE WHEN n > w THEN list_concat(cells[1:w - 1], [array_to_string(list_filter(cells[w:], lambda c: c <> ''), ' ')])
               ELSE list_concat(cells, [x FOR x IN repeat([''], greatest(w - n, 0))]) END AS cells FROM placed WHERE NOT torn),
    more AS (SELECT doc_id, row, list(array_to_string(cells, ' ') ORDER BY line) AS more FROM placed WHERE torn GROUP BY doc_id, row),
    fixed AS (
        SELECT doc_id, row, w, n, coalesce(len(more), 0) AS merged, CASE WHEN more IS NULL THEN cells ELSE list_concat(cells[1:w - 1],
               [list_reduce(more, lambda a, x: {_STRIP.format("a || ' ' || x")}, cells[-1])]) END AS cells
        FROM own LEFT JOIN more USING (doc_id, row))
    SELECT doc_id, CAST(row AS BIGINT) AS row, row = 1 AND len(list_filter(cells, lambda c: regexp_matches({_STRIP.format("c")}, '^[-+]?[0-9,.]+%?$'))) < greatest(1, w // 2) AS is_header,
           cells, CAST(greatest(w - n, 0) AS INT) AS padded, CAST(merged AS INT) AS merged
    FROM fixed""")
def ragged_tables(t: Tables) -> DataFrame:
    """TX-46: every document read as a table of delimited lines."""
    cells = tables.cells_of_lines(t.documents.select("doc_id", "text"), "doc_id", "text")
    return tables.repair_tables(cells, "doc_id", "line", "cells").withColumn("row", F.col("row").cast("long"))


@query("""
    SELECT p_brand, line, k AS "column", [p_name, p_type, CAST(p_size AS VARCHAR)][k] AS cell
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line FROM part), range(1, 4) AS u(k)""")
def column_grid(t: Tables) -> DataFrame:
    """TX-48: parts printed in columns of fixed width, a page for each brand, and read back by the places of their words."""
    line = F.concat(F.rpad("p_name", 60, " "), F.lit("   "), F.rpad("p_type", 40, " "), F.lit("   "), F.lpad(F.col("p_size").cast("string"), 6, " "))
    pages = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("text")))).alias("lines"))
    lines = pages.select("p_brand", F.posexplode("lines").alias("at", "x")).select(F.struct("p_brand", (F.col("at") + 1).cast("long").alias("line")).alias("id"), F.col("x.text").alias("text"))
    words = patches.find_claims(lines, "id", "text", [("word", 0, "[^ ]+")]).select("id.p_brand", "id.line", "start", "end", "found")
    cells = tables.grid_cells(words, tables.column_places(words, "p_brand", "start", "end"), "p_brand", "line", "start", "found")
    return cells.withColumn("column", F.col("column").cast("long"))


_MEASURES = {"Net  revenue": "CAST(sum(round(l_extendedprice * (1 - l_discount))) AS BIGINT)", "Units sold": "CAST(sum(l_quantity) AS BIGINT)", "Change of tax": "-CAST(sum(round(l_tax * 100)) AS BIGINT)"}


@query(f"""
    WITH y AS (SELECT l_returnflag || l_linestatus AS id, year(l_shipdate) AS y, {", ".join(f"{e} AS m{i}" for i, e in enumerate(_MEASURES.values()))} FROM lineitem GROUP BY 1, 2)
    SELECT id, k AS row, ['{"', '".join(" ".join(k.split()) for k in _MEASURES)}'][k - 1] AS label, y || 'A' AS period, CAST([m0, m1, m2][k - 1] AS DOUBLE) AS value FROM y, range(2, 5) AS u(k)""")
def restored_statements(t: Tables) -> DataFrame:
    """TX-47: yearly figures printed as ragged tables with a period header, and read back by label and period."""
    years = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("id"), F.year("l_shipdate").alias("y")).agg(*[F.expr(e).alias(f"m{i}") for i, e in enumerate(_MEASURES.values())])
    shown = lambda c: F.when(c < 0, F.concat(F.lit("("), F.format_number(-c, 0), F.lit(")"))).otherwise(F.format_number(c, 0))
    by_year = years.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("y", *[shown(F.col(f"m{i}")).alias(f"m{i}") for i in range(len(_MEASURES))]))).alias("years"))
    head = F.concat(F.array(F.lit("Item")), F.transform("years", lambda x: F.concat(x["y"].cast("string"), F.lit("A"))))
    body = [F.concat(F.array(F.lit(name)), F.col(f"years.m{i}")) for i, name in enumerate(_MEASURES)]
    rows = by_year.select("id", F.posexplode(F.array(head, *body)).alias("at", "cells")).select("id", (F.col("at") + 1).alias("row"), "cells")
    read = tables.restore_values(rows, "id", "row", "cells")
    return read.select("id", F.col("row").cast("long").alias("row"), "label", "period", numeric.clean_ocr_number(F.col("text")).alias("value"))


#: Kinds of protected text with their priorities: the first to claim a place keeps it.
KINDS = [
    ("url", 1, r"https?://[^ \t\n\r]+"), ("mail", 2, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), ("quantity", 3, r"[0-9]+(?:[.][0-9]+)? ?(?:%|ms|GB|MB|kg|cm|mm)"),
    ("date", 4, r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("phone", 5, r"[+]?[0-9][0-9() -]{6,}[0-9]"), ("number", 6, r"[0-9]+(?:[.,][0-9]+)*"), ("opening", 7, r"[A-Z][a-z]+ [a-z]+"), ("pair", 8, r"[a-z]+ [a-z]+[.]"),
]


#: The same matches, found without a try from inside each word: a match begins where the one before ends or its first run of characters begins.
_QUICK = {"mail": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "pair": r"(?:\G|(?<![a-z]))[a-z]++ [a-z]++[.]"}
QUICK_KINDS = [(kind, priority, _QUICK.get(kind, pattern)) for kind, priority, pattern in KINDS]


def _sql_claims(source: str, kinds: list[tuple[str, int, str]]) -> str:
    """(doc_id, kind, priority, s, e, found) of all matches in ``source`` (doc_id, text)."""
    one = """SELECT doc_id, '{0}' AS kind, {1} AS priority, e - length(found) AS s, e, found FROM (
        SELECT doc_id, found, CAST(sum(length(gap) + coalesce(length(found), 0)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS INT) AS e FROM (
            SELECT doc_id, k, gaps[k] AS gap, hits[k] AS found FROM (SELECT doc_id, string_split_regex(text, '{2}') AS gaps, regexp_extract_all(text, '{2}') AS hits FROM {3}), unnest(range(1, len(gaps) + 1)) AS u(k)))
        WHERE found IS NOT NULL"""
    return " UNION ALL ".join(one.format(*k, source) for k in kinds)


_KEPT = f"""
    claim AS ({_sql_claims("documents", KINDS)}),
    listed AS (SELECT doc_id, list({{'p': priority, 's': s, 'n': s - e, 'e': e, 'kind': kind, 'found': found}} ORDER BY priority, s, s - e) AS every FROM claim GROUP BY doc_id),
    kept AS (SELECT doc_id, unnest(list_reduce(every[2:], lambda a, c: CASE WHEN len(list_filter(a, lambda x: c.s < x.e AND c.e > x.s)) > 0 THEN a ELSE list_append(a, c) END, [every[1]])) AS c FROM listed)"""


@query(f"WITH {_KEPT} SELECT doc_id, c.kind AS kind, c.s AS start, c.e AS \"end\", c.found AS found FROM kept")
def claims_kept(t: Tables) -> DataFrame:
    """TX-09: claims of eight kinds on every document, overlaps resolved by priority, start and length."""
    claims = patches.find_claims(t.documents.select("doc_id", "text"), "doc_id", "text", QUICK_KINDS)
    return patches.resolve_claims(claims, "doc_id").select("doc_id", "kind", "start", "end", "found")


def patches_of(claims: DataFrame, id: str, after: Column) -> DataFrame:
    """id, patches: one array for each text that has claims."""
    patch = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("found").alias("before"), after.alias("after"))
    return claims.groupBy(id).agg(F.array_sort(F.collect_list(patch)).alias("patches"))


def _with_patches(texts: DataFrame, found: DataFrame) -> DataFrame:
    return texts.join(found, "doc_id", "left").withColumn("patches", F.coalesce("patches", F.array().cast(f"array<{patches.PATCH}>")))


@query(f"""
    WITH {_KEPT},
    piece AS (
        SELECT doc_id, c.s AS s, substring(text, coalesce(lag(c.e) OVER w, 0) + 1, c.s - coalesce(lag(c.e) OVER w, 0)) || '<' || c.kind || '>' AS x, c.e AS e
        FROM kept JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY c.s)),
    joined AS (SELECT doc_id, string_agg(x, '' ORDER BY s) AS head, max(e) AS e, count(*) AS n FROM piece GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_patches, NULL AS problem, sha256(coalesce(head, '') || substring(text, coalesce(e, 0) + 1)) AS patched_sha256
    FROM documents LEFT JOIN joined USING (doc_id)""")
def patched_texts(t: Tables) -> DataFrame:
    """TX-13: what keeps its claim is replaced by the name of its kind; patches that do not fit would be named and leave the text alone."""
    texts = t.documents.select("doc_id", "text")
    kept = patches.resolve_claims(patches.find_claims(texts, "doc_id", "text", QUICK_KINDS), "doc_id")
    ready = _with_patches(texts, patches_of(kept, "doc_id", F.concat(F.lit("<"), F.col("kind"), F.lit(">")))).withColumn("problem", patches.problem(F.col("text"), F.col("patches")))
    patched = F.when(F.col("problem").isNull(), patches.applied(F.col("text"), F.col("patches"))).otherwise(F.col("text"))
    return ready.select("doc_id", F.size("patches").cast("long").alias("n_patches"), "problem", F.sha2(patched, 256).alias("patched_sha256"))


_STAGES = [("numbers", r"[0-9]+", "#"), ("marks", r"[!?.]{2,}", "."), ("stale", r"[Tt]he ", "THE ")]


@query(f"""
    WITH one AS (SELECT doc_id, text, regexp_replace(text, '{_STAGES[0][1]}', '#', 'g') AS t1 FROM documents),
    two AS (SELECT *, regexp_replace(t1, '{_STAGES[1][1]}', '.', 'g') AS t2 FROM one),
    late AS ({_sql_claims("documents", [("stale", 1, _STAGES[2][1])])}),
    misfit AS (SELECT doc_id, bool_or(e > length(t2)) AS far, bool_or(substring(t2, s + 1, e - s) <> found) AS other FROM late JOIN two USING (doc_id) GROUP BY doc_id),
    why AS (SELECT *, CASE WHEN far THEN 'span' WHEN other THEN 'before' END AS why FROM two LEFT JOIN misfit USING (doc_id)),
    three AS (SELECT *, CASE WHEN why IS NULL THEN regexp_replace(t2, '{_STAGES[2][1]}', 'THE ', 'g') ELSE t2 END AS t3 FROM why)
    SELECT doc_id, 3 AS n_revisions, why AS stale_rolled_back, sha256(t1) AS rev1_sha256, sha256(t2) AS rev2_sha256, sha256(t3) AS rev3_sha256, true AS reverts FROM three""")
def revision_log(t: Tables) -> DataFrame:
    """TX-15 and TX-16: three stages of patches, the last found in the text before the first and so undone whole where it no longer fits; replay to each revision, and back to the start.

    Where a document's text is null every digest is null.
    """
    rows = t.documents.select("doc_id", "text").withColumn("revisions", F.array().cast(f"array<struct<rev:int,stage:string,patches:array<{patches.PATCH}>,proposed:int,rolled_back:string>>"))
    lines = lambda c: F.size(F.split(c, "\n"))
    for k, (stage, pattern, after) in enumerate(_STAGES):
        now = patches.replay(F.col("text"), F.col("revisions"), F.lit(k))
        seen = t.documents.select("doc_id", "text") if stage == "stale" else rows.select("doc_id", now.alias("text"))
        found = patches_of(patches.find_claims(seen, "doc_id", "text", [(stage, 1, pattern)]), "doc_id", F.lit(after))
        rows = _with_patches(rows.withColumn("now", now), found)
        same_lines = lines(patches.applied(F.col("now"), F.col("patches"))) == lines(F.col("now"))
        rows = rows.withColumn("revisions", patches.commit(F.col("revisions"), stage, F.col("now"), F.col("patches"), same_lines)).drop("patches", "now")
    at = lambda k: patches.replay(F.col("text"), F.col("revisions"), F.lit(k))
    rows = rows.withColumn("last", at(3))
    return rows.select(
        "doc_id", F.size("revisions").alias("n_revisions"), F.col("revisions")[2]["rolled_back"].alias("stale_rolled_back"), F.sha2(at(1), 256).alias("rev1_sha256"), F.sha2(at(2), 256).alias("rev2_sha256"),
        F.sha2("last", 256).alias("rev3_sha256"), (patches.revert(F.col("last"), F.col("revisions"), F.lit(0)) == F.col("text")).alias("reverts"),
    )


@query("""
    WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cells FROM orders WHERE o_orderstatus = 'F'),
    b AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cells FROM orders WHERE o_orderstatus <> 'F'),
    j AS (SELECT o_custkey, place, a.o_orderkey AS ka, a.cells AS ca, b.o_orderkey AS kb, b.cells AS cb, greatest(a.cells, b.cells) <= 1.2::DOUBLE * greatest(least(a.cells, b.cells), 1) AS agree FROM a FULL JOIN b USING (o_custkey, place)),
    v AS (SELECT *, kb IS NULL OR ka IS NOT NULL AND (agree OR ca >= cb) AS own FROM j)
    SELECT o_custkey, CAST(place AS BIGINT) AS place, CASE WHEN own THEN 'first' ELSE 'second' END AS engine, CASE WHEN ka IS NULL OR kb IS NULL THEN 'solo' WHEN agree THEN 'confirmed' ELSE 'larger' END AS verdict,
           CASE WHEN own THEN ka ELSE kb END AS o_orderkey, CASE WHEN own THEN ca ELSE cb END AS cells FROM v""")
def engine_votes(t: Tables) -> DataFrame:
    """JN-14: each customer's finished and other orders as the findings of two engines, paired by place."""
    sized = t.orders.withColumn("cells", F.floor(F.col("o_totalprice") / 1000))
    found = tables.zip_and_vote(sized.where("o_orderstatus = 'F'"), sized.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey", "cells")
    return found.withColumn("place", F.col("place").cast("long"))


_BARE = "regexp_replace(regexp_replace(translate(" + _STRIP.format("regexp_replace(line, '\\{.*?\\}|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|^[-+]? *[0-9]+ *- *$', ' ', 'g')") + ", '\u3000\u00a0', '  '), '([一-龥])\\s+([一-龥])', '\\1\\2', 'g'), ' {2,}', ' ', 'g')"


@query(f"""
    WITH cut AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
    bare AS (SELECT doc_id, i, {_BARE} AS x FROM cut),
    kept AS (SELECT * FROM bare WHERE length(x) >= 2 AND NOT regexp_matches({_STRIP.format("x")}, '^[-+]?[0-9\\s,.]+%?$|^([0-9]+[OBoS]+|[sS]o+|JO+|I+)$') QUALIFY row_number() OVER (PARTITION BY doc_id, left(x, 80) ORDER BY i) = 1),
    marked AS (SELECT *, length(x) < 20 AS title, length(x) < 20 OR regexp_matches({_STRIP.format("x")}, '[。！？.!?]$') AS stop FROM kept),
    opened AS (SELECT *, title OR coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY i), true) AS opens FROM marked),
    numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM opened)
    SELECT doc_id, CAST(block AS BIGINT) AS block, {_STRIP.format("string_agg(x, '' ORDER BY i)")} AS text, CAST(count(*) AS INT) AS lines FROM numbered GROUP BY doc_id, block""")
def repaired_blocks(t: Tables) -> DataFrame:
    """TX-43: lines of every document cleaned, repeats dropped and sentences put together."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return tables.repair_blocks(lines, "doc_id", "line", "text")
