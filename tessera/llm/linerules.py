"""Line-first cleaning of texts in Spark SQL functions alone: rules judge each line, lines that fail go, and texts that lose too much go.

A line is what ``\\n`` separates; only lines with a word (``[^\\x20\\x09-\\x0D]+``) are judged. Rules, the first that fails counts:

1. *punctuation*: the line holds no end of a sentence (a mark of ``.!?…。！？`` before white space, a closing quote or bracket, or the
   line's end), or it has three symbols of ``#*$%&|<>!?{}[]\\^~=_`` or more and more than five to four words.
2. *navigation*: two separators of ``|»›•·`` or more with four words or fewer an item, or at most 12 words, all of them words of menus.
3. *boilerplate*: at most 40 words with a phrase of cookie notices, rights, licences, terms, scripts or subscriptions.

Base counts are those of whole texts before anything is removed. A text fails the base rules with under 50 words, or if more than half of its
words lie in windows of three words found twice or more. A text is kept if it passes these and no more than ``most_lost`` percent of the
characters of its words stood in failed lines. Null texts count as empty (no word, not kept). Rows that repeat are judged
row by row, ids pass through, null or not, and an empty table gives an empty one. Every step is within a row: there is no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&|<>!?{}[]\\^~=_"
SEPARATORS = "|»›•·"
SPLIT = r"[\x20\x09-\x0D]+"
SENTENCE_END = r"""[.!?…]["'”’»)\]]*([\x20\x09-\x0D]|\z)|[。！？]"""
MENU = (
    "home about us contact menu search login logout log sign in out up register account my cart shop blog news faq help sitemap next previous prev back top "
    "share tweet print email rss page pages archive archives categories category tags skip to content main navigation | / > » › • · - & "
    "startseite kontakt impressum suche anmelden weiter zurück accueil contactez recherche connexion suivant précédent inicio contacto buscar siguiente anterior"
).split()
PHRASES = (
    "all rights reserved|copyright ©|© copyright|privacy policy|cookie policy|use cookies|uses cookies|accept cookies|terms of use|terms of service|terms and conditions|"
    "licensed under|enable javascript|javascript is disabled|powered by|subscribe to our|sign up for our|newsletter|click here to|read more at|follow us on|unsubscribe|lorem ipsum|"
    "alle rechte vorbehalten|datenschutzerklärung|verwendet cookies|tous droits réservés|politique de confidentialité|utilise des cookies|todos los derechos reservados|política de privacidad|utiliza cookies"
)
#: A phrase counts from the start of a word on.
PHRASE = rf"(\A|[^a-z])({PHRASES})"
MOST_LOST = 50


def _any(text: Column, chars: str) -> Column:
    return text.rlike(f"[{re.escape(chars)}]")


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def _chars(words: Column) -> Column:
    """How many characters stand in an array of words."""
    return F.length(F.array_join(words, ""))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: a step that functions of its elements are not merged with."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def line_rule(x: Column) -> Column:
    """0 for a line (struct of ``line`` and ``words``) that passes, else the number of the first rule that it fails.

    Symbols and separators are counted only in lines that hold some.
    """
    line, n = x["line"], F.size(x["words"])
    symbols, separators = _count(line, LINE_SYMBOLS), _count(line, SEPARATORS)
    ends, phrase = line.rlike(SENTENCE_END), (n <= 40) & F.lower(line).rlike(PHRASE)
    menu = (n <= 12) & (F.size(F.array_except(_words(F.lower(line)), F.array(*map(F.lit, MENU)))) == 0)
    marked = F.when((symbols >= 3) & (symbols * 4 > n * 5) | ~ends & (separators < 2) & ~menu, 1).when((separators >= 2) & (n <= 4 * (separators + 1)) | menu, 2)
    plain = F.when(~ends & ~menu, 1).when(menu, 2)
    return F.when(_any(line, LINE_SYMBOLS + SEPARATORS), marked.when(phrase, 3).otherwise(0)).otherwise(plain.when(phrase, 3).otherwise(0))


def repeated_words(df: DataFrame, words: str) -> DataFrame:
    """``df`` with n_repeat_words: words of the array column ``words`` that lie in windows of three words found twice or more in it.

    32 bits of a window's hash and its place are sorted as one number; only windows that share these bits with another one
    are then sorted as words, so equal means equal words.
    """
    window = f"{words}[i - 1], {words}[i], {words}[i + 1]"
    hashed = F.sort_array(F.expr(f"transform(sequence(1, size({words}) - 2), i -> shiftleft(xxhash64({window}), 32) | bigint(i))"))
    out = _held(df, "hashed_", F.when(F.size(words) >= 4, hashed))
    alike = "i > 0 and shiftright(hashed_[i - 1], 32) = shiftright(x, 32) or i + 1 < size(hashed_) and shiftright(hashed_[i + 1], 32) = shiftright(x, 32)"
    placed = F.expr(f"transform(filter(hashed_, (x, i) -> {alike}), x -> int(x & 2147483647))")
    # windows with their places in ten digits, in order, so that equal ones stand together
    placed = F.sort_array(F.transform(placed, lambda i: F.concat_ws(" ", *(F.col(words)[i + k] for k in (-1, 0, 1)), F.lpad(i.cast("string"), 10, "0"))))
    out = _held(out, "placed_", placed).drop("hashed_")
    out = _held(out, "keys_", F.expr("transform(placed_, x -> substr(x, 1, length(x) - 11))"))
    twice = F.expr("filter(transform(placed_, (x, i) -> if(i > 0 and keys_[i - 1] = keys_[i] or i + 1 < size(keys_) and keys_[i + 1] = keys_[i], int(right(x, 10)), 0)), i -> i > 0)")
    covered = F.expr("aggregate(places_, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)")
    return out.withColumn("places_", F.sort_array(twice)).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("placed_", "keys_", "places_")


def clean_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", most_lost: int = MOST_LOST) -> DataFrame:
    """Per row of ``docs``: id, n_words, the base counts, base_failed, kept, failed lines by rule, lost_chars, clean_text (the lines with a word that pass, as they were).

    Columns other than the id and the text are not read.
    """
    rows = docs.select(F.col(id).alias("id_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    rows = _held(rows, "words_", _words(F.col("text_")))
    rows = repeated_words(rows, "words_").withColumn("n_words", F.size("words_").cast("long")).withColumn("word_chars", _chars(F.col("words_")).cast("long")).drop("words_")
    lines = F.transform(F.filter(F.split("text_", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda line: F.struct(line.alias("line"), _words(line).alias("words")))
    rows = _held(_held(rows, "lines_", lines), "rules_", F.transform("lines_", line_rule))
    rows = rows.withColumn("lines_", F.zip_with("lines_", "rules_", lambda x, k: F.struct(x["line"].alias("line"), x["words"].alias("words"), k.alias("rule"))))
    failing = lambda k: F.size(F.filter("rules_", lambda x: x == k)).cast("long")
    gone = F.flatten(F.transform(F.filter("lines_", lambda x: x["rule"] > 0), lambda x: x["words"]))
    rows = rows.select(
        "id_", "n_words", "n_repeat_words", "word_chars", F.when(_any(F.col("text_"), SYMBOLS), _count(F.col("text_"), SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct(F.transform("lines_", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        failing(1).alias("n_punctuation_lines"), failing(2).alias("n_navigation_lines"), failing(3).alias("n_boilerplate_lines"), _chars(gone).cast("long").alias("lost_chars"),
        F.array_join(F.transform(F.filter("lines_", lambda x: x["rule"] == 0), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))
    order = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_punctuation_lines", "n_navigation_lines", "n_boilerplate_lines", "lost_chars", "clean_text"]
    return rows.select(F.col("id_").alias(id), *order)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same in DuckDB SQL, without the cleaned text.
ORACLE_SQL = f"""
    WITH doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    worded AS (SELECT row, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM doc),
    win AS (SELECT row, i, array_to_string(list_slice(w, i, i + 2), ' ') AS x FROM worded, unnest(range(1, greatest(len(w) - 1, 1))) AS t(i) WHERE len(w) >= 3),
    again AS (SELECT row, i FROM win JOIN (SELECT row, x FROM win GROUP BY row, x HAVING count(*) > 1) USING (row, x)),
    repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM again, range(3) AS t(k) GROUP BY row),
    cut AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM doc),
    lined AS (
        SELECT row, line, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS lw, lower(line) AS low,
               length(line) - length(translate(line, {_sql(LINE_SYMBOLS)}, '')) AS symbols, length(line) - length(translate(line, {_sql(SEPARATORS)}, '')) AS seps
        FROM cut WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    menued AS (SELECT *, len(lw) <= 12 AND len(list_filter(lw, lambda x: NOT list_contains([{", ".join(map(_sql, MENU))}], x))) = 0 AS menu FROM lined),
    judged AS (
        SELECT row, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
               CASE WHEN NOT regexp_matches(line, {_sql(SENTENCE_END)}) AND seps < 2 AND NOT menu OR symbols >= 3 AND symbols * 4 > len(lw) * 5 THEN 1
                    WHEN seps >= 2 AND len(lw) <= 4 * (seps + 1) OR menu THEN 2
                    WHEN len(lw) <= 40 AND regexp_matches(low, {_sql(PHRASE)}) THEN 3 ELSE 0 END AS rule
        FROM menued),
    summed AS (
        SELECT row, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (rule = 1) AS n1, count(*) FILTER (rule = 2) AS n2, count(*) FILTER (rule = 3) AS n3,
               CAST(sum(chars) FILTER (rule > 0) AS BIGINT) AS lost FROM judged GROUP BY row),
    counted AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
               coalesce(n1, 0) AS n_punctuation_lines, coalesce(n2, 0) AS n_navigation_lines, coalesce(n3, 0) AS n_boilerplate_lines, coalesce(lost, 0) AS lost_chars
        FROM doc JOIN worded USING (row) LEFT JOIN repeated USING (row) LEFT JOIN summed USING (row)),
    based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept,
           n_punctuation_lines, n_navigation_lines, n_boilerplate_lines, lost_chars
    FROM based"""
