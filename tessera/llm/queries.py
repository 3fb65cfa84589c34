"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import codebooks, decontam, embeddings, html, langid, linerules, minhash, packing, passages, quality, suffix_dedup, tandem, toxicity, warc
from tessera.llm.scratch import Scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from all documents, and passages of over 50 words that documents share, which are counted only; nulls are empty texts, rows that repeat are each other's copies; see ``suffix_dedup``, ``passages``."""
    docs, scratch = _read(spark, sf_dir, "documents"), Scratch(spark, "suffix")
    return suffix_dedup.removal_report(docs, scratch, beside=passages.passage_counts(docs, scratch))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of all documents; texts without words stand alone, ties go to the smallest id; see ``minhash``."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents from labels that are not held out; empty texts are scored too; see ``toxicity``."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, _read(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; nulls are a closing id alone; see ``packing``."""
    import public_tokenizers

    return packing.piece_digests(packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; ``und`` without a letter; see ``langid`` for ties."""
    docs = _read(spark, sf_dir, "documents")
    return langid.predict_language(docs, langid.train_languages(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents; nulls have no words; see ``decontam``."""
    return decontam.match_benchmark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; nulls are empty payloads; see ``warc``."""
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("url")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages; nulls give empty texts, ties of paths go to the smallest hash; see ``html``."""
    return html.extract_text(_read(spark, sf_dir, "pages"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; null, zero and non-finite ones link with nothing; see ``embeddings``."""
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grades of all documents; see ``quality`` for nulls and repeated labels."""
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, _read(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, every tenth of them made periodic first; see ``tandem`` for nulls, ties and repeats."""
    return tandem.run_digests(tandem.find_runs(tandem.with_cycles(_read(spark, sf_dir, "documents"))))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of line-first cleaning over all documents; see ``linerules`` for nulls, ties and repeats."""
    return linerules.clean_lines(_read(spark, sf_dir, "documents")).drop("clean_text")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors; see ``codebooks`` for nulls, ties and repeats."""
    coded, books = codebooks.compress(_read(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks.codebooks_digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_minhash, op3_toxicity, op4_packing, op5_language_id, op6_decontamination, op7_warc, op8_html_extraction, op9_embeddings, op10_quality, op11_periodic_runs, op12_quality_rules, op13_vector_codes)}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op12_quality_rules": linerules.ORACLE_SQL,
    "op13_vector_codes": codebooks.oracle_sql(),
    "op7_warc": """
        WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        digest AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d FROM page),
        best AS (SELECT d, n, max(page_id) AS of FROM digest WHERE n >= 1000 GROUP BY d, n)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN of IS NULL OR page_id = of THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> of THEN of END AS refers_to
        FROM digest LEFT JOIN best USING (d, n)""",
    "op6_decontamination": f"""
        WITH item AS (
            SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
        item_window AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS x
            FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
        doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
        doc_window AS (
            SELECT row, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
            FROM doc, (SELECT DISTINCT n FROM item_window) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
        hit AS (SELECT d.row, d.i, d.n, item_id FROM doc_window AS d JOIN item_window AS m ON d.n = m.n AND d.x = m.x),
        hit_word AS (SELECT row, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(j) GROUP BY row),
        hit_item AS (
            SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit_word USING (row) LEFT JOIN hit_item USING (row)""",
}
