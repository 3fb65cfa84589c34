"""Language by compression: the language whose dictionary compresses a text best.

Whole texts are lower-cased, and what parts their words (digits, symbols, white space) becomes one space. For each learned language a bounded sample becomes a raw-content zstandard dictionary. A text is cut into
blocks, so that a long text cannot outgrow the dictionaries, and every block is compressed once per language; the
language with the fewest bytes in all wins. Narrow margins are rejected: ``rejected`` is true there, while
``lang_pred`` still names the best language.

Whole texts of all rows are classified. A null text, or one without a letter, is ``und`` with score 0; so is every
text if no language was learned. Ties go to the language with more learned texts. Columns other than doc_id, text and
(for learning) lang are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import held_out
from tessera.llm.scratch import bounded_batches

#: Bytes of a dictionary, texts sampled for it (about), bytes of a block.
DICT_BYTES, SAMPLE_TEXTS, BLOCK = 112_000, 200, 4096
#: More learned languages than this are an error, as their dictionaries would outgrow a broadcast.
MOST_LANGS = 1000
LEVEL = 9
#: Below this share of bytes saved against the second best language a prediction counts as rejected.
NARROW = 0.01


#: ASCII letters and all bytes of other characters stay.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The words of a text, lower-cased, parted by one space."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def train_languages(docs: DataFrame) -> dict[str, bytes]:
    """lang -> dictionary, from documents with a lang that are not held out. Texts are sampled by a hash of the text."""
    learnable = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and length(text) > 0").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_TEXTS / n))])
    place = (F.xxhash64("text", F.lit(5)) / float(2**64)) + 0.5
    most = DICT_BYTES // 20  # of one training text, from its middle, so that no text fills a dictionary alone
    picked = (
        learnable.where(F.col("lang").isin(*counts)).where(place <= share[F.col("lang")])
        .select("lang", place.alias("place"), F.expr(f"substring(text, greatest(1, int(length(text) / 2) - {most // 2}), {most})").alias("part"))
        .dropDuplicates(["lang", "place"])
        .orderBy("place", "lang").limit(4 * SAMPLE_TEXTS * len(counts)).collect()
    )
    out: dict[str, bytearray] = {}
    for r in picked:
        part = plain(r["part"])
        if len(out.setdefault(r["lang"], bytearray())) + len(part) <= DICT_BYTES:
            out[r["lang"]] += part + b" "
    return {k: bytes(out[k]) for k in counts if len(out.get(k, b"")) >= 8}  # most learned texts first


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    out = []
    for _, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(text: bytes, compressors: list) -> list[int]:
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for each row; score is second / (best + second) bytes, stretched to 0..1."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if dictionaries else F.lit(False)

    def predict(batches):
        names = [k for k, _ in shared.value]
        compressors = _compressors(shared.value)
        for batch in batches:
            lang, margin = [], []
            for text in batch.column(2):
                if text.is_valid:
                    got = sizes(plain(text.as_py()), compressors)
                    best = int(np.argmin(got))
                    second = min((s for i, s in enumerate(got) if i != best), default=2 * got[best])
                    lang.append(names[best])
                    margin.append((second - got[best]) / second)
                else:
                    lang.append("und")
                    margin.append(0.0)
            m = np.array(margin, dtype=float)
            score = np.where(np.array(lang) == "und", 0.0, 1 - 0.5 * np.exp(-m / (2 * NARROW))) if lang else m
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(m, pa.float64()), pa.array(m < NARROW)], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(has_letter, F.col("text")).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")
