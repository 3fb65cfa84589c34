import zlib

import numpy as np
import pytest

from tessera.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check(rows, pieces):
    """Every id in exactly one piece, sequences gapless and of full length or a power of two."""
    want = dict(zip([r[0] for r in rows], direct([r[1] for r in rows])))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and p["doc_tokens"] == len(want[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], ids))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert {d: [i for _, ids in sorted(x) for i in ids] for d, x in by_doc.items()} == want
    for x in by_sequence.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0
    return by_sequence


def test_words_alone_give_the_ids_of_the_text():
    texts = ["Hello  world's\tIT'S 12,5 naïve x\n\nÉcole é \x01 a\x01b", "", " ", "<|endoftext|> a<|startoftext|>b", "ＡＢＣ 中文 🙂🙂", "\x1c\x1d x y", "a" * 3000, "İ ǅ ﬁ ẞ"]
    words = packing.WordIds(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)]
    assert got == [x[:-1] for x in direct(texts)]


def test_round_trip_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, "same text"), (9004, "same text")]
    docs = spark.createDataFrame(rows, SCHEMA)
    sequences = check(rows, packing.pack_documents(docs, PATH).collect())
    assert sum(sum(n for _, n in x) == 2048 for x in sequences.values()) > 0.4 * len(sequences)


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], SCHEMA)
    pieces = packing.pack_documents(docs, PATH)
    for p, q in zip(sorted(pieces.collect(), key=str), sorted(pieces.collect(), key=str)):
        assert p == q
    got = {(r["doc_id"], r["ids_crc32"]) for r in packing.piece_digests(pieces).where("length = doc_tokens").collect()}
    assert got <= {(d, zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in zip([1, None], direct(["a b c", "d"]))}
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    key = packing.hilbert(points, 3)
    along = points[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()
