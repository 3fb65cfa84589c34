import hashlib
import struct

import pytest
import zstandard

from tessera.llm import warc
from tessera.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, digest string"


def made():
    long = "<p>" + "é" * 700
    rows = [(i, f"http://h{i % 3}.example/ä b?{i}", f"<html>{i}" + "y" * i, "x") for i in range(40)]
    rows += [(50 + i, "http://copy.example/", long, None) for i in range(7)]
    rows += [(70, None, None, None), (71, "", "", None), (72, "http://s", "short", None), (73, "http://t", "short", None), (None, "u", "no id", None), (80, "http://big", "z\r\n\r\n" * 300_000, None)]
    return rows


def brute(rows):
    top = {}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            top[raw] = max(top.get(raw, i), i)
    out = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        of = top.get(raw)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), *(("revisit", of) if of is not None and of != i else ("response", None))))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = made()
    got = [tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).drop("url").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_payloads_come_back(spark):
    rows = made()
    pages = spark.createDataFrame(rows, SCHEMA)
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    warc.write_archives(pages, folder, scratch).collect()
    got = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, folder, payloads=True).collect() if r["record_type"] == "response"}
    html = {i: (h or "").encode() for i, _, h, _ in rows}
    assert len(got) == len(rows) - 6 and all(bytes(got[i]) == html[i] for i in got)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(records):
    content = warc.dictionary(records)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
    return struct.pack("<II", warc.MAGIC, len(content)) + content + b"".join(packer.compress(r) for r in records)


def test_broken_archives_are_told():
    digest = hashlib.sha1(b"abc").hexdigest()
    good = warc.record(1, "http://a", b"abc", digest, "response", None)
    assert warc.records_of(archive([good]))[0][:4] == (1, "http://a", 3, digest)
    for bad in (good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"abc\r\n", b"abd\r\n"), good + b"x", good.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(ValueError):
            warc.records_of(archive([bad]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.records_of(archive([good])[:-3])
    with pytest.raises(ValueError):
        warc.records_of(zstandard.compress(good))
