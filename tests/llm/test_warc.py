from __future__ import annotations

import io
import random
import time

import pytest
import zstandard

from tickloom.llm import warc
from tickloom.sources.workdir import new_dir


def pages():
    random.seed(6)
    rows = [(i, f"http://h{i % 7}.org/é {i}\n", f"<p>{random.random()} wörd " * random.randint(1, 60)) for i in range(200)]
    rows += [(300 + i, "u://x", "<p>copy</p>") for i in range(40)]
    rows += [(400, None, None), (401, "", ""), (402, "u", ""), (None, "u", "<p>copy</p>"), (None, "u", "alone")]
    return [*rows, (5, rows[5][1], rows[5][2]), (339, "u://x", "<p>copy</p>")]


def test_round_trip(spark):
    rows = pages()
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    folder = new_dir(spark, "warc-test")
    listed = warc.write_archives(df.repartition(3), folder, most=4000)
    assert listed.agg({"records": "sum"}).first()[0] == len(rows)
    assert listed.count() > 3
    found = warc.read_archives(listed, folder).collect()
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        original = largest.get(html or "")
        other = original if original != i else None
        expected.append((i, len(data), warc.base32_sha1(data), "response" if other is None else "revisit", other))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    texts = {(r.page_id, r.html) for r in found if r.record_type == "response"}
    assert texts == {(i, h or "") for (i, _, h), e in zip(rows, expected, strict=True) if e[3] == "response"}
    assert {r.url for r in found if r.page_id == 3} == {"http://h3.org/%C3%A9%203%0A"}


def test_records_stand_alone(spark):
    folder = new_dir(spark, "warc-one")
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    [archive] = warc.write_archives(df, folder).collect()
    data = open(archive.path, "rb").read()
    size = int.from_bytes(data[4:8], "little")
    trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    frames, rest = [], data[8 + size :]
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        frames.append(one.decompress(rest))
        rest = one.unused_data
    assert len(frames) == archive.records
    assert all(f.startswith(b"WARC/1.1\r\n") for f in frames)
    assert frames == list(warc.read_archive(data))


def test_empty_table(spark):
    folder = new_dir(spark, "warc-none")
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df, folder), folder).collect() == []


def test_few_records_have_a_dictionary_too():
    for samples in ([], [b""], [b"one"], [b"same"] * 50, [bytes([k]) * k for k in range(40)]):
        made = warc.dictionary(samples)
        data = zstandard.ZstdCompressor(dict_data=made).compress(b"text")
        assert zstandard.ZstdDecompressor(dict_data=made).decompress(data) == b"text"


def archive_of(records):
    made = warc.dictionary(records[:2000])
    content = made.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True)
    head = warc.SKIPPABLE.to_bytes(4, "little") + len(content).to_bytes(4, "little")
    return head + content + b"".join(map(compressor.compress, records))


def test_many_small_records_are_read_in_linear_time():
    records = [b"WARC/1.1\r\nnumber: %d\r\n\r\n" % n + random.Random(n).randbytes(n % 300) for n in range(50_000)]
    data = archive_of(records)
    begin = time.perf_counter()
    assert list(warc.read_archive(data)) == records
    assert time.perf_counter() - begin < 15


def test_reading_in_dribs_and_drabs(monkeypatch):
    records = [b"x", b"", b"a long one " * 50_000, random.Random(1).randbytes(300_000), b"end"]
    data = archive_of(records)
    for stretch, first in ((1, 1), (7, 4096), (1 << 20, 3), (5000, 64)):
        monkeypatch.setattr(warc, "STRETCH", stretch)
        monkeypatch.setattr(warc, "FIRST_PIECE", first)
        assert list(warc.read_archive(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_archive(data + b"rubbish"))
