from __future__ import annotations

import hashlib
import io
import struct

import pyarrow.fs
from pyspark.sql import functions as F

from pagemill.llm import warc

SCHEMA = "page_id long, url string, html string, row string, id string, payload string"


def archived(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    manifest, folder = warc.archive_pages(df)
    back = warc.read_archives(manifest, folder)
    return manifest, folder, back.collect()


def test_round_trip_types_and_odd_rows(spark):
    long = "<p>" + "abc " * 40_000
    same = "<html>" + "same " * 40 + "</html>"
    rows = [(5, "http://a/ b\r\nEvil: 1", same), (2, None, same), (9, "http://c", same), (3, "u", "small"), (4, "u", "small"), (7, "u", None), (8, "u", ""), (10, "u", long), (None, "u", same), (11, "u", "é" * 60), (12, "u", "é" * 60)]
    _, _, back = archived(spark, rows)
    got = {r.id: r for r in back}
    assert len(back) == len(rows)
    assert (got["2"].record_type, got["2"].refers_to) == ("response", None)
    assert {(got[k].record_type, got[k].refers_to) for k in ("5", "9", "")} == {("revisit", "2")}
    assert {got[k].record_type for k in ("3", "4", "7", "8")} == {"response"}
    assert (got["12"].record_type, got["12"].refers_to, got["12"].payload_bytes) == ("revisit", "11", 120)
    for page, _, html in rows:
        r, data = got["" if page is None else str(page)], (html or "").encode()
        assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_bytes == len(data)
        assert r.payload == (data if r.record_type == "response" else None)
    assert got["5"].target_uri == "http://a/%20b%0D%0AEvil:%201"


def test_repeated_rows_and_empty_table(spark):
    html = "z" * 200
    _, _, back = archived(spark, [(1, "u", html), (1, "u", html), (2, "u", html)])
    assert sorted((r.id, r.record_type) for r in back) == [("1", "response"), ("1", "response"), ("2", "revisit")]
    manifest, _, back = archived(spark, [])
    assert back == [] and manifest.count() == 0


def test_dictionary_leads_and_records_stand_alone(spark):
    pages = [(i, f"http://x/{i}", f"<html><body>{i} " + f"some prose {i * 7} that repeats in every page " * 40) for i in range(3000)]
    manifest, folder, back = archived(spark, pages)
    assert len(back) == 3000
    row = manifest.orderBy(F.desc("records")).first()
    assert row.dictionary_bytes > 0
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{row.archive}") as f:
        data = f.read()
    magic, size = struct.unpack("<II", data[:8])
    assert (magic, size) == (warc.DICTIONARY_FRAME, row.dictionary_bytes)
    import zstandard

    frame = data[8 + size :]
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(frame)
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC/1.1\r\n") == 1
    assert sum(1 for _ in warc.parse_archive(io.BytesIO(data))) == row.records


def test_names_of_stores():
    from pagemill.llm.common import arrow_uri

    names = {"s3a://b/k": "s3://b/k", "s3n://b/k": "s3://b/k", "wasbs://c@a.blob.core.windows.net/k": "abfss://c@a.dfs.core.windows.net/k", "file:///tmp/x": "file:///tmp/x", "/tmp/x": "/tmp/x", "file:/tmp/x": "file:/tmp/x"}
    assert {n: arrow_uri(n) for n in names} == names
