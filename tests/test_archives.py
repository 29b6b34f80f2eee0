"""The e-book data source: reading orders, every kind of damage, images, writing."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest

from pagemill.sources.archives import COLUMNS, EpubReader, EpubSource, archive_rows, epub_documents, image_size, resolve, write_epubs
from pagemill.sources.epub import read_epubs

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
CREATORS = '<dc:creator opf:role="edt">Ed</dc:creator><dc:creator id="x">Ann B</dc:creator><meta refines="#x" property="role">aut</meta><dc:creator opf:role="aut">ANN B</dc:creator>'


def book(spine=True, nav=True, manifest=True, creators="<dc:creator>Ann</dc:creator>", more=(), method=zipfile.ZIP_STORED, **texts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        refs = '<itemref idref="b"/><itemref idref="a"/><itemref idref="none"/>' if spine else ""
        items = '<item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b%20c.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>' if manifest else ""
        z.writestr("OEBPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> The  Book </dc:title>{creators}<dc:language>en</dc:language><dc:date>1999-05</dc:date></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        entries = '<li><a href="t/a.xhtml">First</a></li><li><a href="t/a.xhtml#S">Second</a><ol><li><a href="t/a.xhtml#u">the  book</a></li><li><a href="t/a.xhtml#gone">Nowhere</a></li></ol></li>' if nav else ""
        z.writestr("OEBPS/nav.xhtml", texts.get("nav_text") or f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>')
        z.writestr("OEBPS/t/a.xhtml", texts.get("a_text") or "<html><body><h1>Head A</h1><p>text a</p><div id='s'><p>text s</p></div><p id='u'>text u</p></body></html>")
        z.writestr("OEBPS/t/b c.xhtml", "<html><body><p>text b</p></body></html>")
        for name, data in more:
            z.writestr(name, data)
    return out.getvalue()


def rows_of(data, name="x.epub"):
    return [dict(zip(COLUMNS, r)) for r in archive_rows(name, lambda: io.BytesIO(data))]


def local_header(data, name):
    """Where an entry's local header begins, and where its data does."""
    info = zipfile.ZipFile(io.BytesIO(data)).getinfo(name)
    at = info.header_offset
    return at, at + 30 + sum(struct.unpack("<HH", data[at + 26 : at + 30]))


def central_header(data, name):
    return data.rindex(b"PK\x01\x02", 0, data.rindex(name.encode()))


def flagged(data, name, offset, value):
    """The archive with two bytes of both headers of an entry replaced: flags (0) or method (2)."""
    out = bytearray(data)
    at, _ = local_header(data, name)
    struct.pack_into("<H", out, at + 6 + offset, value)
    struct.pack_into("<H", out, central_header(data, name) + 8 + offset, value)
    return bytes(out)


def test_reading_orders():
    order = lambda **x: [r["href"] for r in rows_of(book(**x)) if r["role"] == "chapter"]
    assert order() == ["OEBPS/t/b c.xhtml", "OEBPS/t/a.xhtml"] and order(spine=False) == ["OEBPS/t/a.xhtml"]
    assert order(spine=False, nav=False) == ["OEBPS/t/a.xhtml", "OEBPS/t/b c.xhtml"]
    assert order(spine=False, nav=False, manifest=False) == ["OEBPS/nav.xhtml", "OEBPS/t/a.xhtml", "OEBPS/t/b c.xhtml"]
    first = rows_of(book(creators=CREATORS))[0]
    assert (first["title"], first["authors"], first["language"], first["published"]) == ("The Book", ["Ann B"], "en", "1999-05")


def test_entities_cost_nothing():
    """Markup that is no XML: entities without a declaration, missing end tags."""
    data = book(nav_text='<nav epub:type="toc"><ol><li><a href="t/a.xhtml">A&nbsp;B &copy; <i>c</a></li></ol></nav>', a_text='<html><head><link rel="stylesheet" href="../s.css"/><link type="text/css" href="gone.css"/></head><body><p>x&nbsp;y<br>z</body>', more=[("OEBPS/s.css", "p { text-align: center }")])
    rows = rows_of(data)
    assert [r["role"] for r in rows] == ["contents", "chapter", "chapter"] and {r["status"] for r in rows} == {"READY"}
    assert rows[2]["markup"].startswith("<style>p { text-align: center }</style>") and rows_of(book(spine=False, nav_text="<a href='t/b%20c.xhtml'>&nbsp;"))[1]["href"] == "OEBPS/t/b c.xhtml"


@pytest.mark.parametrize("make,reason", [
    (lambda d: b"", "no archive"), (lambda d: b"no zip", "no archive"), (lambda d: d[: len(d) // 2], "no archive"),
    (lambda d: flagged(d, "META-INF/container.xml", 0, 1), "encrypted"), (lambda d: flagged(d, "META-INF/container.xml", 2, 99), "unknown compression"),
    (lambda d: d.replace(b"META-INF/container.xml", b"META-INF/container.xmX"), "no container"),
])
def test_files_that_give_nothing(make, reason):
    assert [(r["status"], r["reason"], r["role"], r["markup"]) for r in rows_of(make(book()))] == [("FAILED", reason, None, None)]


def test_damaged_entries_cost_only_themselves():
    data = book(method=zipfile.ZIP_DEFLATED, a_text="<p>" + "many different words " * 50 + "</p>")
    _, at = local_header(data, "OEBPS/t/a.xhtml")
    corrupt = bytearray(data)
    corrupt[at : at + 8] = b"\xff" * 8
    for damaged, why in ((bytes(corrupt), "corrupt"), (flagged(data, "OEBPS/t/a.xhtml", 0, 1), "encrypted"), (flagged(data, "OEBPS/t/a.xhtml", 2, 99), "unknown compression")):
        rows = rows_of(damaged)
        assert [(r["role"], r["status"], r["href"]) for r in rows] == [("contents", "READY", "OEBPS/nav.xhtml"), ("chapter", "READY", "OEBPS/t/b c.xhtml"), ("lost", "READY", "OEBPS/t/a.xhtml")]
        assert rows[-1]["reason"] == why
    wrong = bytearray(book())
    _, at = local_header(bytes(wrong), "OEBPS/t/b c.xhtml")
    wrong[at + 20] ^= 1  # the checksum doesn't fit
    assert [r["href"] for r in rows_of(bytes(wrong)) if r["role"] == "lost"] == ["OEBPS/t/b c.xhtml"]


def test_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "GOOD.EPUB").write_bytes(book())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "My_file-1.Pdf").write_bytes(b"%PDF")
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = read_epubs(spark, str(tmp_path)).collect()
    ready = sorted((r.chapter_index, r.label, r.chapter_id, r.n, r.text) for r in rows if r.status == "READY")
    assert ready == [
        (0, "Chapter 1", "chapter-1-b-c", 1, "text b"), (1, "First", "chapter-2-a", 1, "Head A"), (1, "First", "chapter-2-a", 2, "text a"),
        (2, "Second", "chapter-3-a--s", 1, "text s"), (3, "Chapter 4", "chapter-4-a--u", 1, "text u"),
    ]
    assert sorted((r.status, r.title, r.text) for r in rows if r.status != "READY") == [("FAILED", None, None), ("UNSUPPORTED", "My file 1", None)]
    (tmp_path / "none").mkdir()
    assert epub_documents(spark, str(tmp_path / "none")).collect() == []


def test_partitions_and_openings(spark, tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"{i}.epub").write_bytes(book(more=[("big", "x" * 3000 * i)]))
    dealt = EpubReader({"path": str(tmp_path), "maxpartitionbytes": str((1 << 20) * 2 + 60_000)}).partitions()
    assert sorted(p for part in dealt for p in part.paths) == [str(tmp_path / f"{i}.epub") for i in range(6)] and len(dealt) == 3
    opened = []
    for part in EpubReader({"path": str(tmp_path)}).partitions():
        for path in part.paths:
            list(archive_rows(path, lambda path=path: opened.append(path) or open(path, "rb")))
    assert sorted(opened) == sorted(set(opened)) and len(opened) == 6
    spark.dataSource.register(EpubSource)
    assert spark.read.format("epub").load(str(tmp_path)).where("role = 'chapter'").count() == 12


def test_wide_pictures_stand_alone(spark, tmp_path):
    """The header of a picture decides, not its width attribute."""
    small = PNG[:16] + (20).to_bytes(4, "big") + PNG[20:]
    text = '<p>before <img src="w.png" width="9"/> between <img src="i/s.png" width="900"/> after</p>'
    (tmp_path / "x.epub").write_bytes(book(a_text=text, more=[("OEBPS/t/w.png", PNG), ("OEBPS/t/i/s.png", small)]))
    rows = sorted((r.n, r.kind, r.text) for r in read_epubs(spark, str(tmp_path)).collect() if r.chapter_index == 1)
    assert [(k, t) for _, k, t in rows] == [("paragraph", "before"), ("image", ""), ("paragraph", "between after")]


def test_writing(spark, tmp_path):
    schema = "book string, title string, language string, position int, label string, text string"
    long = "a & b <c> " * 40_000
    rows = [("A/1 ü", "T & <t>", "uk", 2, "Two", "x\n\n y  z "), ("A/1 ü", "T & <t>", "uk", 1, "<One>", long), (None, None, None, 1, None, "none"), ("b" * 300, "B", "en", 1, "L", "last")]
    write_epubs(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.epub"))) == 3 and not list((tmp_path / "out").glob("_pending*"))
    got = sorted((r.title or "", r.chapter_index, r.label, r.n, r.text) for r in read_epubs(spark, str(tmp_path / "out")).collect())
    assert got == [("", 0, "c1.xhtml", 1, "none"), ("B", 0, "L", 1, "last"), ("T & <t>", 0, "<One>", 1, long.strip()), ("T & <t>", 1, "Two", 1, "x"), ("T & <t>", 1, "Two", 2, "y z")]
    with pytest.raises(Exception, match="must be in one partition"):
        spark.createDataFrame(rows[:2], schema).repartition(2, "position").write.format("epub").mode("append").save(str(tmp_path / "twice"))
    assert not list((tmp_path / "twice").glob("*"))


def test_paths_and_images():
    assert resolve("OEBPS/nav/toc.xhtml", "../t/a%20b.html#x") == "OEBPS/t/a b.html"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x50\x00\xa0\x03"
    assert image_size(PNG) == (300, 200) and image_size(b"GIF89a\x05\x00\x07\x00") == (5, 7) and image_size(jpeg) == (160, 80) and image_size(b"x") is None
