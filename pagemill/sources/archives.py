"""E-book archives as a Spark data source: `spark.read.format("epub")` and `df.write.format("epub")`.

    spark.dataSource.register(EpubSource)
    documents = spark.read.format("epub").load(folder)

Reading: the folder's files are dealt to partitions by bytes; a task opens each
archive once and takes single entries out of it. One row for each document in
reading order, one for the navigation (role contents), and one for each entry
that can't be read (role lost); a file that gives no document has one row with its status and
the reason. Nothing a file holds makes the job fail.

Writing: rows (book, title, language, position, label, text), sorted by book and position in
their partitions, to one archive a book. Tasks write under a name of
their own; the files get their place when all tasks have ended.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .trees import _Tree, tidy, tree_of

SCHEMA = "book string, status string, reason string, title string, authors array<string>, language string, published string, role string, position int, href string, markup string, images map<string,int>"
TYPES = [*[pa.string()] * 4, pa.list_(pa.string()), *[pa.string()] * 3, pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.int32())]
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Endings of documents that can be read, and media types of such.
READABLE = (".xhtml", ".html", ".htm", ".xml")
READABLE_TYPES = ("application/xhtml+xml", "application/xml", "text/html")
#: Endings of the files that are looked at.
BOOKS = (".epub", ".pdf")
#: Bytes of a partition, and what opening a file counts as.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
#: Bytes of an image that hold its size.
IMAGE_HEAD = 256 << 10
BATCH_BYTES = 8 << 20
#: What the name of an element that names a style sheet or an image holds; other text may match too.
REFERS = re.compile(r"<[^<\t\n\r\f />]*(?:link|img|image)", re.IGNORECASE)
#: What a damaged entry can raise: checksums and headers, deflate, encryption, odd methods, ends too early.
DAMAGE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, struct.error, KeyError, ValueError)


def resolve(base_file: str, relative: str) -> str:
    """A path relative to the folder of a file in the archive."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base_file), unquote(relative.partition("#")[0]))).lstrip("/")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG, GIF or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


# Reading one archive -----------------------------------------------------------------------------------


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _elements(tree: _Tree, *names: str) -> list[tuple[int, dict[str, str]]]:
    return [(n, tree.attrs[n - 1]) for n in range(1, len(tree.tags) + 1) if _local(tree.tags[n - 1]) in names]


def _said(tree: _Tree, n: int) -> str:
    return tidy("".join(tree.texts[i] for i in range(n, tree.last[n - 1]) if tree.tags[i] == "#text"))


def reason_of(error: Exception) -> str:
    """A short name for what is wrong with a file or an entry."""
    text = str(error).lower()
    if "encrypted" in text or "password" in text:
        return "encrypted"
    if isinstance(error, NotImplementedError):
        return "unknown compression"
    if isinstance(error, (zlib.error, EOFError)) or "crc" in text:
        return "corrupt"
    if isinstance(error, zipfile.BadZipFile):
        return "no archive" if "not a zip" in text else "corrupt"
    return "missing" if isinstance(error, KeyError) else "unreadable"


class NoBook(ValueError):
    """An archive without what every book has; says why."""


class Book:
    """An open archive and what its package file says. Markup is read leniently, so that an
    entity or a missing end tag costs neither the book nor its style sheets."""

    def __init__(self, archive: zipfile.ZipFile):
        self.archive, self.names, self.lost = archive, set(archive.namelist()), {}
        rootfiles = [a.get("full-path") for _, a in _elements(tree_of(self.text("META-INF/container.xml") or ""), "rootfile")]
        if not rootfiles or not rootfiles[0]:
            why = self.lost.get("META-INF/container.xml", "missing")
            raise NoBook("no container" if why == "missing" else why)
        self.path = rootfiles[0]
        self.package = tree_of(self.text(self.path) or "")
        self.items = [{"id": a.get("id"), "path": resolve(self.path, a["href"]), "type": a.get("media-type", ""), "properties": a.get("properties", "").split()} for _, a in _elements(self.package, "item") if a.get("href")]

    def data(self, path: str, most: int = -1) -> bytes | None:
        try:
            with self.archive.open(path) as entry:
                return entry.read(most)
        except DAMAGE as e:
            self.lost[path] = reason_of(e)
            return None

    def text(self, path: str) -> str | None:
        data = self.data(path)
        return None if data is None else data.decode("utf-8-sig", "replace")

    def about(self) -> dict:
        """Title, authors (those whose role is aut, if any is; repeated ones once, whatever their case), language, date."""
        first = lambda name: next((t for n, _ in _elements(self.package, name) if (t := _said(self.package, n))), None)
        after = lambda n: tidy(self.package.texts[n] or "") if n < len(self.package.tags) else ""  # noqa: E731  a meta element of markup has no end, so its text comes next
        refined = {a["refines"].lstrip("#"): after(n) for n, a in _elements(self.package, "meta") if a.get("refines") and a.get("property") == "role"}
        creators = [(next((v for k, v in a.items() if _local(k) == "role"), refined.get(a.get("id"))), _said(self.package, n)) for n, a in _elements(self.package, "creator")]
        unique: dict[str, str] = {}
        for author in filter(None, [name for role, name in creators if role == "aut"] or [name for _, name in creators]):
            unique.setdefault(author.lower(), author)
        return {"title": first("title"), "authors": list(unique.values()), "language": first("language"), "published": first("date")}

    def order(self, named: list[str]) -> list[str]:
        """Reading order: the spine, else what the contents name, else the manifest, else all readable files."""
        readable = lambda x: "nav" not in x["properties"] and x["type"] != "application/x-dtbncx+xml" and (x["type"] in READABLE_TYPES or x["path"].lower().endswith(READABLE))
        by_id = {x["id"]: x for x in self.items}  # of items that repeat an id the last one counts
        spine = [by_id[a["idref"]]["path"] for _, a in _elements(self.package, "itemref") if a.get("idref") in by_id and readable(by_id[a["idref"]])]
        pages = [x["path"] for x in self.items if readable(x)]
        scanned = sorted(n for n in self.names if n.lower().endswith(READABLE) and not n.lower().startswith("meta-inf/") and n != self.path)
        for order in (spine, [p for p in named if p in set(pages)], pages, scanned):
            if order := [p for p in dict.fromkeys(order) if p in self.names]:
                return order
        return []

    def contents(self) -> tuple[str, str] | None:
        """Path and markup of the navigation document, or else of the older contents file."""
        for fits in (lambda x: "nav" in x["properties"], lambda x: x["type"] == "application/x-dtbncx+xml"):
            for item in filter(fits, self.items):
                if item["path"] in self.names and (markup := self.text(item["path"])) is not None:
                    return item["path"], markup
        return None

    def documents(self) -> Iterator[tuple[str, str, str, dict[str, int]]]:
        """(role, path, markup, widths of its images by the address it gives them)."""
        found, named = self.contents(), []
        if found:
            yield "contents", *found, {}
            addresses = [a.get("href") or a.get("src") for _, a in _elements(tree_of(found[1]), "a", "content")]
            named = [resolve(found[0], h) for h in addresses if h]
        for path in self.order(named):
            if (markup := self.text(path)) is None:
                continue
            if not REFERS.search(markup):  # most chapters: no tree is needed to know that
                yield "chapter", path, markup, {}
                continue
            tree = tree_of(markup)
            sheets = [resolve(path, a["href"]) for _, a in _elements(tree, "link") if a.get("href") and (a.get("rel", "").lower() == "stylesheet" or a.get("type", "").lower() == "text/css")]
            styles = [s for s in (self.text(p) for p in sheets if p in self.names) if s is not None]
            sources = {a["src"]: resolve(path, a["src"]) for _, a in _elements(tree, "img", "image") if a.get("src") and not a["src"].startswith("data:")}
            sizes = {src: image_size(head) for src, p in sources.items() if p in self.names and (head := self.data(p, IMAGE_HEAD)) is not None}
            yield "chapter", path, "".join(f"<style>{s}</style>" for s in styles) + markup, {src: min(size[0], 2**31 - 1) for src, size in sizes.items() if size}


def archive_rows(book: str, opened) -> Iterator[tuple]:
    """The rows of one file; `opened()` gives it as a binary file that can seek."""
    none = {"title": None, "authors": [], "language": None, "published": None}
    if book.lower().endswith(".pdf"):
        title = tidy(unquote(posixpath.basename(book))[:-4].replace("_", " ").replace("-", " "))
        yield (book, "UNSUPPORTED", "not an e-book", title, [], None, None, None, None, None, None, None)
        return
    about, n, reason, lost = none, 0, "no documents", {}
    try:
        with opened() as file, zipfile.ZipFile(file) as archive:
            read = Book(archive)
            about, lost = read.about(), read.lost
            held: list[tuple] = []  # what comes before the first document waits until it is known that there is one
            for position, (role, path, markup, images) in enumerate(read.documents()):
                held.append((book, "READY", None, *about.values(), role, position, path, markup, list(images.items())))
                if role == "chapter":
                    n += 1
                    yield from held
                    held.clear()
    except DAMAGE as e:
        reason = str(e) if isinstance(e, NoBook) else reason_of(e)
    for path, why in lost.items():
        yield (book, "READY" if n else "FAILED", why, *about.values(), "lost", None, path, None, None)
    if not n:
        why = next(iter(lost.values()), reason)
        yield (book, "FAILED", why, *about.values(), None, None, None, None, None)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    full = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], COLUMNS)
    for row in rows:
        held.append(row)
        size += len(row[10] or "")
        if size >= BATCH_BYTES:
            yield full()
            held, size = [], 0
    if held:
        yield full()


# The data source -----------------------------------------------------------------------------------------


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Hadoop's names for object stores are mapped to those that Arrow knows."""
    scheme, mark, rest = path.partition(":")
    path = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class EpubReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("maxpartitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        store, path = file_system(self.folder)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(BOOKS))
        dealt: list[list[str]] = []
        held = self.most
        for name, size in files:
            if held + size + OPEN_BYTES > self.most:
                dealt.append([])
                held = 0
            dealt[-1].append(name)
            held += size + OPEN_BYTES
        return [Files(tuple(names)) for names in dealt] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.folder)
        yield from _batches(row for path in partition.paths for row in archive_rows(path, lambda path=path: store.open_input_file(path)))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


#: What a reader expects in an archive beside the documents.
CONTAINER = '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
PACKAGE = '<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:language>{language}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
NAVIGATION = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>'
CHAPTER = '<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'


class EpubWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        store, base = file_system(self.folder)
        store.create_dir(f"{base}/{self.pending}", recursive=True)
        done, seen, current = [], set(), None
        for row in rows:
            book = "" if row.book is None else row.book
            if current is None or current.book != book:
                if book in seen:
                    raise ValueError(f"rows must be sorted by book; {book!r} comes again")
                if current:
                    done.append(current.close())
                seen.add(book)
                current = _OpenBook(store, f"{base}/{self.pending}", base, book, row)
            current.add(row)
        if current:
            done.append(current.close())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = file_system(self.folder)
        store.create_dir(base, recursive=True)
        files = [f for m in messages if m for f in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("a book's rows must be in one partition")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(base)):
                if info.path.lower().endswith(".epub"):
                    store.delete_file(info.path)
        for made, to in files:
            store.move(made, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = file_system(self.folder)
        if store.get_file_info(f"{base}/{self.pending}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.pending}")


class _OpenBook:
    """An archive while its chapters come in; only their labels are held."""

    def __init__(self, store: fs.FileSystem, pending: str, base: str, book: str, first):
        self.book, self.title, self.language, self.labels = book, first.title or "", first.language or "", []
        name = quote(book, safe=" ") or "_"
        name = name if len(name) <= 150 else f"{name[:100]}-{hashlib.sha256(book.encode()).hexdigest()[:16]}"
        self.made, self.to = f"{pending}/{uuid.uuid4().hex}.epub", f"{base}/{name}.epub"
        self.out = store.open_output_stream(self.made)
        self.archive = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.archive.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        self.archive.writestr("META-INF/container.xml", CONTAINER)

    def add(self, row) -> None:
        self.labels.append(row.label or "")
        lines = [line for line in (row.text or "").split("\n") if line.strip()]
        body = "".join(f"<p>{escape(line)}</p>" for line in lines)
        self.archive.writestr(f"OEBPS/c{len(self.labels)}.xhtml", CHAPTER.format(body=body))

    def close(self) -> tuple[str, str]:
        numbers = range(1, len(self.labels) + 1)
        items = "".join(f'<item id="c{n}" href="c{n}.xhtml" media-type="application/xhtml+xml"/>' for n in numbers)
        spine = "".join(f'<itemref idref="c{n}"/>' for n in numbers)
        entries = "".join(f"<li><a href={quoteattr(f'c{n}.xhtml')}>{escape(label)}</a></li>" for n, label in zip(numbers, self.labels))
        self.archive.writestr("OEBPS/package.opf", PACKAGE.format(title=escape(self.title), language=escape(self.language), items=items, spine=spine))
        self.archive.writestr("OEBPS/nav.xhtml", NAVIGATION.format(entries=entries))
        self.archive.close()
        self.out.close()
        return self.made, self.to


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EpubReader:
        return EpubReader(self.options)

    def writer(self, schema, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options["path"], overwrite)


def epub_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's books by the data source; from a store that only Spark can read, whole files
    come by its binary source instead. Same rows either way."""
    try:
        file_system(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from _batches(archive_rows(path, lambda content=content: io.BytesIO(content.as_py())))

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[eE][pP][uU][bB],[pP][dD][fF]}").load(folder)
        return files.select("path", "content").mapInArrow(run, SCHEMA)
    spark.dataSource.register(EpubSource)
    return spark.read.format("epub").load(folder)


def write_epubs(chapters: DataFrame, folder: str, mode: str = "append") -> None:
    """(book, title, language, position, label, text) rows to one archive a book. A book's rows go
    through one task, one chapter at a time: split what has no natural size into volumes."""
    chapters.sparkSession.dataSource.register(EpubSource)
    rows = chapters.select("book", "title", "language", "position", "label", "text")
    rows.repartition("book").sortWithinPartitions("book", "position").write.format("epub").mode(mode).save(folder)
