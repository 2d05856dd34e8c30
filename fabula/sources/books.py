"""Book files as tables: TXT, PDF, EPUB and FB2 by extension or media type.

Files are read by Spark's ``binaryFile`` source and parsed where they are. PDF needs
an extractor function (bytes to text), as no library for it is assumed.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import text as T
from fabula.operators.ledger import write_whole

#: What may be uploaded, and the order in which formats are tried.
FORMATS = (
    ("TXT", ".txt", ("text/plain",)),
    ("PDF", ".pdf", ("application/pdf",)),
    ("EPUB", ".epub", ("application/epub+zip",)),
    ("FB2", ".fb2", ("application/x-fictionbook+xml", "application/fictionbook+xml", "text/xml", "application/xml")),
)
MOST_BYTES = 50 * 1024 * 1024
PARSED = "path string, format string, content_hash string, text string, title string, author string, language string, error string"


def book_format(path: Column, media_type: Column | None = None) -> Column:
    """TXT, PDF, EPUB or FB2, the first that extension or media type name; else null."""
    out = F.lit(None).cast("string")
    for name, extension, types in reversed(FORMATS):
        fits = F.lower(path).endswith(extension)
        if media_type is not None:
            fits = fits | F.coalesce(F.lower(media_type).isin(*types), F.lit(False))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def upload_errors(path: Column, media_type: Column, size: Column) -> Column:
    """Why a file may not be uploaded, or null: both its extension and its type must be
    allowed, and it may have 50 MiB at most."""
    extension = F.lit(False)
    allowed = F.lit(False)
    for _, e, types in FORMATS:
        extension = extension | F.lower(path).endswith(e)
        allowed = allowed | F.lower(media_type).isin(*types)
    return F.when(~extension, "extension").when(~F.coalesce(allowed, F.lit(False)), "media type").when(size > MOST_BYTES, "size")


def storage_path(content_sha256: Column, path: Column, root: str = "storage/books") -> Column:
    return F.concat(F.lit(f"{root}/"), content_sha256, F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first(root: ElementTree.Element, name: str) -> str | None:
    return next((e.text.strip() for e in root.iter() if _local(e.tag) == name and e.text and e.text.strip()), None)


def parse_epub(data: bytes) -> dict:
    """The pages by name, and title, creator and language of the first package file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(z.namelist())
        pages = [z.read(n).decode("utf-8", "replace") for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]
        out = {"text": "\n\n".join(pages)}
        package = next((n for n in names if n.lower().endswith(".opf")), None)
        if package:
            root = ElementTree.fromstring(z.read(package))
            out |= {"title": _first(root, "title"), "author": _first(root, "creator"), "language": _first(root, "language")}
    return out


def parse_fb2(data: bytes) -> dict:
    """All strings of the document in its order, attribute values included."""
    root = ElementTree.fromstring(data)
    leaves: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        leaves.extend(v for v in e.attrib.values() if v.strip())
        if e.text and e.text.strip():
            leaves.append(e.text.strip())
        for child in e:
            walk(child)
            if child.tail and child.tail.strip():
                leaves.append(child.tail.strip())

    walk(root)
    info = next((e for e in root.iter() if _local(e.tag) == "title-info"), None)
    out = {"text": "\n".join(leaves)}
    if info is not None:
        author = next((e for e in info if _local(e.tag) == "author"), None)
        parts = [_first(author, n) for n in ("first-name", "middle-name", "last-name")] if author is not None else []
        out |= {"title": _first(info, "book-title"), "author": " ".join(p for p in parts if p) or None, "language": _first(info, "lang")}
    return out


def parse_books(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, format, text, metadata, error) of files (path, content, format). A file that
    can't be parsed has an error instead of a text. HTML of EPUBs is still in the text;
    read_books() removes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                path, data, kind = (batch.column(c)[i].as_py() for c in range(3))
                row: dict = {"path": path, "format": kind, "content_hash": hashlib.sha256(data).hexdigest()}
                try:
                    if kind == "TXT":
                        row["text"] = data.decode("utf-8", "replace")
                    elif kind == "EPUB":
                        row |= parse_epub(data)
                    elif kind == "FB2":
                        row |= parse_fb2(data)
                    elif kind == "PDF" and pdf is not None:
                        row["text"] = pdf(data)
                    else:
                        row["error"] = f"no parser for {kind}"
                except Exception as e:  # one bad file must not stop the others
                    row["error"] = f"{type(e).__name__}: {e}"[:300]
                names = [x.split()[0] for x in PARSED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], pa.string()) for n in names], names=names)

    return files.select("path", "content", "format").mapInArrow(run, PARSED)


def read_books(spark: SparkSession, glob: str, pdf: Callable[[bytes], str] | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """Books below ``glob`` with normalized texts and the SHA-256 of their files, each file
    read once. ``metadata`` (path, title, author, language) overrides what files say."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content", book_format(F.col("path")).alias("format"))
    parsed = parse_books(files, pdf)
    if metadata is not None:
        given = metadata.select("path", *(F.col(c).alias(f"_{c}") for c in ("title", "author", "language")))
        parsed = parsed.join(given, "path", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("title", "author", "language") else c for c in parsed.columns))
    text = F.when(F.col("format") == "EPUB", T.strip_xml_tags(F.col("text"))).otherwise(F.col("text"))
    return parsed.withColumn("text", T.normalize_book_text(text))


def save_originals(files: DataFrame, root: str) -> DataFrame:
    """Writes each file (path, content) below ``root`` under the name of its content, and
    returns (path, stored). A file has its name once it is whole; the same content is the same
    file, so a task may run again, and two at once. Files
    go through ``pyarrow.fs``, so ``root`` needs a scheme that it knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for path, data, name in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                write_whole(store, f"{base}/{name}", data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{root}/{name}"])], names=["path", "stored"])

    name = F.substring_index(storage_path(F.sha2("content", 256), F.col("path"), ""), "/", -1).alias("name")
    return files.select("path", "content", name).mapInArrow(run, "path string, stored string")
