"""A data source for folders of mixed files (§2.1.8 to 2.1.12, 2.1.20, 2.1.22, 2.1.24): read by kind, one row a record."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioflux.sources.markup import read_html

#: Extensions of each kind that is read, and leading bytes by which other kinds are known (fixed values of the formats).
KINDS = {"text": ("txt", "md", "log"), "csv": ("csv", "tsv"), "html": ("html", "htm"), "xml": ("xml",), "rtf": ("rtf",)}
BINARY = {b"%PDF-": "pdf", b"PK\x03\x04": "zip", b"\x89PNG": "png", b"\xff\xd8\xff": "jpeg", b"GIF8": "gif", b"\xd0\xcf\x11\xe0": "ole", b"II*\x00": "tiff", b"MM\x00*": "tiff"}
#: Bytes of files a partition reads, about.
PARTITION_BYTES = 64 << 20
SCHEMA = "path string, kind string, record int, text string, cells array<string>, error string"
_ESCAPE = re.compile(r"\\u(-?\d+) ?\??|\\'([0-9a-fA-F]{2})|\\(par|line|tab)\b ?|\\[a-zA-Z]+-?\d* ?|\\([^a-zA-Z])|[{}]|[\r\n]+")


def decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else Windows' Latin, else Latin-1, in which all bytes are characters."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def kind_of(path: str, data: bytes) -> tuple[str, str | None]:
    """(kind, error): by the extension, which the leading bytes must not belie; without a known one by the content."""
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    named = next((k for k, own in KINDS.items() if extension in own), None)
    found = next((k for magic, k in BINARY.items() if data.startswith(magic)), None)
    if found:
        return found, "signature_mismatch" if named else "unsupported_kind"
    head = data.lstrip(b"\xef\xbb\xbf \t\r\n")[:256].lower()
    seen = "rtf" if head.startswith(b"{\\rtf") else "html" if head.startswith((b"<!doctype html", b"<html")) else "xml" if head.startswith(b"<?xml") else None
    if named in ("rtf", "xml") and seen != named and not (named == "xml" and head.startswith(b"<") and seen is None):
        return named, "signature_mismatch"
    if named is None and seen is None and b"\x00" in data[:4096]:
        return "binary", "unsupported_kind"
    return named or seen or "text", None


def rtf_text(text: str) -> str:
    """What an RTF file says: escaped characters as such, paragraphs as lines, control words and groups' braces away."""

    def plain(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1]) % 65536)
        if m[2]:
            return bytes.fromhex(m[2]).decode("cp1252", "replace")
        return "\n" if m[3] in ("par", "line") else "\t" if m[3] else m[4] if m[4] and m[4] in "\\{}" else ""

    bare = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    return "\n".join(x for x in (" ".join(line.split()) for line in _ESCAPE.sub(plain, bare).split("\n")) if x)


def records(path: str, data: bytes) -> Iterator[tuple[str, int, str, list[str] | None, str | None]]:
    """(kind, record, text, cells, error) of a file: lines that are not blank, rows of a CSV, lines of a page as a reader sees
    them, an XML file's leaves as `path: value`. A file that can't be read as its kind gives one row that says why."""
    kind, error = kind_of(path, data)
    if not error and not data.strip():
        error = "empty_file"
    rows: list[tuple[str, list[str] | None]] = []
    if not error:
        try:
            if kind == "csv":
                text = decoded(data)
                table = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if path.lower().endswith(".tsv") else ",", strict=True)
                rows = [(" | ".join(c.strip() for c in row), row) for row in table if row]
            elif kind == "html":
                rows = [(line, None) for line in read_html(decoded(data)).lines]
            elif kind == "xml":
                if re.search(rb"<!ENTITY", data, re.I):
                    raise ValueError("entity_declaration")
                rows = [(f"{at}: {value}", None) for at, value in leaves(ElementTree.fromstring(data))]
            else:
                text = rtf_text(decoded(data)) if kind == "rtf" else decoded(data)
                rows = [(line.strip(), None) for line in text.splitlines() if line.strip()]
        except (csv.Error, ElementTree.ParseError, ValueError) as why:
            rows, error = [], "entity_declaration" if str(why) == "entity_declaration" else f"malformed_{kind}"
    if error:
        yield kind, 0, "", None, error
    for n, (text, cells) in enumerate(rows, 1):
        yield kind, n, text, cells, None


def leaves(root: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """Path and text of each element that has text, attributes as /@name."""
    open_ = [(root, "")]
    while open_:
        e, above = open_.pop()
        at = f"{above}/{e.tag.rpartition('}')[2]}"
        yield from ((f"{at}/@{k.rpartition('}')[2]}", v) for k, v in e.attrib.items())
        if (e.text or "").strip():
            yield at, " ".join(e.text.split())
        open_ += [(c, at) for c in reversed(e)]


@dataclass
class Files(InputPartition):
    paths: list[str]


class MixedReader(DataSourceReader):
    def __init__(self, path: str, pattern: str | None):
        self.path, self.pattern = path, pattern

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        """Files by name, so many to a partition as have about PARTITION_BYTES; one larger file is one of its own."""
        from pyarrow import fs

        store, root = self._store()
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        wanted = re.compile(self.pattern) if self.pattern else None
        out, size = [Files([])], 0
        for f in sorted(found, key=lambda f: f.path):
            if wanted and not wanted.search(f.base_name):
                continue
            if out[-1].paths and size + f.size > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_stream(path) as stream:
                data = stream.read()
            for row in records(path, data):
                yield (path, *row)


class MixedFiles(DataSource):
    """spark.read.format("folioflux_files").load(folder), with the option `pattern`, a regular expression for file names."""

    @classmethod
    def name(cls) -> str:
        return "folioflux_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MixedReader:
        return MixedReader(self.options["path"], self.options.get("pattern"))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(MixedFiles)
