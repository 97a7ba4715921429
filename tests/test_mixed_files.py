"""The data source of mixed files, with malformed ones."""

import pytest

from folioflux.sources import mixed

FILES = {
    "a.txt": "first line\n\n  second\n".encode(),
    "latin.txt": "caf\xe9 \x93quoted\x94".encode("latin-1"),
    "mark.csv": "\ufeffName,Note\n\"Smith, J\",\"two\nlines\"\n,\n".encode(),
    "t.tsv": b"a\tb\n1\t2\n",
    "bad.csv": b'a,b\n"open,1\n',
    "page.html": b"<html><body><h1>Title</h1><p>One &amp; two</p><table><tr><td>a</td><td>b</td></tr></table></body></html>",
    "noname": b"<!DOCTYPE html><p>Seen as a page</p>",
    "bare.xml": b"<?xml version='1.0'?><r/>",
    "good.xml": b'<r xmlns="u"><i n="1">x</i><i n="2"> y  z </i></r>',
    "broken.xml": b"<r><i></r>",
    "entity.xml": b'<?xml version="1.0"?><!DOCTYPE r [<!entity a "b">]><r>&a;</r>',
    "note.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 caf\'e9 \u8364? \{x\}\par Second \b line\b0}",
    "fake.rtf": b"plain",
    "scan.pdf": b"%PDF-1.7 ...",
    "liar.txt": b"\x89PNG\r\n...",
    "empty.txt": b"  \n",
    "blob": b"\x00\x01\x02",
    ".hidden.txt": b"no",
    "sub/deep.md": b"deep",
}


def test_kinds_records_and_errors(spark, tmp_path, monkeypatch):
    for name, data in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    mixed.register(spark)
    rows = spark.read.format("folioflux_files").load(str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.record)):
        got.setdefault(r.path.removeprefix(f"{tmp_path}/"), []).append((r.kind, r.error or r.text))
    assert got == {
        "a.txt": [("text", "first line"), ("text", "second")],
        "latin.txt": [("text", "caf\xe9 \u201cquoted\u201d")],
        "mark.csv": [("csv", "Name | Note"), ("csv", "Smith, J | two\nlines"), ("csv", " | ")],
        "t.tsv": [("csv", "a | b"), ("csv", "1 | 2")],
        "bad.csv": [("csv", "malformed_csv")],
        "page.html": [("html", "Title"), ("html", "One & two"), ("html", "a | b")],
        "noname": [("html", "Seen as a page")],
        "good.xml": [("xml", "/r/i/@n: 1"), ("xml", "/r/i: x"), ("xml", "/r/i/@n: 2"), ("xml", "/r/i: y z")],
        "broken.xml": [("xml", "malformed_xml")],
        "entity.xml": [("xml", "entity_declaration")],
        "note.rtf": [("rtf", "caf\xe9 \u20ac {x}"), ("rtf", "Second line")],
        "fake.rtf": [("rtf", "signature_mismatch")],
        "scan.pdf": [("pdf", "unsupported_kind")],
        "liar.txt": [("png", "signature_mismatch")],
        "empty.txt": [("text", "empty_file")],
        "blob": [("binary", "unsupported_kind")],
        "sub/deep.md": [("text", "deep")],
    }
    cells = {tuple(r.cells) for r in rows if r.path.endswith("mark.csv")}
    assert ("Smith, J", "two\nlines") in cells
    only = spark.read.format("folioflux_files").option("pattern", r"\.xml$").load(f"file://{tmp_path}")
    assert {r.kind for r in only.collect()} == {"xml"}
    monkeypatch.setattr(mixed, "PARTITION_BYTES", 40)
    assert len(mixed.MixedReader(str(tmp_path), None).partitions()) > 5
    with pytest.raises(FileNotFoundError):
        mixed.MixedReader(f"{tmp_path}/absent", None).partitions()
