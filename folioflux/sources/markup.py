"""HTML and XML sources: readable text, tables and records of markup columns, an Arrow batch at a time (§2.1)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_SKIP = {"script", "style", "head", "template", "noscript"}
_BLOCK = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "br", "dt", "dd", "ul", "ol", "table"}


class _Reader(HTMLParser):
    """Readable lines and tables of a page; what a page leaves open is closed at its end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.tables, self.links = [], [], []
        self._line, self._skip, self._open = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self._skip += 1
        elif tag == "table":
            self._end()
            self._open.append([])
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open:
            if not self._open[-1]:
                self._open[-1].append([])
            self._open[-1][-1].append("")
        elif tag in _BLOCK and not self._open:
            self._end()
            if tag == "li":
                self._line.append("- ")
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self._skip = max(0, self._skip - 1)
        elif tag == "table" and self._open:
            self._close()
        elif tag in _BLOCK and not self._open:
            self._end()

    def handle_data(self, data):
        if self._skip:
            return
        if self._open:
            if self._open[-1] and self._open[-1][-1]:
                self._open[-1][-1][-1] += data
        else:
            self._line.append(data)

    def _end(self):
        text = " ".join("".join(self._line).split())
        if text and text != "-":
            self.lines.append(text)
        self._line = []

    def _close(self):
        rows = [[" ".join(c.split()) for c in r] for r in self._open.pop() if any(c.strip() for c in r)]
        if rows:
            wide = max(map(len, rows))
            rows = [r + [""] * (wide - len(r)) for r in rows]
            self.tables.append(rows)
            self.lines += [" | ".join(r) for r in rows]

    def finish(self):
        while self._open:
            self._close()
        self._end()
        return self


def read_html(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.finish()


def html_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col, n_lines, text: headings, paragraphs, list items and `a | b` table rows, a line each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read_html(h) for h in b[html_col]]
            yield pd.DataFrame({id_col: b[id_col], "n_lines": [len(f.lines) for f in found], "text": ["\n".join(f.lines) for f in found]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, n_lines long, text string")


def html_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col, table, row, header, value for each cell below a table's first row, which names the columns: blank names
    are `Column i`, repeated ones get ` (k)`; short rows are padded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, html in zip(b[id_col], b[html_col], strict=True):
                for t, rows in enumerate(read_html(html).tables):
                    heads = unique_headers(rows[0])
                    out += [(key, t, r, h, c) for r, cells in enumerate(rows[1:], 1) for h, c in zip(heads, cells, strict=True)]
            yield pd.DataFrame(out, columns=[id_col, "table", "row", "header", "value"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, table int, row int, header string, value string")


def unique_headers(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names, 1):
        name = " ".join((name or "").split()) or f"Column {i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def xml_records(docs: DataFrame, id_col: str, xml_col: str, max_groups: int = 4, max_depth: int = 3) -> DataFrame:
    """id_col, path, record, key, value: elements that repeat under one parent are records. Groups are ranked by records
    times fields; a group within a better one is left out. Entity declarations and malformed texts give no rows."""

    def flatten(e, prefix="", depth=0):
        tag = lambda x: x.tag.rsplit("}", 1)[-1]
        for k, v in e.attrib.items():
            yield prefix + k.rsplit("}", 1)[-1], v
        for c in e:
            if len(c) and depth < max_depth:
                yield from flatten(c, f"{prefix}{tag(c)}.", depth + 1)
            else:
                yield prefix + tag(c), " ".join("".join(c.itertext()).split())
                yield from ((f"{prefix}{tag(c)}.{k}", v) for k, v in c.attrib.items())

    def groups(root):
        found = []

        def walk(e, path):
            same: dict[str, list] = {}
            for c in e:
                same.setdefault(c.tag, []).append(c)
            for tag, members in same.items():
                at = f"{path}/{tag.rsplit('}', 1)[-1]}"
                fields = {k for m in members for k, _ in flatten(m)}
                if len(members) > 1 and fields:
                    found.append((len(members) * len(fields), at, members))
            for c in e:
                walk(c, f"{path}/{c.tag.rsplit('}', 1)[-1]}")

        walk(root, "/" + root.tag.rsplit("}", 1)[-1])
        best = []
        for _, at, members in sorted(found, key=lambda g: (-g[0], g[1])):
            if len(best) < max_groups and not any(at.startswith(b[0] + "/") for b in best):
                best.append((at, members))
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, xml in zip(b[id_col], b[xml_col], strict=True):
                if not xml or re.search("<!ENTITY", xml, re.I):
                    continue
                try:
                    root = ET.fromstring(xml)
                except ET.ParseError:
                    continue
                for at, members in groups(root):
                    for n, m in enumerate(members, 1):
                        merged: dict[str, list[str]] = {}
                        for k, v in flatten(m):
                            merged.setdefault(k, []).append(v)
                        out += [(key, at, n, k, "\n".join(v)) for k, v in merged.items()]
            yield pd.DataFrame(out, columns=[id_col, "path", "record", "key", "value"])

    return docs.select(id_col, xml_col).mapInPandas(run, f"{id_col} {dict(docs.dtypes)[id_col]}, path string, record int, key string, value string")
