import re

import numpy as np

from folioflux.llm import license_scan as ls
from folioflux.llm.license_templates import TEMPLATES
from folioflux.sources.tables import load

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_align_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 12))
        matched, first, last = ls.align(b, a, -12, 12)
        assert matched == lcs(a.tolist(), b.tolist())
        assert not matched or 0 <= first <= last < len(b)


def test_templates_edits_and_places(spark):
    mit = TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "at no cost at all").replace("whom", "whomever")
    half = " ".join(mit.split()[:40])
    docs = [
        (1, "é🎉 start. " + mit + " end", "x"),
        (2, "one two three " + edited, "x"),
        (3, half, "x"),
        (4, None, "x"),
        (5, "", "x"),
        (6, "Licensed under CC BY-NC 4.0.\nfiller " * 3 + "word " * 30_000 + "RELEASED under the mit license!", "x"),
        (6, "Released under the MIT", None),
        (None, "Licensed under the Apache License, Version 2.0.", None),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string, matches string")
    got = [(r.doc_id, r.matches) for r in ls.scan_licenses(table).select("_row.doc_id", "matches").collect()]
    assert len(got) == len(docs)
    one = got[0][1]
    assert [m.template for m in one] == ["MIT"] and one[0].coverage == 1 and docs[0][1][one[0].start : one[0].end] == mit.rstrip(".")
    assert [m.template for m in got[1][1]] == ["MIT"] and 0.9 < got[1][1][0].coverage < 1
    assert got[2][1] == got[3][1] == got[4][1] == []
    assert [m.template for m in got[5][1]] == ["CC-BY-NC-4.0-notice"] * 3 + ["MIT-notice"]
    assert [m.template for m in got[6][1]] == ["MIT-notice"] and got[6][1][0].coverage == 0.8
    assert [m.template for m in got[7][1]] == ["Apache-2.0-notice"]
    assert ls.scan_licenses(table.limit(0)).count() == 0
    assert not any(r.matches for r in ls.scan_licenses(table, {}).collect())


def test_query_finds_every_whole_notice(spark, sf_dir):
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    rows = ls.op9_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    notices = {n: words(TEMPLATES[n]) for n in TEMPLATES if n.endswith("-notice")}
    seen = 0
    for r in rows:
        w = " ".join(["", *words(texts[r.doc_id]), ""])
        there = {n for n, t in notices.items() if " " + " ".join(t) + " " in w}
        assert there <= set(r.licenses.split(",")), r
        seen += len(there)
        for span in filter(None, r.spans.split(",")):
            name, a, b, matched = span.split(":")
            part, t = words(texts[r.doc_id][int(a) : int(b)]), words(TEMPLATES[name])
            assert int(matched) == lcs(t, part) >= 0.8 * len(t)
    assert seen > 2


def test_insertions_and_whole_templates():
    index = ls.build_index(TEMPLATES)

    def scan(*texts):
        data = [t.encode() for t in texts]
        return ls.scan_slice(index, np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]), ls.COVERAGE).to_pylist()

    for name in ("MIT", "Apache-2.0-header", "ISC", "BSD-2-Clause", "Unlicense"):
        w = TEMPLATES[name].split()
        k = len(w) // 2
        for n in (13, 40):
            added = [f"zq{i}" for i in range(n)]
            got, doubled = scan(" ".join(w[:k] + added + w[k:]), " ".join([*w, *added, *w]))
            assert [m["template"] for m in got] == [name] and got[0]["coverage"] == 1 and got[0]["start"] == 0
            assert [m["template"] for m in doubled] == [name] * 2
        (half,) = scan(" ".join(w[: k - 5] + added))
        assert name not in [m["template"] for m in half]
        (turned,) = scan(" ".join(w[k:] + added + w[:k]))
        assert name not in [m["template"] for m in turned]
    assert "SUCH DAMAGE." in TEMPLATES["BSD-2-Clause"] and "PERFORMANCE OF THIS SOFTWARE." in TEMPLATES["ISC"] and "unlicense.org" in TEMPLATES["Unlicense"]
