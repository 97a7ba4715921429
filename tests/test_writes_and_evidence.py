"""Relationship writes, cycles, evidence and documents on small inputs."""

import json

from pyspark.sql import functions as F

from folioflux.functions import evidence as ev
from folioflux.operators import exports, references
from folioflux.operators import relational as rel
from folioflux.operators import workflow as wf


def test_cycles_and_what_leads_into_them(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 7), (7, None), (8, 8), (9, 6)] + [(100 + i, 101 + i) for i in range(40)] + [(140, 139)]
    edges = spark.createDataFrame(pairs, "c int, p int")
    assert {r.c for r in rel.on_cycles(edges, "c", "p").collect()} == {1, 2, 3, 8, 139, 140}
    assert rel.on_cycles(edges.limit(0), "c", "p").collect() == []


def test_relationship_writes(spark):
    relations = spark.createDataFrame([(1, 2, "confirmed"), (2, 3, "pending"), (3, 1, "pending"), (4, 1, "pending"), (5, 1, "rejected"), (6, 1, "confirmed"), (7, 1, "pending"), (8, 9, "pending"), (9, 8, "pending")], "child int, parent int, status string")
    actions = spark.createDataFrame([(2, "confirm", "a"), (3, "confirm", "b"), (4, "confirm", "c"), (5, "confirm", "d"), (6, "remove", "e"), (7, "reject", "f"), (8, "confirm", "g"), (99, "confirm", "h"), (None, "confirm", "i")], "child int, action string, actor string")
    got = {r.child: (r.status, r.outcome, r.audit) for r in wf.relationship_writes(relations, actions).collect()}
    assert got == {1: ("confirmed", None, None), 2: ("pending", "cycle", None), 3: ("pending", "cycle", None), 4: ("confirmed", "done", "c confirm"), 5: ("rejected", "not_allowed", None), 6: ("pending", "done", "e remove"), 7: ("rejected", "done", "f reject"), 8: ("confirmed", "done", "g confirm"), 9: ("pending", None, None)}
    stamps = spark.sql("SELECT * FROM VALUES (1, null, null), (2, date'2024-01-01', null), (3, date'2024-01-01', date'2024-01-02') AS t(i, a, p)")
    assert {r.i: r.s for r in stamps.select("i", wf.promotion(F.col("a"), F.col("p")).alias("s")).collect()} == {1: "draft", 2: "approved", 3: "promoted"}


def test_evidence(spark):
    rows = [("ACME", "by Acme, Inc.", 0), ("cm", "by Acme", 0), ("a.b", "axb", 0), ("a.b", "see A.B!", 0), ("x\\Ey", "x\\ey", 0), ("", "any", 0), (None, "any", 0), ("é", "“é”", 0), ("1,200", None, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, e string, n int")
    assert [r.t for r in df.orderBy("i").select(ev.has_token(F.col("v"), F.col("e")).alias("t")).collect()] == [True, False, False, True, True, False, False, True, False]
    figures = spark.createDataFrame([(0, -1200.5, "(1,200.50)"), (1, 1200.51, "1,200.50"), (2, 3.0, "no 3"), (3, None, "3"), (4, 3.0, None), (5, 12.0, "120 and 1.2")], "i int, v double, e string")
    assert [r.t for r in figures.orderBy("i").select(ev.has_figure(F.col("v"), F.col("e")).alias("t")).collect()] == [True, False, True, False, False, False]
    texts = spark.createDataFrame([(0, "2024-02-30x"), (1, "2024-02-29T10:00"), (2, "29/02/2024"), (3, None)], "i int, t string")
    assert [str(r.d) for r in texts.orderBy("i").select(ev.iso_date(F.col("t")).alias("d")).collect()] == ["None", "2024-02-29", "None", "None"]
    states = spark.createDataFrame([(0, "Unverified"), (1, "PASSED"), (2, "open"), (3, None)], "i int, t string")
    assert [r.v for r in states.orderBy("i").select(ev.verified(F.col("t")).alias("v")).collect()] == [True, True, False, False]
    one = spark.sql("SELECT array('missing', 'odd_code') AS r, array(' ', 'NSP', '5 ea', 'free') AS c")
    got = one.select(ev.reason_labels(F.col("r")).alias("r"), F.transform("c", lambda x: ev.amount_stated(x)).alias("c")).first()
    assert got.r == ["Value is missing", "odd_code"] and got.c == [None, True, True, False]


def test_documents_and_running_lines(spark):
    fields = spark.createDataFrame([(1, "kv_total", "5", 1), (1, "total", "6", 2), (1, "name", None, 3), (2, "x", "y", 1), (2, None, "z", 2)], "doc int, name string, value string, place int")
    rows = spark.createDataFrame([(1, "t", 2, {"a": "2"}), (1, "t", 1, {"a": "1"}), (3, "u", 1, {"b": ""})], "doc int, table string, place int, cells map<string,string>")
    got = {r.doc: json.loads(r.document) for r in exports.normalized_document(fields, rows, "doc").collect()}
    assert got == {1: {"fields": {"name": None, "total": "6"}, "tables": {"t": ['{"a":"1"}', '{"a":"2"}']}}, 2: {"fields": {"x": "y"}}, 3: {"tables": {"u": ['{"b":""}']}}}
    lines = [(1, p, 100.0, y, y + 4, text) for p in range(4) for y, text in ((2.0, f"Page {p}"), (50.0, f"Page {p}"), (94.0, "once" if p else "first"))]
    blocks = spark.createDataFrame([*lines, (2, 1, 100.0, 2.0, 6.0, "Page 1")], "doc int, page int, height double, y0 double, y1 double, text string")
    left = references.without_running_lines(blocks, ["doc"])
    assert left.columns == blocks.columns
    assert sorted((r.doc, r.page, r.y0, r.text) for r in left.collect()) == sorted([(1, p, 50.0, f"Page {p}") for p in range(4)] + [(1, 0, 94.0, "first"), (2, 1, 2.0, "Page 1")])
