"""Scalar functions and operators on small rows, odd values included."""

import pytest
from pyspark.sql import functions as F

from folioflux.functions import similarity as sim
from folioflux.functions import text as tx
from folioflux.functions import values as vx
from folioflux.operators import cells, exports, layout
from folioflux.operators import relational as rel
from folioflux.operators import sequence as seq
from folioflux.sources import files, markup
from folioflux.streaming import events as ev


def values(spark, f, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("AB-77/12", "identifier"), ("7/4/1999", "date"), ("2001-02-03 04:05", "datetime"), ("a.b@c.org", "email"), ("(555) 010-2000", "phone"), ("12.5 %", "percentage"), ("$1,200.00", "currency"),
     ("(1,200)", "currency"), ("88,010.55", "currency"), ("1200", "number"), ("Yes", "boolean"), ("12 Main Street, Town TX 75001", "address"), ("plain words", "text"), ("", "text")],
)
def test_value_type(spark, text, kind):
    assert values(spark, tx.value_type, [text]) == [kind]


def test_text_functions(spark):
    assert values(spark, tx.clean_cell, [" a \n b ", None]) == ["a b", ""]
    assert values(spark, tx.slugify, ["Hello, World!", "!!!", None]) == ["hello_world", "field", "field"]
    assert values(spark, tx.humanize_key, ["kv_due__date", "vendor_id"]) == ["Due Date", "Vendor ID"]
    assert values(spark, tx.label_rejection, ["Invoice Number", "", "Chapter .... 12", "It ends.", "12345 6"]) == [None, "empty", "toc_entry", "prose", "no_letters"]
    assert [tuple(x) for x in values(spark, tx.page_range, ["pages 3 to 7", "page 4", "pages 3", "on pages 12-15 or page 2", "pages x, page 9", None])] == [(3, 7), (4, 4), (None, None), (12, 15), (9, 9), (None, None)]
    assert values(spark, tx.intent, ["Give a summary", "list the rows", "What is due?", "vendor name"]) == ["summary", "table", "question", "fields"]


def test_intents_of_words_beside_other_letters(spark, tmp_path):
    """Letters beyond ASCII, unusual blanks and line ends, against the SQL."""
    import duckdb

    from folioflux.plans import registry

    texts = ["Isü ok", "İs it", "is\u0301 ok", "isa", "is_ ok", "éis", "a tableé", "ésummary", "rows\u0661", "a?\u2028", "a?\u0085", "a?\x0b", "a? \r\n\t\f", "a?\n\n", "\x0bwhat", "\u00a0what", " \n what", "x\nwhat", "LINE ITEMS", "a?b", "", None]
    duck = duckdb.connect()
    for i, text in enumerate(texts):
        spark.createDataFrame([(i, text)], "conv_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{i}/conversations.parquet")
        duck.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/{i}/conversations.parquet/*.parquet')")
        got = registry.QUERIES["intents"](spark, f"{tmp_path}/{i}").collect()
        assert [tuple(r) for r in got] == duck.sql(registry.ORACLES["intents"]).fetchall(), text
    assert values(spark, tx.plural, ["box", "party", "day", "line", "items", "Batch"]) == ["boxes", "parties", "days", "lines", "items", "Batches"]
    assert values(spark, lambda c: tx.occurrences(c, "aa"), ["aaaa", "aaa", ""]) == [2, 1, 0]
    assert [tuple(x) for x in values(spark, tx.code_and_rest, ["AB-12 bolt", "plain bolt", None])] == [("AB-12", "bolt"), (None, "plain bolt"), (None, "")]
    assert values(spark, tx.search_terms, ["Find the unit price for all bolts, unit"]) == [["unit", "price", "bolts", "unit"]]


def test_values(spark):
    assert [str(x) for x in values(spark, vx.lenient_date, ["2025-03-14", "March 14, 2025", "14.03.2025", "soon", "1899-01-01", None])] == ["2025-03-14"] * 3 + ["None"] * 3
    assert values(spark, vx.to_number, ["(1,200.50)", "$ 3", "-7", "none", None]) == [-1200.5, 3.0, -7.0, None, None]
    assert values(spark, vx.money, ["$1,000.00", "NSP", "N/A", ""]) == [1000.0, None, None, None]
    assert values(spark, lambda c: vx.band(c.cast("double")), ["0.9", "0.6", "0.1"]) == ["high", "medium", "low"]


def test_similarity(spark):
    pair = spark.createDataFrame([("Hex Bolt", "hex-bolt"), ("abc", "xyz"), (None, "a"), ("Café", "CAFÉ")], "a string, b string")
    got = [r[0] for r in pair.select(sim.ratio("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.0
    assert values(spark, sim.canonical, ["ﬁne—Print  ‘x’", "A  b", None]) == ["fine-print 'x'", "a b", None]
    page = spark.createDataFrame([("total", None, "The TOTAL  due"), ("other", "due", "The TOTAL due")], "v string, s string, p string")
    assert [r[0] for r in page.select(sim.grounded(F.col("v"), F.col("s"), F.col("p"))).collect()] == [True, True]


def test_relational(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "gone")], "n string, p string")
    assert sorted(tuple(r) for r in rel.roots(edges, "n", "p").collect()) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("z", "gone", 1)]
    old = spark.createDataFrame([(1, "a", "accepted"), (2, "b", "pending"), (3, "c", "edited"), (4, "d", None)], "k int, value string, status string")
    new = spark.createDataFrame([(1, "z"), (2, "y"), (3, "c"), (5, "e")], "k int, value string")
    got = {r.k: (r.value, r.status, r.reason) for r in rel.upsert_reviewed(old, new, ["k"]).collect()}
    assert got == {1: ("a", "pending", "value_changed"), 2: ("y", "pending", None), 3: ("c", "edited", None), 4: ("d", "pending", None), 5: ("e", "pending", None)}
    df = spark.createDataFrame([(1, "me"), (2, None)], "k int, owner string")
    assert [rel.scoped(df, "owner", *a).count() for a in ((None, True), ("me",), (None,))] == [2, 1, 0]
    assert rel.wide(old, ["k"], "status", "value", ["accepted"]).where("accepted is not null").count() == 1


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, "a")], "k int, t int, v string")
    assert [r.island for r in seq.with_islands(df, ["k"], ["t"], "v").orderBy("k", "t").collect()] == [1, 1, 2, 2, 3, 1]
    assert [r.s for r in seq.carried_forward(df, ["k"], ["t"], F.col("v"), "s").orderBy("k", "t").collect()] == ["a"] * 6
    right = spark.createDataFrame([(1, 2, "x"), (1, 4, "y")], "k int, t int, w string")
    assert [r.w for r in seq.as_of(df, right, ["k"], "t", "t", ["w"]).orderBy("k", "t").collect()] == [None, "x", "x", "y", "y", None]


def test_files_and_markup(spark):
    assert files.resolve_page_range(9) == (1, 9) and files.resolve_page_range(9, 2, 3) == (2, 3)
    for bad in ((9, 0, 3), (9, 5, 4), (9, 1, 10)):
        with pytest.raises(ValueError):
            files.resolve_page_range(*bad)
    heads = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"PK\x03\x04"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in heads.select(files.kind_of(F.col("c"))).collect()] == ["pdf", "zip", None]
    assert values(spark, files.display_name, ["../a:b?.pdf", None, "x"]) == ["a_b_.pdf", "document.pdf", "x.pdf"]
    assert values(spark, files.rtf_text, [r"{\rtf1\b bold\b0 and \'e9 plain}"]) == ["bold and plain"]
    raw = spark.createDataFrame([(bytearray("﻿é".encode()),), (bytearray("é".encode("latin-1")),)], "c binary")
    assert [r[0] for r in raw.select(files.decoded(F.col("c"))).collect()] == ["é", "é"]
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>a<script>x</script> b<table><tr><th>n</th><th>n</th></tr><tr><td>1</td></tr></table><ul><li>i"), (2, None), (3, "")], "id int, html string")
    got = {r.id: r.text for r in markup.html_text(pages, "id", "html").collect()}
    assert got == {1: "T\na b\nn | n\n1 | \n- i", 2: "", 3: ""}
    assert sorted((r.header, r.value) for r in markup.html_cells(pages, "id", "html").collect()) == [("n", "1"), ("n (2)", "")]
    docs = spark.createDataFrame([(1, "<o><i k='1'><n>a</n></i><i k='2'><n>b</n><n>c</n></i></o>"), (2, "<o"), (3, None), (4, "<!DOCTYPE x [<!ENTITY e 'x'>]><o/>"), (5, "<!DOCTYPE o [" + " " * 300_000 + "<!ENTITY e 'x'>]><o><i/><i/></o>")], "id int, x string")
    assert sorted((r.record, r.key, r.value) for r in markup.xml_records(docs, "id", "x").where("path = '/o/i'").collect()) == [(1, "k", "1"), (1, "n", "a"), (2, "k", "2"), (2, "n", "b\nc")]


def test_cells_and_exports(spark, tmp_path):
    fields = [cells.Field("n", "number", required=True, positive=True), cells.Field("d", "date"), cells.Field("t", pattern="^[a-z]+$")]
    records = spark.createDataFrame([(1, "5", "2025-01-01", "ok"), (2, "-1", "never", "NO"), (3, None, None, None)], "id int, n string, d string, t string")
    checked = cells.validated(cells.cube(records, ["id"], fields), fields)
    assert {(r.id, r.field): list(r.reasons) for r in checked.where("size(reasons) > 0").collect()} == {(2, "n"): ["not_positive"], (2, "d"): ["not_a_date"], (2, "t"): ["pattern"], (3, "n"): ["missing"]}
    assert {r.id: r.status for r in cells.record_status(checked, ["id"]).collect()} == {1: "Verified", 2: "Needs Review", 3: "Missing"}
    manifest = spark.createDataFrame([(2, ["n"])], "id int, fields array<string>")
    assert [tuple(r) for r in exports.selected(records, manifest, ["n", "d"], "id", "id").collect()] == [(2, "-1", None)]
    with pytest.raises(ValueError):
        exports.selected(records, manifest, ["d"], "id", "id")
    path = str(tmp_path / "out")
    exports.replace_documents(records.withColumnRenamed("id", "document_id"), path)
    exports.replace_documents(records.where("id = 1").withColumn("n", F.lit("9")).withColumnRenamed("id", "document_id"), path)
    assert {r.document_id: r.n for r in spark.read.parquet(path).collect()} == {1: "9", 2: "-1", 3: None}


def test_layout(spark):
    runs = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 10.0, "head"), (1, 0.0, 40.0, 40.0, 50.0, "l1"), (1, 60.0, 40.0, 100.0, 50.0, "r1"), (1, 0.0, 52.0, 40.0, 62.0, "l2"), (1, 60.0, 52.0, 100.0, 62.0, "r2")], "p int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.text for r in layout.reading_order(runs, ["p"]).orderBy("place").collect()] == ["head", "l1", "l2", "r1", "r2"]
    assert [r.line for r in layout.lines(runs, ["p"]).orderBy("y0", "x0").collect()] == [1, 2, 2, 3, 3]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    a = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0), "cat", 0.5), (1, 2, (20.0, 0.0, 30.0, 10.0), "dog", 0.9)], f"p int, word int, box {box}, text string, confidence double")
    b = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 9.0), "cat", 0.8), (1, 2, (20.0, 0.0, 30.0, 10.0), "dot", 0.4), (1, 3, (50.0, 0.0, 60.0, 10.0), "new", 0.7)], f"p int, word int, box {box}, text string, confidence double")
    assert sorted((r.text, r.confidence) for r in layout.fused(a, b, ["p"]).collect()) == [("cat", 0.8), ("dog", 0.4), ("new", 0.7)]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    for k, f in enumerate((ev.hourly, ev.sessions)):
        q = f(stream).writeStream.outputMode("complete" if f is ev.hourly else "append").format("memory").queryName(f"s{k}").option("checkpointLocation", str(tmp_path / f"c{k}"))
        run = q.start()
        run.processAllAvailable()
        run.stop()
        got, want = {tuple(map(str, r)) for r in spark.sql(f"SELECT * FROM s{k}").collect()}, {tuple(map(str, r)) for r in f(events).collect()}
        assert got == want if f is ev.hourly else got <= want
