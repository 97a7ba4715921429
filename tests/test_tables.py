"""Segments, alignment tables and tag labels on inputs whose results are known."""

from pyspark.sql import functions as F

from folioflux.functions import tags
from folioflux.operators import tables as tab


def words(spark, lines):
    """Lines of (x0, text) as words of six points a letter; a page is a list of lines."""
    rows = [(p, n, t, float(x), float(x + 6 * len(t)), 12.0 * n, 12.0 * n + 10, 10.0) for p, page in enumerate(lines) for n, line in enumerate(page) for x, t in line]
    return spark.createDataFrame(rows, "page int, line int, text string, x0 double, x1 double, y0 double, y1 double, size double")


def tables(spark, *pages):
    got = {}
    for r in tab.alignment_tables(tab.segments(words(spark, pages), ["page", "line"]), ["page"]).collect():
        got.setdefault((r.page, r.table), {})[r.row, r.column] = r.text
    return got


def row(*texts):
    return [(x, t) for x, t in zip((10, 100, 200, 300), texts, strict=False) if t]


def test_segments(spark):
    line = [(100, "right"), (10, "two"), (33, "words"), (72, "x"), (300, "far")]
    got = sorted((r.segment, r.text, r.x0, r.x1, r.n_words) for r in tab.segments(words(spark, [[line]]), ["page", "line"]).collect())
    # the gaps are 5, 9, 22 and 170 points; 9 is not over 0.9 of the size
    assert got == [(1, "two words x", 10.0, 78.0, 3), (2, "right", 100.0, 130.0, 1), (3, "far", 300.0, 318.0, 1)]


def test_tables_rows_and_wrapped_cells(spark):
    page = [[(10, "Title")], row("a", "b", "c"), row("d", "e", "f"), [(100, "wrapped")], row("g", "", "i"), row("2.", "", ""), [(10, "Text that runs over all columns of it")]]
    got = tables(spark, page)
    assert list(got) == [(0, 1)]
    assert got[0, 1] == {(1, 0): "a", (1, 1): "b", (1, 2): "c", (2, 0): "d", (2, 1): "e wrapped", (2, 2): "f", (3, 0): "g", (3, 2): "i", (4, 0): "2."}


def test_columns_widen_and_too_few_rows_are_no_table(spark):
    wide = [row("a", "b", "c"), [(10, "a"), (104, "bbbb"), (200, "c")], [(10, "a"), (127, "b"), (200, "c")]]  # the third fits the widened column only
    assert len(tables(spark, wide)[0, 1]) == 9
    short = [row("a", "b", "c"), [(10, "a"), (127, "b"), (200, "c")], row("a", "b", "c")]
    assert tables(spark, short, [row("a", "b"), row("a", "b"), row("a", "b")], []) == {}
    two = [row("a", "b", "c")] * 3 + [[(10, "x" * 60)]] + [row("d", "e", "f", "g")] * 3
    assert {k: len(v) for k, v in tables(spark, two).items()} == {(0, 1): 9, (0, 2): 12}


def test_lines_with_their_words_gathered(spark):
    """The same segments from arrays of words; lines without words give none, odd sizes and missing ones count as little."""
    made = words(spark, [[[(100, "right"), (10, "two"), (33, "words")], [(10, "a")], [(10, "a"), (10, "b"), (25, "c")]]])
    made = made.withColumn("size", F.when(F.col("text") == "words", F.lit(None)).when(F.col("text") == "c", 12.0).otherwise(F.col("size")))
    lines = made.groupBy("page", "line").agg(F.collect_list(F.struct("size", "y1", "y0", "x1", "x0", "text")).alias("w"))
    lines = lines.union(spark.sql("select 0, 7, array() union all select 0, 8, null"))
    got = tab.line_segments(lines, ["page", "line"], "w")
    want = [(0, 0, 1, "two words"), (0, 0, 2, "right"), (0, 1, 1, "a"), (0, 2, 1, "a b c")]
    for found in (got, tab.segments(made, ["page", "line"])):
        assert sorted((r.page, r.line, r.segment, r.text) for r in found.collect()) == want


def test_pages_are_folded_many_in_a_batch(spark):
    """No call of Python for each page, and pages with null keys or with lines that have no number."""
    found = tab.segments(words(spark, [[row("a", "b", "c")] * 3, [row("a", "b")], [row("d", "e", "f")] * 4]), ["page", "line"])
    odd = found.withColumn("page", F.when(F.col("page") < 2, F.col("page"))).union(found.where("page = 0").select(F.lit(5), F.lit(None).cast("int"), *found.columns[2:]))
    tables_ = tab.alignment_tables(odd, ["page"])
    assert "InPandas" not in tables_._jdf.queryExecution().toString()
    assert sorted((str(r.page), r.n) for r in tables_.groupBy("page").agg(F.count("*").alias("n")).collect()) == [("0", 9), ("None", 12)]


def test_tag_labels(spark):
    known = spark.createDataFrame([(w,) for w in "date published file name datepub lished a ab b address add ress".split()], "word string")
    made = spark.createDataFrame([(t,) for t in ["datepublished", "DATEPUBLISHED", "FileName", "XMLFileName", "Attribute1", "file_name", "filenames", "address", "aabbab", "ab-cd.ef", "", None, "datepublished"]], "tag string")
    got = {r.tag: r.label for r in tags.tag_labels(made, known).collect()}
    want = {"datepublished": "Date Published", "DATEPUBLISHED": "Date Published", "FileName": "File Name", "XMLFileName": "XML File Name", "Attribute1": "Attribute 1", "file_name": "File Name", "filenames": "Filenames", "address": "Address", "aabbab": "A Ab B Ab", "ab-cd.ef": "Ab Cd Ef"}
    assert got == want
    assert tags.compounds(made, known.where(F.lit(False))).count() == 0


def test_line_segments_deals_items_once(spark, sf_dir):
    """One exchange, by the order; words are neither dealt out again nor joined with their line."""
    from folioflux.plans import registry

    plan = registry.QUERIES["line_segments"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
