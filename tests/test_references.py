"""Citations, parents, templates and tables of contents on small inputs."""

import datetime

from pyspark.sql import functions as F

from folioflux.operators import references as refs


def test_clauses_once_and_their_five_statuses(spark):
    rows = [(1, 1, None, "52.1", "Scope of Work (Jan. 2020)", 0.5), (1, 2, None, "52.1", "scope of work (Jan. 2020)", 0.9), (1, 3, None, "52.1", "Scope of work Alternate i (JAN 2020)", 0.5), (1, 4, None, "52.2", "Wrong title", 0.5), (1, 5, None, "52.3", "Any", 0.5), (1, 6, None, "52.9", "Any", 0.5), (1, 7, "DFARS", "52.1", "Scope of Work (MAR 1999)", 0.5), (1, 8, None, "52.2", None, 0.5), (1, 9, None, "52.4", "Terms (DEVIATION 2) -", 0.1), (1, 10, None, None, "x", 0.1)]
    cited = spark.createDataFrame(rows, "doc int, place int, regulation string, number string, title string, confidence double")
    master = spark.createDataFrame([("52.1", "Clause", "Scope of work", "Jan. 2020"), ("52.2", "Clause", "Title", None), ("52.3", "Provision", "Any", None), ("52.4", "Clause", "TERMS", "x")], "number string, record_type string, clause_title string, effective_date string")
    got = sorted((r.regulation, r.number, r.title, r.alternate or "", r.deviation, r.match_status, r.qa_status) for r in refs.clause_references(cited, master, ["doc"]).collect())
    assert got == sorted([
        ("FAR", "52.1", "scope of work", "", False, "matched", "Verified"), ("FAR", "52.1", "Scope of work", "I", False, "date_mismatch", "Needs Review"), ("FAR", "52.2", "Wrong title", "", False, "title_mismatch", "Needs Review"),
        ("FAR", "52.3", "Any", "", False, "record_type_mismatch", "Needs Review"), ("FAR", "52.9", "Any", "", False, "not_found", "Needs Review"), ("DFARS", "52.1", "Scope of Work", "", False, "date_mismatch", "Needs Review"), ("FAR", "52.4", "Terms", "", True, "matched", "Verified"),
    ])


def test_parents_by_points(spark):
    d = datetime.date
    children = spark.createDataFrame([(1, "Acme", None, d(2020, 5, 1)), (2, None, None, None), (3, "Acme", "Us", d(2020, 1, 1)), (4, "x", "y", None)], "child int, party string, second_party string, date date")
    parents = spark.createDataFrame([(10, "AB-1", "Master Service Agreement", "Acme", None, d(2019, 1, 1), True), (11, " ab-1 ", "Other", "Zed", None, d(2021, 1, 1), True), (12, None, "Lease of Land", "Acme", "Us", None, False), (3, "S-3", "Self", None, None, None, True), (13, "AB-1", None, "Acme", None, d(2019, 1, 1), True)], "parent int, number string, title string, party string, second_party string, date date, base boolean")
    numbers = spark.createDataFrame([(1, "ab-1"), (3, "S-3"), (2, "none")], "child int, number string")
    titles = spark.createDataFrame([(2, "the master services agreement"), (3, "Lease of Land"), (4, "quite unlike")], "child int, phrase string")
    got = {r.child: (r.parent, r.confidence, r.matched_on, r.reasons) for r in refs.detected_parents(children, parents, numbers, titles).collect()}
    assert got == {
        1: (10, 0.85, "contract_number", ["Matching contract number", "Same counterparty", "Compatible document type", "Compatible date range"]),
        2: (10, 0.2, "contract_title", ["Explicit agreement reference", "Compatible document type"]),
        3: (12, 0.22, "contract_title", ["Explicit agreement reference", "Same counterparty"]),
    }
    assert refs.detected_parents(children, parents.limit(0), numbers).collect() == []


def test_templates_and_contents(spark):
    rows = [(1, p, 100.0, 2.0, 8.0, f"Page {p} of 9") for p in range(1, 10)] + [(1, p, 100.0, 50.0, 55.0, "in the middle") for p in range(1, 10)] + [(1, p, 100.0, 92.0, 96.0, "rare") for p in (1, 2)] + [(1, p, 0.0, 1.0, 2.0, "no height") for p in range(1, 10)] + [(2, 1, 100.0, 1.0, 2.0, "twice"), (2, 2, 100.0, 1.0, 2.0, "twice")]
    blocks = spark.createDataFrame(rows, "doc int, page int, height double, y0 double, y1 double, text string")
    assert [tuple(r) for r in refs.margin_templates(blocks, ["doc"]).collect()] == [(1, "page # of #", 9)]
    lines = spark.createDataFrame([(1, "Section B .... 12"), (1, "Scope   iv"), (1, "Annex C . . . . A-3"), (1, "It was 12"), (2, "Table of Contents"), (2, "One ... 1"), (3, "One ... 1"), (3, "It ends here."), (4, "...... 7"), (4, None)], "page int, text string")
    assert sorted((r.page, r.n_toc, r.n_lines, r.is_toc) for r in refs.toc_pages(lines, ["page"]).collect()) == [(1, 3, 4, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 1, False)]
    assert refs.margin_templates(blocks.where(F.lit(False)), ["doc"]).collect() == []


def test_contents_with_long_page_numbers(spark):
    """Page numbers as long as the caller says; four digits without a word."""
    lines = spark.createDataFrame([(1, "Section 7 ........ 9999"), (1, "Section 7 ........ 10000"), (1, "Part of text 7   9223372036854775807"), (1, "It costs 10000")], "page int, text string")
    assert [(r.n_toc, r.n_lines) for digits in (4, 19) for r in refs.toc_pages(lines, ["page"], digits=digits).collect()] == [(1, 4), (3, 4)]


def test_toc_density_with_large_keys(spark, tmp_path):
    """Suppliers' keys of five digits and more, as larger tables have them, against the SQL."""
    import duckdb

    from folioflux.plans import registry

    rows = [(o, 5 + o * 10**6, s, n) for o, s in ((1, 9999), (2, 10000), (3, 9223372036854775807)) for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = registry.QUERIES["toc_density"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(duck.sql(registry.ORACLES["toc_density"]).fetchall())
