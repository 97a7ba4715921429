"""Queries over markup, cells, exports and similarity (§2.1, 2.2, 2.11); those without SQL run Python over batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import similarity as sim
from folioflux.functions import values as vx
from folioflux.operators import bags, cells, exports
from folioflux.plans.catalog import query
from folioflux.sources import files, markup


@query("html_records")
def html_records(t):
    """Readable lines of every page."""
    return markup.html_text(t("pages"), "page_id", "html")


@query("html_tables")
def html_tables(t):
    """Cells of every table of every page."""
    return markup.html_cells(t("pages"), "page_id", "html")


@query("fuzzy_titles")
def fuzzy_titles(t):
    """Names of parts that are alike, each pair of different names once, with the number of parts that have them."""
    return bags.alike(t("part"), name="p_name")


@query("canonical_text")
def canonical_text(t):
    """Canonical texts: NFKC where a text is not plain ASCII."""
    return t("documents").select("doc_id", F.md5(sim.canonical(F.col("text"))).alias("h"))


FIELDS = [cells.Field("p_name", required=True), cells.Field("p_size", "number", positive=True), cells.Field("p_brand", pattern="^Brand#[1-3]"), cells.Field("p_retailprice", "number", positive=True)]


@query("cell_validation", """WITH c AS (SELECT p_partkey, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-3]') THEN 1 ELSE 0 END + CASE WHEN p_size <= 0 THEN 1 ELSE 0 END + CASE WHEN p_retailprice <= 0 THEN 1 ELSE 0 END AS bad FROM part)
SELECT p_partkey, CASE WHEN bad > 0 THEN 'Needs Review' ELSE 'Verified' END AS status, CAST(bad AS BIGINT) AS n_flagged FROM c""")
def cell_validation(t):
    """Every cell checked, and records rolled up."""
    return cells.record_status(cells.validated(cells.cube(t("part"), ["p_partkey"], FIELDS), FIELDS), ["p_partkey"])


def _fields(t):
    """Metadata fields of documents out of labels: two keys each."""
    long = t("labels").select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("field_key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(("quality", "toxic"))])).alias("f"), F.col("quality").alias("q"))
    return long.select(F.col("doc_id").alias("document_id"), "f.*", F.col("f.field_key").alias("label"), F.when((F.col("q") == 1) | (F.col("f.field_key") == "toxic"), "accepted").alias("status"), F.lit("0").alias("page"))


@query("export_fields", """SELECT doc_id AS document_id, field_key, field_key AS label, value, coalesce(CASE WHEN q = 1 OR field_key = 'toxic' THEN 'accepted' END, 'pending') AS status, q = 1 OR field_key = 'toxic' AS authoritative, CAST(1 AS INTEGER) AS page
FROM (SELECT doc_id, quality AS q, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels) UNPIVOT (value FOR field_key IN (quality, toxic))""")
def export_fields(t):
    """One export row a field."""
    return exports.field_records(_fields(t))


@query("export_json", """SELECT doc_id AS document_id, CASE WHEN quality = 1 THEN '{"quality":"1","toxic":"' || toxic || '"}' ELSE '{"toxic":"' || toxic || '"}' END AS json, CASE WHEN quality = 1 THEN '' ELSE 'quality' END AS skipped FROM labels""")
def export_json(t):
    """Approved values of each document as JSON, and what was left out."""
    return exports.document_json(_fields(t)).withColumn("skipped", F.array_join("skipped", ","))


@query("line_items", """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS row, CAST(CAST(l_partkey AS BIGINT) AS VARCHAR) AS item FROM lineitem""")
def line_items(t):
    """Nested tables of orders, the largest as rows."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    tables = t("lineitem").groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", F.lit("lines").alias("table_key"), F.array(F.lit("line"), F.lit("item")).alias("headers"), "rows")
    return exports.largest_table(tables, "l_orderkey").select("l_orderkey", "row", F.col("cells")["item"].alias("item"))


@query("selection_export", """SELECT n_nationkey, CASE WHEN n_regionkey IN (0, 1) THEN n_name END AS n_name, CASE WHEN n_regionkey <> 1 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation WHERE n_regionkey < 3""")
def selection_export(t):
    """Chosen cells of chosen records, in the source's order."""
    n = t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    fields = F.filter(F.array(F.when(F.col("n_regionkey").isin("0", "1"), "n_name"), F.when(F.col("n_regionkey") != "1", "n_regionkey")), lambda x: x.isNotNull())
    return exports.selected(n, n.where("n_regionkey < 3").select("n_nationkey", fields.alias("fields")), ["n_name", "n_regionkey"], "n_nationkey", "n_nationkey")


@query("sheet_titles", """SELECT c_custkey, CASE WHEN rn = 1 THEN t ELSE t || ' ' || rn END AS title FROM (SELECT c_custkey, c_mktsegment AS t, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS rn FROM customer)""")
def sheet_titles(t):
    """Titles made unique."""
    return exports.sheet_titles(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "title")


@query("display_names", r"""SELECT page_id, CASE WHEN b = '' THEN 'document' ELSE substr(b, 1, 146) END || '.pdf' AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(string_split(url, '/')[-1], '[<>:"|?*]', '_', 'g'), '\s+', ' ', 'g')) AS b FROM pages)""")
def display_names(t):
    """Safe file names of urls."""
    return t("pages").select("page_id", files.display_name(F.col("url")).alias("name"))


@query("ocr_need", r"""SELECT doc_id, CASE WHEN n = 0 THEN 'blank_page' ELSE array_to_string(list_filter([CASE WHEN n < 40 THEN 'few_characters' END, CASE WHEN w < 8 THEN 'few_words' END], lambda x: x IS NOT NULL), ',') END AS reasons
FROM (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[^\s]+')) AS w FROM documents)""")
def ocr_need(t):
    """Why a page would need OCR."""
    zero = F.lit(0.0)
    r = files.ocr_reasons(F.length("text"), F.regexp_count("text", F.lit(r"[^\s]+")), F.lit(1.0), zero, zero)
    return t("documents").select("doc_id", F.array_join(r, ",").alias("reasons"))


@query("money_values", "SELECT s_suppkey, round(s_acctbal, 2) AS amount FROM supplier")
def money_values(t):
    """Printed amounts read back."""
    return t("supplier").select("s_suppkey", vx.money(F.concat(F.lit("$ "), F.format_string("%.2f", "s_acctbal"))).alias("amount"))


@query("typed_references", r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s]+')) AS urls, len(regexp_extract_all(regexp_replace(text, 'https?://[^\s]+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails FROM documents""")
def typed_references(t):
    """References of ordered kinds: what an earlier kind has taken is masked for the later."""
    url, mail = r"https?://[^\s]+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return t("documents").select("doc_id", F.regexp_count("text", F.lit(url)).cast("long").alias("urls"), F.regexp_count(F.regexp_replace("text", url, " "), F.lit(mail)).cast("long").alias("emails"))
