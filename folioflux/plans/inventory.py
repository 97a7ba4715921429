"""Further queries of the inventory: distinct rows, numbering, chunks, flags, permissions, boxes, citations; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflux.functions import text as tx
from folioflux.operators import sequence as seq
from folioflux.plans.catalog import query


@query("rows_distinct", "SELECT lower(event_type) AS label, lower(json_extract_string(props, '$.k')) AS value, min(event_id) AS first_row, count(*) AS n FROM events GROUP BY 1, 2")
def rows_distinct(t):
    """Rows that differ in label or value, in any case; the first of each stands for it."""
    return t("events").groupBy(F.lower("event_type").alias("label"), F.lower(F.get_json_object("props", "$.k")).alias("value")).agg(F.min("event_id").alias("first_row"), F.count("*").alias("n"))


@query("multiset_difference", "SELECT o_custkey AS k, count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT user_id FROM events) GROUP BY 1")
def multiset_difference(t):
    """What is left of the words of one side when the other's are taken away, once for each time they occur."""
    left = t("orders").select(F.col("o_custkey").alias("k"))
    return left.exceptAll(t("events").select("user_id")).groupBy("k").agg(F.count("*").alias("n"))


@query("display_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS display_order, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders")
def display_order(t):
    """Each row's number among all and within its party; no task holds all rows, or all of a party's."""
    order = ["o_orderdate", "o_orderkey"]
    one = seq.numbered(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), [], order, "display_order")
    return seq.numbered(one, ["o_custkey"], order, "sequence").select("o_orderkey", "display_order", "sequence")


@query("batches", "SELECT event_type, (rn - 1) // 50 AS batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) GROUP BY event_type, CAST(ts AS DATE), batch")
def batches(t):
    """Work of a kind and day in batches of fifty."""
    e = t("events").select("event_type", "event_id", F.to_date("ts").alias("day"))
    numbered = seq.numbered(e, ["event_type", "day"], ["event_id"]).withColumn("batch", F.floor((F.col("number") - 1) / 50))
    return numbered.groupBy("event_type", "day", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("event_type", "batch", "n", "first_id")


@query("document_confidence", """SELECT o_orderkey, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(l_orderkey), 0) AS confidence, count(l_orderkey) AS fields, coalesce(bool_or(l_discount < 0.02), false) AS needs_review FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def document_confidence(t):
    """A document's mean confidence, null without fields, and whether a weak field makes it need review."""
    per = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double").alias("c"), F.count("*").alias("n"), F.bool_or(F.col("l_discount") < 0.02).alias("weak"))
    j = t("orders").select("o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", (F.col("c") / F.col("n")).alias("confidence"), F.coalesce("n", F.lit(0)).alias("fields"), F.coalesce("weak", F.lit(False)).alias("needs_review"))


@query("confidence_range", "SELECT l_orderkey, l_linenumber, l_returnflag = 'A' IS TRUE AS accepted FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 AND (l_tax > 0.04) IS TRUE")
def confidence_range(t):
    """Fields within a range of confidence whose flag is true; an unknown flag is not."""
    rows = t("lineitem").where(F.col("l_discount").between(0.02, 0.05) & F.coalesce(F.col("l_tax") > 0.04, F.lit(False)))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(F.col("l_returnflag") == "A", F.lit(False)).alias("accepted"))


@query("page_density", r"""WITH l AS (SELECT doc_id, length(trim(unnest(string_split(text, chr(10))))) AS n FROM documents)
SELECT doc_id, count(*) AS lines, CAST(median(n) AS DOUBLE) AS middle, CASE WHEN count(*) < 2 THEN 'single' WHEN median(n) < 40 THEN 'sparse' WHEN median(n) > 200 THEN 'dense' ELSE 'normal' END AS density FROM l WHERE n > 0 GROUP BY 1""")
def page_density(t):
    """Lines of a page, the median of their lengths, and what kind of page that makes. On the row: sorted lengths."""
    n = F.array_sort(F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(x))), lambda n: n > 0))
    p = t("documents").select("doc_id", n.alias("n")).where(F.size("n") > 0).withColumn("lines", F.size("n").cast("long"))
    low, high = F.get("n", F.floor((F.col("lines") - 1) / 2).cast("int")), F.get("n", F.floor(F.col("lines") / 2).cast("int"))
    m = p.select("doc_id", "lines", ((low + high) / 2).alias("middle"))
    return m.select("doc_id", "lines", "middle", F.when(F.col("lines") < 2, "single").when(F.col("middle") < 40, "sparse").when(F.col("middle") > 200, "dense").otherwise("normal").alias("density"))


@query("character_conservation", r"""WITH p AS (SELECT doc_id, text, list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(regexp_replace(regexp_replace(x, '([a-z])-\n([a-z])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS p FROM documents)
SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS before, CAST(list_sum(list_transform(p, lambda x: length(regexp_replace(x, '\s+', '', 'g')))) AS BIGINT) AS after,
  CAST((length(text) - length(regexp_replace(text, '[a-z]-\n[a-z]', '', 'g'))) // 4 AS BIGINT) AS glued FROM p""")
def character_conservation(t):
    """Characters other than blanks in a text and in the paragraphs it became: what is missing are hyphens of words that
    were glued together, which are counted beside."""
    bare = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    after = F.aggregate(tx.paragraphs(F.col("text")), F.lit(0).cast("long"), lambda n, x: n + bare(x))
    return t("documents").select("doc_id", bare(F.col("text")).cast("long").alias("before"), after.alias("after"), F.regexp_count("text", F.lit("[a-z]-\n[a-z]")).cast("long").alias("glued"))


@query("repeated_rows", "SELECT conv_id, turn, text = lag(text) OVER w IS TRUE AS repeats_last, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) > 1 AS seen FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def repeated_rows(t):
    """Rows that repeat the one before, as the header of a continued table does, or any before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    seen = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn")) > 1
    return t("conversations").select("conv_id", "turn", F.coalesce(F.col("text") == F.lag("text").over(w), F.lit(False)).alias("repeats_last"), seen.alias("seen"))


@query("points_in_boxes", "SELECT p_partkey, n_nationkey FROM part JOIN (SELECT n_nationkey, n_nationkey * 2 AS x0, n_nationkey * 2 + 7 AS x1, 900 + n_regionkey * 20 AS y0, 960 + n_regionkey * 20 AS y1 FROM nation) ON p_size BETWEEN x0 AND x1 AND p_retailprice BETWEEN y0 AND y1")
def points_in_boxes(t):
    """Points within boxes: an equi-join on the cells of ten that a box covers, then the bounds."""
    boxes = t("nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("x0"), (F.col("n_nationkey") * 2 + 7).alias("x1"), (F.col("n_regionkey") * 20 + 900).alias("y0"), (F.col("n_regionkey") * 20 + 960).alias("y1"))
    cells = boxes.withColumn("cell", F.explode(F.expr("sequence(x0 div 10, x1 div 10)")))
    points = t("part").select("p_partkey", "p_size", "p_retailprice", F.expr("p_size div 10").alias("cell"))
    return points.join(cells, "cell").where("p_size between x0 and x1 and p_retailprice between y0 and y1").select("p_partkey", "n_nationkey")


@query("permissions", """WITH a(role, action) AS (VALUES ('admin', 'click'), ('admin', 'view'), ('admin', 'error'), ('admin', 'purchase'), ('reviewer', 'click'), ('reviewer', 'view'), ('viewer', 'view')),
e AS (SELECT event_id, event_type, CASE user_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'reviewer' ELSE 'viewer' END AS role FROM events)
SELECT event_id, e.role, a.action IS NOT NULL AS allowed FROM e LEFT JOIN a ON e.role = a.role AND e.event_type = a.action""")
def permissions(t):
    """Whether an actor's role allows what it asks for; what no rule names is refused."""
    rules = {"admin": ("click", "view", "error", "purchase"), "reviewer": ("click", "view"), "viewer": ("view",)}
    role = F.when(F.col("user_id") % 3 == 0, "admin").when(F.col("user_id") % 3 == 1, "reviewer").otherwise("viewer")
    allowed = F.lit(False)
    for name, actions in rules.items():
        allowed = allowed | (F.col("role") == name) & F.coalesce(F.col("event_type").isin(*actions), F.lit(False))
    return t("events").select("event_id", "event_type", role.alias("role")).select("event_id", "role", allowed.alias("allowed"))


@query("selected_json", "SELECT o_orderkey, CAST(to_json({'order': o_orderkey, 'status': o_orderstatus, 'customer': o_custkey}) AS VARCHAR) AS json FROM orders WHERE o_orderkey % 3 = 0")
def selected_json(t):
    """Selected records as JSON with the chosen fields, in their order."""
    chosen = t("orders").where("o_orderkey % 3 = 0")
    return chosen.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))).alias("json"))


_CITED = "'As in 52.' || (200 + p_size) || '-' || (p_partkey % 20) || ', subpart 9.' || (p_partkey % 8) || ' and 48 CFR 52.' || (200 + p_size)"


@query("citation_scan", rf"""WITH s AS (SELECT p_partkey, {_CITED} AS text FROM part), m AS (SELECT p_partkey, regexp_extract_all(text, '[0-9]+ CFR [0-9]+\.[0-9]+') AS code, regexp_replace(text, '[0-9]+ CFR [0-9]+\.[0-9]+', ' ', 'g') AS rest FROM s)
SELECT p_partkey, array_to_string(code, ';') AS code, array_to_string(regexp_extract_all(rest, '[0-9]+\.[0-9]{{3}}(?:-[0-9]+)?'), ';') AS clauses, array_to_string(regexp_extract_all(rest, 'subpart [0-9]+\.[0-9]+'), ';') AS subparts FROM m""")
def citation_scan(t):
    """Typed citations: what the code's numbers have taken is masked before clauses and subparts are looked for."""
    text = F.concat(F.lit("As in 52."), (F.col("p_size") + 200).cast("string"), F.lit("-"), (F.col("p_partkey") % 20).cast("string"), F.lit(", subpart 9."), (F.col("p_partkey") % 8).cast("string"), F.lit(" and 48 CFR 52."), (F.col("p_size") + 200).cast("string"))
    code = r"[0-9]+ CFR [0-9]+\.[0-9]+"
    masked = t("part").select("p_partkey", text.alias("text")).select("p_partkey", "text", F.regexp_replace("text", code, " ").alias("rest"))
    every = lambda c, p: F.array_join(F.regexp_extract_all(c, F.lit(p), F.lit(0)), ";")
    return masked.select("p_partkey", every("text", code).alias("code"), every("rest", r"[0-9]+\.[0-9]{3}(?:-[0-9]+)?").alias("clauses"), every("rest", r"subpart [0-9]+\.[0-9]+").alias("subparts"))


@query("preferred_first", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey LIMIT 40")
def preferred_first(t):
    """The forty first customers, preferred segments before others, then by balance."""
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return t("customer").orderBy(rank, F.col("c_acctbal").desc(), "c_custkey").limit(40).select("c_custkey", "c_mktsegment")
