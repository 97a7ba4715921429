"""Queries of review writes, corrections, reuse, reference joins and grid reads, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.operators import references as refs
from folioflux.operators import workflow as wf
from folioflux.plans.catalog import query

_FIELDS_SQL = "SELECT doc_id, CAST(quality AS VARCHAR) AS value, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'pending' END AS status FROM labels"
_ACTIONS_SQL = "SELECT user_id AS doc_id, ts, event_id, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'edit' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'mark_unknown' ELSE event_type END AS action, CASE WHEN event_id % 7 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS new_value FROM events"


def _fields(t):
    return t("labels").select("doc_id", F.col("quality").cast("string").alias("value"), F.when(F.col("toxic") == 1, "rejected").otherwise("pending").alias("status"))


def _actions(t):
    e = F.col("event_type")
    action = F.when(e == "click", "accept").when(e == "view", "edit").when(e == "error", "reject").when(e == "purchase", "mark_unknown").otherwise(e)
    return t("events").select(F.col("user_id").alias("doc_id"), "ts", "event_id", action.alias("action"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.get_json_object("props", "$.k")).alias("new_value"))


@query("review_actions", f"""WITH f AS ({_FIELDS_SQL}), a AS ({_ACTIONS_SQL}),
j AS (SELECT a.*, f.value, f.status, CASE action WHEN 'reject' THEN 'rejected' WHEN 'mark_unknown' THEN 'unknown' ELSE 'accepted' END AS status_after, CASE WHEN action = 'edit' THEN new_value END AS e
FROM a JOIN f ON a.doc_id = f.doc_id WHERE action IN ('accept', 'reject', 'mark_unknown') OR action = 'edit' AND new_value <> '')
SELECT doc_id, ts, event_id, action,
coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value) AS value_before,
coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), value) AS value_after,
coalesce(lag(status_after) OVER (PARTITION BY doc_id ORDER BY ts, event_id), status) AS status_before, status_after FROM j""")
def review_actions(t):
    """The audit of a log of review actions."""
    return wf.review_actions(_fields(t), _actions(t), ["doc_id"], ["ts", "event_id"])


@query("accept_all", f"SELECT doc_id, value, CASE WHEN status = 'pending' THEN 'accepted' ELSE status END AS status FROM ({_FIELDS_SQL})")
def accept_all(t):
    """Every pending field accepted."""
    return wf.accept_all(_fields(t), ["doc_id"])[0]


@query("accept_all_audit", f"SELECT doc_id, 'accept' AS action, status AS status_before, 'accepted' AS status_after FROM ({_FIELDS_SQL}) WHERE status = 'pending'")
def accept_all_audit(t):
    """The audit rows of accepting all."""
    return wf.accept_all(_fields(t), ["doc_id"])[1]


@query("corrections", """WITH c AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT p_partkey, coalesce(event_type, p_type) AS value, CASE WHEN event_type IS NOT NULL THEN p_type END AS original, CAST(event_id AS VARCHAR) AS corrected_by FROM part LEFT JOIN c ON p_partkey = user_id AND n = 1""")
def corrections(t):
    """Targets with their newest correction, the extracted value kept beside it."""
    made = t("events").select(F.col("user_id").alias("p_partkey"), F.col("event_type").alias("corrected"), F.col("event_id").cast("string").alias("by"), "ts", "event_id")
    return wf.corrected(t("part").select("p_partkey", F.col("p_type").alias("value")), made, ["p_partkey"], ["ts", "event_id"])


@query("content_reuse", """WITH r AS (SELECT o_custkey, max(CASE WHEN year(o_orderdate) = 2000 THEN o_orderkey END) AS reuse_run, max(year(o_orderdate)) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, reuse_run, CAST(latest AS INTEGER) AS latest, CASE WHEN reuse_run IS NOT NULL THEN 'reuse' WHEN latest IS NOT NULL THEN 'rebuild' ELSE 'run' END AS decision FROM customer LEFT JOIN r ON c_custkey = o_custkey""")
def content_reuse(t):
    """Documents whose content has a finished run of the current version, of an older one, or of none."""
    runs = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.year("o_orderdate").alias("version"))
    return wf.reusable(runs, t("customer").select("c_custkey"), "c_custkey", 2000)


#: How the citations are made: an item cites its part's number, a tenth of them one that isn't there, with a title and date.
_CITED = """SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS place, CASE WHEN l_tax >= 0.08 THEN l_partkey + 1000000 ELSE l_partkey END AS number, l_discount AS confidence,
  CASE WHEN l_discount >= 0.09 THEN 'other ' ELSE '' END || p_name || CASE WHEN l_returnflag = 'R' THEN ' Alternate II' ELSE '' END || CASE WHEN l_linestatus = 'O' THEN ' (JAN ' || (1990 + p_size % 20 + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) || ')' ELSE '' END AS title FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("reference_match", f"""WITH c AS ({_CITED}),
x AS (SELECT *, nullif(regexp_extract(title, '\\((JAN [0-9]{{4}})\\)', 1), '') AS d, CASE WHEN contains(title, 'Alternate II') THEN 'II' END AS alt, regexp_replace(regexp_replace(title, ' \\(JAN [0-9]+\\)', ''), ' Alternate II', '') AS bare FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, number, alt, d ORDER BY confidence DESC, place) AS rn FROM x)
SELECT l_orderkey, r.number, d AS date, alt AS alternate, bare AS title, CASE WHEN p_partkey IS NULL THEN 'not_found' WHEN p_size % 10 = 0 THEN 'record_type_mismatch' WHEN bare <> p_name THEN 'title_mismatch' WHEN d IS NOT NULL AND d <> 'JAN ' || (1990 + p_size % 20) THEN 'date_mismatch' ELSE 'matched' END AS match_status,
  CASE WHEN p_partkey IS NOT NULL AND p_size % 10 <> 0 AND bare = p_name AND (d IS NULL OR d = 'JAN ' || (1990 + p_size % 20)) THEN 'Verified' ELSE 'Needs Review' END AS qa_status
FROM r LEFT JOIN part ON r.number = p_partkey WHERE rn = 1""")
def reference_match(t):
    """Clauses that orders cite, each once, against parts as the master table: found, of the right kind, title and date."""
    p = t("part").withColumn("year", 1990 + F.col("p_size") % 20)
    joined = t("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    empty = F.lit("")
    date = F.concat(F.lit(" (JAN "), (F.col("year") + F.when(F.col("l_quantity") > 40, 1).otherwise(0)).cast("string"), F.lit(")"))
    title = F.concat(F.when(F.col("l_discount") >= 0.09, "other ").otherwise(empty), "p_name", F.when(F.col("l_returnflag") == "R", " Alternate II").otherwise(empty), F.when(F.col("l_linestatus") == "O", date).otherwise(empty))
    number = F.when(F.col("l_tax") >= 0.08, F.col("l_partkey") + 1000000).otherwise(F.col("l_partkey"))
    citations = joined.select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"), F.lit(None).cast("string").alias("regulation"), number.alias("number"), title.alias("title"), F.col("l_discount").alias("confidence"))
    master = p.select(F.col("p_partkey").alias("number"), F.when(F.col("p_size") % 10 == 0, "Provision").otherwise("Clause").alias("record_type"), F.col("p_name").alias("clause_title"), F.concat(F.lit("JAN "), F.col("year").cast("string")).alias("effective_date"))
    return refs.clause_references(citations, master, ["l_orderkey"]).select("l_orderkey", "number", "date", "alternate", "title", "match_status", "qa_status")


@query("contract_keys", """WITH k AS (SELECT DISTINCT p_partkey, upper(regexp_replace(unnest(regexp_extract_all(p_brand || ' / ' || p_type || '-' || p_size, '[A-Za-z]+[#-][0-9]+')), '[^A-Za-z0-9]', '', 'g')) AS key FROM part)
SELECT key, count(*) AS documents, min(p_partkey) AS first_document FROM k GROUP BY key HAVING count(*) > 1""")
def contract_keys(t):
    """Numbers as join keys: found by shape, without separators and in capitals; those that several documents cite."""
    text = F.concat_ws("", "p_brand", F.lit(" / "), "p_type", F.lit("-"), F.col("p_size").cast("string"))
    found = t("part").select("p_partkey", F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]+[#-][0-9]+"), F.lit(0))).alias("k"))
    keys = found.select("p_partkey", F.upper(F.regexp_replace("k", "[^A-Za-z0-9]", "")).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("documents"), F.min("p_partkey").alias("first_document")).where("documents > 1")


@query("relationship_score", """WITH c AS (SELECT *, 'n' || o_custkey AS cited FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
m AS (SELECT c.o_orderkey AS child, p.o_orderkey AS parent, p.o_orderpriority = c.o_orderpriority AS party, p.o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS base, c.o_orderdate >= p.o_orderdate AS dates
  FROM c JOIN orders p ON upper(c.cited) = 'N' || p.o_custkey AND p.o_orderstatus = 'F' AND p.o_orderkey <> c.o_orderkey),
s AS (SELECT *, 70 + CASE WHEN party THEN 7 ELSE 0 END + CASE WHEN base THEN 5 ELSE 0 END + CASE WHEN dates THEN 3 ELSE 0 END AS points FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY points DESC, parent) AS rn FROM s)
SELECT child, parent, points / 100.0::DOUBLE AS confidence, 'contract_number' AS matched_on, 'Matching contract number' || CASE WHEN party THEN ', Same counterparty' ELSE '' END || CASE WHEN base THEN ', Compatible document type' ELSE '' END || CASE WHEN dates THEN ', Compatible date range' ELSE '' END AS reasons FROM r WHERE rn = 1""")
def relationship_score(t):
    """Urgent orders as supporting documents, which cite their customer's number; finished orders that have it as parents."""
    o = t("orders")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    none = F.lit(None).cast("string")
    children = o.where(urgent).select(F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("party"), none.alias("second_party"), F.col("o_orderdate").alias("date"))
    numbers = o.where(urgent).select(F.col("o_orderkey").alias("child"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("number"))
    parents = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("parent"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("number"), none.alias("title"), F.col("o_orderpriority").alias("party"), none.alias("second_party"), F.col("o_orderdate").alias("date"), (~urgent).alias("base"))
    return refs.detected_parents(children, parents, numbers).withColumn("reasons", F.array_join("reasons", ", "))


@query("grid_search", """SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)), '12')""")
def grid_search(t):
    """Rows with a text in any of their cells."""
    cells = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return t("customer").where(F.exists(F.array(*[F.col(c).cast("string") for c in cells]), lambda c: F.contains(F.lower(c), F.lit("12")))).select("c_custkey")


@query("column_fill", """WITH j AS (SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality, CASE WHEN l.toxic = 2 THEN 'x' END AS never FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT 'lang' AS name, count(*) AS n, count(lang) AS filled FROM j UNION ALL SELECT 'source', count(*), count(source) FROM j UNION ALL SELECT 'quality', count(*), count(quality) FROM j UNION ALL SELECT 'never', count(*), count(never) FROM j)
SELECT name, n, filled, CASE WHEN filled = 0 THEN 'blank' WHEN filled < 0.5 * n THEN 'sparse' ELSE 'shown' END AS kind FROM u""")
def column_fill(t):
    """Which columns of a grid are blank, sparse or shown: one pass over the rows, one row a column out."""
    j = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left").withColumn("never", F.when(F.col("toxic") == 2, "x"))
    names = ("lang", "source", "quality", "never")
    filled = j.agg(F.count("*").alias("n"), *[F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in names])
    each = filled.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in names])).alias("x"))
    return each.select("x.name", "n", "x.filled", F.when(F.col("x.filled") == 0, "blank").when(F.col("x.filled") < 0.5 * F.col("n"), "sparse").otherwise("shown").alias("kind"))


@query("drill_through", """SELECT source, lang, count(*) AS n, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM documents JOIN labels USING (doc_id) WHERE NOT (toxic = 1) AND n_chars BETWEEN 200 AND 5000 GROUP BY 1, 2""")
def drill_through(t):
    """What a chart's segment stands for: the rows of a class within a range, by its two dimensions."""
    j = t("documents").select("doc_id", "source", "lang", "n_chars").where(F.col("n_chars").between(200, 5000)).join(t("labels").where("not toxic = 1"), "doc_id")
    return j.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low"))
