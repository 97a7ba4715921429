"""Portfolio, review and search queries (§2.3 to 2.5, 2.7, 2.8, 2.12) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import text as tx
from folioflux.functions import values as vx
from folioflux.operators import relational as rel
from folioflux.plans.catalog import query
from folioflux.streaming import events as ev

TODAY = "1998-06-01"


@query("portfolio_mix", "SELECT coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'Unclassified') AS name, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, name LIMIT 12")
def portfolio_mix(t):
    """Documents by family label, with a fallback chain; the twelve most frequent."""
    return rel.histogram(t("documents"), F.coalesce(tx.blank_to_null(F.col("lang")), tx.blank_to_null(F.col("source")), F.lit("Unclassified")), n=12)


@query("uploads_by_month", "SELECT month, n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12) ORDER BY month")
def uploads_by_month(t):
    """Monthly series of the last twelve months that occur."""
    months = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return rel.top_n(months, [F.col("month").desc()], 12).orderBy("month")


@query("status_rollup", """SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n, avg(n_chars) AS mean, min(n_chars) AS least, max(n_chars) AS most
FROM labels JOIN documents USING (doc_id) GROUP BY quality""")
def status_rollup(t):
    """Count and mean by review status."""
    joined = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return joined.groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("weighted_mean", """SELECT sum(s) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n FROM
(SELECT CAST(sum(n_chars) AS DOUBLE) AS s, count(*) AS n FROM documents WHERE n_chars <> 0 GROUP BY source)""")
def weighted_mean(t):
    """Mean of group means, weighted by group; zeros count as missing."""
    groups = t("documents").where("n_chars <> 0").groupBy("source").agg(F.sum("n_chars").cast("double").alias("s"), F.count("*").alias("n"))
    return groups.agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


@query("low_quality_docs", "SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 0 GROUP BY source")
def low_quality_docs(t):
    """Filtered grouped count."""
    return t("documents").join(t("labels").where("quality = 0 and toxic = 0"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("clause_top12", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_orders, min(l_returnflag) AS flag FROM lineitem GROUP BY 1 ORDER BY n_orders DESC, l_partkey LIMIT 12")
def clause_top12(t):
    """Distinct documents by clause, twelve most cited."""
    cited = t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.min("l_returnflag").alias("flag"))
    return rel.top_n(cited, [F.col("n_orders").desc(), F.col("l_partkey")], 12)


@query("duplicate_groups", "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(t):
    """Checksums that more than one document has."""
    return rel.duplicate_groups(t("documents"), "doc_id", F.sha2("text", 256))


@query("duplicate_lookup", """SELECT d.doc_id, e.n - 1 AS others FROM documents d JOIN (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1) e ON md5(d.text) = e.h""")
def duplicate_lookup(t):
    """For each document how many others have its checksum."""
    d = t("documents").select("doc_id", F.md5("text").alias("h"))
    return d.join(d.groupBy("h").agg(F.count("*").alias("n")), "h").select("doc_id", (F.col("n") - 1).alias("others"))


@query("expiring_orders", f"""SELECT o_orderkey, c_name, date_diff('day', DATE '{TODAY}', CAST(o_orderdate AS DATE)) AS days_left FROM orders JOIN customer ON o_custkey = c_custkey
WHERE date_diff('day', DATE '{TODAY}', CAST(o_orderdate AS DATE)) BETWEEN -30 AND 180 ORDER BY days_left, o_orderkey LIMIT 50""")
def expiring_orders(t):
    """What ends within 180 days, or ended up to 30 days ago; the soonest fifty."""
    due = t("orders").select("o_orderkey", "o_custkey", F.datediff(F.to_date("o_orderdate"), F.lit(TODAY).cast("date")).cast("long").alias("days_left")).where("days_left between -30 and 180")
    return rel.top_n(due.join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "days_left"), [F.col("days_left"), F.col("o_orderkey")], 50)


@query("risk_register", f"""WITH r AS (
SELECT 'toxic_text' AS kind, 'high' AS severity, 'doc' || doc_id AS subject FROM labels WHERE toxic = 1
UNION ALL SELECT 'low_quality', 'medium', 'doc' || doc_id FROM labels WHERE quality = 0
UNION ALL SELECT 'duplicate', 'low', 'doc' || min(doc_id) FROM documents GROUP BY md5(text) HAVING count(*) > 1
UNION ALL SELECT 'short_text', 'low', 'doc' || doc_id FROM documents WHERE n_chars < 100
UNION ALL SELECT 'stale_order', 'high', 'order' || o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'negative_balance', 'medium', c_name FROM customer WHERE c_acctbal < -900
UNION ALL SELECT 'unlabelled', 'low', 'doc' || doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT * FROM r ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, kind, subject LIMIT 200""")
def risk_register(t):
    """Seven rules in one list, the gravest two hundred."""
    d, labels = t("documents"), t("labels")
    doc = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    rule = lambda df, kind, severity, subject: df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), subject.alias("subject"))
    every = [
        rule(labels.where("toxic = 1"), "toxic_text", "high", doc),
        rule(labels.where("quality = 0"), "low_quality", "medium", doc),
        rule(rel.duplicate_groups(d, "doc_id", F.md5("text")), "duplicate", "low", F.concat(F.lit("doc"), F.col("first_id").cast("string"))),
        rule(d.where("n_chars < 100"), "short_text", "low", doc),
        rule(t("orders").where("o_orderstatus = 'O' and o_orderdate < timestamp'1996-01-01'"), "stale_order", "high", F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))),
        rule(t("customer").where("c_acctbal < -900"), "negative_balance", "medium", F.col("c_name")),
        rule(d.join(labels, "doc_id", "left_anti"), "unlabelled", "low", doc),
    ]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return rel.top_n(out, [rank, F.col("kind"), F.col("subject")], 200)


@query("severity_counts", """SELECT k AS severity, count(q) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('none')) v(k)
LEFT JOIN (SELECT CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS q FROM labels) ON k = q GROUP BY k""")
def severity_counts(t):
    """Counts with fixed keys, zero where none."""
    s = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    counts = t("labels").agg(*[F.count(F.when(s == k, 1)).alias(k) for k in ("high", "medium", "low", "none")])
    return counts.unpivot([], ["high", "medium", "low", "none"], "severity", "n")


@query("kpi_dashboard", """SELECT count(*) AS total, count(CASE WHEN toxic = 1 THEN 1 END) AS failed, count(CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 1 END) AS processing,
100.0 * count(CASE WHEN quality = 1 THEN 1 END) / nullif(count(l.doc_id), 0)::DOUBLE AS accepted_share, 100.0 * count(l.doc_id) / count(*)::DOUBLE AS reviewed_share,
CAST(sum(d.n_chars) AS DOUBLE) / count(*) AS mean_chars, count(DISTINCT lang) AS n_lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def kpi_dashboard(t):
    """Counts, shares and means in one aggregate; failed documents count as processing too."""
    j = t("documents").join(t("labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), F.col("doc_id") == F.col("id"), "left")
    share = lambda p, of: F.count(F.when(p, 1)) * 100.0 / F.nullif(of, F.lit(0)).cast("double")
    return j.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("toxic") == 1, 1)).alias("failed"), F.count(F.when(F.col("id").isNull() | (F.col("toxic") == 1), 1)).alias("processing"),
        share(F.col("quality") == 1, F.count("id")).alias("accepted_share"), share(F.col("id").isNotNull(), F.count("*")).alias("reviewed_share"),
        (F.sum("n_chars").cast("double") / F.count("*")).alias("mean_chars"), F.countDistinct("lang").alias("n_lang"),
    )


@query("review_buckets", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN 'rejected' WHEN l.doc_id IS NULL THEN 'unknown' WHEN d.n_chars >= 4000 THEN 'high'
WHEN d.n_chars >= 1000 THEN 'medium' ELSE 'low' END AS bucket FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY bucket""")
def review_buckets(t):
    """Ordered buckets: rejected, unknown, high, medium, low."""
    j = t("documents").join(t("labels").select(F.col("doc_id").alias("id"), "toxic"), F.col("doc_id") == F.col("id"), "left")
    b = F.when(F.col("toxic") == 1, "rejected").when(F.col("id").isNull(), "unknown").when(F.col("n_chars") >= 4000, "high").when(F.col("n_chars") >= 1000, "medium").otherwise("low")
    return j.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("review_queue", """WITH r AS (SELECT source, unnest(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN n_chars < 500 THEN 'short' END,
CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS reason FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, reason, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, reason) AS rn FROM c)
SELECT source, string_agg(reason, ',' ORDER BY rn) AS top_reasons, CAST(sum(n) AS BIGINT) AS n FROM k WHERE rn <= 3 GROUP BY source""")
def review_queue(t):
    """The three most frequent reasons of each source."""
    j = t("documents").select("doc_id", "source", "lang", "n_chars").join(t("labels"), "doc_id")
    reasons = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("n_chars") < 500, "short"), F.when(F.col("lang") != "en", "foreign")), lambda x: x.isNotNull())
    counts = j.select("source", F.explode(reasons).alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason")))
    return counts.groupBy("source").agg(F.slice(ranked, 1, 3).alias("k")).select("source", F.array_join("k.reason", ",").alias("top_reasons"), F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a - x["m"]).alias("n"))


@query("review_fields", """SELECT o_orderkey, o_orderpriority, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 100""")
def review_fields(t):
    """Pending fields with their documents: priority rank, then confidence downwards, then id."""
    j = t("orders").where("o_orderstatus = 'P'").join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    first = F.substring("o_orderpriority", 1, 1)
    return rel.top_n(j, [F.when(first == "1", 0).when(first == "2", 1).otherwise(2), F.col("o_totalprice").desc(), F.col("o_orderkey")], 100).select("o_orderkey", "o_orderpriority", "c_name")


@query("repo_search", """WITH h AS (SELECT doc_id AS id FROM documents WHERE source ILIKE '%src1%' UNION SELECT doc_id FROM documents WHERE text ILIKE '%worthless%' UNION SELECT conv_id FROM conversations WHERE text ILIKE '%stupid%')
SELECT d.doc_id, d.source, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT id FROM h)) AS total FROM documents d WHERE doc_id IN (SELECT id FROM h) ORDER BY doc_id DESC LIMIT 25 OFFSET 10""")
def repo_search(t):
    """Three searches, their ids united, a semi-join, and one page of the hits with their number."""
    d = t("documents")
    hits = rel.union_distinct(d.where(F.col("source").ilike("%src1%")).select(F.col("doc_id").alias("id")), d.where(F.col("text").ilike("%worthless%")).select("doc_id"), t("conversations").where(F.col("text").ilike("%stupid%")).select("conv_id"))
    found = d.select("doc_id", "source").join(hits, F.col("doc_id") == F.col("id"), "left_semi")
    page = rel.top_n(found, [F.col("doc_id").desc()], 25, offset=10)
    return page.withColumn("total", found.agg(F.count("*")).scalar())


@query("family_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def family_semi(t):
    """Documents of a family."""
    return t("documents").select("doc_id", "source").join(t("labels").where("quality = 1"), "doc_id", "left_semi")


@query("unlabeled_anti", "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def unlabeled_anti(t):
    """Documents of no family."""
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left_anti")


@query("hierarchy", """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, NULL AS up FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
w AS (SELECT node, node AS root, 0 AS depth FROM e WHERE up IS NULL UNION ALL SELECT e.node, w.root, w.depth + 1 FROM e JOIN w ON e.up = w.node) SELECT * FROM w""")
def hierarchy(t):
    """Every node's root and depth."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t("region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up"))
    edges = edges.union(t("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(t("customer").select(name("c", "c_custkey"), name("n", "c_nationkey")))
    return rel.roots(edges, "node", "up")


@query("portfolio_members", "SELECT n_regionkey AS root, count(*) AS members FROM (SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY 1")
def portfolio_members(t):
    """Id is the root, or the parent is: two equi-joins united."""
    return t("nation").select(F.col("n_regionkey").alias("root")).union(t("region").select("r_regionkey")).groupBy("root").agg(F.count("*").alias("members"))


@query("field_buckets", """SELECT k AS value, count(*) AS n FROM (SELECT user_id, arg_min(json_extract_string(props, '$.k'), event_id) AS k FROM events GROUP BY user_id) GROUP BY k""")
def field_buckets(t):
    """Each document's first value of a field, counted."""
    first = t("events").groupBy("user_id").agg(F.min_by(F.get_json_object("props", "$.k"), "event_id").alias("value"))
    return first.groupBy("value").agg(F.count("*").alias("n"))


@query("latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at FROM events GROUP BY user_id")
def latest_state(t):
    """The last state of each key of a log."""
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"))


@query("best_by_identity", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""")
def best_by_identity(t):
    """The best candidate of each identity."""
    return rel.first_by(t("lineitem"), ["l_partkey", "l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def status_counts(t):
    """Counts and sums by status, without a cap."""
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("audit_page", "SELECT e.event_id, coalesce(c_name, 'Unknown document') AS name FROM events e LEFT JOIN customer ON user_id = c_custkey ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def audit_page(t):
    """One page of the audit log with names, unknown where the document is gone."""
    page = rel.top_n(t("events").select("event_id", "user_id", "ts"), [F.col("ts").desc(), F.col("event_id")], 50, offset=100)
    return page.join(t("customer").select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.coalesce("c_name", F.lit("Unknown document")).alias("name"))


@query("confidence_score", """SELECT doc_id, round(greatest(CAST(0.05 AS DOUBLE), least(CAST(0.99 AS DOUBLE), least(s, CASE WHEN toxic = 1 THEN CAST(0.59 AS DOUBLE) ELSE CAST(0.99 AS DOUBLE) END))), 2) AS confidence FROM
(SELECT d.doc_id, toxic, CASE WHEN quality = 1 THEN CAST(0.82 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END + CASE WHEN lang = 'en' THEN CAST(0.05 AS DOUBLE) ELSE 0 END + least(CAST(0.10 AS DOUBLE), (d.n_chars // 2000) * CAST(0.03 AS DOUBLE))
- CASE WHEN source = 'src1' THEN CAST(0.25 AS DOUBLE) WHEN source = 'src2' THEN CAST(0.08 AS DOUBLE) ELSE 0 END + CASE WHEN n_chars >= 200 THEN CAST(0.05 AS DOUBLE) ELSE 0 END + CASE WHEN toxic = 1 THEN CAST(-0.20 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END
- CASE WHEN lang = 'fr' THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS s FROM documents d JOIN labels USING (doc_id)) d""")
def confidence_score(t):
    """The confidence model over labels."""
    j = t("documents").join(t("labels"), "doc_id")
    base = vx.method_base(F.when(F.col("quality") == 1, "form_field").otherwise("ai"))
    ocr = F.when(F.col("source") == "src1", False).when(F.col("source") == "src2", True)
    score = vx.confidence(base, F.floor(F.col("n_chars") / 2000) + 1, F.col("lang") == "en", F.col("toxic") == 0, F.col("n_chars") >= 200, F.col("lang") == "fr", ocr=ocr)
    return j.select("doc_id", score.alias("confidence"))


@query("review_decision", """WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN CAST(0.9 AS DOUBLE) WHEN n_chars > 2000 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS c, toxic, lang, n_chars FROM documents JOIN labels USING (doc_id)),
h AS (SELECT *, list_filter([CASE WHEN c < 0.6 THEN 'low_confidence' END, CASE WHEN toxic = 1 THEN 'validation_failed' END, CASE WHEN n_chars < 500 THEN 'not_source_grounded' END, CASE WHEN lang = 'fr' THEN 'ambiguous_candidates' END], lambda x: x IS NOT NULL) AS reasons FROM r)
SELECT doc_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'ready_to_accept' ELSE 'needs_review' END AS status,
CASE WHEN len(reasons) = 0 THEN CASE WHEN c >= 0.85 THEN 'high' ELSE 'medium' END WHEN c < 0.6 OR toxic = 1 OR lang = 'fr' THEN 'low' ELSE 'medium' END AS priority,
CASE WHEN len(reasons) = 0 AND c >= 0.85 THEN 'accepted' ELSE 'pending' END AS review_status FROM h""")
def review_decision(t):
    """Reasons to review, status and priority, high confidence accepted by itself."""
    j = t("documents").join(t("labels"), "doc_id")
    reasons = {"validation_failed": F.col("toxic") == 1, "not_source_grounded": F.col("n_chars") < 500, "ambiguous_candidates": F.col("lang") == "fr"}
    c = F.when(F.col("quality") == 1, 0.9).when(F.col("n_chars") > 2000, 0.7).otherwise(0.5)
    return j.select("doc_id", vx.review(reasons, c, auto_accept=True).alias("r")).select("doc_id", F.array_join("r.reasons", ",").alias("reasons"), "r.status", "r.priority", "r.review_status")


@query("consensus", """SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_values, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'conflict' WHEN count(*) >= 3 THEN 'auto' ELSE 'low_confidence' END AS decision,
arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS value FROM lineitem GROUP BY 1""")
def consensus(t):
    """Candidates of a field: one value, agreed often enough or not, or a conflict."""
    g = t("lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n_values"), F.count("*").alias("n"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("value"))
    return g.select("l_orderkey", "n_values", F.when(F.col("n_values") > 1, "conflict").when(F.col("n") >= 3, "auto").otherwise("low_confidence").alias("decision"), "value")


@query("line_extension", """SELECT l_orderkey, l_linenumber, abs(l_quantity * p_retailprice - l_extendedprice) <= greatest(CAST(0.01 AS DOUBLE), abs(l_quantity) * CAST(0.005 AS DOUBLE)) + CAST(0.005 AS DOUBLE) AS extends
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def line_extension(t):
    """Quantity times price against the amount, within tolerance."""
    j = t("lineitem").join(t("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity")
    return j.select("l_orderkey", "l_linenumber", (F.abs(q * F.col("p_retailprice") - F.col("l_extendedprice")) <= F.greatest(F.lit(0.01), F.abs(q) * 0.005) + 0.005).alias("extends"))


@query("totals_reconcile", """SELECT o_orderkey, CAST(s AS DOUBLE) AS lines, n, abs(CAST(s AS DOUBLE) - o_totalprice) <= greatest(1, n) * CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE) AS agrees FROM orders
JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def totals_reconcile(t):
    """Sum of lines against the stated total."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"), F.count("*").alias("n"))
    j = t("orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", "lines", "n", vx.close(F.col("lines"), F.col("o_totalprice"), F.col("n")).alias("agrees"))


@query("upsert_locked", """WITH e AS (SELECT doc_id, CAST(quality AS VARCHAR) AS value, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'pending' END AS status FROM labels),
i AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS value FROM documents WHERE lang = 'en')
SELECT doc_id, CASE WHEN e.status IN ('accepted', 'rejected') OR i.doc_id IS NULL THEN e.value ELSE i.value END AS value,
CASE WHEN e.status IN ('accepted', 'rejected') AND i.doc_id IS NOT NULL AND e.value IS DISTINCT FROM i.value THEN 'pending' ELSE coalesce(e.status, 'pending') END AS status,
CASE WHEN e.status IN ('accepted', 'rejected') AND i.doc_id IS NOT NULL AND e.value IS DISTINCT FROM i.value THEN 'value_changed' END AS reason, i.value AS machine_value FROM e FULL JOIN i USING (doc_id)""")
def upsert_locked(t):
    """A re-extraction over reviewed values."""
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("pending")
    existing = t("labels").select("doc_id", F.col("quality").cast("string").alias("value"), status.alias("status"))
    incoming = t("documents").where("lang = 'en'").select("doc_id", F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("value"))
    return rel.upsert_reviewed(existing, incoming, ["doc_id"])


@query("qa_rollup", """SELECT v.dataset, coalesce(n, 0) AS n, coalesce(flagged, 0) AS flagged, CASE WHEN coalesce(n, 0) = 0 THEN 'NOT FOUND' WHEN flagged > 0 THEN 'REVIEW' ELSE 'PASS' END AS status
FROM (VALUES ('orders'), ('parts'), ('suppliers'), ('signatures')) v(dataset) LEFT JOIN (
SELECT 'orders' AS dataset, count(*) AS n, count(CASE WHEN o_totalprice <= 0 THEN 1 END) AS flagged FROM orders UNION ALL SELECT 'parts', count(*), count(CASE WHEN p_size > 45 THEN 1 END) FROM part
UNION ALL SELECT 'suppliers', count(*), count(CASE WHEN s_acctbal < 0 THEN 1 END) FROM supplier) q ON v.dataset = q.dataset""")
def qa_rollup(t):
    """A row for each of the known datasets, found or not."""
    one = lambda table, name, p: t(table).agg(F.count("*").alias("n"), F.count(F.when(F.expr(p), 1)).alias("flagged")).select(F.lit(name).alias("dataset"), "n", "flagged")
    found = one("orders", "orders", "o_totalprice <= 0").union(one("part", "parts", "p_size > 45")).union(one("supplier", "suppliers", "s_acctbal < 0"))
    known = t("region").sparkSession.createDataFrame([("orders",), ("parts",), ("suppliers",), ("signatures",)], "dataset string")
    n, flagged = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("flagged", F.lit(0)).cast("long")
    return known.join(found, "dataset", "left").select("dataset", n.alias("n"), flagged.alias("flagged"), F.when(n == 0, "NOT FOUND").when(flagged > 0, "REVIEW").otherwise("PASS").alias("status"))


@query("stale_jobs", "SELECT event_id, 'failed' AS status FROM events WHERE event_type <> 'purchase' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTES")
def stale_jobs(t):
    """Jobs that are still open after thirty minutes, as failed."""
    jobs = t("events").select("event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("processing").alias("status"), F.col("ts").alias("started_at"))
    return ev.stale(jobs, "2024-01-30 00:00:00").select("event_id", "status")


@query("document_summary", """SELECT d.doc_id, coalesce(l.n, 0) AS n_fields, coalesce(c.turns, 0) AS turns, greatest(d.n_chars, coalesce(c.longest, 0)) AS longest FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id LEFT JOIN (SELECT conv_id, count(*) AS turns, max(length(text)) AS longest FROM conversations GROUP BY 1) c ON d.doc_id = c.conv_id""")
def document_summary(t):
    """Aggregates of several tables on each document."""
    fields = t("labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    turns = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("t"), F.max(F.length("text")).cast("long").alias("m"))
    j = t("documents").select("doc_id", "n_chars").join(fields, "doc_id", "left").join(turns, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select("doc_id", zero("n").alias("n_fields"), zero("t").alias("turns"), F.greatest("n_chars", zero("m")).alias("longest"))


@query("set_operations", "SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT conv_id FROM conversations) UNION ALL SELECT doc_id, 'labels_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT conv_id FROM conversations)")
def set_operations(t):
    """Intersection and difference of id sets."""
    conv = t("conversations").select(F.col("conv_id").alias("doc_id"))
    both = t("documents").select("doc_id").intersect(conv).withColumn("side", F.lit("both"))
    return both.union(t("labels").select("doc_id").subtract(conv).withColumn("side", F.lit("labels_only")))


@query("cascade_delete", "SELECT * FROM (SELECT 'orders' AS kind, count(*) AS deleted FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)))")
def cascade_delete(t):
    """Rows that a delete with its dependents takes away."""
    orders = t("orders").join(t("customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("kind"), "deleted")
    return count(orders, "orders").union(count(lines, "lines"))


@query("rollup_cube", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def rollup_cube(t):
    """Subtotals by every combination of two keys."""
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.grouping_id().cast("long").alias("level"))
