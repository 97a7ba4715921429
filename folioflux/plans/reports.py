"""Queries on jobs and reports (§2.12.9, 2.6.17, 2.5.45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import evidence as ev
from folioflux.operators import exports as ex
from folioflux.operators import portfolio as pf
from folioflux.operators import references as refs
from folioflux.operators import validation as val
from folioflux.operators import workflow as wf
from folioflux.plans.catalog import query
from folioflux.streaming import jobs


@query("job_states", """WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
j AS (SELECT *, sum(CASE WHEN gap < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS job FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS n_stages, last(event_type ORDER BY ts, event_id) AS last_stage, coalesce(max(CASE WHEN gap < 1800000000 THEN gap END), 0) / 1e6::DOUBLE AS longest_seconds,
  CASE WHEN last(event_type ORDER BY ts, event_id) = 'purchase' THEN 'succeeded' ELSE 'failed' END AS status FROM j GROUP BY user_id, job""")
def job_states(t):
    """Jobs of all users: stages less than half an hour apart."""
    return jobs.job_states(t("events"))


_CHECKS = """no_key|every item names its order|l_orderkey IS NULL
quantity|quantities are positive|l_quantity <= 0
discount|discounts lie in 0 to 1|l_discount < 0 OR l_discount > 1
tax|taxes lie in 0 to 1|l_tax < 0 OR l_tax > 1
flag|return flags are A, N or R|l_returnflag NOT IN ('A', 'N', 'R')
status|line status is O or F|l_linestatus NOT IN ('O', 'F')
price|prices are positive|l_extendedprice <= 0
cents|prices have two decimals|abs(l_extendedprice * 100 - round(l_extendedprice * 100)) > 0.000001
line|line numbers lie in 1 to 7|l_linenumber < 1 OR l_linenumber > 7
shipped|no item ships after 2001|l_shipdate > TIMESTAMP '2001-12-31 00:00:00'
free|no item is free after its discount|l_extendedprice * (1 - l_discount) <= 0
part|every item names its part|l_partkey IS NULL
supplier|every item names its supplier|l_suppkey IS NULL"""
RULES = [tuple(r.split("|", 2)) for r in _CHECKS.splitlines()]
_ROWS = " UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS \"check\", '{e}' AS expected, CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) AS value FROM lineitem" for i, (n, e, c) in enumerate(RULES, 1))


@query("validation_report", f"""WITH r AS ({_ROWS} UNION ALL SELECT {len(RULES) + 1}, 'rows', 'there are items', CAST(count(*) AS DOUBLE) FROM lineitem UNION ALL SELECT {len(RULES) + 2}, 'mean_quantity', 'the mean quantity lies in 20 to 30', avg(l_quantity) FROM lineitem)
SELECT CAST(place AS INTEGER) AS place, "check", expected, round(value, 6) AS value, CASE WHEN CASE "check" WHEN 'rows' THEN value >= 1 WHEN 'mean_quantity' THEN value BETWEEN 20 AND 30 ELSE value = 0 END THEN 'PASS' ELSE 'REVIEW' END AS result FROM r""")
def validation_report(t):
    """Fifteen checks of all items in one scan."""
    rules = [val.violations(n, e, F.expr(c)) for n, e, c in RULES]
    rules += [val.between("rows", "there are items", F.count("*"), 1, 1e18), val.between("mean_quantity", "the mean quantity lies in 20 to 30", F.avg("l_quantity"), 20, 30)]
    return val.report(t("lineitem"), rules).withColumn("value", F.round("value", 6))


_DAY = "2000-06-15"


@query("portfolio_bundle", f"""WITH d AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'queued' END ELSE 'failed' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'order' END AS kind FROM orders),
r AS (SELECT 'mix' AS section, coalesce(kind, CASE WHEN o_orderkey % 7 = 0 THEN 'Unclassified' ELSE 'order' END) AS name, count(*) AS n, 0.0::DOUBLE AS total FROM d GROUP BY ALL
  UNION ALL SELECT 'status', s, (SELECT count(*) FROM d WHERE CASE WHEN status = 'completed' THEN 'processed' WHEN status = 'failed' THEN 'failed' WHEN status IS NULL THEN 'not_processed' ELSE 'processing' END = s), 0.0 FROM (VALUES ('processed'), ('failed'), ('not_processed'), ('processing')) v(s)
  UNION ALL (SELECT 'month', strftime(o_orderdate, '%Y-%m') AS m, count(*), 0.0 FROM d GROUP BY m ORDER BY m DESC LIMIT 12)
  UNION ALL SELECT 'today', 'uploads', count(*), coalesce(sum(o_custkey % 40), 0)::DOUBLE FROM d WHERE CAST(o_orderdate AS DATE) = DATE '{_DAY}'
  UNION ALL SELECT 'processing', 'durations', count(*), coalesce(sum(o_orderkey % 100), 0)::DOUBLE FROM d WHERE o_orderkey % 100 > 0
  UNION ALL SELECT 'duplicates', 'checksums', count(*), coalesce(sum(c), 0)::DOUBLE FROM (SELECT count(*) AS c FROM d GROUP BY o_custkey HAVING count(*) > 1))
SELECT * FROM r""")
def portfolio_bundle(t):
    """All that a portfolio shows, with orders as documents and half of their priorities as families."""
    key, low = F.col("o_orderkey"), F.col("o_orderpriority") == "5-LOW"
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", F.when(key % 3 != 0, "queued")).otherwise("failed")
    docs = t("orders").select(key.alias("id"), status.alias("status"), F.when(key % 7 != 0, "order").alias("type"), F.col("o_orderdate").alias("uploaded_at"), (F.col("o_custkey") % 40).alias("pages"), (key % 100).alias("seconds"), F.col("o_custkey").alias("checksum"))
    families = t("orders").where("o_orderkey % 2 = 0").select(key.alias("id"), F.when(low, "unknown").otherwise("priority").alias("family"), F.when(~low, F.col("o_orderpriority")).alias("label"))
    return pf.bundle(docs, families, _DAY)


@query("relationship_writes", """WITH RECURSIVE r AS (SELECT c_custkey AS child, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 WHEN c_custkey % 6 = 1 THEN c_custkey - 1 ELSE c_custkey // 2 END AS parent, CASE WHEN c_custkey % 3 = 2 THEN CASE WHEN c_custkey % 4 = 0 THEN 'rejected' ELSE 'confirmed' END ELSE 'pending' END AS status,
  CASE c_nationkey % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'confirm' WHEN 2 THEN 'reject' ELSE NULL END AS action FROM customer),
m AS (SELECT *, coalesce(status = 'pending' AND action IN ('confirm', 'reject'), false) AS may FROM r),
e AS (SELECT child, parent FROM m WHERE (status = 'confirmed' AND NOT may) OR (may AND action = 'confirm')),
w AS (SELECT child AS start, parent AS node FROM e UNION SELECT start, e.parent FROM w JOIN e ON w.node = e.child),
g AS (SELECT DISTINCT start FROM w WHERE start = node),
o AS (SELECT m.*, CASE WHEN action IS NULL THEN NULL WHEN NOT may THEN 'not_allowed' WHEN action = 'confirm' AND g.start IS NOT NULL THEN 'cycle' ELSE 'done' END AS outcome FROM m LEFT JOIN g ON m.child = g.start)
SELECT child, parent, CASE WHEN outcome = 'done' THEN CASE action WHEN 'confirm' THEN 'confirmed' ELSE 'rejected' END ELSE status END AS status, outcome, CASE WHEN outcome = 'done' THEN 'reviewer ' || action END AS audit FROM o""")
def relationship_writes(t):
    """Customers as documents under each other: confirmations and rejections, cycles refused."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    parent = F.when(k % 3 == 0, k + 1).when(k % 6 == 1, k - 1).otherwise(F.floor(k / 2))
    status = F.when(k % 3 == 2, F.when(k % 4 == 0, "rejected").otherwise("confirmed")).otherwise("pending")
    relations = t("customer").select(k.alias("child"), parent.alias("parent"), status.alias("status"))
    actions = t("customer").where(nation % 4 < 3).select(k.alias("child"), F.when(nation % 4 < 2, "confirm").otherwise("reject").alias("action"), F.lit("reviewer").alias("actor"))
    return wf.relationship_writes(relations, actions)


@query("evidence", r"""SELECT p_partkey, contains(' ' || p_name || ' ', ' ' || split_part(p_name, ' ', 2) || ' ') AS word, contains(' ' || p_name || ' ', ' ' || substr(split_part(p_name, ' ', 2), 1, 3) || ' ') AS part_of_word, p_size % 2 = 0 AS figure,
CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN true ELSE p_size % 4 = 0 END AS amount FROM part""")
def evidence(t):
    """Names and prices of parts against sources that state them, or something near."""
    second = F.split("p_name", " ")[1]
    price = F.concat(F.lit("Price: $ "), F.format_number(F.col("p_retailprice") + F.when(F.col("p_size") % 2 == 0, 0).otherwise(0.01), 2))
    cell = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")).otherwise(F.when(F.col("p_size") % 4 == 0, "n/a").otherwise("free"))
    name = F.upper("p_name")
    return t("part").select("p_partkey", ev.has_token(second, name).alias("word"), ev.has_token(F.substring(second, 1, 3), name).alias("part_of_word"), ev.has_figure(F.col("p_retailprice"), price).alias("figure"), ev.amount_stated(cell).alias("amount"))


@query("running_lines", r"""WITH b AS (SELECT c_nationkey, c_custkey, unnest([c_name, CAST(c_acctbal AS VARCHAR), c_mktsegment]) AS text, unnest([true, false, true]) AS margin FROM customer),
n AS (SELECT c_nationkey, count(*) AS pages FROM customer GROUP BY 1), k AS (SELECT *, CASE WHEN margin THEN regexp_replace(lower(text), '[0-9]', '#', 'g') END AS t FROM b),
r AS (SELECT c_nationkey, t FROM k JOIN n USING (c_nationkey) WHERE t IS NOT NULL GROUP BY c_nationkey, t, n.pages HAVING count(DISTINCT c_custkey) >= greatest(3, floor(n.pages * 0.3)))
SELECT k.c_nationkey, count(*) AS lines FROM k LEFT JOIN r ON k.c_nationkey = r.c_nationkey AND k.t = r.t WHERE r.t IS NULL GROUP BY 1""")
def running_lines(t):
    """Lines that are left of a nation's customers as pages, names and frequent segments stripped from the margins."""
    line = lambda text, y: F.struct(F.col(text).cast("string").alias("text"), F.lit(y).alias("y0"), F.lit(y + 4.0).alias("y1"))
    rows = F.array(line("c_name", 3.0), line("c_acctbal", 50.0), line("c_mktsegment", 92.0))
    blocks = t("customer").select("c_nationkey", F.col("c_custkey").alias("page"), F.lit(100.0).alias("height"), F.inline(rows))
    return refs.without_running_lines(blocks, ["c_nationkey"]).groupBy("c_nationkey").agg(F.count("*").alias("lines"))


@query("normalized_document", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem),
f AS (SELECT * FROM l WHERE rn = 1)
SELECT l_orderkey, count(*) AS fields, string_agg(l_returnflag || '=' || l_partkey, ',' ORDER BY l_returnflag) AS shown, CAST(sum(n) AS BIGINT) AS rows FROM f GROUP BY 1""")
def normalized_document(t):
    """An order's items as fields (by flag, the last counts) and as a table's rows, read back from the JSON."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    items = t("lineitem")
    fields = items.select("l_orderkey", F.concat(F.lit("kv_"), "l_returnflag").alias("name"), F.col("l_partkey").cast("string").alias("value"), place.alias("place"))
    rows = items.select("l_orderkey", F.lit("items").alias("table"), place.alias("place"), F.create_map(F.lit("part"), F.col("l_partkey").cast("string")).alias("cells"))
    read = F.from_json("document", "fields map<string,string>, tables map<string,array<string>>")
    back = ex.normalized_document(fields, rows, "l_orderkey").select("l_orderkey", read.alias("d"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("d.fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return back.select("l_orderkey", F.size("d.fields").cast("long").alias("fields"), shown.alias("shown"), F.size(F.element_at("d.tables", "items")).cast("long").alias("rows"))
