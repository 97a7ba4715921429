"""Queries on order (§2.6, 2.4.16 to 2.4.20): carry-forward, islands, as-of, nearest, templates, time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import text as tx
from folioflux.operators import references as refs
from folioflux.operators import sequence as seq
from folioflux.plans.catalog import query
from folioflux.streaming import events as ev


@query("seen_before", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 AS seen FROM conversations")
def seen_before(t):
    """Whether the role spoke before in the conversation."""
    return seq.seen_before(t("conversations"), ["conv_id"], ["turn"], F.col("role")).select("conv_id", "turn", "seen")


@query("carry_forward_role", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def carry_forward_role(t):
    """The heading in force at each turn: the last user turn."""
    return seq.carried_forward(t("conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.md5("text")), "section").select("conv_id", "turn", "section")


@query("islands_turns", """WITH b AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, count(*) AS turns, md5(string_agg(text, ' ' ORDER BY turn)) AS text FROM i GROUP BY conv_id, island""")
def islands_turns(t):
    """Consecutive turns of one role as one, their texts joined."""
    runs = seq.with_islands(t("conversations"), ["conv_id"], ["turn"], "role")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy("conv_id", F.col("island").cast("long").alias("island")).agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.md5(joined).alias("text"))


@query("stage_durations", "SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6::DOUBLE AS seconds FROM events")
def stage_durations(t):
    """Seconds from stage to stage."""
    return seq.gap_seconds(t("events"), ["user_id"], ["ts", "event_id"], "ts").select("event_id", "seconds")


@query("margin_templates", r"""WITH b AS (SELECT c_nationkey, c_custkey, unnest([c_name, c_mktsegment]) AS text FROM customer),
n AS (SELECT c_nationkey, count(*) AS pages FROM customer GROUP BY 1)
SELECT c_nationkey, regexp_replace(lower(text), '[0-9]', '#', 'g') AS template, count(DISTINCT c_custkey) AS pages FROM b JOIN n USING (c_nationkey) GROUP BY c_nationkey, template, n.pages HAVING count(DISTINCT c_custkey) >= greatest(3, floor(n.pages * 0.25))""")
def margin_templates(t):
    """A nation's customers as pages, with the name in the top margin, the balance between and the segment at the bottom."""
    line = lambda text, y: F.struct(F.col(text).cast("string").alias("text"), F.lit(y).alias("y0"), F.lit(y + 4.0).alias("y1"))
    rows = F.array(line("c_name", 3.0), line("c_acctbal", 50.0), line("c_mktsegment", 92.0))
    blocks = t("customer").select("c_nationkey", F.col("c_custkey").alias("page"), F.lit(100.0).alias("height"), F.inline(rows))
    return refs.margin_templates(blocks, ["c_nationkey"])


@query("toc_density", r"""WITH l AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'Section ' || l_partkey || ' ........ ' || l_suppkey WHEN 1 THEN 'Part of text ' || l_partkey || '   ' || l_linenumber ELSE 'It costs ' || l_suppkey END AS text, l_linenumber % 3 < 2 AS toc FROM lineitem),
n AS (SELECT l_orderkey, count(*) FILTER (WHERE toc) AS n_toc, count(*) AS n_lines FROM l GROUP BY 1)
SELECT l_orderkey, n_toc, n_lines, n_toc / n_lines::DOUBLE AS ratio, n_toc >= 3 AS is_toc FROM n""")
def toc_density(t):
    """Orders as pages, items as lines: entries with a leader or a gap before the page number, and sentences. Page numbers are
    keys of suppliers here, which may be as long as a bigint."""
    c = lambda *x: F.concat(*[F.lit(v) if v.startswith(" ") or v.endswith(" ") else F.col(v).cast("string") for v in x])
    third = F.col("l_linenumber") % 3
    text = F.when(third == 0, c("Section ", "l_partkey", " ........ ", "l_suppkey")).when(third == 1, c("Part of text ", "l_partkey", "   ", "l_linenumber")).otherwise(c("It costs ", "l_suppkey"))
    return refs.toc_pages(t("lineitem").select("l_orderkey", text.alias("text")), ["l_orderkey"], digits=19)


@query("as_of_heading", """SELECT c.event_id, v.ts AS as_of, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def as_of_heading(t):
    """Each click with the user's last view at or before it."""
    e = t("events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return seq.as_of(e.where("event_type = 'click'"), views, ["user_id"], "ts", "ts", ["view_id"]).select("event_id", "as_of", "view_id")


@query("nearest_neighbour_pairs", """WITH a AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS to_id, epoch_us(ts) / 1e6 AS s FROM events WHERE event_type = 'purchase'),
m AS (SELECT event_id, to_id, b.s - a.s AS distance FROM a JOIN b ON a.user_id = b.user_id AND b.s >= a.s AND b.s - a.s <= 86400),
r AS (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS second FROM m WINDOW w AS (PARTITION BY event_id ORDER BY distance, to_id))
SELECT event_id, to_id, distance, coalesce(second - distance <= 600, false) AS ambiguous FROM r WHERE rn = 1""")
def nearest_neighbour_pairs(t):
    """Each click with the user's next purchase within a day; ambiguous where another follows within ten minutes."""
    e = t("events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return seq.nearest_within(e.where("event_type = 'click'"), e.where("event_type = 'purchase'").withColumnRenamed("event_id", "to_id"), ["user_id"], "s", "s", "event_id", "to_id", 86400.0, 600.0)


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    """Hourly counts and sums by type."""
    return ev.hourly(t("events"))


@query("session_windows", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    """Sessions that a gap of thirty minutes ends."""
    return ev.sessions(t("events"))


@query("streaming_dedup", "SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2")
def streaming_dedup(t):
    """The first event of each kind of each user."""
    return ev.first_of_each(t("events").select("user_id", "event_type", "ts"), ["user_id", "event_type"])


@query("paragraph_join", r"""SELECT doc_id, len(p) AS n, md5(array_to_string(list_transform(p, lambda x: trim(regexp_replace(regexp_replace(x, '([a-z])-\n([a-z])', '\1\2', 'g'), '\s+', ' ', 'g'))), chr(10))) AS text
FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t]*\n') AS p FROM documents)""")
def paragraph_join(t):
    """Paragraphs at blank lines; wrapped lines rejoined, words that a hyphen broke glued."""
    return t("documents").select("doc_id", tx.paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "\n")).alias("text"))
