"""Queries on positions (§2.4.16 to 2.4.19, 2.4.28, 2.6.11): labels and values on a page, form cells, tables over pages.

The positions are derived from `events`: a user's events stand on a calendar page, days across and the time of day down.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.operators import geometry as geo
from folioflux.plans.catalog import query

#: Left edge and top of an event on its calendar, in points.
X0, Y0 = "day(ts) * 20.0", "(hour(ts) * 60 + minute(ts)) / 2.0"
_PLACED = f"SELECT event_id, user_id, event_type, value, ts, CAST({X0} AS DOUBLE) AS x0, CAST({Y0} AS DOUBLE) AS y0 FROM events"


def placed(t):
    return t("events").select("event_id", "user_id", "event_type", "value", "ts", F.expr(X0).cast("double").alias("x0"), F.expr(Y0).cast("double").alias("y0"))


def _in_turn(candidates: str, labels: str, margin: float) -> str:
    """SQL that takes a page's labels one by one: what is claimed is carried as a list."""
    return f"""
c AS ({candidates}),
o AS (SELECT label, list(struct_pack(d := distance, v := value, k := kind) ORDER BY distance, value) AS near FROM c GROUP BY label),
l AS (SELECT user_id, label, known, near, row_number() OVER (PARTITION BY user_id ORDER BY label) AS i FROM ({labels}) LEFT JOIN o USING (label)),
s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS label, []::BIGINT[] AS claimed, NULL::STRUCT(d DOUBLE, v BIGINT, k VARCHAR)[] AS left_over, false AS close FROM l GROUP BY user_id
  UNION ALL SELECT user_id, i, label, CASE WHEN len(left_over) > 0 AND NOT close THEN list_append(claimed, left_over[1].v) ELSE claimed END, left_over, close
  FROM (SELECT *, coalesce(known AND left_over[2].d - left_over[1].d < {margin}, false) AS close
        FROM (SELECT l.user_id, l.i, l.label, l.known, s.claimed, list_filter(coalesce(l.near, []), lambda x: NOT list_contains(s.claimed, x.v)) AS left_over FROM s JOIN l ON s.user_id = l.user_id AND s.i + 1 = l.i)))
SELECT label, CASE WHEN NOT close THEN left_over[1].v END AS value, CASE WHEN NOT close THEN left_over[1].k END AS kind, CASE WHEN NOT close THEN left_over[1].d END AS distance,
  CASE WHEN len(left_over) = 0 THEN 'unassociated' WHEN close THEN 'ambiguous' ELSE 'associated' END AS outcome,
  CASE WHEN close THEN array_to_string(list_transform(left_over[1:3], lambda x: x.v), ',') ELSE '' END AS alternates FROM s WHERE i > 0"""


def _shown(found):
    return found.select("label", "value", "kind", "distance", "outcome", F.coalesce(F.array_join(F.transform("alternates", lambda x: x.cast("string")), ","), F.lit("")).alias("alternates"))


LABELS_SQL = f"""WITH RECURSIVE p AS ({_PLACED}),{_in_turn(
    f"SELECT a.event_id AS label, b.event_id AS value, abs(a.y0 - b.y0) + abs(a.x0 - b.x0) * 0.5 AS distance, 'near' AS kind FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type IN ('purchase', 'view') AND b.event_id >= a.event_id AND abs(a.y0 - b.y0) <= {geo.LABEL_Y} AND abs(a.x0 - b.x0) <= {geo.LABEL_X}",
    "SELECT user_id, event_id AS label, value < 50 AS known FROM p WHERE event_type = 'click'",
    geo.LABEL_MARGIN,
)}"""


@query("label_value_join", LABELS_SQL)
def label_value_join(t):
    """Each click with the nearest later purchase or view on the calendar that no click before it took."""
    p = placed(t)
    labels = p.where("event_type = 'click'").select("user_id", F.col("event_id").alias("label"), F.col("event_id").alias("place"), (F.col("value") < 50).alias("known"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    values = p.where("event_type IN ('purchase', 'view')").select("user_id", F.col("event_id").alias("value"), F.col("event_id").alias("value_place"), F.col("x0").alias("value_x"), F.col("y0").alias("value_y"))
    found = geo.claimed(geo.label_candidates(labels, values, ["user_id"]), geo.LABEL_MARGIN)
    return _shown(geo.with_unclaimed(labels.select("label"), found))


_BELOW = f"CASE WHEN b.y0 - a.y1 >= -1 AND b.y0 - a.y1 <= {geo.BELOW} THEN CASE WHEN abs(a.x0 - b.x0) <= {geo.ALIGNED} THEN b.y0 - a.y1 WHEN (b.x0 + b.x1) / 2 BETWEEN a.x0 - {geo.BESIDE} AND a.x1 + {geo.BESIDE} OR (b.x0 <= a.x1 + {geo.BESIDE} AND b.x1 >= a.x0 - {geo.BESIDE}) THEN b.y0 - a.y1 + {geo.UNALIGNED_COST} END END"
_RIGHT = f"CASE WHEN b.x0 - a.x1 >= -2 AND b.x0 - a.x1 <= {geo.RIGHT} AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(a.y1 - a.y0, 10) * 1.5 THEN b.x0 - a.x1 + {geo.RIGHT_COST} END"
CELLS_SQL = f"""WITH RECURSIVE p AS (SELECT *, x0 + 8 + floor(value) % 40 AS x1, y0 + 8 AS y1 FROM ({_PLACED})),{_in_turn(
    f"SELECT label, value, least(below, beside) AS distance, CASE WHEN below <= coalesce(beside, below) THEN 'below_label' ELSE 'right_of_label' END AS kind FROM (SELECT a.event_id AS label, b.event_id AS value, {_BELOW} AS below, {_RIGHT} AS beside FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type IN ('view', 'error') AND (a.value >= 40 OR b.event_type = 'view')) WHERE below IS NOT NULL OR beside IS NOT NULL",
    "SELECT user_id, event_id AS label, value < 40 AS known FROM p WHERE event_type = 'signup'",
    geo.CELL_MARGIN,
)}"""


@query("form_cells", CELLS_SQL)
def form_cells(t):
    """Each signup as a form's label with the value below or right of it; known labels take views only."""
    p = placed(t).withColumn("x1", F.col("x0") + 8 + F.floor("value") % 40).withColumn("y1", F.col("y0") + 8)
    box = ["x0", "y0", "x1", "y1"]
    labels = p.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("label"), F.col("event_id").alias("place"), (F.col("value") < 40).alias("known"), *box)
    values = p.where("event_type IN ('view', 'error')").select("user_id", F.col("event_id").alias("value"), F.col("event_type").alias("value_type"), *[F.col(c).alias(f"value_{c}") for c in box])
    found = geo.claimed(geo.cell_candidates(labels, values, ["user_id"], lambda: ~F.col("known") | (F.col("value_type") == "view")), geo.CELL_MARGIN)
    return _shown(geo.with_unclaimed(labels.select("label"), found))


_TABLES = "SELECT user_id, event_id AS table_id, day(ts) AS page, (hour(ts) * 60 + minute(ts)) / 2880.0 AS top, (hour(ts) * 60 + minute(ts)) / 2880.0 + 0.6 AS bottom, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS header FROM events"
CHAINS_SQL = f"""WITH RECURSIVE t AS ({_TABLES}),
lo AS (SELECT user_id, page, first(struct_pack(t := table_id, b := bottom) ORDER BY bottom DESC, table_id) AS l FROM t GROUP BY ALL),
hi AS (SELECT user_id, page, first(struct_pack(t := table_id, p := top) ORDER BY top, table_id) AS h FROM t GROUP BY ALL),
g AS (SELECT h.t AS table_id, l.t AS before FROM hi JOIN lo ON hi.user_id = lo.user_id AND hi.page = lo.page + 1 WHERE l.b >= {geo.NEAR_BOTTOM} AND h.p <= {geo.NEAR_TOP}),
w AS (SELECT t.table_id, NULL::BIGINT AS previous, NULL::VARCHAR AS reason, t.table_id AS chain, coalesce(t.header, 'columns:2') AS signature, 0 AS place FROM t LEFT JOIN g USING (table_id) WHERE g.before IS NULL
  UNION ALL SELECT table_id, CASE WHEN ok THEN before END, CASE WHEN ok THEN why END, CASE WHEN ok THEN chain ELSE table_id END, CASE WHEN header IS NULL THEN signature ELSE header END, CASE WHEN ok THEN place + 1 ELSE 0 END
  FROM (SELECT g.table_id, g.before, w.chain, w.signature, w.place, t.header, t.header IS NULL OR t.header = w.signature AS ok, CASE WHEN t.header IS NULL THEN 'next_page_table_has_no_header_row' ELSE 'repeated_header_on_next_page' END AS why FROM w JOIN g ON w.table_id = g.before JOIN t ON t.table_id = g.table_id))
SELECT table_id AS "table", previous, reason, chain, signature, place FROM w"""


@query("table_chains", CHAINS_SQL)
def table_chains(t):
    """A user's events as tables, days as pages: chains over the page breaks, headers inherited along them."""
    at = (F.hour("ts") * 60 + F.minute("ts")) / 2880.0
    header = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    tables = t("events").select("user_id", F.col("event_id").alias("table"), F.dayofmonth("ts").alias("page"), at.alias("top"), (at + 0.6).alias("bottom"), F.lit(2).alias("n_columns"), header.alias("header"))
    return geo.table_chains(tables, ["user_id"])
