"""Geometry of pages (§2.4.16 to 2.4.19, 2.4.28, 2.6.11): two-dimensional grid joins, values claimed once, table chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.operators.relational import roots
from folioflux.session import checkpointed

#: Distances within which a value may belong to a label, in points (fixed values): tops in a column, left edges, and the
#: difference under which two values are too close to choose.
LABEL_Y, LABEL_X, LABEL_MARGIN = 20.0, 250.0, 15.0
#: The same for cells of a form: below, right of the label, aligned left edges, room beside the label, costs of the
#: weaker kinds, and the margin.
BELOW, RIGHT, ALIGNED, BESIDE, UNALIGNED_COST, RIGHT_COST, CELL_MARGIN = 28.0, 220.0, 18.0, 50.0, 8.0, 40.0, 12.0
#: Shares of a page's height: a table that ends below the second one may go on in one that starts above the first.
NEAR_TOP, NEAR_BOTTOM = 0.30, 0.70


def boxes_met(left: DataFrame, right: DataFrame, keys: list[str], reach: tuple[Column, Column, Column, Column], extent: tuple[Column, Column, Column, Column], cell: tuple[float, float]) -> DataFrame:
    """Pairs of rows of one key whose boxes meet: `reach` (x0, y0, x1, y1) of left rows and `extent` of right rows.

    Each box is entered in the cells of a grid that it covers, so that the join is an equi-join on key and cell and makes
    no pair outside common cells; of the cells two boxes share the first one gives the pair. Column names must differ but
    for the keys; rows with a null edge meet nothing."""
    at = lambda edge, size: F.floor(edge / size)

    def entered(df, box, side):
        x0, y0, x1, y1 = box
        placed = df.withColumns({f"_{side}x": at(x0, cell[0]), f"_{side}y": at(y0, cell[1]), f"_{side}box": F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))}).where((x1 >= x0) & (y1 >= y0))
        across = placed.withColumn("_cx", F.explode(F.sequence(F.col(f"_{side}x"), at(F.col(f"_{side}box.x1"), cell[0]))))
        return across.withColumn("_cy", F.explode(F.sequence(F.col(f"_{side}y"), at(F.col(f"_{side}box.y1"), cell[1]))))

    met = entered(left, reach, "l").join(entered(right, extent, "r"), [*keys, "_cx", "_cy"])
    first = (F.col("_cx") == F.greatest("_lx", "_rx")) & (F.col("_cy") == F.greatest("_ly", "_ry"))
    cross = (F.col("_lbox.x0") <= F.col("_rbox.x1")) & (F.col("_rbox.x0") <= F.col("_lbox.x1")) & (F.col("_lbox.y0") <= F.col("_rbox.y1")) & (F.col("_rbox.y0") <= F.col("_lbox.y1"))
    return met.where(first & cross).drop("_cx", "_cy", "_lx", "_ly", "_rx", "_ry", "_lbox", "_rbox")


def claimed(candidates: DataFrame, margin: float, kept: int = 3) -> DataFrame:
    """label, value, kind, distance, outcome and alternates from candidates (label, place, value, distance, kind, known): each
    label in order of its place takes the nearest value that no label before it took, and no other label has it then. A
    known label whose nearest two values are less than `margin` apart takes neither: it is ambiguous and its nearest
    `kept` values are the alternates.

    Labels are not taken one by one: in a round a label is settled if it comes first among the open labels near each
    value it may depend on. Whatever the order, that gives what one label after the other gives; the first open label
    is settled in any round, so rounds end by themselves, and there are as many as labels that wait for each other in a
    chain, not as many as labels. Places are unique; of equally near values the smaller takes precedence."""
    order = Window.partitionBy("label").orderBy("distance", "value")
    near = order.rowsBetween(0, kept - 1)
    columns = ["label", "place", "value", "distance", "kind", "known"]
    rest, out = checkpointed(candidates.select(*columns)), None
    while True:
        firsts = rest.withColumn("_first", F.col("place") == F.min("place").over(Window.partitionBy("value")))
        top = firsts.withColumn("_rn", F.row_number().over(order)).withColumn("_next", F.lead("distance").over(order)).withColumn("_top", F.collect_list(F.struct("value", "_first")).over(near))
        close = F.col("known") & F.coalesce(F.col("_next") - F.col("distance") < margin, F.lit(False))
        # an ambiguous label depends on the values it shows, another one on the value it takes, and on the next if that is near
        sure = F.when(close, F.forall("_top", lambda x: x["_first"])).otherwise(F.col("_first"))
        heads = top.withColumn("_close", close).withColumn("_sure", sure)
        mine = Window.partitionBy("label")
        marked = heads.withColumn("_settled", F.max(F.col("_sure") & (F.col("_rn") == 1)).over(mine)).withColumn("_takes", (F.col("_rn") == 1) & F.col("_sure") & ~F.col("_close"))
        marked = checkpointed(marked.withColumn("_gone", F.max("_takes").over(Window.partitionBy("value"))))
        settled = marked.where("_settled and _rn = 1").select(
            "label",
            F.when(~F.col("_close"), F.col("value")).alias("value"),
            F.when(~F.col("_close"), F.col("kind")).alias("kind"),
            F.when(~F.col("_close"), F.col("distance")).alias("distance"),
            F.when(F.col("_close"), "ambiguous").otherwise("associated").alias("outcome"),
            F.when(F.col("_close"), F.transform("_top", lambda x: x["value"])).otherwise(F.slice(F.array("value"), 1, 0)).alias("alternates"),
        )
        out = settled if out is None else out.unionByName(settled)
        rest = marked.where("not _settled and not _gone").select(*columns)
        if not rest.take(1):
            return out


def with_unclaimed(labels: DataFrame, found: DataFrame) -> DataFrame:
    """All labels (label, ...) with what claimed() found; those without any value are 'unassociated'."""
    return labels.join(found, "label", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unassociated")))


def label_candidates(labels: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of labels (keys, label, place, known, x, y: left edge and middle) among values (keys, value, value_place,
    value_x, value_y): not before the label in reading order, and near in both directions; distances count half across."""
    x, y, vx, vy = (F.col(c) for c in ("x", "y", "value_x", "value_y"))
    met = boxes_met(labels, values, keys, (x - LABEL_X, y - LABEL_Y, x + LABEL_X, y + LABEL_Y), (vx, vy, vx, vy), (2 * LABEL_X, 2 * LABEL_Y))
    after = met.where(F.col("value_place") >= F.col("place"))
    return after.select("label", "place", "value", (F.abs(y - vy) + F.abs(x - vx) * 0.5).alias("distance"), F.lit("near").alias("kind"), "known")


def cell_candidates(labels: DataFrame, values: DataFrame, keys: list[str], fits: Callable[[], Column] | None = None) -> DataFrame:
    """Candidates of form labels (keys, label, place, known, x0, y0, x1, y1) among values (keys, value, value_x0 ...): below the
    label, aligned or at least under its cell, or right of it in its band. `fits` says what else a pair must satisfy."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    v0, w0, v1, w1 = (F.col(f"value_{c}") for c in ("x0", "y0", "x1", "y1"))
    band = F.greatest(y1 - y0, F.lit(10.0)) * 1.5
    reach = (x0 - BESIDE, y0 - band - 1, x1 + RIGHT, y1 + F.greatest(band, F.lit(BELOW)) + 1)
    met = boxes_met(labels, values, keys, reach, (v0, w0, v1, w1), (RIGHT, 2 * BELOW))
    gap, across = w0 - y1, v0 - x1
    under = ((v0 + v1) / 2).between(x0 - BESIDE, x1 + BESIDE) | ((v0 <= x1 + BESIDE) & (v1 >= x0 - BESIDE))
    below = F.when((gap >= -1) & (gap <= BELOW), F.when(F.abs(x0 - v0) <= ALIGNED, gap).when(under, gap + UNALIGNED_COST))
    right = F.when((across >= -2) & (across <= RIGHT) & (F.abs((y0 + y1) / 2 - (w0 + w1) / 2) <= band), across + RIGHT_COST)
    scored = met.where(fits()) if fits else met
    best = scored.select("label", "place", "value", "known", F.least(below, right).alias("distance"), F.when(below <= F.coalesce(right, below), "below_label").otherwise("right_of_label").alias("kind"))
    return best.where("distance is not null").select("label", "place", "value", "distance", "kind", "known")


def table_chains(tables: DataFrame, keys: list[str]) -> DataFrame:
    """table, previous, reason, chain (its first table), signature (in force) and place in its chain, for each of the tables
    (keys, table, page, top, bottom: shares of the page's height; n_columns, header: null for none).

    The lowest table of a page may go on in the topmost one of the next page if both are near the break and as wide, and
    that one repeats the header in force or has none; then the header stays in force. Segments without headers and whole
    chains are both followed by pointer doubling, so that a chain of a thousand pages takes ten rounds, and no document
    is gathered in one task. Of equally low or high tables the smaller name comes first."""
    own = F.coalesce("header", F.concat(F.lit("columns:"), F.col("n_columns").cast("string")))
    t = checkpointed(tables.select(*keys, "table", "page", "top", "bottom", "n_columns", "header", own.alias("own")))
    low = t.groupBy(*keys, "page").agg(F.min_by(F.struct("table", "bottom", "n_columns"), F.struct(-F.col("bottom"), F.col("table"))).alias("l"))
    high = t.groupBy(*keys, "page").agg(F.min_by(F.struct("table", "top", "n_columns", "header", "own"), F.struct("top", "table")).alias("h"))
    met = high.join(low.withColumn("page", F.col("page") + 1), [*keys, "page"])
    near = (F.col("l.bottom") >= NEAR_BOTTOM) & (F.col("h.top") <= NEAR_TOP) & (F.col("l.n_columns") == F.col("h.n_columns"))
    may = met.where(near).select(F.col("h.table").alias("table"), F.col("l.table").alias("before"))
    edges = checkpointed(t.join(may, "table", "left").select("table", "header", "own", "before", F.when(F.col("header").isNull(), F.col("before")).alias("inherits")))
    heads = roots(edges, "table", "inherits").select("table", F.col("root").alias("head"))
    named = heads.join(edges.select(F.col("table").alias("head"), F.col("own").alias("signature")), "head").select("table", "signature")
    signed = checkpointed(edges.join(named, "table"))
    prior = signed.select(F.col("table").alias("before"), F.col("signature").alias("_in_force"))
    reason = F.when(F.col("before").isNotNull(), F.when(F.col("header").isNull(), "next_page_table_has_no_header_row").when(F.col("own") == F.col("_in_force"), "repeated_header_on_next_page"))
    linked = checkpointed(signed.join(prior, "before", "left").select("table", "signature", reason.alias("reason"), F.when(reason.isNotNull(), F.col("before")).alias("previous")))
    chains = roots(linked, "table", "previous")
    return linked.join(chains, "table").select("table", "previous", "reason", F.col("root").alias("chain"), "signature", F.col("depth").alias("place"))
