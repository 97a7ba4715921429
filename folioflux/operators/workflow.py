"""Review writes as change sets (§2.12): actions on fields with their audit, accept-all, corrections, reuse, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.operators.relational import on_cycles

#: Status after a review action. Fixed values.
STATUS_AFTER = {"accept": "accepted", "edit": "accepted", "reject": "rejected", "mark_unknown": "unknown"}


def _status(action: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, status in STATUS_AFTER.items():
        found = F.when(action == name, status).otherwise(found)
    return found


def review_actions(fields: DataFrame, actions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The audit that a log of actions (keys, action, new_value, order) leaves on `fields` (keys, value, status): one row
    for each action that is allowed, with the value and status before and after it. An edit without a value is refused,
    an action on a missing field too. Values carry forward within a field: the window is on the field, and one field's
    actions are its own history only."""
    ok = actions.where(F.col("action").isin(*STATUS_AFTER) & ((F.col("action") != "edit") | F.col("new_value").isNotNull() & (F.col("new_value") != "")))
    joined = ok.join(fields.select(*keys, F.col("value").alias("_value"), F.col("status").alias("_status")), keys)
    by = Window.partitionBy(*keys).orderBy(*order)
    edited = F.when(F.col("action") == "edit", F.col("new_value"))
    return (
        joined.withColumn("value_after", F.coalesce(F.last(edited, True).over(by), F.col("_value")))
        .withColumn("value_before", F.coalesce(F.last(edited, True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("_value")))
        .withColumn("status_after", _status(F.col("action")))
        .withColumn("status_before", F.coalesce(F.lag("status_after").over(by), F.col("_status")))
        .select(*keys, *order, "action", "value_before", "value_after", "status_before", "status_after")
    )


def accept_all(fields: DataFrame, keys: list[str], audit_action: str = "accept") -> tuple[DataFrame, DataFrame]:
    """The fields with every pending one accepted, and an audit row for each of those."""
    pending = F.col("status") == "pending"
    done = fields.withColumn("status", F.when(pending, "accepted").otherwise(F.col("status")))
    audit = fields.where(pending).select(*keys, F.lit(audit_action).alias("action"), F.col("status").alias("status_before"), F.lit("accepted").alias("status_after"))
    return done, audit


def corrected(targets: DataFrame, corrections: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`targets` with the newest correction of each (keys, corrected): value, original (null where untouched), corrected_by."""
    newest = corrections.groupBy(*keys).agg(F.max_by(F.struct("corrected", "by"), F.struct(*order)).alias("_c"))
    joined = targets.join(newest, keys, "left")
    return joined.select(*keys, F.coalesce("_c.corrected", "value").alias("value"), F.when(F.col("_c").isNotNull(), F.col("value")).alias("original"), F.col("_c.by").alias("corrected_by"))


def reusable(runs: DataFrame, documents: DataFrame, content: str, version: int) -> DataFrame:
    """For each document the newest finished run on the same content and version, if there is one: its id and whether to
    reuse or to rebuild (an older version only) or to run (none)."""
    done = runs.where("status = 'done'").groupBy(content).agg(F.max(F.when(F.col("version") == version, F.col("run_id"))).alias("reuse_run"), F.max("version").alias("latest"))
    decision = F.when(F.col("reuse_run").isNotNull(), "reuse").when(F.col("latest").isNotNull(), "rebuild").otherwise("run")
    return documents.join(done, content, "left").withColumn("decision", decision)


def relationship_writes(relations: DataFrame, actions: DataFrame) -> DataFrame:
    """child, parent, status, outcome and audit of `relations` (child, parent, status: pending, confirmed or rejected; one a
    child) after `actions` (child, action, actor): confirm, reject or remove.

    Only a pending relation can be confirmed or rejected, only a confirmed one removed (it is pending again); of several
    actions on a child the first by name counts. A confirmation that would close a cycle with confirmed relations, or
    with others confirmed at once, is refused. An action on no relation leaves nothing. audit names who did what."""
    asked = actions.where("child is not null").groupBy("child").agg(F.min(F.struct("action", "actor")).alias("_a")).select("child", F.col("_a.action").alias("action"), F.col("_a.actor").alias("actor"))
    now = relations.join(asked, "child", "left")
    may = ((F.col("status") == "pending") & F.col("action").isin("confirm", "reject")) | ((F.col("status") == "confirmed") & (F.col("action") == "remove"))
    stays = (F.col("status") == "confirmed") & ~F.coalesce(may, F.lit(False))
    tree = now.where(stays | (may & (F.col("action") == "confirm"))).select("child", "parent")
    rings = on_cycles(tree, "child", "parent").withColumn("_ring", F.lit(True))
    known = now.join(rings, "child", "left").withColumn("_may", F.coalesce(may, F.lit(False)))
    refused = F.when(~F.col("_may"), "not_allowed").when((F.col("action") == "confirm") & F.col("_ring").isNotNull(), "cycle")
    after = F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "reject", "rejected").otherwise("pending")
    outcome = F.when(F.col("action").isNotNull(), F.coalesce(refused, F.lit("done")))
    return known.select("child", "parent", F.when(outcome == "done", after).otherwise(F.col("status")).alias("status"), outcome.alias("outcome"), F.when(outcome == "done", F.concat_ws(" ", "actor", "action")).alias("audit"))


def promotion(approved_at: Column, promoted_at: Column) -> Column:
    """promoted, approved or draft, by what has been stamped."""
    return F.when(promoted_at.isNotNull(), "promoted").when(approved_at.isNotNull(), "approved").otherwise("draft")
