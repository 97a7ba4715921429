"""Relational operators (§2.3 to 2.8, 2.12): scopes, top rows, paging, duplicates, roots, upserts that honour reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.session import checkpointed


def scoped(df: DataFrame, owner_col: str, owner: str | None, everything: bool = False) -> DataFrame:
    """All rows for who may see everything, the owner's rows for an owner, none otherwise."""
    return df if everything else df.where(F.col(owner_col) == owner) if owner is not None else df.where(F.lit(False))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by `order`, which should end with a unique column. Spark limits each group before
    the shuffle (WindowGroupLimit), so that a hot key sends one row a task."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """`n` rows by `order` after `offset`: a top-k of partitions, never a global sort."""
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def histogram(df: DataFrame, value: Column, name: str = "name", n: int | None = None) -> DataFrame:
    """Counts by value, most frequent first, ties by name."""
    counts = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    return counts if n is None else top_n(counts, [F.col("n").desc(), F.col(name).asc_nulls_last()], n)


def duplicate_groups(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """checksum, n, first_id of the keys that more than one row has."""
    return df.groupBy(key.alias("checksum")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def roots(edges: DataFrame, child: str, parent: str, deepest: int = 1 << 20) -> DataFrame:
    """child, root, depth: parents followed to the top by pointer doubling; each turn is checkpointed and doubles what a
    node has climbed, until no node climbs further, whatever the tree's depth.

    A parent that is no child is a root. A node on a cycle, or under one, has no root and is left out: it still climbs
    when the climb is longer than `deepest`, which no tree is."""
    at = edges.select(F.col(child).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col(parent).isNotNull().alias("_open"))
    steps = 1
    while True:
        above = at.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("depth").alias("_d"))
        joined = at.join(above, F.col("up") == F.col("_n"), "left")
        at = checkpointed(joined.select("node", F.coalesce("_u", "up").alias("up"), F.when(F.col("_u").isNotNull(), F.col("depth") + F.col("_d")).otherwise(F.col("depth")).alias("depth"), F.col("_u").isNotNull().alias("_open")))
        steps *= 2
        if steps > deepest or not at.where("_open").take(1):
            return at.where("not _open").select(F.col("node").alias(child), F.coalesce("up", "node").alias("root"), F.col("depth").cast("int").alias("depth"))


def on_cycles(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """The children that are their own ancestors. Each child has one parent here; steps are doubled until every climb is
    longer than there are edges: where climbs then stand are the cycles, whatever leads into them."""
    at = checkpointed(edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("up")))
    total, steps = at.count(), 1
    while steps <= total:
        above = at.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        at = checkpointed(at.join(above, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")))  # who climbs out is on no cycle
        steps *= 2
    return at.select(F.col("up").alias(child)).distinct()


def upsert_reviewed(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str = "value", status: str = "status") -> DataFrame:
    """The table after a re-extraction: new keys are added as pending, pending values overwritten, reviewed values kept;
    where a kept value differs from the new one the row is pending again, with the reason. One full outer join."""
    old = existing.select(*keys, F.col(value).alias("_old"), F.col(status).alias("_status"))
    new = incoming.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_there"))
    both = old.join(new, keys, "full_outer")
    locked = F.coalesce("_status", F.lit("pending")).isin("accepted", "edited", "rejected")
    reopened = locked & F.col("_there").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))
    return both.select(
        *keys,
        F.when(locked | F.col("_there").isNull(), F.col("_old")).otherwise(F.col("_new")).alias(value),
        F.when(reopened, "pending").otherwise(F.coalesce("_status", F.lit("pending"))).alias(status),
        F.when(reopened, "value_changed").alias("reason"),
        F.when(F.col("_there").isNotNull(), F.col("_new")).alias("machine_value"),
    )


def union_distinct(*ids: DataFrame) -> DataFrame:
    """The distinct rows of several sets of ids."""
    out = ids[0]
    for x in ids[1:]:
        out = out.union(x)
    return out.distinct()


def wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide: one column for each of the known names (a stated list saves the extra pass that finds them)."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def long(df: DataFrame, keys: list[str], columns: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """Wide to long, values as text."""
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, name, value)
