"""Ordered operators (§2.6, 2.4.20): carry-forward, islands, running sets, as-of and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.session import checkpointed


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null at or before each row of its key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def with_islands(df: DataFrame, keys: list[str], order: list[str], same: Column | str, name: str = "island") -> DataFrame:
    """Numbers the runs of rows with an equal `same`, from 1 within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    value = F.col(same) if isinstance(same, str) else same
    broken = df.withColumn("_new", F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    return broken.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Numbers the rows of each key from 1 by `order`, or all rows where there are no keys, as row_number() does, but with no
    key in one task: rows are dealt out by ranges of (keys, order), which Spark samples, numbered within their range, and
    the rows of the ranges before are added. Order should end with a unique column."""
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    rows = checkpointed(ranged)
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    at = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    met = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return at.join(offsets, met).select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))


def seen_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "seen") -> DataFrame:
    """Whether the row's value occurred earlier in its key: its rank among equal values, so that no set is gathered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) > 1)


def gap_seconds(df: DataFrame, keys: list[str], order: list[str], ts: str, name: str = "seconds") -> DataFrame:
    """Seconds since the row before of the same key; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    Both sides in one stream, right rows first at equal times, the last right row carried forward: one shuffle and one
    sort on the key, whatever the number of matches."""
    names = left.columns
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(F.col(right_time).alias("at"), *values)).schema[0].dataType))
    b = right.select(*[F.col(k) for k in keys], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("at"), *values).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*names, F.col("_last.at").alias("as_of"), *[F.col(f"_last.{v}").alias(v) for v in values])


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, to: str, left_id: str, right_id: str, reach: float, margin: float) -> DataFrame:
    """left_id, right_id, distance, ambiguous: for each left row the nearest right row of its key with
    0 <= to - at <= reach; ambiguous if the second nearest is no more than `margin` farther.

    Places are cut into cells of width `reach`: a match lies in the left row's cell or the next one, so that an equi-join
    on key and cell replaces the range join. Ties go to the smaller right_id."""
    a = left.select(*keys, F.col(at).alias("_a"), F.col(left_id)).withColumn("_cell", F.explode(F.array(F.floor(F.col("_a") / reach), F.floor(F.col("_a") / reach) + 1)))
    b = right.select(*keys, F.col(to).alias("_b"), F.col(right_id)).withColumn("_cell", F.floor(F.col("_b") / reach))
    met = a.join(b, [*keys, "_cell"]).where((F.col("_b") >= F.col("_a")) & (F.col("_b") - F.col("_a") <= reach))
    w = Window.partitionBy(left_id).orderBy("_d", right_id)
    ranked = met.withColumn("_d", F.col("_b") - F.col("_a")).withColumn("_rn", F.row_number().over(w)).withColumn("_second", F.lead("_d").over(w))
    return ranked.where("_rn = 1").select(left_id, right_id, F.col("_d").alias("distance"), F.coalesce(F.col("_second") - F.col("_d") <= margin, F.lit(False)).alias("ambiguous"))
