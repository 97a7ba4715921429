"""Cells of records: the cube of records by fields, checks, roll-ups, quality (§2.11.11 to 2.11.13, 2.5.30 to 2.5.33)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions.values import lenient_date, to_number


@dataclass(frozen=True)
class Field:
    """A field of a dataset: its type (text, number, date), whether it must be there, a pattern, a bound from below."""

    name: str
    kind: str = "text"
    required: bool = False
    pattern: str | None = None
    positive: bool = False


def cube(records: DataFrame, keys: list[str], fields: list[Field]) -> DataFrame:
    """keys, field, value: a cell for each record and field, null where missing."""
    cells = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f.name).cast("string").alias("value")) for f in fields])
    return records.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.field", F.nullif(F.trim("c.value"), F.lit("")).alias("value"))


def checks(field: Field, value: Column) -> Column:
    """The names of the checks that a value fails, in order; a missing value only fails to be there."""
    failed = [F.when(value.isNull() & F.lit(field.required), "missing")]
    if field.kind == "number":
        failed.append(F.when(value.isNotNull() & to_number(value).isNull(), "not_a_number"))
    if field.kind == "date":
        failed.append(F.when(value.isNotNull() & lenient_date(value).isNull(), "not_a_date"))
    if field.positive:
        failed.append(F.when(to_number(value) <= 0, "not_positive"))
    if field.pattern:
        failed.append(F.when(~value.rlike(field.pattern), "pattern"))
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def validated(cells: DataFrame, fields: list[Field]) -> DataFrame:
    """Cells with reasons and status: Missing, Needs Review or Verified."""
    reasons = F.array().cast("array<string>")
    for f in fields:
        reasons = F.when(F.col("field") == f.name, checks(f, F.col("value"))).otherwise(reasons)
    status = F.when(F.col("value").isNull(), "Missing").when(F.size("reasons") > 0, "Needs Review").otherwise("Verified")
    return cells.withColumn("reasons", reasons).withColumn("status", status)


def record_status(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, n_flagged: any cell in doubt, else any that is verified, else missing."""
    has = lambda s: F.bool_or(F.col("status") == s)
    return cells.groupBy(*keys).agg(F.when(has("Needs Review"), "Needs Review").when(has("Verified"), "Verified").otherwise("Missing").alias("status"), F.count(F.when(F.size("reasons") > 0, 1)).alias("n_flagged"))


def outcome(failed: Column, rows: Column, in_doubt: Column, recorded: Column) -> Column:
    """failed, then needs_review or populated where there are rows, pending where nothing is recorded yet, else empty."""
    return F.when(failed, "failed").when((rows > 0) & (in_doubt > 0), "needs_review").when(rows > 0, "populated").when(~recorded, "pending").otherwise("no_supported_fields")
