"""The portfolio bundle (§2.3.15, 2.5.12, 2.5.15): everything a portfolio's first page shows, from one scan of its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Processing states that count as done, and families that say nothing about a document (fixed values).
COMPLETED, NO_FAMILY = ("completed", "completed_with_warnings", "processed"), ("unknown", "generic_business")
MONTHS = 12


def portfolio_status(status: Column) -> Column:
    """processed, failed, not_processed (also for null) or processing."""
    return F.when(status.isin(*COMPLETED), "processed").when(status == "failed", "failed").when(status.isNull() | (status == "not_processed"), "not_processed").otherwise("processing")


def bundle(documents: DataFrame, families: DataFrame, today: str) -> DataFrame:
    """section, name, n and total (a sum of the section's measure) of documents (id, status, type, uploaded_at, pages,
    seconds, checksum) and their families (id, family, label).

    mix: by the family's label or name, else the type, else Unclassified; status: by portfolio_status, zeros included;
    month: the last twelve that occur; today: uploads of that day and their pages; processing: documents with a duration
    and its sum; duplicates: different checksums that several documents have, and how many documents that are.

    A document adds a few (section, name) pairs, which are counted map-side: one shuffle of one row a name and task, and
    one more for the checksums. A family that repeats an id counts once. An empty portfolio has the zero rows only."""
    label = F.when(~F.coalesce(F.col("family").isin(*NO_FAMILY), F.lit(True)), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("family")))
    named = families.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.min(F.struct("family", "label")).alias("_f")).select("_id", F.col("_f.family").alias("family"), F.col("_f.label").alias("label"))
    d = documents.join(named, F.col("id") == F.col("_id"), "left")
    day = F.to_date("uploaded_at") == F.lit(today).cast("date")
    entry = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    entries = F.array(
        entry("mix", F.coalesce(label, F.nullif(F.col("type"), F.lit("")), F.lit("Unclassified")), F.lit(0)),
        entry("status", portfolio_status(F.col("status")), F.lit(0)),
        F.when(F.col("uploaded_at").isNotNull(), entry("month", F.date_format("uploaded_at", "yyyy-MM"), F.lit(0))),
        F.when(day, entry("today", F.lit("uploads"), F.coalesce("pages", F.lit(0)))),
        F.when(F.col("seconds") > 0, entry("processing", F.lit("durations"), F.col("seconds"))),
    )
    counted = d.select(F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e")).groupBy("e.section", "e.name").agg(F.count("*").alias("n"), F.sum("e.value").alias("total"))
    copies = documents.where("checksum is not null").groupBy("checksum").agg(F.count("*").alias("n")).where("n > 1")
    duplicates = copies.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total")).select(F.lit("duplicates").alias("section"), F.lit("checksums").alias("name"), "n", "total")
    zeros = documents.sparkSession.createDataFrame([("status", x, 0, 0.0) for x in ("processed", "failed", "not_processed", "processing")] + [("today", "uploads", 0, 0.0), ("processing", "durations", 0, 0.0)], "section string, name string, n long, total double")
    summed = counted.unionByName(zeros).unionByName(duplicates).groupBy("section", "name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    last = F.row_number().over(Window.partitionBy("section").orderBy(F.col("name").desc()))  # a row a name
    return summed.withColumn("_last", last).where(f"section <> 'month' or _last <= {MONTHS}").drop("_last")
