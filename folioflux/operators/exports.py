"""Exports (§2.2): fields, line items and selections as CSV or JSON, long texts in parts, idempotent writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.operators.sequence import numbered
from folioflux.session import checkpointed

REVIEWED = ("accepted", "edited")


def authoritative(status: Column) -> Column:
    """Reviewed and approved; a missing status is pending."""
    return F.coalesce(status, F.lit("pending")).isin(*REVIEWED)


def extracted_value(machine: Column, original: Column, value: Column) -> Column:
    """The first of the three that isn't blank, or the empty text."""
    return F.coalesce(F.nullif(F.trim(machine), F.lit("")), F.nullif(F.trim(original), F.lit("")), value, F.lit(""))


def field_records(fields: DataFrame, authoritative_only: bool = False) -> DataFrame:
    """document_id, field_key, label, value, status, authoritative, page: one row a field. A page that is no positive
    number is 1."""
    page = F.col("page").try_cast("int")
    out = fields.select("document_id", "field_key", "label", "value", F.coalesce("status", F.lit("pending")).alias("status"), authoritative(F.col("status")).alias("authoritative"), F.when(page > 0, page).otherwise(1).alias("page"))
    return out.where("authoritative") if authoritative_only else out


def document_json(fields: DataFrame, key: str = "document_id") -> DataFrame:
    """document_id, json (the approved values by key, the last one of a repeated key), skipped: keys not approved."""
    f = fields.withColumn("_ok", authoritative(F.col("status")))
    last = f.where("_ok").groupBy(key, "field_key").agg(F.max_by("value", "seq").alias("value"))
    made = last.groupBy(key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_key", "value"))))).alias("json"))
    skipped = f.where("not _ok").groupBy(key).agg(F.sort_array(F.collect_set("field_key")).alias("skipped"))
    return made.join(skipped, key, "full_outer").select(key, F.coalesce("json", F.lit("{}")).alias("json"), F.coalesce("skipped", F.array().cast("array<string>")).alias("skipped"))


def largest_table(tables: DataFrame, key: str = "document_id") -> DataFrame:
    """The table with most rows of each document, the first on ties, as rows: key, row, cells (map header to value)."""
    best = tables.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.size("rows").desc(), "table_key"))).where("_rn = 1")
    each = best.select(key, "headers", F.posexplode("rows").alias("row", "_cells"))
    padded = F.transform(F.sequence(F.lit(0), F.size("headers") - 1), lambda i: F.coalesce(F.get("_cells", i), F.lit("")))
    return each.select(key, "row", F.map_from_arrays("headers", padded).alias("cells"))


def selected(records: DataFrame, manifest: DataFrame, fields: list[str], identifier: str = "record_id", order: str = "source_order") -> DataFrame:
    """The chosen cells of a table, in the table's own order: manifest rows are (record_id, fields); other cells are null,
    the identifier is always there, and unknown records or fields are an error."""
    unknown = manifest.join(records, identifier, "left_anti").limit(1).union(manifest.where(F.size(F.array_except("fields", F.array(*[F.lit(f) for f in fields]))) > 0).limit(1)).take(1)
    if unknown:
        raise ValueError(f"unknown record or field: {unknown[0]}")
    picked = records.join(manifest.withColumnRenamed("fields", "_fields"), identifier)
    return picked.orderBy(order).select(identifier, *[F.when(F.array_contains("_fields", f), F.col(f)).alias(f) for f in fields])


def normalized_document(fields: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key and document: JSON of {fields: {name: value}, tables: {name: [rows]}} of each document in `fields` (key, name,
    value, place) or `rows` (key, table, place, cells as a map). The prefix kv_ of names is dropped; of fields of one name
    the last by place counts; names and rows are sorted. A document without tables has none in its JSON."""
    named = fields.where("name is not null").withColumn("_name", F.regexp_replace("name", "^kv_", ""))
    last = named.groupBy(key, "_name").agg(F.max_by("value", "place").alias("_v"))
    maps = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_v")))).alias("fields"))
    tables = rows.groupBy(key, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.to_json("cells").alias("c")))), lambda x: x["c"]).alias("_rows"))
    lists = tables.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "_rows")))).alias("tables"))
    return maps.join(lists, key, "full_outer").select(key, F.to_json(F.struct("fields", "tables")).alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Folders that a table of documents is dealt out to, by the hash of the key.
BUCKETS = 64


def replace_documents(df: DataFrame, path: str, key: str = "document_id", buckets: int = BUCKETS) -> None:
    """Puts the documents of `df` in the place of those the table at `path` has, and leaves all others: a rerun gives the same
    table. Documents stand in folders by the hash of their key (column `bucket`), a fixed number whatever their number;
    only folders that `df` touches are read and written. What they keep is checkpointed before they are overwritten."""
    spark = df.sparkSession
    new = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` rows
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        old = None
    if old is not None:
        kept = old.where(F.col("bucket").isin(touched)).join(new.select(key).distinct(), key, "left_anti")
        new = checkpointed(new.unionByName(kept, allowMissingColumns=True))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def sheet_titles(names: DataFrame, name: str, order: str, limit: int = 28) -> DataFrame:
    """Names as sheet titles: reserved characters as blanks, cut, and numbered where they are equal in any case; a title of
    many rows is numbered in ranges."""
    safe = F.coalesce(F.nullif(F.trim(F.substring(F.regexp_replace(name, r"[\[\]:*?/\\]", " "), 1, limit)), F.lit("")), F.lit("Sheet"))
    rows = numbered(names.withColumn("_title", safe).withColumn("_low", F.lower("_title")), ["_low"], [order], "_at")
    return rows.withColumn("title", F.when(F.col("_at") == 1, F.col("_title")).otherwise(F.concat("_title", F.lit(" "), F.col("_at").cast("string")))).drop("_title", "_low", "_at")
