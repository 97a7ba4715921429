"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.common import bitmap, flagged, text_of
from folioflux.sources.tables import load

#: Characters of the prefix that the second step hashes.
PREFIX = 256
#: Bits of the bitmaps that carry surviving groups to the next scan: 2**22 bits are at most 65,536 rows, about 1 MB.
BITS = 22


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS, hash_all: bool = False) -> DataFrame:
    """Groups of equal texts: one row per row of `docs` with id_col, keep_id, group_size, kept and text_sha256.

    Three scans, each of which leaves fewer texts to the next: lengths that occur once are settled by the first, pairs
    of length and prefix hash that occur once by the second, and only what is left is read and hashed in full by the
    third. The surviving groups of a step reach the next scan as a bitmap of 2**bits bits, which is broadcast: its size
    is bounded however many groups there are, and a bit shared by chance only means a text that is hashed needlessly.
    No text is shuffled; groups are counted map-side first, so that a group with a third of all rows is a few rows.

    Of equal texts the row with the largest id stays. Null counts as the empty text. Rows with a null id count in
    group_size and are kept only where their whole group has null ids; rows that repeat an id and its text count each,
    and share that id's fate. text_sha256 is null for rows settled by the first two steps, unless hash_all is set. An
    empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    sized = base.withColumn("_len", F.octet_length("_text")).withColumn("_k1", F.xxhash64("_len"))
    lengths = sized.groupBy("_k1").agg(F.count("*").alias("n")).where("n > 1")
    by_length = flagged(sized, "_k1", bitmap(lengths, "_k1", bits), bits, "_same_length")
    by_length = by_length.withColumn("_k2", F.when(F.col("_same_length"), F.xxhash64("_len", F.substring("_text", 1, prefix))))
    prefixes = by_length.where("_same_length").groupBy("_k2").agg(F.count("*").alias("n")).where("n > 1")
    by_prefix = flagged(by_length, "_k2", bitmap(prefixes, "_k2", bits), bits, "_same_prefix")
    full = F.sha2(F.col("_text"), 256)
    hashed = by_prefix.select("_id", (full if hash_all else F.when(F.col("_same_prefix"), full)).alias("text_sha256"), "_same_prefix")
    groups = hashed.where("_same_prefix").groupBy(F.col("text_sha256").alias("_sha")).agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    # Rows settled before have no hash to meet a group by: their own id spreads them over the partitions. The key is a
    # new expression on either side, so that both are dealt out for the join and AQE can split a hot group's partition.
    keyed = hashed.withColumn("_key", F.coalesce(F.unhex("text_sha256"), F.col("_id").cast("string").cast("binary"), F.lit("").cast("binary")))
    return keyed.join(groups.withColumn("_group", F.unhex("_sha")), F.col("_key") == F.col("_group"), "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("_keep", "_id").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.coalesce("_keep", "_id")).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents."""
    return exact_duplicates(load(spark, sf_dir, "documents"), hash_all=True)


OP3_SQL = """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT h.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, h.doc_id = g.keep_id AS kept, h.text_sha256
FROM h JOIN g USING (text_sha256)
"""
