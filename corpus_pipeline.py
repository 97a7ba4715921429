"""From raw documents to a training mix: toxicity, exact copies, near copies, benchmark leaks, then the mix of sources.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents, whatever their names. Each row is
a document of its own, also where ids repeat or are null: of equal rows one stays, and rows with a null id go before others.
Null texts are empty; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.common import row_keyed, staged, without
from folioflux.llm.decontamination import contamination
from folioflux.llm.exact_dedup import exact_duplicates
from folioflux.llm.mixing import mix_sources
from folioflux.llm.ngram_join import near_duplicates
from folioflux.llm.toxicity import fit, score_texts, threshold_of
from folioflux.sources.tables import load


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below their language's threshold, by a model of the labelled ones."""
    model = fit(docs, load(spark, sf_dir, "labels"))
    scored = score_texts(docs, model)
    return scored.where(F.col("score") < threshold_of(model, F.col("_row.lang"))).select("_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    rows = row_keyed(docs)
    found = exact_duplicates(rows.select("_key", "_row.text"), id_col="_key")
    return without(rows, found.where("not kept").select(F.col("_key").alias("_id")), "_key").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a Jaccard similarity of 0.8 the one with the smallest doc_id."""
    rows = row_keyed(docs, nulls=(1 << 63) - 1)
    found = near_duplicates(rows.select("_key", "_row.text"), id_col="_key")
    return without(rows, found.where("_key <> component_id").select(F.col("_key").alias("_id")), "_key").select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's window of ten words."""
    return contamination(docs, load(spark, sf_dir, "benchmark")).where("n_hit = 0").select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: A trained classifier has no SQL; tests/llm/test_pipeline.py holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is a table in the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
