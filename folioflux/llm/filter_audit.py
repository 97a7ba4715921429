"""Audit of how filters interact: histograms of failure masks, multiplied by integer matrices of all orders and steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.common import BLANKS, text_of
from folioflux.sources.tables import load

#: Filters whose orders are laid out in full: 6! * 6 columns of 2**6 rows are the most that is reasonable.
MAX_FILTERS = 6
#: Parts multiplied at a time; each gives a row for every order and step.
SLICE_PARTS = 32
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def incidence(letters: str) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """(order of each column, step of each column, matrices). A row of a matrix is a failure mask, bit i for the filter
    letters[i]; a column is one step of one order. An entry of `kept`, `removed`, `redundant` and `unique` is 1 where a
    document of that mask has that outcome at that step; `shapley` holds, for the column's filter, in how many of all
    orders a document of that mask is removed by it. So a row of counts by mask, times a matrix, counts outcomes."""
    if not 0 < len(letters) <= MAX_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"1 to {MAX_FILTERS} different letters")
    k, masks = len(letters), np.arange(1 << len(letters))[:, None]
    orders = list(permutations(range(k)))
    own = np.array([1 << f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:step]) for order in orders for step in range(k)])
    fails, gone = (masks & own) != 0, (masks & before) != 0
    removed = (fails & ~gone).astype(np.int64)
    total = {f: removed[:, own == 1 << f].sum(axis=1) for f in range(k)}
    made = {
        "kept": ((masks & (own | before)) == 0).astype(np.int64),
        "removed": removed,
        "redundant": (fails & gone).astype(np.int64),
        "unique": (masks == own).astype(np.int64),
        "shapley": np.stack([total[f] for order in orders for f in order], axis=1),
    }
    return ["".join(letters[f] for f in order) for order in orders for _ in range(k)], np.tile(np.arange(1, k + 1), len(orders)), made


def outcomes(histograms: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and OUTCOMES, one row for each part, order and step, zeros included, from the counts
    (part, mask, n, good, toxic), one row at most for a part and mask.

    A part is gathered as 2**k counts at most, whatever the number of its documents; its three histograms are rows of one
    integer matrix that is multiplied by each incidence matrix, so that nothing is expanded by order before it is counted.
    An empty table has no parts and gives no rows.
    """
    one = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUTCOMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, step, matrix = incidence(letters)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_PARTS):
                batch = whole.slice(at, SLICE_PARTS)
                counts = batch.column(1)
                row = np.repeat(np.arange(len(counts)), np.diff(counts.offsets.to_numpy()))
                flat = counts.flatten()
                mask, *values = (flat.field(i).to_numpy() for i in range(4))
                stacked = np.zeros((3, len(counts), 1 << len(letters)), dtype=np.int64)
                for kind, value in enumerate(values):
                    stacked[kind, row, mask] = value
                all_, good, toxic = stacked
                made = (all_ @ matrix["kept"], all_ @ matrix["removed"], all_ @ matrix["redundant"], all_ @ matrix["unique"], good @ matrix["removed"], toxic @ matrix["removed"], all_ @ matrix["shapley"])
                parts = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), len(order))))
                columns = [parts, pa.array(order * len(counts)), pa.array(np.tile(step, len(counts)), type=pa.int32()), *(pa.array(x.ravel()) for x in made)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *OUTCOMES])

    return one.mapInArrow(run, schema)


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text: few words, few distinct words, many capitals, a symbol of tables or code."""
    words = F.filter(F.split(text, BLANKS), lambda x: x != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def failure_histograms(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", failures=text_failures, good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail exactly the filters in `mask`, of all and of those
    that `labels` marks good and toxic. The conditions `failures` gives for a text are bits 0 up; the next bit is set where
    any row with a smaller id has the same text.

    Texts don't leave their task: a document goes on as its id, part, mask and the SHA-256 of its text. Copies are counted
    map-side by text, part and labels, beside the smallest id and how many rows have it: a group of copies that holds a
    third of all rows is a few rows of the shuffle.

    A null text is empty; a null part is ''. A row with a null id has no smaller id, nor is it one; its labels are unknown.
    Rows that repeat an id are documents of their own, and equal texts of one id don't fail for each other. Of labels
    that repeat an id any mark counts. Other columns are ignored.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures(F.col("_text")))]
    rows = base.select("_id", "_part", reduce(lambda a, b: a + b, bits, F.lit(0)).alias("_mask"), F.unhex(F.sha2("_text", 256)).alias("_sha"))
    # a null id meets no label: its text spreads such rows over the partitions
    rows = rows.withColumn("_known", F.col("_id").isNotNull()).withColumn("_key", F.coalesce(F.col("_id").cast("string"), F.base64("_sha")))
    mark = lambda c, name: F.coalesce(F.max(F.when(F.col(c) == 1, 1).otherwise(0)), F.lit(0)).alias(name)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("_key"), F.lit(True).alias("_known")).agg(mark(good_col, "_good"), mark(toxic_col, "_toxic"))
    marked = rows.join(marks, ["_key", "_known"], "left").fillna(0, ["_good", "_toxic"])
    kind = ["_sha", "_part", "_mask", "_good", "_toxic"]
    by_id = marked.groupBy("_key", "_known", "_id", *kind).agg(F.count("*").alias("_c"))
    first = F.when(F.col("_known"), F.struct("_id", "_c"))
    copies = by_id.groupBy(*kind).agg(F.sum("_c").alias("_n"), F.sum(F.when(~F.col("_known"), F.col("_c")).otherwise(0)).alias("_loose"), F.min(first).alias("_first"))
    least = copies.groupBy("_sha").agg(F.min("_first._id").alias("_least"), F.count("*").alias("_kinds"))
    met = copies.join(least, "_sha")
    passing = F.col("_loose") + F.when(F.col("_first._id") == F.col("_least"), F.col("_first._c")).otherwise(0)
    bit = 1 << len(bits)
    split = met.select("_part", "_good", "_toxic", F.explode(F.array(F.struct(F.col("_mask").alias("mask"), passing.alias("n")), F.struct((F.col("_mask") + bit).alias("mask"), (F.col("_n") - passing).alias("n")))).alias("_x"))
    n = F.col("_x.n")
    return split.where("_x.n > 0").groupBy(F.col("_part").alias("part"), F.col("_x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("_good")).alias("good"), F.sum(n * F.col("_toxic")).alias("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters A to E over all documents: a row for each source, order of the filters and step."""
    return outcomes(failure_histograms(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")), "ABCDE")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS mask,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM f a, f b, f c, f d, f e
  WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step, bs[step] AS own, CAST(list_sum(bs[1:step]) AS INTEGER) - bs[step] AS before FROM o, generate_series(1, 5) g(step)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
