"""Operators on positioned words (§2.1.43, 2.6.12 to 2.6.16): boxes, lines, reading order, fused OCR passes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes (structs x0, y0, x1, y1) over their union."""
    c = lambda s, k: F.col(f"{s}.{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, x0, y0, x1, y1, text) with `line` numbers: a word whose middle is below the bottoms so far starts a line."""
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "text")
    bottom = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    broken = words.withColumn("_new", F.when(((F.col("y0") + F.col("y1")) / 2 < bottom), 0).otherwise(1))
    return broken.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def reading_order(runs: DataFrame, keys: list[str], gutter: float = 12.0, gap: float = 6.0) -> DataFrame:
    """runs (keys, x0, y0, x1, y1, text) with `place`: recursive cuts, across at blank bands, else down the widest gutter.
    One page is a group; what a group needs is a page's runs."""
    schema = runs.select(*keys, "x0", "y0", "x1", "y1", "text").schema.add("place", "integer")

    def cut(rows, low, high, least):
        rows = sorted(rows, key=lambda r: (r[low], r[high]))
        best, at, reach = least, None, rows[0][high]
        for i, r in enumerate(rows[1:], 1):
            if r[low] - reach > best:
                best, at = r[low] - reach, i
            reach = max(reach, r[high])
        return None if at is None else (rows[:at], rows[at:])

    def order(rows, depth=0):
        if len(rows) < 2 or depth > 40:
            return sorted(rows, key=lambda r: (r["y0"], r["x0"]))
        parts = cut(rows, "y0", "y1", gap * 2) or cut(rows, "x0", "x1", gutter) or cut(rows, "y0", "y1", gap)
        return sorted(rows, key=lambda r: (r["y0"], r["x0"])) if parts is None else order(parts[0], depth + 1) + order(parts[1], depth + 1)

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = order(pdf.to_dict("records"))
        return pd.DataFrame([{**r, "place": i} for i, r in enumerate(rows)])[schema.names]

    return runs.select(*schema.names[:-1]).groupBy(*keys).applyInPandas(page, schema)


def fused(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Two OCR passes (keys, word, box, text, confidence) as one: words whose boxes overlap by 0.6 are the same word; the
    surer reading stays where they agree, the primary's at the lower confidence where they don't, and words of the second
    pass that overlap none by 0.3 are added."""
    a, b = primary.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("word", "box", "text", "confidence")]), secondary.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("word", "box", "text", "confidence")])
    met = a.join(b, keys).withColumn("iou", iou("a_box", "b_box")).where("iou > 0")
    best = met.where("iou >= 0.6").withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "a_word").orderBy(F.col("iou").desc(), "b_word"))).where("rn = 1").select(*keys, "a_word", "b_text", "b_confidence")
    kept = a.join(best, [*keys, "a_word"], "left").select(
        *keys, F.col("a_box").alias("box"), F.col("a_text").alias("text"),
        F.when(F.col("b_text").isNull(), F.col("a_confidence")).when(F.col("a_text") == F.col("b_text"), F.greatest("a_confidence", "b_confidence")).otherwise(F.least("a_confidence", "b_confidence")).alias("confidence"),
    )
    added = b.join(met.where("iou >= 0.3").select(*keys, "b_word"), [*keys, "b_word"], "left_anti").select(*keys, F.col("b_box").alias("box"), F.col("b_text").alias("text"), F.col("b_confidence").alias("confidence"))
    return kept.unionByName(added)
