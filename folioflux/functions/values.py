"""Dates, numbers, confidence and review decisions as Column expressions (§2.10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MM-dd-yyyy")
#: Base confidence by extraction method; any other has 0.60. Fixed values.
METHOD_BASE = {
    "source_evidence": 0.90, "form_field": 0.82, "label_value": 0.72, "layout_proximity": 0.68, "layout_form_cell": 0.80, "layout_form_cell_right": 0.82,
    "layout_form_cell_below": 0.78, "layout_inline_same_line": 0.76, "targeted_crop_ocr": 0.74, "regex": 0.70, "ai": 0.55,
}


def lenient_date(c: Column) -> Column:
    """The first format that fits; years up to 1900 count as none."""
    day = F.coalesce(*[F.try_to_date(F.trim(c), f) for f in DATE_FORMATS])
    return F.when(F.year(day) > 1900, day)


def to_number(c: Column) -> Column:
    """The first number in a text; parentheses around it or a minus before it make it negative."""
    figure = F.regexp_extract(c, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    value = F.replace(figure, F.lit(","), F.lit("")).try_cast("double")
    return F.when(c.rlike(r"\([^0-9]*[0-9][0-9,.]*\s*\)|-\s*[$€£]?\s*[0-9]"), -value).otherwise(value)


def money(c: Column) -> Column:
    """A printed amount; UNDEFINED, NSP and N/A have none."""
    return F.when(~F.upper(F.trim(c)).isin("UNDEFINED", "NSP", "N/A", ""), F.regexp_replace(c, "[$,\\s]", "").try_cast("double"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def close(a: Column, b: Column, parts: Column | int = 1) -> Column:
    """Equal amounts, within a cent for each of the parts that were summed and half a cent more."""
    n = F.greatest(F.lit(1), F.lit(parts) if isinstance(parts, int) else parts)
    return F.abs(a - b) <= n * 0.01 + 0.005


def method_base(method: Column) -> Column:
    found = F.lit(0.60)
    for name, value in METHOD_BASE.items():
        found = F.when(method == name, value).otherwise(found)
    return found


def confidence(base: Column, repeats: Column, exact: Column, passed: Column, grounded: Column | bool = True, ambiguous: Column | bool = False, match: Column | float = 1.0, ocr: Column | None = None, coverage: Column | None = None, layout: Column | None = None) -> Column:
    """How sure a value is, to two places.

    From the method's base: 0.15 for each unit the match falls short of exact, 0.05 more for the exact label, 0.03 for each
    repeat up to 0.10; on a page read by OCR (`ocr` true: with success, false: without, null: native text) 0.08 or 0.25
    less, and 0.05 less where its coverage is under 0.3; a layout score counts 3 parts in 10. Then 0.05 more if the source
    has the value, 0.05 more if validation passed or 0.20 less, 0.15 less among several candidates. Held to 0.05 to 0.99,
    and to 0.59 where validation failed."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    points = lambda c, yes, no=0.0: F.when(as_column(c), yes).otherwise(no)
    total = base + (as_column(match) - 1.0) * 0.15 + points(exact, 0.05) + F.greatest(F.lit(0.0), F.least(F.lit(0.10), (repeats - 1) * 0.03))
    if ocr is not None:
        low = F.lit(False) if coverage is None else F.coalesce(coverage, F.lit(0.0)) < 0.3
        total = total - F.when(ocr.isNull(), 0.0).when(~ocr, 0.25).otherwise(F.lit(0.08) + points(low, 0.05))
    if layout is not None:
        total = F.when(layout.isNotNull(), total * 0.7 + layout * 0.3).otherwise(total)
    total = total + points(grounded, 0.05) + points(passed, 0.05, -0.20) - points(ambiguous, 0.15)
    return F.round(clamp(F.least(total, points(passed, 0.99, 0.59)), 0.05, 0.99), 2)


def band(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.60, "medium").otherwise("low")


def review(reasons: dict[str, Column], c: Column, auto_accept: bool = False) -> Column:
    """struct<reasons, status, priority, review_status> of a value of confidence c.

    low_confidence, then those of `reasons` that hold. Without one the value is ready to accept, its priority its band;
    with one it needs review, at low priority if confidence is low, validation failed or candidates are ambiguous, else
    medium. It stays pending, unless high ones are accepted by themselves (`auto_accept`)."""
    every = {"low_confidence": c < 0.60, **reasons}
    held = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in every.items()]), lambda x: x.isNotNull())
    ready = F.size(held) == 0
    grave = F.arrays_overlap(held, F.array(*[F.lit(x) for x in ("low_confidence", "validation_failed", "ambiguous_candidates")]))
    priority = F.when(ready, band(c)).when(grave, "low").otherwise("medium")
    accepted = F.when(ready & (band(c) == "high") & F.lit(auto_accept), "accepted").otherwise("pending")
    return F.struct(held.alias("reasons"), F.when(ready, "ready_to_accept").otherwise("needs_review").alias("status"), priority.alias("priority"), accepted.alias("review_status"))
