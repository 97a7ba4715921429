"""Evidence of values (§2.9.4, 2.10.2, 2.10.10, 2.10.16, 2.5.29, 2.5.44): words and figures found in a source, checks, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflux.functions.similarity import canonical

#: How far a figure may stand off (fixed value), codes that stand for an amount, and what reviewers read for reasons.
NEAR = 0.005
NO_PRICE = ("NSP", "N/A")
LABELS = {"missing": "Value is missing", "not_a_date": "Not a valid date", "not_positive": "Not a positive number", "pattern": "Unexpected format", "value_changed": "The machine reads another value now", "low_confidence": "Low confidence"}
_FIGURE = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def has_token(value: Column, evidence: Column) -> Column:
    """Whether the evidence has the value between characters that are no digits or small letters, both in canonical form; an
    empty value is nowhere."""
    v = canonical(F.coalesce(value, F.lit("")))
    quoted = F.concat(F.lit(r"(?<![0-9a-z])\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![0-9a-z])"))
    return F.when(v == "", F.lit(False)).otherwise(F.rlike(canonical(F.coalesce(evidence, F.lit(""))), quoted))


def has_figure(value: Column, evidence: Column) -> Column:
    """Whether a figure in the evidence has the value's magnitude within 0.005; signs and brackets don't count."""
    figures = F.regexp_extract_all(F.coalesce(evidence, F.lit("")), F.lit(_FIGURE), F.lit(0))
    return F.coalesce(F.exists(figures, lambda x: F.abs(F.abs(F.replace(x, F.lit(","), F.lit("")).try_cast("double")) - F.abs(value)) < NEAR), F.lit(False))


def iso_date(c: Column) -> Column:
    """The date that the first ten characters are, or null."""
    return F.when(F.substring(c, 1, 10).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def verified(status: Column) -> Column:
    """Whether a status says verified or pass anywhere, as in unverified too; null doesn't."""
    return F.coalesce(F.lower(status).rlike("verified|pass"), F.lit(False))


def amount_stated(cell: Column) -> Column:
    """Whether a cell that isn't empty has a figure, or a code for no price; null for an empty cell."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(text != "", text.rlike("[0-9]") | F.upper(text).isin(*NO_PRICE))


def reason_labels(reasons: Column) -> Column:
    """What the codes say to a reader; unknown codes stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.transform(reasons, lambda x: F.coalesce(F.try_element_at(known, x), x))
