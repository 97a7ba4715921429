"""Validation reports (§2.5.45): many checks of a table in one pass, by aggregates that add up, exact ones and sketches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A check: what is expected, an aggregate that counts or measures, and when its value passes. An aggregate that
    combines map-side (sums, extremes, sketches) keeps the report at one row a task."""

    name: str
    expected: str
    value: Column
    passes: Column | None = None

    def result(self) -> Column:
        v = F.col(f"`{self.name}`")
        return F.when(F.coalesce(v == 0 if self.passes is None else self.passes, F.lit(False)), "PASS").otherwise("REVIEW")


def violations(name: str, expected: str, bad: Column) -> Check:
    """Passes if no row is bad; a condition that is null is not."""
    return Check(name, expected, F.count_if(F.coalesce(bad, F.lit(False))).cast("double"))


def between(name: str, expected: str, value: Column, low: float, high: float) -> Check:
    """Passes if the measured value lies in the range; null, as of an empty table, doesn't."""
    return Check(name, expected, value.cast("double"), F.col(f"`{name}`").between(low, high))


def distinct_about(name: str, key: Column, share: float = 0.95, sketch: int = 14) -> Check:
    """Passes if a HyperLogLog sketch finds nearly as many different keys as there are: exact repeats need a shuffle of all
    keys, this one row a task. Its error is about 1 % at 14 bits."""
    return between(name, f"at least {share:.0%} of the keys differ (sketch)", F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(sketch))) / F.greatest(F.count(key), F.lit(1)), share, 2.0)


def quantile_between(name: str, value: Column, q: float, low: float, high: float, accuracy: int = 1000) -> Check:
    """Passes if the q-quantile, from a mergeable summary with a rank error of 1/accuracy, lies in the range."""
    return between(name, f"the {q} quantile lies in {low:g} to {high:g} (sketch)", F.percentile_approx(value, F.lit(q), F.lit(accuracy)), low, high)


def report(df: DataFrame, checks: list[Check]) -> DataFrame:
    """place, check, expected, value and result (PASS or REVIEW), one row a check: checks flag, they change nothing. All are
    aggregates of one scan. Of an empty table counts of bad rows are 0 and pass, measured values are null and don't."""
    one = df.agg(*[c.value.alias(c.name) for c in checks])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(c.name).alias("check"), F.lit(c.expected).alias("expected"), F.col(f"`{c.name}`").cast("double").alias("value"), c.result().alias("result")) for i, c in enumerate(checks, 1)]
    return one.select(F.inline(F.array(*rows)))
