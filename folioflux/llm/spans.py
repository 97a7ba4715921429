"""Matches of patterns with their places, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place_matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<at, match, group>> of the leftmost non-overlapping matches: `at` counts code points from 0.

    The pieces between the matches and the matches themselves, laid end to end, give each match its place. Places are
    summed in blocks of sqrt(n) matches and blocks then moved to theirs, so that the work for n matches in one text grows
    as n * sqrt(n). Texts without a match cost one search. No match of `pattern` may be empty. With `group` the text of
    that group comes too.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.split(text, pattern, -1).alias("piece"), whole.alias("match")]
    parts.append((F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else whole).alias("group"))
    empty = F.expr("cast(array() as array<struct<at:int,match:string,group:string>>)")

    def step(seen, x):
        at = seen["pos"] + F.length(x["piece"])
        one = F.array(F.struct(at.alias("at"), x["match"].alias("match"), x["group"].alias("group")))
        found = x["match"].isNotNull()
        return F.struct(
            F.when(found, at + F.length(x["match"])).otherwise(at).cast("int").alias("pos"),
            F.when(found, F.concat(seen["out"], one)).otherwise(seen["out"]).alias("out"),
        )

    def laid(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda k: F.slice(x, k * size + 1, size))
        return F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).cast("int").alias("pos"), empty.alias("out")), step))

    def moved(seen, b):
        out = F.transform(b["out"], lambda m: F.struct((m["at"] + seen["pos"]).alias("at"), m["match"].alias("match"), m["group"].alias("group")))
        return F.struct((seen["pos"] + b["pos"]).alias("pos"), F.concat(seen["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(0).cast("int").alias("pos"), F.expr("cast(array() as array<array<struct<at:int,match:string,group:string>>>)").alias("out"))
    placed = F.flatten(F.transform(F.array(F.arrays_zip(*parts)), lambda x: F.flatten(F.aggregate(laid(x), start, moved, lambda seen: seen["out"]))))
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(empty)


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of `spans` (with `at` and `end`, in order, not overlapping) meets the stretch from start to end: by
    binary search for the last one that begins before `end`."""
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(x, _):
        middle = F.floor((x["lo"] + x["hi"]) / 2).cast("int")
        before = F.get(spans, middle)["at"] < end
        open_ = x["lo"] < x["hi"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(x["lo"]).alias("lo"), F.when(open_ & ~before, middle).otherwise(x["hi"]).alias("hi"))

    last = F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda x: F.get(spans, x["lo"] - 1)["end"])
    return F.when(F.size(spans) > 0, F.coalesce(last > start, F.lit(False))).otherwise(F.lit(False))
