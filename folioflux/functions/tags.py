"""Labels of XML and form tags (§2.9.46): compounds cut by a dictionary table, other tags by their signs and capitals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters a word of the dictionary may have, and those from which a tag may be a compound (fixed values).
LONGEST, SHORTEST = 14, 6


def spaced(tag: Column) -> Column:
    """A tag's words: at signs, where a capital follows a small letter or begins a word after capitals, and before digits;
    each with its first letter as a capital."""
    text = F.regexp_replace(tag, r"[_\-.:]+", " ")
    for rule in ("(?<=[a-z])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z])", "(?<=[A-Za-z])(?=[0-9])"):
        text = F.regexp_replace(text, rule, " ")
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), " ")


def compounds(tags: DataFrame, dictionary: DataFrame, tag: str = "tag", word: str = "word") -> DataFrame:
    """tag and parts (two or more) of the tags that are words of the dictionary set together, all in one case.

    Of all ways to cut a tag the one with the fewest parts counts; of these the one whose last part is longest, then the
    one before. All stretches of a tag that are words come from one join with the dictionary, and the best way to each
    place is folded over them from left to right, natively; nothing is tried twice. A dictionary of any size is a table."""
    known = dictionary.select(F.lower(F.col(word)).alias("_word")).where(F.length("_word").between(1, LONGEST)).distinct()
    t = tags.select(F.col(tag).alias("tag")).distinct().withColumn("_low", F.lower("tag"))
    t = t.where(F.col("tag").rlike("^([a-z]+|[A-Z]+)$") & (F.length("tag") >= SHORTEST)).join(known, F.col("_low") == F.col("_word"), "left_anti")
    stretches = F.expr(f"flatten(transform(sequence(1, length(_low)), s -> transform(sequence(s, least(length(_low), s + {LONGEST - 1})), e -> struct(e AS e, s - 1 AS s, substring(_low, s, e - s + 1) AS w))))")
    found = t.select("tag", F.length("tag").alias("_n"), F.explode(stretches).alias("_x")).join(known, F.col("_x.w") == F.col("_word"))
    steps = found.groupBy("tag", "_n").agg(F.array_sort(F.collect_list("_x")).alias("_steps"))

    def better(best, x):
        before = F.try_element_at(best, x["s"])
        now = F.try_element_at(best, x["e"])
        improves = before.isNotNull() & (now.isNull() | (F.size(before) + 1 < F.size(now)))
        with_it = F.map_concat(F.map_filter(best, lambda k, v: k != x["e"]), F.create_map(x["e"], F.concat(before, F.array(x["w"]))))
        return F.when(improves, with_it).otherwise(best)

    start = F.expr("map(0, cast(array() as array<string>))")
    cut = steps.select("tag", F.try_element_at(F.aggregate("_steps", start, better), F.col("_n")).alias("parts"))
    return cut.where(F.size("parts") >= 2)


def tag_labels(tags: DataFrame, dictionary: DataFrame, tag: str = "tag", word: str = "word") -> DataFrame:
    """tag and label of each different tag; null and empty tags have none and are left out."""
    t = tags.select(F.col(tag).alias("tag")).where("tag <> ''").distinct()
    cut = compounds(t, dictionary, "tag", word)
    label = F.when(F.col("parts").isNotNull(), F.array_join(F.transform("parts", lambda x: F.initcap(x)), " ")).otherwise(spaced(F.col("tag")))
    return t.join(cut, "tag", "left").select("tag", label.alias("label"))
