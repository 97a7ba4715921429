"""Bags of words (§2.4.24, 2.4.25) and alike names (§2.4.13, 2.9.31): joins on tokens with filters that lose no pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions.similarity import ratio
from folioflux.session import checkpointed

#: A table accounts for its words if it holds this share of them; pages with fewer words are not asked (fixed values).
COVERED, FEWEST = 0.85, 4
#: Two titles are the same from this ratio on (fixed value).
TITLE = 0.6


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def bag_overlap(left: DataFrame, right: DataFrame, keys: list[str], tokens: str = "token") -> DataFrame:
    """keys, n_left, n_right, shared and share for each key of `left`: how many of its tokens the right side of that key holds,
    a token as often as it is on both sides, over the smaller side's tokens (0 if that is empty).

    Both sides are rows (keys, token). Tokens are counted map-side by key, and counts are joined on key and token: a key
    with a third of all rows is spread over its tokens, a frequent token is one row. Null keys or tokens count nowhere."""
    count = lambda df, name: df.where(" and ".join(f"`{k}` is not null" for k in [*keys, tokens])).groupBy(*keys, tokens).agg(F.count("*").alias(name))
    both = count(left, "_l").join(count(right, "_r"), [*keys, tokens], "full_outer").fillna(0, ["_l", "_r"])
    sums = both.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"), F.sum(F.least("_l", "_r")).alias("shared")).where("n_left > 0")
    smaller = F.least("n_left", "n_right")
    return sums.withColumn("share", F.when(smaller > 0, F.col("shared") / smaller).otherwise(F.lit(0.0)))


def accounts_for(overlap: DataFrame) -> DataFrame:
    """bag_overlap() of a page's words (left) and its table's cells, with `accounts`: whether the table may stand for them."""
    return overlap.withColumn("accounts", (F.col("n_left") < FEWEST) | (F.col("shared") >= COVERED * F.col("n_left")))


def contained(blocks: DataFrame, rows: DataFrame, keys: list[str], block: str, cells: str) -> DataFrame:
    """`blocks` (keys, `block` text, ...) with `found`: 'header' or 'row' for the first kind of table row (keys, kind, `cells`
    text) of its key whose text contains the block's, else null; headers go before rows.

    Both texts become words with one blank between. Of a block of three words or more the inner ones are words of the row,
    of a shorter one the first three characters stand in it: the join is on the key and on the longest inner word, or on
    those characters, and only rows that have them are searched. Blocks without words are found nowhere."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "))
    longest = lambda a: F.reduce(a, F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    names = blocks.columns
    b = blocks.withColumn("_block", clean(block)).withColumn("_words", F.split("_block", " "))
    inner = F.concat(F.lit(" "), longest(F.slice("_words", 2, F.greatest(F.size("_words") - 2, F.lit(1)))), F.lit(" "))
    b = checkpointed(b.withColumn("_at", F.when(F.size("_words") > 2, inner).otherwise(F.substring("_block", 1, 3))).drop("_words").withColumn("_id", F.monotonically_increasing_id()))
    r = rows.select(*keys, "kind", clean(cells).alias("_row")).where("_row <> ''").distinct()
    parts = [F.expr(f"transform(sequence(1, length(_row)), p -> substring(_row, p, {k}))") for k in (1, 2, 3)]
    words_in = F.transform(F.split("_row", " "), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    placed = r.withColumn("_at", F.explode(F.array_distinct(F.concat(words_in, *parts))))
    met = b.where("_block <> ''").select("_id", *keys, "_at", "_block").join(placed, [*keys, "_at"]).where(F.contains(F.col("_row"), F.col("_block")))
    best = met.groupBy("_id").agg(F.min(F.when(F.col("kind") == "header", 0).otherwise(1)).alias("_k"))
    return b.join(best, "_id", "left").select(*names, F.when(F.col("_k") == 0, "header").when(F.col("_k") == 1, "row").alias("found"))


def alike(left: DataFrame, right: DataFrame | None = None, name: str = "name", least: float = TITLE) -> DataFrame:
    """name, other, ratio, n and n_other of all pairs of different names whose ratio() is `least` or more; n rows have the name,
    n_other rows the other. Of one table (right None) each pair comes once, the smaller name first.

    Names are made distinct, as letters and digits in lower case, before they are compared: copies cost nothing. A ratio
    is twice the matched characters over both lengths, and matched characters are common ones, copies numbered. So a pair
    from `least` on has lengths within a factor and shares so many numbered characters that it must share one of the
    rarest few of either name: the join is on those, lengths and counts are tested before a name is compared in full.
    No pair is lost; the ratio itself depends on the order of a pair, the one given is that of (name, other)."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", "")

    def prepared(df):
        d = df.select(F.col(name).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n")).withColumn("_p", plain("name")).where("_p <> ''")
        # the k-th copy of a character is a token of its own
        chars = F.array_sort(F.split("_p", ""))
        numbered = F.transform(chars, lambda x, i: F.concat(x, (i - F.array_position(chars, x)).cast("string")))
        return checkpointed(d.withColumn("_t", F.filter(numbered, lambda x: F.length(x) > 1)).withColumn("_len", F.length("_p")))

    a = prepared(left)
    b = a if right is None else prepared(right)
    tokens = (a if right is None else a.unionByName(b)).select(F.explode("_t").alias("_x")).groupBy("_x").agg(F.count("*").alias("_f"))
    share = least / (2 - least)

    def leading(d):
        each = d.select("name", "_len", F.explode("_t").alias("_x")).join(tokens, "_x")
        w = Window.partitionBy("name").orderBy("_f", "_x")
        # at least ceil(share * length) tokens are common, so one of the first length - that + 1 is
        return each.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.col("_len") - F.ceil(share * F.col("_len") - 1e-9) + 1).select("name", "_len", "_x")

    x, y = leading(a), leading(b).select(F.col("name").alias("other"), F.col("_len").alias("_len2"), "_x")
    fits = (2 * F.least("_len", "_len2") >= least * (F.col("_len") + F.col("_len2")) - 1e-9) & (F.col("name") < F.col("other") if right is None else F.col("name") != F.col("other"))
    pairs = x.join(y, "_x").where(fits).select("name", "other").distinct()
    full = pairs.join(a, "name").join(b.select(F.col("name").alias("other"), F.col("n").alias("n_other"), F.col("_t").alias("_t2"), F.col("_len").alias("_len2")), "other")
    near = full.where(2 * F.size(F.array_intersect("_t", "_t2")) >= least * (F.col("_len") + F.col("_len2")) - 1e-9)
    return near.select("name", "other", ratio("name", "other").alias("ratio"), "n", "n_other").where(F.col("ratio") >= least)
