"""Label/value pairs of pages (§2.9.18 to 2.9.24): form fields, two-column tables, inline and stacked lines, and the best
of them by label. Everything is an expression on the row, until pairs are ranked within their page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions.text import normalize_label

#: Confidence by the way a pair was found. Fixed values.
CONFIDENCE = {"form_field": 0.95, "table_2col": 0.85, "wide_gap": 0.80, "colon": 0.78, "dot_leader": 0.76, "stacked": 0.62}
#: What a label in capitals is given at least.
CAPITALS = 0.82

LABEL = r"[A-Za-z][A-Za-z0-9 /#().&'-]{0,58}"
INLINE = {
    "colon": rf"^\s*({LABEL}?)\s*:\s+(\S.*)$",
    "wide_gap": rf"^\s*({LABEL}?[^ ]) {{3,}}(\S.*)$",
    "dot_leader": rf"^\s*({LABEL}?[^ .]) ?\.{{3,}} ?(\S.*)$",
}
IN_CAPITALS = r"^[A-Z0-9 /#().&'-]*[A-Z][A-Z0-9 /#().&'-]*$"


def _pair(label: Column, value: Column, method: str, confidence: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"), F.lit(method).alias("method"), confidence.alias("confidence"))


def _raised(label: Column, method: str) -> Column:
    return F.when(label.rlike(IN_CAPITALS), F.greatest(F.lit(CONFIDENCE[method]), F.lit(CAPITALS))).otherwise(F.lit(CONFIDENCE[method]))


def inline_pairs(text: Column) -> Column:
    """array<struct<label, value, method, confidence>>: lines of the form `label: value`, `label   value` (three blanks or
    more) and `label .... value`. A leader to a bare page number is a line of a table of contents and left out."""
    lines = F.split(text, "\n")

    def found(method: str) -> Column:
        hits = F.filter(lines, lambda x: x.rlike(INLINE[method]))
        pairs = F.transform(hits, lambda x: F.struct(F.trim(F.regexp_extract(x, INLINE[method], 1)).alias("l"), F.trim(F.regexp_extract(x, INLINE[method], 2)).alias("v")))
        if method == "dot_leader":
            pairs = F.filter(pairs, lambda p: ~p["v"].rlike(r"^[0-9]{1,4}$"))
        return F.transform(pairs, lambda p: _pair(p["l"], p["v"], method, _raised(p["l"], method)))

    return F.concat(*[found(m) for m in INLINE])


def stacked_pairs(text: Column) -> Column:
    """Pairs of a label line and the value line under it; the label has no figure and no mark, the value isn't a label in
    capitals itself."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    two = F.zip_with(lines, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    shape = F.filter(two, lambda p: p["a"].rlike(r"^[A-Z][A-Za-z /]{2,48}$") & (p["b"] != "") & ~p["b"].rlike(IN_CAPITALS) & ~p["b"].contains(":"))
    return F.transform(shape, lambda p: _pair(p["a"], p["b"], "stacked", F.when(p["a"].rlike(IN_CAPITALS), CAPITALS).otherwise(CONFIDENCE["stacked"])))


def map_pairs(fields: Column, method: str) -> Column:
    """Pairs of a map of form fields, or of a table's two columns: labels that are only figures and blank values are no pairs."""
    entries = F.filter(F.map_entries(fields), lambda e: (F.trim(e["key"]) != "") & (F.trim(e["value"]) != "") & ~e["key"].rlike(r"^[0-9 .,]+$"))
    return F.transform(entries, lambda e: _pair(F.trim(e["key"]), F.trim(e["value"]), method, F.lit(CONFIDENCE[method])))


def best_pairs(pages: DataFrame, page: str, pairs: Column) -> DataFrame:
    """page, label (normalised), value, method, confidence: for each label of a page the pair of most confidence, the
    first on ties. Pairs are exploded with their place; the window is on (page, label)."""
    each = pages.select(page, F.posexplode(pairs).alias("_place", "_p")).withColumn("label", normalize_label(F.col("_p.label"))).where("label <> ''")
    first = Window.partitionBy(page, "label").orderBy(F.col("_p.confidence").desc(), "_place")
    return each.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(page, "label", "_p.value", "_p.method", "_p.confidence")


def page_score(text: Column, keywords: list[str], instruction: str | None = None, form: Column | None = None, tables: Column | None = None) -> Column:
    """How well a page answers a request: 5 for the whole instruction (of eight characters or more), 2 for each pair of
    neighbouring words of it, 1 for each hit of a keyword, 3 for each in the form fields and 2 for each in the tables."""
    from folioflux.functions.text import occurrences

    low = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0.0)
    if instruction:
        phrase = instruction.lower().strip()
        words = [w for w in "".join(c if c.isalnum() or c in "-_" else " " for c in phrase).split() if len(w) > 3]
        if len(phrase) >= 8:
            score = score + F.when(low.contains(phrase), 5.0).otherwise(0.0)
        for a, b in zip(words, words[1:], strict=False):
            score = score + F.when(low.contains(f"{a} {b}"), 2.0).otherwise(0.0)
    for part, weight in ((low, 1.0), (form, 3.0), (tables, 2.0)):
        if part is not None:
            for k in keywords:
                score = score + occurrences(F.lower(F.coalesce(part, F.lit(""))), k.lower()) * weight
    return score


def selected_pages(scored: DataFrame, keys: list[str], page: str, k: int) -> DataFrame:
    """The k best pages of each request in page order: score descending, then page, only scores above 0; _order counts
    them by page from 1."""
    best = scored.where("score > 0").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), page))).where(F.col("_n") <= k).drop("_n")
    return best.withColumn("page_order", F.row_number().over(Window.partitionBy(*keys).orderBy(page)))


#: Words that stay small in a label (fixed values), and what each flag of a pair takes from its score.
JOINERS = ("of", "to", "and", "for", "per", "in", "on", "at", "by", "the", "or", "a", "an", "de")
FLAG = 0.2


def label_value(text: Column, label: str) -> Column:
    """The value a text states for a label, in any case: the rest of the line after the label and a mark, else after blanks
    what begins with a letter or figure, 101 characters at most; the first form goes before the second. Null for none."""
    from re import escape

    after = lambda rule: F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i){escape(label)}{rule}", 1)), F.lit(""))
    return F.coalesce(after(r"\s*[:#-]\s*([^\n]+)"), after(r"\s+([A-Za-z0-9][^\n]{0,100})"))


def pair_quality(label: Column, value: Column, relation: Column) -> Column:
    """struct<score, flags>: how far a pair's shapes speak for it. Each flag takes 0.2: a label of one word, all in capitals,
    or with small words that are no joiners; a value that looks like a label, is a list, or breaks off; a pair that only
    type or place made."""
    words = F.filter(F.split(F.trim(F.coalesce(label, F.lit(""))), r"\s+"), lambda x: x != "")
    letters = F.regexp_replace(F.coalesce(label, F.lit("")), r"\P{L}", "")
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    n_words, bare = F.size(F.split(text, " ")), F.regexp_replace(text, r"\P{L}", "")
    lines = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "\\R"), lambda x: F.trim(x)), lambda x: x != "")
    small = lambda w: w.rlike(r"^\p{Ll}") & ~F.lower(w).isin(*JOINERS)
    flags = F.array(
        F.when(F.size(words) == 1, "single_word_label"),
        F.when((F.length(letters) >= 2) & (letters == F.upper(letters)) & (F.size(words) >= 2), "all_caps_label"),
        F.when(F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), small), "label_has_lowercase_words"),
        F.when(n_words.between(2, 4) & (bare != "") & (bare == F.upper(bare)) & ~text.rlike("[0-9]"), "value_looks_like_label"),
        F.when((F.size(lines) >= 3) & F.forall(lines, lambda x: F.size(F.split(x, r"\s+")) <= 2), "value_is_list"),
        F.when(text.rlike("[,;\u2013-]$"), "value_truncated"),
        F.when(relation == "left_right_typography", "pairing_by_typography_only"),
        F.when(relation == "left_right_whitespace", "pairing_by_position_only"),
    )
    kept = F.filter(flags, lambda x: x.isNotNull())
    return F.struct(F.round(F.greatest(F.lit(0.0), 1 - FLAG * F.size(kept)), 2).alias("score"), kept.alias("flags"))
