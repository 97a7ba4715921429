"""References of a document (§2.4.11 to 2.4.14, 2.5.35, 2.5.37): citations against a master table, parents by points, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.operators import bags
from folioflux.operators.relational import first_by

#: Points of a parent (fixed values): its number is cited, its title is named, same party, a base type, dates in order.
POINTS = {"number": 70, "title": 15, "party": 7, "type": 5, "dates": 3}
REASONS = {"number": "Matching contract number", "title": "Explicit agreement reference", "party": "Same counterparty", "type": "Compatible document type", "dates": "Compatible date range"}
#: A template stands on this share of the pages and on so many, in the margins of a page, and is no longer than this; a
#: page with so many lines of a table of contents is one (fixed values).
TEMPLATE_SHARE, TEMPLATE_PAGES, MARGIN, TEMPLATE_LENGTH, TOC_LINES = 0.25, 3, 0.10, 160, 3
_DATE, _DEVIATION, _ALTERNATE = r"\(\s*([A-Za-z]{3,9}\.?\s+[0-9]{4})\s*\)", r"(?i)\(DEVIATION[^)]*\)", r"(?i)Alternate\s+([IVXLC0-9]+)"


def cited(title: Column) -> Column:
    """struct<date, alternate, deviation, title>: what a cited title has in its tail, and the title without it."""
    t = F.coalesce(title, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _DATE, ""), _ALTERNATE, ""), _DEVIATION, "")
    return F.struct(
        F.nullif(F.regexp_extract(t, _DATE, 1), F.lit("")).alias("date"),
        F.nullif(F.upper(F.regexp_extract(t, _ALTERNATE, 1)), F.lit("")).alias("alternate"),
        t.rlike(_DEVIATION).alias("deviation"),
        F.regexp_replace(bare, r"^[ .-]+|[ .-]+$", "").alias("title"),
    )


def clause_references(citations: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    """keys, regulation, number, date, alternate, deviation, title, confidence, match_status and qa_status: one row for each
    different clause that `keys` (a document) cites, against the master table (number, record_type, clause_title,
    effective_date).

    Citations (keys, place, regulation, number, title, confidence) are one clause if regulation, number, alternate,
    deviation and date are equal; the surest one counts, the first on ties. A number may be not_found, no clause
    (record_type_mismatch), of another title or date, or matched; what one side does not state cannot differ. The
    master's numbers are made unique before the join, and Spark limits repeats of a citation before they are shuffled."""
    found = citations.withColumn("_c", cited(F.col("title"))).select(*keys, "place", F.coalesce("regulation", F.lit("FAR")).alias("regulation"), "number", "_c.date", "_c.alternate", "_c.deviation", F.col("_c.title").alias("title"), "confidence").where("number is not null")
    best = first_by(found, [*keys, "regulation", "number", "alternate", "deviation", "date"], [F.col("confidence").desc(), F.col("place")])
    one = master.groupBy("number").agg(F.min(F.struct("record_type", "clause_title", "effective_date")).alias("_m"))
    low = lambda c: F.lower(F.trim(F.col(c)))
    differs = lambda a, b: (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "") & (low(a) != low(b))
    status = (
        F.when(F.col("_m").isNull(), "not_found")
        .when(F.coalesce(F.col("_m.record_type"), F.lit("")) != "Clause", "record_type_mismatch")
        .when(differs("title", "_m.clause_title"), "title_mismatch")
        .when(differs("date", "_m.effective_date"), "date_mismatch")
        .otherwise("matched")
    )
    joined = best.join(one, "number", "left").withColumn("match_status", status)
    return joined.select(*keys, "regulation", "number", "date", "alternate", "deviation", "title", "confidence", "match_status", F.when(F.col("match_status") == "matched", "Verified").otherwise("Needs Review").alias("qa_status"))


def detected_parents(children: DataFrame, parents: DataFrame, numbers: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """child, parent, confidence, matched_on and reasons: for each child document the parent with the most points, the
    smallest on ties; children that cite no parent's number or title have none.

    children (child, party, second_party, date), parents (parent, number, title, party, second_party, date, base: no
    supporting type), numbers and titles (child, number or phrase) as cited. Candidates come from two equi-joins: numbers
    in capitals, and phrases whose ratio() with a title is high enough, which are found among the different phrases and
    titles (bags.alike) before they are joined to documents. A document is no parent of its own."""
    p = parents.select(F.col("parent"), F.upper(F.trim("number")).alias("_number"), "title", F.col("party").alias("_party"), F.col("second_party").alias("_second"), F.col("date").alias("_date"), "base")
    by_number = numbers.select("child", F.upper("number").alias("_number")).distinct().join(p.select("parent", "_number"), "_number").select("child", "parent", F.lit(1).alias("number"), F.lit(0).alias("title"))
    met = by_number
    if titles is not None:
        phrases, named = titles.select(F.lower("phrase").alias("name")).distinct(), p.select(F.lower("title").alias("name")).distinct()
        near = bags.alike(phrases, named).select("name", "other").union(phrases.join(named, "name").select("name", F.col("name").alias("other")))
        by_title = titles.select("child", F.lower("phrase").alias("name")).distinct().join(near, "name").join(p.select("parent", F.lower("title").alias("other")), "other")
        met = met.union(by_title.select("child", "parent", F.lit(0).alias("number"), F.lit(1).alias("title")))
    pairs = met.where("child <> parent").groupBy("child", "parent").agg(F.max("number").alias("number"), F.max("title").alias("title"))
    full = pairs.join(children, "child").join(p.select("parent", "_party", "_second", "_date", "base"), "parent")
    same = lambda a, b: F.coalesce((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(False))
    holds = {"number": F.col("number") == 1, "title": F.col("title") == 1, "party": same("party", "_party") | same("second_party", "_second"), "type": F.coalesce("base", F.lit(False)), "dates": F.coalesce(F.col("date") >= F.col("_date"), F.lit(False))}
    score = sum((F.when(c, POINTS[k]).otherwise(0) for k, c in holds.items()), F.lit(0))
    reasons = F.filter(F.array(*[F.when(c, REASONS[k]) for k, c in holds.items()]), lambda x: x.isNotNull())
    scored = full.select("child", "parent", F.least(score, F.lit(100)).alias("_points"), reasons.alias("reasons"), F.when(F.col("number") == 1, "contract_number").otherwise("contract_title").alias("matched_on"))
    return first_by(scored, ["child"], [F.col("_points").desc(), F.col("parent")]).select("child", "parent", F.round(F.col("_points") / 100, 2).alias("confidence"), "matched_on", "reasons")


def margin_templates(blocks: DataFrame, keys: list[str], share: float = TEMPLATE_SHARE) -> DataFrame:
    """keys, template and pages: texts in the top or bottom tenth of pages, digits masked and in lower case, that stand on a
    quarter of a document's pages and on three at least. blocks (keys, page, height, y0, y1, text); pages without height
    count among the pages only. Pages of a template are counted map-side, a template of all pages is a row a task."""
    pages = blocks.groupBy(*keys, "page").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("*").alias("_pages"))
    text = F.trim("text")
    margin = (F.col("height") > 0) & ((F.col("y0") <= F.col("height") * MARGIN) | (F.col("y1") >= F.col("height") * (1 - MARGIN)))
    seen = blocks.where(margin & (text != "") & (F.length(text) <= TEMPLATE_LENGTH)).select(*keys, "page", F.regexp_replace(F.lower(text), "[0-9]", "#").alias("template")).distinct()
    counts = seen.groupBy(*keys, "template").agg(F.count("*").alias("pages"))
    return counts.join(pages, keys).where(F.col("pages") >= F.greatest(F.lit(TEMPLATE_PAGES), F.floor(F.col("_pages") * share))).select(*keys, "template", "pages")


#: Lines that stand on this share of the pages, and on three, are stripped; documents of fewer pages are left alone (fixed).
RUNNING_SHARE, RUNNING_PAGES = 0.30, 3


def without_running_lines(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """`blocks` as margin_templates() takes them, without those in the margins whose text, digits aside, runs through a
    document. The join is on the document and the text, so that the running lines themselves meet in many tasks."""
    running = margin_templates(blocks, keys, RUNNING_SHARE).select(*keys, F.col("template").alias("_t"), F.lit(True).alias("_runs"))
    margin = (F.col("height") > 0) & ((F.col("y0") <= F.col("height") * MARGIN) | (F.col("y1") >= F.col("height") * (1 - MARGIN)))
    masked = blocks.withColumn("_t", F.when(margin, F.regexp_replace(F.lower(F.trim("text")), "[0-9]", "#")))
    return masked.join(running, [*keys, "_t"], "left").where("_runs is null").select(*blocks.columns)


def toc_line(text: Column, digits: int = 4) -> Column:
    """Whether a line is an entry of a table of contents: a text, a leader of points or a wide gap, and a page number of
    `digits` digits at most (four as surveyed)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.rlike(r"^\S.*[A-Za-z].*?(\.{3,}|\s{3,}|\. \. \.)[ .]*([0-9]{1,%d}|[A-Z]-[0-9]{1,3}|[ivxl]{1,6})$" % digits)


def toc_pages(lines: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """keys, n_toc, n_lines, ratio and is_toc of each page `keys` from its lines (keys, text): three entries, or one below
    a banner; page numbers have `digits` digits at most."""
    banner = F.contains(F.lower(F.trim("text")), F.lit("table of contents"))
    n = lines.groupBy(*keys).agg(F.count_if(toc_line(F.col("text"), digits)).alias("n_toc"), F.count_if(F.trim("text") != "").alias("n_lines"), F.max(banner).alias("_banner"))
    ratio = F.when(F.col("n_lines") > 0, F.col("n_toc") / F.col("n_lines")).otherwise(F.lit(0.0))
    return n.select(*keys, "n_toc", "n_lines", ratio.alias("ratio"), ((F.col("n_toc") >= TOC_LINES) | (F.coalesce("_banner", F.lit(False)) & (F.col("n_toc") >= 1))).alias("is_toc"))
