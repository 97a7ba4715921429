"""Queries of text functions (§2.9, 2.11): counts, shapes, reasons, retrieval, chunks, keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflux.functions import text as tx
from folioflux.functions import values as vx
from folioflux.operators import relational as rel
from folioflux.plans.catalog import query
from folioflux.sources import files

TARGETS = {"greeting": ("hand", "and"), "article": ("the", "that", "this"), "loss": ("loser", "trash", "worthless")}
FAMILIES = {"english": ("the", "and", "of the"), "german": ("und", "der", "die"), "french": ("les", "une", "de la"), "spanish": ("los", "por", "de los")}


def _count(term: str) -> str:
    return f"(length(x) - length(replace(x, '{term}', ''))) // {len(term)}"


@query("topk_pages", "WITH s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS target, doc_id, {' + '.join(_count(w) for w in v)} AS score FROM (SELECT doc_id, lower(text) AS x FROM documents)" for k, v in TARGETS.items()) + """),
m AS (SELECT target, max(score) AS best FROM s GROUP BY 1)
SELECT s.target, doc_id, score / best::DOUBLE AS share, CAST(row_number() OVER (PARTITION BY s.target ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM s JOIN m ON s.target = m.target WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY s.target ORDER BY score DESC, doc_id) <= 10""")
def topk_pages(t):
    """The ten best pages of each target by hits of its terms, as shares of the best. One scan for all targets."""
    low = t("documents").select("doc_id", F.lower("text").alias("x"))
    scores = F.array(*[F.struct(F.lit(k).alias("target"), sum((tx.occurrences(F.col("x"), w) for w in v), F.lit(0)).alias("score")) for k, v in TARGETS.items()])
    s = low.select("doc_id", F.explode(scores).alias("s")).select("s.target", "doc_id", "s.score").where("score > 0")


    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.col("score").desc(), "doc_id")).cast("long")).where("rank <= 10")
    best = F.max("score").over(Window.partitionBy("target"))
    return ranked.select("target", "doc_id", (F.col("score") / best.cast("double")).alias("share"), "rank")


@query("concept_counts", f"SELECT lang, CAST(sum({_count('the')}) AS BIGINT) AS n_the, CAST(sum({_count('der')}) AS BIGINT) AS n_der FROM (SELECT lang, lower(text) AS x FROM documents) GROUP BY lang")
def concept_counts(t):
    """Non-overlapping occurrences of concepts by language."""
    low = t("documents").select("lang", F.lower("text").alias("x"))
    return low.groupBy("lang").agg(F.sum(tx.occurrences(F.col("x"), "the")).alias("n_the"), F.sum(tx.occurrences(F.col("x"), "der")).alias("n_der"))


@query("entity_extract", r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS emails,
len(list_distinct(regexp_extract_all(text, '\+?[0-9]* ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}'))) AS phones, len(list_distinct(regexp_extract_all(text, '\$[0-9][0-9,]*(?:\.[0-9]{2})?'))) AS money FROM documents""")
def entity_extract(t):
    """Distinct e-mails, phones and amounts of each document."""
    e = t("documents").select("doc_id", tx.entities(F.col("text")).alias("e"))
    return e.select("doc_id", *[F.size(f"e.{k}").cast("long").alias(k) for k in ("emails", "phones", "money")])


@query("value_types", f"""SELECT {tx.value_type_sql('v', 'regexp_matches')} AS kind, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT v, count(*) AS n FROM (SELECT trim(unnest(string_split(replace(text, chr(10), ' '), ' '))) AS v FROM documents) WHERE v <> '' GROUP BY v) GROUP BY 1""")
def value_types(t):
    """Shapes of all tokens, counted: each different token is classified once."""
    tokens = t("documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("v")).select(F.trim("v").alias("v")).where("v <> ''")
    counts = tokens.groupBy("v").agg(F.count("*").alias("n"))
    return counts.select(tx.value_type(F.col("v")).alias("kind"), "n").groupBy("kind").agg(F.sum("n").alias("n"))


@query("label_rejection", r"""WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS v FROM documents)
SELECT CASE WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '\.{3,}\s*\d+$') THEN 'toc_entry' WHEN length(v) > 60 OR len(regexp_split_to_array(v, '\s+')) > 8 THEN 'too_long' WHEN NOT regexp_matches(v, '[A-Za-z]') THEN 'no_letters'
WHEN regexp_matches(v, '[.!?]$') THEN 'prose' WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) * 2 > length(v) THEN 'mostly_digits' END AS reason, count(*) AS n FROM l GROUP BY 1""")
def label_rejection(t):
    """Why lines are no labels."""
    lines = t("documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(tx.label_rejection(F.col("line")).alias("reason")).agg(F.count("*").alias("n"))


def _family_sql() -> str:
    score = lambda words: " + ".join(f"CASE WHEN contains(x, '{w}') THEN {2 if ' ' in w else 1} ELSE 0 END" for w in words)
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS family, {score(v)} AS score FROM (SELECT doc_id, lower(text) AS x FROM documents)" for k, v in FAMILIES.items())
    return f"""WITH s AS ({rows}), r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, family))
SELECT doc_id, CASE WHEN score >= 2 AND score - second >= 1 THEN family ELSE 'unknown' END AS family, CAST(score AS BIGINT) AS score FROM r WHERE rn = 1"""


@query("family_classify", _family_sql())
def family_classify(t):
    """The best family by keyword score, if it is good enough and clear of the second."""
    s = t("documents").select("doc_id", tx.family_scores(F.col("text"), FAMILIES).alias("s"))
    best, second = F.get("s", 0), F.get("s", 1)
    return s.select("doc_id", F.when((best["score"] >= 2) & (best["score"] - second["score"] >= 1), best["family"]).otherwise("unknown").alias("family"), best["score"].cast("long").alias("score"))


@query("long_text_chunks", """SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(ceil(length(text) / 3000.0) AS BIGINT) AS parts, md5(substr(text, CAST((part - 1) * 3000 + 1 AS BIGINT), 3000)) AS h
FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 3000.0) AS BIGINT))) AS part FROM documents)""")
def long_text_chunks(t):
    """Texts in numbered parts."""
    p = t("documents").select("doc_id", F.explode(tx.long_text_parts(F.col("text"), 3000)).alias("p"))
    return p.select("doc_id", F.col("p.part").cast("long").alias("part"), F.col("p.of").cast("long").alias("parts"), F.md5("p.text").alias("h"))


@query("token_overlap", r"""SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')), ['the', 'and', 'that', 'this', 'for'])) AS n FROM conversations""")
def token_overlap(t):
    """How many of a header's tokens a text has."""
    return t("conversations").select("conv_id", "turn", F.size(F.array_intersect(tx.token_set(F.col("text")), F.array(*[F.lit(w) for w in ("the", "and", "that", "this", "for")]))).cast("long").alias("n"))


@query("slug_keys", r"""SELECT p_partkey, coalesce(nullif(substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 1, 20), ''), 'field') AS slug, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS label FROM part""")
def slug_keys(t):
    """Keys and normalized labels of names."""
    return t("part").select("p_partkey", tx.slugify(F.col("p_name"), 20).alias("slug"), tx.normalize_label(F.col("p_name")).alias("label"))


@query("snippets", """SELECT doc_id, CASE WHEN strpos(lower(text), 'worthless') > 0 THEN substr(text, greatest(strpos(lower(text), 'worthless') - 120, 1), strpos(lower(text), 'worthless') + 129 - greatest(strpos(lower(text), 'worthless') - 120, 1))
ELSE substr(text, 1, 240) END AS snippet FROM documents""")
def snippets(t):
    """Text around the first hit."""
    return t("documents").select("doc_id", tx.snippet(F.col("text"), "worthless").alias("snippet"))


@query("date_parse", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_parse(t):
    """Dates in several printed forms, read back leniently."""
    o = t("orders")
    forms = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMMM d, yyyy", "d MMM yyyy")]
    printed = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", vx.lenient_date(printed).alias("day"))


@query("number_parse", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer")
def number_parse(t):
    """Amounts in accounting form, read back with their sign."""
    c = F.col("c_acctbal")
    printed = F.when(c < 0, F.concat(F.lit("($"), F.format_number(-c, 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))
    return t("customer").select("c_custkey", vx.to_number(printed).alias("amount"))


@query("wide_fields", "SELECT n_regionkey, count(*) AS n, max(CASE WHEN n_nationkey % 5 = 0 THEN n_name END) AS zero, max(CASE WHEN n_nationkey % 5 = 1 THEN n_name END) AS one FROM nation GROUP BY 1")
def wide_fields(t):
    """A pivot over stated names."""
    n = t("nation")
    names = n.select("n_regionkey", "n_name", F.when(F.col("n_nationkey") % 5 == 0, "zero").when(F.col("n_nationkey") % 5 == 1, "one").alias("k"))
    pivoted = names.groupBy("n_regionkey").pivot("k", ["zero", "one"]).agg(F.max("n_name"))
    return pivoted.join(n.groupBy("n_regionkey").agg(F.count("*").alias("n")), "n_regionkey")


@query("long_fields", "SELECT doc_id, field, value FROM (SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels) UNPIVOT (value FOR field IN (quality, toxic))")
def long_fields(t):
    """Columns as rows of field and value."""
    return rel.long(t("labels"), ["doc_id"], ["quality", "toxic"])


@query("column_hints", r"""SELECT col, avg(CASE WHEN regexp_matches(v, '^-?\d+(\.\d+)?$') THEN 1.0::DOUBLE ELSE 0 END) AS number_share, count(DISTINCT v) = count(*) AS is_unique, max(len(string_split(v, ' '))) AS most_words FROM (
SELECT p_name AS p_name, p_brand AS p_brand, CAST(p_size AS VARCHAR) AS p_size, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part) UNPIVOT (v FOR col IN (p_name, p_brand, p_size, p_partkey)) GROUP BY col""")
def column_hints(t):
    """What the values of each column look like."""
    cells = rel.long(t("part"), [], ["p_name", "p_brand", "p_size", "p_partkey"], "col", "v")
    return cells.groupBy("col").agg(F.avg(F.when(F.col("v").rlike(r"^-?\d+(\.\d+)?$"), 1.0).otherwise(0.0)).alias("number_share"), (F.countDistinct("v") == F.count("*")).alias("is_unique"), F.max(F.size(F.split("v", " "))).cast("long").alias("most_words"))


@query("table_quality", r"""WITH l AS (SELECT doc_id, len(string_split(unnest(string_split(text, chr(10))), ' ')) AS w FROM documents), m AS (SELECT doc_id, count(*) AS n, sum(w) AS s, list(w) AS ws FROM l GROUP BY 1)
SELECT doc_id, n AS n_rows, list_sum(list_transform(ws, lambda x: abs(x * n - s))) / CAST(n * s AS DOUBLE) AS spread FROM m""")
def table_quality(t):
    """How even a document's rows are: mean absolute deviation of their words over the mean, on the row."""
    w = t("documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.size(F.split(x, " ")).cast("long")).alias("w"))
    w = w.withColumn("n", F.size("w").cast("long")).withColumn("s", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x))
    apart = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.abs(x * F.col("n") - F.col("s")))
    return w.select("doc_id", F.col("n").alias("n_rows"), (apart / (F.col("n") * F.col("s")).cast("double")).alias("spread"))


@query("intents", r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), '\b(summary|summarize|summarise|overview)\b') THEN 'summary' WHEN regexp_matches(lower(text), '\b(tables?|rows|columns|line items?)\b') THEN 'table'
WHEN regexp_matches(lower(text), '\?\s*$|^\s*(what|who|when|where|why|how|which|is|are|does)\b') THEN 'question' ELSE 'fields' END AS kind FROM conversations) GROUP BY kind""")
def intents(t):
    """What each turn asks for."""
    return t("conversations").groupBy(tx.intent(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("size_tiers", "SELECT CASE WHEN n_chars * 8192 < 10485760 THEN 'small' WHEN n_chars * 8192 < 52428800 THEN 'medium' WHEN n_chars * 8192 <= 104857600 THEN 'large' ELSE 'very_large' END AS tier, count(*) AS n FROM documents GROUP BY 1")
def size_tiers(t):
    """Documents by upload size, 8 KB a character as a scan has them."""
    return t("documents").groupBy(files.size_tier(F.col("n_chars") * 8192).alias("tier")).agg(F.count("*").alias("n"))


@query("merged_targets", """SELECT event_type AS key, string_agg(DISTINCT CAST(hour(ts) AS VARCHAR), ',' ORDER BY CAST(hour(ts) AS VARCHAR)) AS pages, max(value) AS confidence, count(*) AS n FROM events GROUP BY 1""")
def merged_targets(t):
    """Targets of one key merged: the set of pages, the highest confidence, the count."""
    e = t("events").select("event_type", F.hour("ts").cast("string").alias("h"), "value")
    return e.groupBy(F.col("event_type").alias("key")).agg(F.array_join(F.sort_array(F.collect_set("h")), ",").alias("pages"), F.max("value").alias("confidence"), F.count("*").alias("n"))
