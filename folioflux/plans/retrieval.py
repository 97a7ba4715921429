"""Queries of label/value extraction and page ranking, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.operators import keyvalues as kv
from folioflux.plans.catalog import query

_Q = lambda s: s.replace("'", "''")  # noqa: E731  inside an SQL literal

#: A page for each order, as a form prints it.
_PAGE_SQL = """SELECT o_orderkey, 'STATUS   ' || o_orderstatus || chr(10) || 'Order Number: ' || o_orderkey || chr(10) || 'Priority .... ' || o_orderpriority || chr(10) || 'Listed ....... ' || (o_orderkey % 900) || chr(10) || 'Order Date' || chr(10) || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'CUSTOMER: ' || o_custkey AS text FROM orders"""
_INLINE_SQL = "SELECT o_orderkey, k, trim(l) AS label, trim(v) AS value, method, CASE WHEN regexp_matches(trim(l), '{caps}') THEN greatest(c, CAST(0.82 AS DOUBLE)) ELSE c END AS confidence FROM (".format(caps=_Q(kv.IN_CAPITALS)) + " UNION ALL ".join(
    f"SELECT o_orderkey, {i} * 100 + p AS k, regexp_extract(line, '{_Q(r)}', 1) AS l, regexp_extract(line, '{_Q(r)}', 2) AS v, '{m}' AS method, CAST({kv.CONFIDENCE[m]} AS DOUBLE) AS c FROM lines WHERE regexp_matches(line, '{_Q(r)}')"
    + (" AND NOT regexp_matches(trim(regexp_extract(line, '" + _Q(r) + "', 2)), '^[0-9]{1,4}$')" if m == "dot_leader" else "")
    for i, (m, r) in enumerate(kv.INLINE.items())
) + ")"
_LINES_SQL = f"pages AS ({_PAGE_SQL}), lines AS (SELECT o_orderkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM pages)"
_STACKED_SQL = f"""SELECT a.o_orderkey, 1000 + a.p AS k, trim(a.line) AS label, trim(b.line) AS value, 'stacked' AS method, CAST(CASE WHEN regexp_matches(trim(a.line), '{_Q(kv.IN_CAPITALS)}') THEN 0.82 ELSE 0.62 END AS DOUBLE) AS confidence
FROM lines a JOIN lines b ON a.o_orderkey = b.o_orderkey AND b.p = a.p + 1 WHERE regexp_matches(trim(a.line), '^[A-Z][A-Za-z /]{{2,48}}$') AND trim(b.line) <> '' AND NOT regexp_matches(trim(b.line), '{_Q(kv.IN_CAPITALS)}') AND NOT contains(b.line, ':')"""


def order_pages(t):
    """o_orderkey, text: each order as the page that prints it."""
    line = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    text = F.concat_ws(
        "\n", line("STATUS   ", "o_orderstatus"), line("Order Number: ", "o_orderkey"), line("Priority .... ", "o_orderpriority"),
        F.concat(F.lit("Listed ....... "), (F.col("o_orderkey") % 900).cast("string")), F.lit("Order Date"), F.date_format("o_orderdate", "yyyy-MM-dd"), line("CUSTOMER: ", "o_custkey"),
    )
    return t("orders").select("o_orderkey", text.alias("text"))


def _flat(df, key, pairs):
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.label", "p.value", "p.method", "p.confidence")


@query("kv_inline", f"WITH {_LINES_SQL} SELECT o_orderkey, label, value, method, confidence FROM ({_INLINE_SQL})")
def kv_inline(t):
    """Inline label/value lines of order pages."""
    return _flat(order_pages(t), "o_orderkey", kv.inline_pairs(F.col("text")))


@query("kv_stacked", f"WITH {_LINES_SQL} SELECT o_orderkey, label, value, method, confidence FROM ({_STACKED_SQL})")
def kv_stacked(t):
    """Labels with their value on the next line."""
    return _flat(order_pages(t), "o_orderkey", kv.stacked_pairs(F.col("text")))


@query("kv_table", """SELECT event_id, e.key AS label, e.value, 'table_2col' AS method, CAST(0.85 AS DOUBLE) AS confidence FROM (
SELECT event_id, unnest([{'key': 'Event', 'value': event_type}, {'key': 'k', 'value': json_extract_string(props, '$.k')}, {'key': CAST(user_id AS VARCHAR), 'value': event_type}]) AS e FROM events) WHERE trim(e.value) <> '' AND NOT regexp_matches(e.key, '^[0-9 .,]+$')""")
def kv_table(t):
    """Rows of two-column tables; a label of figures only is none."""
    fields = F.map_concat(F.create_map(F.lit("Event"), F.col("event_type")), F.from_json("props", "map<string,string>"), F.create_map(F.col("user_id").cast("string"), F.col("event_type")))
    return _flat(t("events"), "event_id", kv.map_pairs(fields, "table_2col"))


@query("kv_pages", f"""WITH {_LINES_SQL}, every AS ({_INLINE_SQL} UNION ALL {_STACKED_SQL} UNION ALL SELECT o_orderkey, 5000, 'Customer', CAST(o_custkey AS VARCHAR), 'form_field', CAST(0.95 AS DOUBLE) FROM orders),
named AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS name FROM every),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, name ORDER BY confidence DESC, k) AS n FROM named WHERE name <> '')
SELECT o_orderkey, name AS label, value, method, confidence FROM ranked WHERE n = 1""")
def kv_pages(t):
    """All pairs of a page, the surest for each label."""
    pages = order_pages(t).join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    form = kv.map_pairs(F.create_map(F.lit("Customer"), F.col("o_custkey").cast("string")), "form_field")
    return kv.best_pairs(pages, "o_orderkey", F.concat(kv.inline_pairs(F.col("text")), kv.stacked_pairs(F.col("text")), form))


_KEYWORDS = ["that", "en", "src1"]
_PHRASE = "with this that from"
_COUNT = lambda c, k: f"((length({c}) - length(replace({c}, '{k}', ''))) // {len(k)})"
_SCORE_SQL = "SELECT doc_id, source, CAST(" + " + ".join(
    [f"CASE WHEN contains(low, '{_PHRASE}') THEN 5 ELSE 0 END"]
    + [f"CASE WHEN contains(low, '{b}') THEN 2 ELSE 0 END" for b in ("with this", "this that", "that from")]
    + [f"{w} * {_COUNT(c, k)}" for c, w in (("low", 1), ("form", 3), ("tab", 2)) for k in _KEYWORDS]
) + " AS DOUBLE) AS score FROM (SELECT doc_id, source, lower(text) AS low, lower('lang ' || lang || ' source ' || source) AS form, lower(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]')), ' ')) AS tab FROM documents)"


def _scored(t):
    tab = F.array_join(F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9]")), " ")
    form = F.concat(F.lit("lang "), "lang", F.lit(" source "), "source")
    return t("documents").select("doc_id", "source", kv.page_score(F.col("text"), _KEYWORDS, _PHRASE, form, tab).alias("score"))


@query("page_rank", _SCORE_SQL)
def page_rank(t):
    """Score of each page for an instruction and its keywords, with form fields three and tables two times."""
    return _scored(t)


@query("selected_pages", f"""WITH s AS ({_SCORE_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_order FROM b WHERE n <= 8""")
def selected_pages(t):
    """The eight best pages of each source, in page order."""
    return kv.selected_pages(_scored(t), ["source"], "doc_id", 8).select("source", "doc_id", "score", "page_order")


@query("label_lookup", r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?i)the\s*[:#-]\s*([^\n]+)', 1)), ''), nullif(trim(regexp_extract(text, '(?i)the\s+([A-Za-z0-9][^\n]{0,100})', 1)), '')) AS value FROM documents""")
def label_lookup(t):
    """What documents state for a label."""
    return t("documents").select("doc_id", kv.label_value(F.col("text"), "the").alias("value"))


@query("pair_quality", r"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN upper(p_name) WHEN p_size % 4 = 1 THEN string_split(p_name, ' ')[1] ELSE p_name END AS label,
  CASE WHEN p_size % 5 = 0 THEN upper(p_name) WHEN p_size % 5 = 1 THEN p_name || ',' ELSE p_brand END AS value, CASE WHEN p_size % 3 = 0 THEN 'left_right_whitespace' ELSE 'below' END AS relation FROM part),
f AS (SELECT p_partkey, list_filter([CASE WHEN len(string_split(label, ' ')) = 1 THEN 'single_word_label' END, CASE WHEN label = upper(label) AND len(string_split(label, ' ')) >= 2 THEN 'all_caps_label' END,
  CASE WHEN len(string_split(label, ' ')) >= 2 AND label <> upper(label) THEN 'label_has_lowercase_words' END, CASE WHEN value = upper(value) AND len(string_split(value, ' ')) BETWEEN 2 AND 4 AND NOT regexp_matches(value, '[0-9]') THEN 'value_looks_like_label' END,
  CASE WHEN value LIKE '%,' THEN 'value_truncated' END, CASE WHEN relation = 'left_right_whitespace' THEN 'pairing_by_position_only' END], lambda x: x IS NOT NULL) AS flags FROM p)
SELECT p_partkey, round(greatest(0, 1 - 0.2 * len(flags)), 2)::DOUBLE AS score, array_to_string(flags, ',') AS flags FROM f""")
def pair_quality(t):
    """Flags and score of pairs made of parts: names as labels, names and brands as values."""
    size, name = F.col("p_size"), F.col("p_name")
    label = F.when(size % 4 == 0, F.upper(name)).when(size % 4 == 1, F.split(name, " ")[0]).otherwise(name)
    value = F.when(size % 5 == 0, F.upper(name)).when(size % 5 == 1, F.concat(name, F.lit(","))).otherwise(F.col("p_brand"))
    q = kv.pair_quality(label, value, F.when(size % 3 == 0, "left_right_whitespace").otherwise("below"))
    return t("part").select("p_partkey", q.alias("q")).select("p_partkey", "q.score", F.array_join("q.flags", ",").alias("flags"))
