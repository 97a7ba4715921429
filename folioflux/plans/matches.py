"""Queries on bags of words and on vectors (§2.4.24, 2.4.25, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.operators import bags, vectors
from folioflux.plans.catalog import query

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"


@query("bag_overlap", f"""WITH w AS (SELECT conv_id, role, unnest({_WORDS}) AS token FROM conversations),
n AS (SELECT conv_id, token, count(*) FILTER (WHERE role = 'user') AS l, count(*) FILTER (WHERE role = 'assistant') AS r FROM w GROUP BY ALL),
s AS (SELECT conv_id, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right, CAST(sum(least(l, r)) AS BIGINT) AS shared FROM n GROUP BY conv_id)
SELECT *, CASE WHEN least(n_left, n_right) > 0 THEN shared / least(n_left, n_right)::DOUBLE ELSE 0 END AS share, n_left < {bags.FEWEST} OR shared >= {bags.COVERED} * n_left AS accounts FROM s WHERE n_left > 0""")
def bag_overlap(t):
    """Of the words a conversation's user says, how many the assistant says as often."""
    said = t("conversations").select("conv_id", "role", F.explode(bags.words(F.col("text"))).alias("token"))
    return bags.accounts_for(bags.bag_overlap(said.where("role = 'user'"), said.where("role = 'assistant'"), ["conv_id"]))


@query("cell_containment", r"""WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, i, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS x FROM l),
r AS (SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'header' ELSE 'row' END AS kind, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS y FROM benchmark)
SELECT c.doc_id, CAST(i AS INTEGER) AS line, CASE min(CASE WHEN kind = 'header' THEN 0 WHEN kind = 'row' THEN 1 END) WHEN 0 THEN 'header' WHEN 1 THEN 'row' END AS found
FROM c LEFT JOIN r ON x <> '' AND contains(y, x) GROUP BY c.doc_id, i""")
def cell_containment(t):
    """Which lines of documents stand word for word in a benchmark item, taken as a table's rows."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "block")).select("doc_id", (F.col("i") + 1).alias("line"), "block", F.lit(1).alias("page"))
    rows = t("benchmark").select(F.lit(1).alias("page"), F.when(F.col("item_id") % 2 == 0, "header").otherwise("row").alias("kind"), F.col("text").alias("cells"))
    return bags.contained(lines, rows, ["page"], "block", "cells").select("doc_id", "line", "found")


@query("cosine_topk", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query, id, c, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM m)
SELECT query, CAST(rank AS INTEGER) AS rank, id, round(c, 6) AS cosine FROM r WHERE rank <= 10""")
def cosine_topk(t):
    """The ten nearest vectors of every hundredth one, all cells probed: exact."""
    e = t("embeddings")
    return vectors.cosine_topk(e.where("vec_id % 100 = 0"), e, 10, probes=None).withColumn("cosine", F.round("cosine", 6))
