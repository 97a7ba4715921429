"""URL filters: rules on hosts and paths, and for what no rule settles, trust and distrust spread over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.common import ascii_lower, staged
from folioflux.sources.tables import load

#: (verdict, host and path) of the query's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#>\s]+)"""
#: Share of a score that is passed on along edges, and the share of all scores below which a round's changes end the spread.
DAMPING, TOLERANCE = 0.85, 1e-4
#: A host is blocked when its distrust is over this many times its trust.
MARGIN = 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    known = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(known, r"://([^/?#]*)", 1)), F.regexp_extract(known, r"://[^/?#]*([^?#]*)", 1)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """_host, _rules: for each host the rules of it and its parent domains, the longest first."""
    parts = F.split("_host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = rules.select(F.substring_index("rule", "/", 1).alias("_suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("path"), "rule", "verdict")
    met = hosts.select("_host", F.explode(suffixes).alias("_suffix")).join(each, "_suffix")
    return met.groupBy("_host").agg(F.sort_array(F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")), asc=False).alias("_rules"))


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """_src, _dst, _n: absolute links between different hosts, counted."""
    links = pages.select(F.col(host).alias("_src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("_to"))
    named = links.select("_src", ascii_lower(F.col("_to")).alias("_dst")).where("_src <> '' and _dst <> '' and _src <> _dst")
    return named.groupBy("_src", "_dst").agg(F.count("*").cast("double").alias("_n"))


def spread(seeds: DataFrame, hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """_host, _score: personalised PageRank from `seeds` (_host, _seed) along `edges` (_src, _dst, _n), for `hosts` (_host).

    Each round a host passes damping times its score on along its links, by their counts, and seeds get the rest; a walk
    ends at a host without links. Scores are in units of a seed and add up over seeds, so what a seed passes on does not
    depend on how many others there are. Rounds go on until the changes of all hosts together are below `tolerance` of
    the seeds' sum, which the damping brings about within log(tolerance) / log(damping) rounds. Rounds are staged, so that
    a lost executor costs one round; the join is on the sender, whose many links AQE may split, and sums are partial
    before the shuffle.
    """
    total = seeds.agg(F.sum("_seed")).first()[0] or 0.0
    base = hosts.select("_host").join(seeds.select("_host", "_seed"), "_host", "left").select("_host", (F.coalesce("_seed", F.lit(0.0)) * (1 - damping)).alias("_base"))
    score = staged(base.withColumn("_score", F.col("_base")), "url-seeds")
    out = edges.groupBy("_src").agg(F.sum("_n").alias("_out"))
    steps = staged(edges.join(out, "_src").select("_src", "_dst", (F.col("_n") / F.col("_out") * damping).alias("_p")), "url-steps")
    turn, change = 0, 1.0 if total and steps.take(1) else 0.0
    while change > tolerance:
        moved = steps.join(score, F.col("_src") == F.col("_host")).groupBy("_dst").agg(F.sum(F.col("_score") * F.col("_p")).alias("_in"))
        new = score.join(moved, F.col("_host") == F.col("_dst"), "left").select("_host", "_base", (F.col("_base") + F.coalesce("_in", F.lit(0.0))).alias("_score"), F.col("_score").alias("_old"))
        new = staged(new, f"url-round-{turn}")
        change = new.agg(F.sum(F.abs(F.col("_score") - F.col("_old")))).first()[0] / total
        score, turn = new.drop("_old"), turn + 1
    return score.select("_host", "_score")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str = "html", columns: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """_row (a struct of `columns` of each row, all by default), host, path, rule, verdict, trust and distrust.

    The longest rule whose host is the page's host or a parent domain of it, and whose path begins the page's path,
    gives the verdict; `rules` has the columns verdict and rule (host, then a path from its `/`). For other pages the
    host decides: hosts with half or more of their pages allowed by rules are trusted seeds, with half or more blocked
    they are blocked seeds. Trust spreads from the one along links, distrust from the other against them, and a host
    whose distrust is over `margin` times its trust is blocked. A host that neither reaches is allowed.

    Null urls and urls without `://` have an empty host and path, which no rule fits, and are allowed; null html has no
    links; an empty table gives no rows. Links are counted per pair of hosts before the shuffle; the graph stays distributed. The last join, from
    pages to hosts, may be split by AQE where one host has many pages. Repeated rows are judged each.
    """
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns or pages.columns]).alias("_row"), host.alias("_page_host"), path.alias("_path"))
    hosts = staged(named.groupBy(F.col("_page_host").alias("_host")).agg(F.count("*").alias("_pages")).where("_host <> ''"), "url-hosts")
    fitting = staged(rules_by_host(hosts, rules), "url-rules")

    def judged(df: DataFrame) -> DataFrame:
        fits = F.filter("_rules", lambda r: F.startswith("_path", r["path"]))
        return df.withColumn("_hit", F.get(fits, 0))

    counted = judged(named.select(F.col("_page_host").alias("_h"), "_path").join(fitting, F.col("_h") == F.col("_host"))).groupBy("_host").agg(
        F.count(F.when(F.col("_hit.verdict") == "allow", 1)).alias("_allow"), F.count(F.when(F.col("_hit.verdict") == "block", 1)).alias("_block")
    )
    shares = staged(counted.join(hosts, "_host").select("_host", (F.col("_allow") / F.col("_pages")).alias("_a"), (F.col("_block") / F.col("_pages")).alias("_b")), "url-shares")
    edges = staged(host_edges(pages.withColumn("_from", host), "_from", html_col), "url-edges")
    nodes = staged(hosts.select("_host").union(edges.select("_dst")).distinct(), "url-nodes")
    trust = spread(shares.where("_a >= 0.5").select("_host", F.col("_a").alias("_seed")), nodes, edges)
    against = edges.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst"), "_n")
    distrust = spread(shares.where("_b >= 0.5").select("_host", F.col("_b").alias("_seed")), nodes, against)
    known = hosts.join(fitting, "_host", "left").join(trust.withColumnRenamed("_score", "_trust"), "_host", "left").join(distrust.withColumnRenamed("_score", "_distrust"), "_host", "left")
    table = staged(known.select("_host", "_rules", F.coalesce("_trust", F.lit(0.0)).alias("_trust"), F.coalesce("_distrust", F.lit(0.0)).alias("_distrust")), "url-table")
    done = judged(named.join(table, F.col("_page_host") == F.col("_host"), "left"))
    by_host = F.when(F.coalesce(F.col("_distrust") > F.col("_trust") * margin, F.lit(False)), "block").otherwise("allow")
    return done.select("_row", F.col("_page_host").alias("host"), F.col("_path").alias("path"), F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", by_host).alias("verdict"), F.coalesce("_trust", F.lit(0.0)).alias("trust"), F.coalesce("_distrust", F.lit(0.0)).alias("distrust"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return filter_urls(load(spark, sf_dir, "pages"), rules, columns=["page_id"]).select("_row.page_id", "host", "path", "rule", "verdict")
