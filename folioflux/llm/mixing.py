"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equal tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.llm.common import NON_BLANK, staged, text_of
from folioflux.sources.tables import load

#: Words of a block: one slot of the schedule takes one block.
BLOCK = 1024
#: The golden ratio's fractional part over 2**31, made odd: slot i stands at (i * GOLDEN) mod 2**31, which visits each
#: of the 2**31 points once before it repeats.
PERIOD, GOLDEN = 1 << 31, 1327217885
#: Cells of the grid over which points find their source's interval.
CELL_BITS = 12
#: A source is taken at most this often.
MAX_EPOCHS = 3


def token_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_id, _source, _size (words) and _h, the 60-bit place in the shuffle, from the id alone so that reruns agree."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.regexp_count(text_of(text_col), F.lit(NON_BLANK)).cast("long").alias("_size"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("_h"),
    )


def source_targets(sizes: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: _source, _index (1 up, by code point, null last), _total, _weight, _target.

    The targets share all words by weight; a target stops at max_epochs times its source, and the excess is shared by
    weight among the others until none is above. In order of cap over weight the sources that reach their cap come
    first, so that the level of the others follows from running sums. `weights` (_source, _weight) replaces the default
    weights 1, 2, 3, repeating by _index. One row a source: these windows read a table of sources, not of documents.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    per = per.withColumn("_index", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    if weights is None:
        per = per.withColumn("_weight", ((F.col("_index") - 1) % 3 + 1).cast("double"))
    else:
        per = per.alias("p").join(weights.alias("w"), F.expr("p._source <=> w._source"), "left").select("p.*", F.coalesce("w._weight", F.lit(0.0)).cast("double").alias("_weight"))
    cap = F.col("_total") * max_epochs
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    leveled = (
        per.withColumn("_all", F.sum("_total").over(everything))
        .where("_weight > 0")
        .withColumn("_cap", cap)
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_weight").over(after))
        .withColumn("_full", F.col("_cap") / F.col("_weight") <= F.col("_level"))
        .withColumn("_water", F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_weight")).alias("r"), "_index", "_level"))).over(everything)["_level"])
        .select("_source", "_index", "_total", "_weight", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_water") * F.col("_weight")).alias("_target"))
    )
    rest = per.where("_weight <= 0").select("_source", "_index", "_total", "_weight", F.lit(0.0).alias("_target"))
    return leveled if weights is None else leveled.unionByName(rest)


def with_need(targets: DataFrame, block: int) -> DataFrame:
    """The blocks of each source, its whole epochs, the words of the last, broken epoch, and the slots all that takes."""
    words = F.floor(F.col("_target") + 0.5).cast("long")
    total = F.greatest(F.col("_total"), F.lit(1))
    return (
        targets.withColumn("_blocks", F.ceil(F.col("_total") / block).cast("long"))
        .withColumn("_epochs", F.floor(words / total).cast("long"))
        .withColumn("_rest", words - F.col("_epochs") * total)
        .withColumn("_need", F.col("_epochs") * F.col("_blocks") + F.ceil(F.col("_rest") / block).cast("long"))
    )


def schedule(needs: DataFrame, slots: int) -> DataFrame:
    """The mix as an order of slots: _slot, _index, _rank (of the slot within its source, from 0), for _rank < _need.

    Slot i is the i-th point of the golden-ratio sequence, which falls into one source's interval of the cumulative
    needs (slots of each source); any stretch of slots therefore holds the sources in their proportions. Ranks are
    counted in chunks of sqrt(slots) slots, so that no task has more than a chunk of one source, and chunks are offset by
    a running sum. A source that is drawn too often, by the sequence's discrepancy, leaves its last slots empty; the
    ranks that another is left short of stand where an even spacing of its slots has them, beside the slot there. So a
    source of one block stands in the middle, not at the end.
    """
    spark = needs.sparkSession
    chunk = max(1, math.isqrt(max(0, slots - 1)) + 1)
    order = Window.orderBy("_index")
    upto = F.sum("_need").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = needs.where("_need > 0").withColumn("_end", F.floor(upto.cast("double") / F.lit(float(max(1, slots))) * PERIOD).cast("long")).withColumn("_start", F.coalesce(F.lag("_end").over(order), F.lit(0)))
    width = PERIOD >> CELL_BITS
    grid = ends.where("_end > _start").select("_index", "_start", "_end", F.explode(F.expr(f"sequence(_start div {width}, (_end - 1) div {width})")).alias("_cell"))
    points = spark.range(slots).select(F.col("id").alias("_slot"), F.expr(f"pmod(pmod(id, {PERIOD}L) * {GOLDEN}L, {PERIOD}L)").alias("_u")).withColumn("_cell", F.expr(f"_u div {width}"))
    placed = points.join(grid, "_cell").where("_u >= _start and _u < _end").select("_slot", "_index", F.expr(f"_slot div {chunk}").alias("_chunk"))
    counts = placed.groupBy("_index", "_chunk").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_index").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_index", "_chunk").orderBy("_slot")))
    ranked = ranked.join(counts, ["_index", "_chunk"]).select("_slot", "_index", (F.col("_before") + F.col("_r") - 1).alias("_rank"))
    drawn = counts.groupBy("_index").agg(F.sum("_n").alias("_drawn"))
    lacking = needs.join(drawn, "_index", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0))).where("_need > _drawn")
    short = lacking.select("_index", "_need", F.explode(F.expr("sequence(cast(_drawn as bigint), cast(_need - 1 as bigint))")).alias("_rank"))
    topped = short.select(F.floor((F.col("_rank") + 0.5) / F.col("_need") * slots).cast("long").alias("_slot"), "_index", "_rank")
    kept = ranked.join(needs.select("_index", "_need"), "_index").where("_rank < _need").drop("_need")
    return kept.select("_slot", "_index", "_rank").unionByName(topped)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, block: int = BLOCK, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How many words of each document the mix takes, and where: id_col, size, source_size, target, taken, source_index,
    start, first_slot.

    Each source's documents, shuffled by a hash of their id, make one stream of words, cut into blocks of `block` words.
    The schedule's k-th slot of a source takes its next block, from the start again after each epoch; the last slot of
    a source stops at its target. So the words taken from a source are its target, rounded, and a document is taken at
    most max_epochs times. `start` is the document's place in its source's stream, `first_slot` the first slot of the mix
    that takes words of it (null: none). A hot source only means more blocks: streams are summed in sqrt(rows) ranges of the shuffle, and every join is on (source, range) or (source, block).

    Null text has size 0, a null source is a source of its own (the last), rows with a null or repeated id are rows of
    their own, an empty table gives no rows, and columns beside the three named are ignored.
    """
    sizes = staged(token_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    rows = sizes.count()
    needs = staged(with_need(source_targets(sizes, weights, max_epochs), block), "mix-needs")
    slots = needs.agg(F.coalesce(F.sum("_need"), F.lit(0))).first()[0]
    ranges = max(1, math.isqrt(max(0, rows - 1)) + 1)
    sizes = sizes.withColumn("_range", F.expr(f"cast(_h div {(1 << 60) // ranges + 1} as int)"))

    per_range = sizes.groupBy("_source", "_range").agg(F.sum("_size").alias("_n"))
    begin = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = per_range.withColumn("_begin", begin).alias("b").join(needs.alias("n"), F.expr("b._source <=> n._source"))
    begins = begins.select("b._source", "_range", "_begin", "_index", "_total", "_target")
    inner = F.coalesce(F.sum("_size").over(Window.partitionBy("_source", "_range").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("_inner", inner).alias("s").join(begins.alias("b"), F.expr("s._source <=> b._source and s._range = b._range"))
    at = at.select("_id", "_size", "_index", "_total", "_target", (F.col("_begin") + F.col("_inner")).alias("_at"))

    takes = (
        schedule(needs, slots)
        .join(needs.select("_index", "_blocks", "_epochs", "_rest"), "_index")
        .select("_slot", "_index", F.expr("_rank % _blocks").alias("_block"), F.expr(f"case when _rank div _blocks < _epochs then {block}L else least({block}L, _rest - _rank % _blocks * {block}L) end").alias("_limit"))
        .groupBy("_index", "_block", "_limit")
        .agg(F.count("*").alias("_times"), F.min("_slot").alias("_slot"))
    )
    pieces = at.where("_size > 0").withColumn("_block", F.explode(F.expr(f"sequence(_at div {block}, (_at + _size - 1) div {block})")))
    pieces = pieces.withColumn("_lo", F.expr(f"greatest(_at - _block * {block}L, 0L)")).withColumn("_hi", F.expr(f"least(_at + _size - _block * {block}L, {block}L)"))
    took = F.coalesce(F.col("_times") * F.greatest(F.least("_hi", "_limit") - F.col("_lo"), F.lit(0)), F.lit(0))
    taken = pieces.join(takes, ["_index", "_block"], "left").groupBy("_id", "_size", "_index", "_total", "_target", "_at").agg(F.sum(took).alias("_taken"), F.min(F.when(took > 0, F.col("_slot"))).alias("_slot"))
    empty = at.where("_size = 0").withColumn("_taken", F.lit(0).cast("long")).withColumn("_slot", F.lit(None).cast("long"))
    return taken.unionByName(empty).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_index").alias("source_index"), F.col("_at").alias("start"), F.col("_slot").alias("first_slot")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot for every row of documents."""
    return mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mix_sql(table: str) -> str:
    """The same mix: words taken in closed form (a document has a place in its source's stream, which is taken whole
    _epochs times and then up to _rest), first slots by the schedule laid out slot by slot."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM {table}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS idx, total * 3 AS cap FROM s),
l AS (SELECT *, CAST((SELECT sum(total) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT *, cap / weight <= lev AS is_full FROM l),
t AS (SELECT source, idx, total, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
             ELSE (SELECT lev FROM f WHERE NOT is_full ORDER BY cap / weight, idx LIMIT 1) * weight END AS target FROM f),
k AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, (total + {BLOCK} - 1) // {BLOCK} AS blocks FROM t),
n AS (SELECT *, words // greatest(total, 1) AS epochs, words % greatest(total, 1) AS rest FROM k),
b AS (SELECT *, CAST(epochs * blocks + (rest + {BLOCK} - 1) // {BLOCK} AS BIGINT) AS need FROM n),
e AS (SELECT *, CAST(floor(CAST(sum(need) OVER (ORDER BY idx) AS DOUBLE) / CAST((SELECT sum(need) FROM b) AS DOUBLE) * {PERIOD}) AS BIGINT) AS upto FROM b WHERE need > 0),
i AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY idx), 0) AS since FROM e),
g AS (SELECT slot, (slot % {PERIOD}) * {GOLDEN} % {PERIOD} AS u FROM range(CAST((SELECT coalesce(sum(need), 0) FROM b) AS BIGINT)) r(slot)),
r AS (SELECT i.idx, i.need, g.slot, row_number() OVER (PARTITION BY i.idx ORDER BY g.slot) - 1 AS place FROM g JOIN i ON g.u >= i.since AND g.u < i.upto),
c AS (SELECT i.idx, i.need, coalesce(max(r.place) + 1, 0) AS drawn FROM i LEFT JOIN r ON i.idx = r.idx GROUP BY 1, 2),
q AS (SELECT idx, slot, place FROM r WHERE place < need
      UNION ALL SELECT idx, CAST(floor((place + 0.5) / need * (SELECT sum(need) FROM b)) AS BIGINT), place FROM c, unnest(range(drawn, need)) t(place) WHERE need > drawn),
a AS (SELECT b.idx, q.place % b.blocks AS block, q.slot, CASE WHEN q.place // b.blocks < b.epochs THEN {BLOCK} ELSE least({BLOCK}, b.rest - q.place % b.blocks * {BLOCK}) END AS most FROM q JOIN b ON q.idx = b.idx),
p AS (SELECT d.n, d.doc_id, d.size, b.idx, b.total, b.target, b.words,
             coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
x AS (SELECT n, idx, pos, size, block FROM p, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) t(block) WHERE size > 0),
y AS (SELECT x.n, min(a.slot) AS first_slot FROM x JOIN a ON x.idx = a.idx AND x.block = a.block WHERE a.most > greatest(x.pos - x.block * {BLOCK}, 0) GROUP BY x.n)
SELECT doc_id, size, total AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE words // total * size + greatest(0, least(pos + size, words % total) - pos) END AS BIGINT) AS taken,
       y.first_slot
FROM p LEFT JOIN y ON p.n = y.n
"""


OP6_SQL = mix_sql("documents")
