"""What the operators share: staging of intermediate tables, bounded bitmaps, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as several operators count them: runs of anything but the six ASCII blanks.
BLANKS = r"[ \x09-\x0D]+"
NON_BLANK = r"[^ \x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a local session gets a temporary folder; on a
    cluster that would be another disk for each executor, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="folioflux-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: the plan is cut there, and a lost executor costs
    a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The 64-bit hashes in column `key` as a bitmap of 2**bits bits: at most 2**(bits-12) rows (_w, _bits) of 64 words of 64
    bits, whatever the number of keys, so that it may be broadcast. Few rows with long arrays take a fifth of the memory
    that a row for each word does."""
    slot = F.expr(f"pmod({key}, {1 << bits}L)")
    words = keys.select(slot.alias("_s")).groupBy(F.expr("cast(shiftright(_s, 6) as int)").alias("_v")).agg(F.expr("bit_or(shiftleft(1L, cast(_s & 63 as int)))").alias("_bits"))
    blocks = words.groupBy(F.expr("shiftright(_v, 6)").alias("_w")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("_v & 63").alias("k"), "_bits"))).alias("_m"))
    return blocks.select("_w", F.expr("transform(sequence(0, 63), i -> coalesce(try_element_at(_m, i), 0L))").alias("_bits"))


def flagged(df: DataFrame, key: str, found: DataFrame, bits: int, flag: str) -> DataFrame:
    """`df` with boolean `flag`: true for each row whose hash `key` is in the bitmap (and for the few that share a bit)."""
    slot = F.expr(f"pmod({key}, {1 << bits}L)")
    at = df.withColumn("_s", slot).withColumn("_w", F.expr("cast(shiftright(_s, 12) as int)"))
    hit = F.expr("coalesce((shiftright(get(_bits, cast(shiftright(_s, 6) & 63 as int)), cast(_s & 63 as int)) & 1L) = 1L, false)")
    return at.join(F.broadcast(found), "_w", "left").withColumn(flag, hit).drop("_s", "_w", "_bits")


def text_of(name: str = "text") -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The smallest node of each node's connected component: _node, _comp, for every node of the edges (_a, _b).

    Each round takes for a node the smallest label among its own and its neighbours', then that label's own label, so
    that a path of length n takes about log n rounds; it ends when no label changes. Labels are staged after each round.
    """
    both = staged(edges.union(edges.select("_b", "_a")).distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("_a").alias("_node")).agg(F.least("_node", F.min("_b")).alias("_comp")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, F.col("_b") == F.col("_node")).groupBy(F.col("_a").alias("_n")).agg(F.min("_comp").alias("_near"))
        lower = labels.join(near, F.col("_node") == F.col("_n"), "left").select("_node", F.least("_comp", F.coalesce("_near", "_comp")).alias("_new"), F.col("_comp").alias("_old"))
        top = labels.select(F.col("_node").alias("_m"), F.col("_comp").alias("_top"))
        jumped = lower.join(top, F.col("_new") == F.col("_m"), "left")
        new = staged(jumped.select("_node", F.least("_new", F.coalesce("_top", "_new")).alias("_comp"), (F.least("_new", F.coalesce("_top", "_new")) != F.col("_old")).alias("_moved")), f"{name}-{turn}")
        labels = new.select("_node", "_comp")
        if not new.where("_moved").take(1):
            return labels


def row_keyed(docs: DataFrame, id_col: str = "doc_id", nulls: int = -(1 << 63)) -> DataFrame:
    """_key and _row (a struct of the row): _key orders rows by their id, a null id as `nulls`, and tells rows apart that
    repeat an id or have none, by the file and place they were read from. Rows that come from no file are staged first.
    """
    if "_metadata" not in docs.columns:
        place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
        key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(nulls)).alias("id"), place.alias("place")).alias("_key")
        try:
            return docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        except AnalysisException:  # no files, or past a join or union
            pass
    rows = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), "rows")
    return row_keyed(rows.select("_row", F.col(f"_row.{id_col}").alias("id")), "id", nulls).select("_key", F.col("_row._row").alias("_row"))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", bits: int = 22) -> DataFrame:
    """`docs` without the rows whose id is in `dropped` (_id). A bitmap of the dropped ids, of bounded size, is broadcast;
    only rows whose bit is set take part in the join, the others never leave their partition. Null ids stay."""
    names = docs.columns
    gone = staged(dropped.select("_id").where("_id is not null").distinct(), "dropped")
    flag = flagged(docs.withColumn("_k", F.xxhash64(F.col(id_col))), "_k", bitmap(gone.select(F.xxhash64("_id").alias("_k")), "_k", bits), bits, "_maybe")
    maybe = flag.where("_maybe").join(gone, F.col(id_col) == F.col("_id"), "left_anti")
    return flag.where("not _maybe").select(*names).union(maybe.select(*names))


def within(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Of a bounded sample `rows` those that `sizes` (_id, _g, _o, _n; a row each, as few) lets in, in order of _o: of each
    group _g as many as have `most` in all, by their _n. One that would go over it is passed over."""
    used, out = {}, []
    for r in sorted(sizes.collect(), key=lambda r: (r._o, r._id)):
        if used.get(r._g, 0) + r._n <= most:
            used[r._g] = used.get(r._g, 0) + r._n
        else:
            out.append(tuple(r))
    if not out:
        return rows
    over = sizes.sparkSession.createDataFrame(out, sizes.schema).select(F.col("_id").alias("_over"))
    return rows.join(F.broadcast(over), F.col("_id") == F.col("_over"), "left_anti")
