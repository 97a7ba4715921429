"""The join of texts whose sets of word 5-grams have a Jaccard similarity of 0.8 or more, by vertical partitioning.

The global order of n-grams is that of their hashes, frequent ones last and those by frequency. It is cut into fragments.
A set's leading fragment, its first n-grams in that order, is joined first: what two sets share there, and where, bounds
their overlap. For pairs that may still be similar the overlaps of the other cuts are counted one by one and summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflux.llm.common import BLANKS, ascii_lower, bitmap, components, flagged, staged, text_of
from folioflux.sources.tables import load

#: Words of a shingle, and the similarity from which two sets are linked, in hundredths.
WORDS, SIMILAR = 5, 80
#: The share of the hash order in which n-grams are counted over all texts. Sets whose leading part reaches past it are
#: counted whole, among themselves.
LEADING = 0.3
#: n-grams in so many sets or more go last in the order; the bound is doubled until at most MOST_FREQUENT have it.
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: Bits of the bitmaps of frequent n-grams, of repeated n-grams and of candidates: their size is bounded by these.
FREQUENT_BITS, REPEATED_BITS, CANDIDATE_BITS = 23, 26, 24
#: Fragments in which overlaps are counted, a power of two.
FRAGMENTS = 4
#: Rounds in which the sets of a bucket are compared with one of them only, before all that is still open is compared.
STAR_ROUNDS = 2


def shingles(text: Column, words: int = WORDS) -> Column:
    """The 64-bit hashes of a text's shingles, in its order.

    The words are bound by a lambda of their own: where Catalyst moves the expression, it moves as a whole, and the text
    is never split again for each shingle.
    """
    split = F.array_remove(F.split(ascii_lower(text), BLANKS), "")

    def hashes(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        return F.when(F.size(w) >= words, grams).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.flatten(F.transform(F.array(split), hashes))


def shingle_set(text: Column, words: int = WORDS) -> Column:
    """The sorted distinct hashes of a text's shingles."""
    return F.sort_array(F.array_distinct(shingles(text, words)))


def set_names(hashes: Column) -> list[Column]:
    """_h, _g: two independent 64-bit hashes, by which equal sets are known."""
    return [F.xxhash64(hashes).alias("_h"), F.xxhash64(F.lit(1), hashes).alias("_g")]


def cut_at(leading: float) -> Column:
    """The hash at which the counted part of the order ends."""
    return F.lit(int(-(2**63) + leading * 2**64))


def leading_counts(docs: DataFrame, text_col: str, words: int, leading: float) -> DataFrame:
    """Staged: _x, _n of the n-grams of the leading part of the hash order that occur more than once. (explode_outer: for
    explode, Catalyst would build each set twice, once for a filter on its size.)"""
    grams = docs.select(F.explode_outer(shingles(text_of(text_col), words)).alias("_x")).where(F.col("_x") < cut_at(leading))
    return staged(grams.groupBy("_x").agg(F.count("*").alias("_n")).where("_n > 1"), "ngram-counts")


def frequency_bound(counts: DataFrame, frequent: int, most: int) -> int:
    """The least of frequent, 2 * frequent, 4 * frequent ... that at most `most` n-grams reach."""
    levels = counts.where(F.col("_n") >= frequent).groupBy(F.floor(F.log2(F.col("_n") / frequent)).alias("_l")).agg(F.count("*").alias("_c"))
    above, bound = 0, frequent
    for level, count in sorted(levels.collect(), reverse=True):  # one row for each power of two
        above += count
        if above > most:
            return frequent << int(level + 1)
    return bound


def frequent_bits(counts: DataFrame, frequent: int, most: int, bits: int) -> DataFrame:
    """One row: _words, 2**bits bits in 64-bit words, set at the low bits of the frequent n-grams. An n-gram that shares
    its low bits with one of them goes last as well: any order will do, if it is the same for all."""
    top = counts.where(F.col("_n") >= frequency_bound(counts, frequent, most))
    blocks = counts.sparkSession.range(1 << (bits - 12)).select(F.col("id").cast("int").alias("_w"))
    filled = blocks.join(bitmap(top, "_x", bits), "_w", "left").select("_w", F.coalesce("_bits", F.array_repeat(F.lit(0).cast("long"), 64)).alias("_bits"))
    return filled.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_bits"))), lambda x: x["_bits"])).alias("_words"))


def leading_parts(docs: DataFrame, counts: DataFrame, id_col: str, text_col: str, words: int, similar: int, leading: float) -> DataFrame:
    """Staged: for each row of docs one row (_id, _h, _g, _size) without _x, and one for each n-gram _x at place _pos of
    its leading part, the first n - ceil(t n) + 1 in the global order: of two sets that are similar enough, these
    have an n-gram in common. n-grams that no other text has are left out. Where the part of the order that was counted
    has too few n-grams of a set that aren't frequent, all its n-grams follow, without a place: see whole_sets."""
    frequent = staged(frequent_bits(counts, FREQUENT, MOST_FREQUENT, FREQUENT_BITS), "ngram-frequent").scalar()

    def is_frequent(bits: Column, x: Column) -> Column:
        low = x.bitwiseAND(F.lit((1 << FREQUENT_BITS) - 1))
        word = F.get(bits, F.shiftright(low, 6).cast("int"))
        return F.call_function("shiftright", word, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def split(s: Column) -> Column:
        early = F.transform(F.filter(s["set"], lambda x: x < cut_at(leading)), lambda x: F.struct(x.alias("x"), is_frequent(s["bits"], x).alias("last")))
        return F.struct(s["set"].alias("set"), F.filter(early, lambda e: ~e["last"]).alias("rare"), F.filter(early, lambda e: e["last"]).alias("last"))

    sets = docs.select(F.col(id_col).alias("_id"), shingle_set(text_of(text_col), words).alias("_set"), frequent.alias("_bits"))
    # set and bits are named once each, so that Catalyst moves them into the lambda's argument: bits as a column of its
    # own would be copied beside every set.
    divided = sets.select("_id", F.transform(F.array(F.struct(F.col("_set").alias("set"), F.col("_bits").alias("bits"))), split)[0].alias("_s"))
    sized = divided.select("_id", "_s", *set_names(F.col("_s.set")), F.size("_s.set").alias("_size")).withColumn("_take", F.expr(f"_size - cast((_size * {similar}L + 99) div 100 as int) + 1"))
    entry = lambda x, pos, last: F.struct(x.alias("x"), pos.cast("int").alias("pos"), last.alias("last"))
    part = F.transform(F.slice("_s.rare", F.lit(1), F.col("_take")), lambda e, i: entry(e["x"], i, F.lit(False)))
    late = F.transform(F.filter("_s.set", lambda x: x >= cut_at(leading)), lambda x: entry(x, F.lit(None), F.lit(False)))
    whole = F.concat(*[F.transform(f"_s.{k}", lambda e: entry(e["x"], F.lit(None), e["last"])) for k in ("rare", "last")], late)
    none = F.expr("cast(array(null) as array<struct<x:bigint,pos:int,last:boolean>>)")
    each = F.when(F.col("_size") == 0, none).otherwise(F.concat(none, F.when(F.size("_s.rare") >= F.col("_take"), part).otherwise(whole)))
    rows = sized.select("_id", "_h", "_g", "_size", F.explode_outer(each).alias("_e")).select("_id", "_h", "_g", "_size", F.col("_e.x").alias("_x"), F.col("_e.pos").alias("_pos"), F.col("_e.last").alias("_last"))
    known = flagged(rows, "_x", bitmap(counts, "_x", REPEATED_BITS), REPEATED_BITS, "_repeated")
    return staged(known.where("_x is null or _pos is null or _repeated").drop("_repeated"), "ngram-parts")


def whole_sets(rows: DataFrame, similar: int, leading: float) -> DataFrame:
    """_h, _g, _size, _x, _pos: the leading parts of the sets that leading_parts gave whole. Their n-grams are counted among
    themselves: beyond the counted part of the order only these sets' leading parts can meet."""
    each = staged(rows.where("_x is not null and _pos is null").groupBy("_h", "_g", "_x").agg(F.max("_size").alias("_size"), F.max("_last").alias("_last")), "ngram-whole")
    counts = each.groupBy(F.col("_x").alias("_y")).agg(F.count("*").alias("_n")).where("_n > 1")
    known = each.join(counts, F.col("_x") == F.col("_y"), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    last = F.when(F.col("_last") | (F.col("_x") >= cut_at(leading)) & (F.col("_n") >= FREQUENT), F.col("_n")).otherwise(0)
    placed = known.withColumn("_pos", F.row_number().over(Window.partitionBy("_h", "_g").orderBy(last, "_x")) - 1)
    return placed.where(f"_pos < _size - cast((_size * {similar}L + 99) div 100 as int) + 1 and _n > 1 or _pos < _size - cast((_size * {similar}L + 99) div 100 as int) + 1 and not _last and _x < {int(-(2**63) + leading * 2**64)}L").select("_h", "_g", "_size", "_x", "_pos")


def buckets(rows: DataFrame, names: DataFrame, similar: int, leading: float) -> DataFrame:
    """Staged: _x, _name, _size, _pos of the leading n-grams that other texts have as well. Equal sets are one row."""
    near = rows.where("_pos is not null").select("_h", "_g", "_size", "_x", "_pos")
    each = near.union(whole_sets(rows, similar, leading)).groupBy("_x", "_h", "_g").agg(F.max("_size").alias("_size"), F.max("_pos").alias("_pos"))
    return staged(each.join(names.select("_h", "_g", "_name"), ["_h", "_g"]).select("_x", "_name", "_size", "_pos"), "ngram-buckets")


def segments(docs: DataFrame, names: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Staged: _h, _g, _fragment, _segment of the sets in `pairs`, and of a few others. One id stands for equal sets; rows
    that don't have it are left out by a bitmap of ids before their set is built again. A set may come more than once."""
    wanted = names.join(pairs.select(F.col("_a").alias("_name")).union(pairs.select("_b")).distinct(), "_name", "left_semi").select(F.xxhash64("_first").alias("_k"))
    flag = flagged(docs.select(F.xxhash64(F.col(id_col)).alias("_k"), F.col(text_col).alias("_text")), "_k", bitmap(wanted, "_k", CANDIDATE_BITS), CANDIDATE_BITS, "_may")
    shift = 64 - (FRAGMENTS.bit_length() - 1)
    sets = flag.where("_may").select(shingle_set(text_of("_text"), words).alias("_set")).select("_set", *set_names(F.col("_set")))
    cut = sets.select("_h", "_g", F.explode_outer(F.array(*[F.struct(F.lit(f).alias("_fragment"), F.filter("_set", _in_fragment(f, shift)).alias("_segment")) for f in range(FRAGMENTS)])).alias("s"))
    return staged(cut.where("size(s._segment) > 0").select("_h", "_g", "s._fragment", "s._segment"), "ngram-segments")


def _in_fragment(f: int, shift: int):
    return lambda x: F.shiftright(x, shift) == f - FRAGMENTS // 2


def similar_pairs(pairs: DataFrame, names: DataFrame, cut: DataFrame, similar: int) -> DataFrame:
    """The pairs (_a, _b, _na, _nb) whose sets are similar: overlaps counted by fragment, each once, then summed. The
    names of pairs are turned into hashes, not those of the sets, which are larger."""
    by = lambda x: names.select(F.col("_name").alias(f"_{x}"), F.col("_h").alias(f"_h{x}"), F.col("_g").alias(f"_g{x}"))
    left = cut.select(F.col("_h").alias("_ha"), F.col("_g").alias("_ga"), "_fragment", F.col("_segment").alias("_s"))
    right = cut.select(F.col("_h").alias("_hb"), F.col("_g").alias("_gb"), "_fragment", F.col("_segment").alias("_t"))
    met = pairs.join(by("a"), "_a").join(by("b"), "_b").join(left, ["_ha", "_ga"]).join(right, ["_hb", "_gb", "_fragment"])
    partial = met.select("_a", "_b", "_na", "_nb", "_fragment", F.size(F.array_intersect("_s", "_t")).cast("long").alias("_o"))
    counts = partial.groupBy("_a", "_b", "_na", "_nb").agg(*[F.max(F.when(F.col("_fragment") == f, F.col("_o")).otherwise(0)).alias(f"_o{f}") for f in range(FRAGMENTS)])
    total = counts.withColumn("_o", sum((F.col(f"_o{f}") for f in range(1, FRAGMENTS)), F.col("_o0")))
    return total.where(f"100 * _o >= {similar} * (_na + _nb - _o)").select("_a", "_b")


def promising_pairs(pairs: DataFrame, found: DataFrame, similar: int) -> DataFrame:
    """The pairs that may be similar by what their leading fragments share.

    Of two leading parts one ends first; up to there all that the sets share is in both parts, and what is left of that
    set bounds the rest. So the overlap is at most the number of shared leading n-grams and the larger rest."""
    a = found.select(F.col("_name").alias("_a"), "_x")
    b = found.select(F.col("_name").alias("_b"), "_x")
    counted = pairs.join(a, "_a").join(b, ["_b", "_x"]).groupBy("_a", "_b", "_na", "_nb").agg(F.count("*").alias("_c"))
    rest = lambda n: F.expr(f"({n} * {similar}L + 99) div 100 - 1")
    return counted.where((100 + similar) * (F.col("_c") + F.greatest(rest("_na"), rest("_nb"))) >= similar * (F.col("_na") + F.col("_nb"))).drop("_c")


def may_be_similar(similar: int) -> Column:
    """Whether sets of _size and _other_size may be similar if the first n-gram that they share is at _pos and _other_pos.

    Every n-gram that they share is at or after these places. (At a later shared n-gram the test is stricter; the pair
    meets at the first as well, so it may be left out here.)"""
    return F.expr(f"{100 + similar}L * least(_size - _pos, _other_size - _other_pos) >= {similar}L * (_size + _other_size)")


def ordered_pairs(joined: DataFrame) -> DataFrame:
    """Distinct pairs _a < _b from (_name, _size, _other, _other_size)."""
    swap = F.col("_name") > F.col("_other")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return joined.select(pick("_name", "_other").alias("_a"), pick("_other", "_name").alias("_b"), pick("_size", "_other_size").alias("_na"), pick("_other_size", "_size").alias("_nb")).distinct()


def linked_sets(docs: DataFrame, names: DataFrame, found: DataFrame, id_col: str, text_col: str, words: int, similar: int, rounds: int = STAR_ROUNDS) -> DataFrame:
    """_node, _comp: the component of each set that is linked with another.

    A bucket's sets are first compared with one of them: the one with the fewest n-grams before the shared one, hence the
    closest to what the others have in common; in later rounds one by a hash. A set that all others of its bucket have been
    compared with leaves the bucket; so do all sets of a bucket that are one component, whatever their number. When a
    round finds no link, or after `rounds`, every pair of a bucket's sets that is still in different components, and that
    may be similar by sizes and places, is compared, so that no link is lost. Only sets of pairs that are promising by
    their leading fragments are built again, cut into fragments and compared whole.
    """
    labels, edges, known = None, None, found.withColumn("_comp", F.col("_name"))
    for turn in range(rounds):
        central = F.col("_pos").cast("long") if turn == 0 else F.xxhash64("_name", F.lit(turn))
        star = open_buckets(known, F.min(F.struct(central.alias("h"), "_name", "_size", "_pos", "_comp")).alias("_star")).select("_y", *[F.col(f"_star.{c}").alias(f"_other{c}".replace("_name", "")) for c in ("_name", "_size", "_pos", "_comp")])
        met = known.join(star, (F.col("_x") == F.col("_y")) & (F.col("_name") != F.col("_other")))
        rest = staged(met, f"ngram-round-{turn}")
        new = compared(docs, names, found, rest.where((F.col("_comp") != F.col("_other_comp")) & may_be_similar(similar)), id_col, text_col, words, similar)
        edges = new if edges is None else edges.union(new)
        linked = bool(new.take(1))
        if linked or labels is None:
            labels = components(edges, "ngram")
        known = rest.select("_x", "_name", "_size", "_pos").join(labels, F.col("_name") == F.col("_node"), "left").select("_x", "_name", "_size", "_pos", F.coalesce("_comp", "_name").alias("_comp"))
        if not linked:
            break
    still = staged(known.join(open_buckets(known), F.col("_x") == F.col("_y"), "left_semi"), "ngram-open")
    other = still.select(F.col("_x").alias("_y"), F.col("_name").alias("_other"), F.col("_size").alias("_other_size"), F.col("_pos").alias("_other_pos"), F.col("_comp").alias("_other_comp"))
    near = still.join(other, (F.col("_x") == F.col("_y")) & (F.col("_name") < F.col("_other")) & (F.col("_comp") != F.col("_other_comp")) & may_be_similar(similar))
    return components(edges.union(compared(docs, names, found, near, id_col, text_col, words, similar)), "ngram")


def open_buckets(known: DataFrame, *more: Column) -> DataFrame:
    """_y: the n-grams whose sets are in more than one component, with the aggregates `more`."""
    return known.groupBy(F.col("_x").alias("_y")).agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi"), *more).where("_lo <> _hi")


def compared(docs: DataFrame, names: DataFrame, found: DataFrame, met: DataFrame, id_col: str, text_col: str, words: int, similar: int) -> DataFrame:
    """Staged: the similar ones (_a, _b) of the pairs in `met` (_name, _size, _other, _other_size)."""
    pairs = staged(ordered_pairs(met), "ngram-pairs")
    near = staged(promising_pairs(pairs, found, similar), "ngram-near")
    return staged(similar_pairs(near, names, segments(docs, names, near, id_col, text_col, words), similar), "ngram-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR, leading: float = LEADING) -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles and component_id, the smallest id reachable by links.

    A set is a text's distinct shingles of `words` words, A-Z lower-cased; a text of fewer words has the whole sequence
    as its only one, a text without words or null has none and is linked with nothing, its component its own id. Two
    rows are linked when 100 * |A and B| >= similar * |A or B|; equal sets always are. Ids that repeat are one document
    for component_id's sake; a null id is passed over where another id is reachable. An empty table gives no rows. Only
    id_col and text_col are read, so further columns, whatever their names, do no harm.

    Sets are built where the texts are and never shuffled whole: counts of n-grams of a part of the order, then the
    n-grams of leading parts that occur twice, then only the sets that share one. Equal sets, known by two 64-bit hashes, are
    one number from then on; large groups of near copies are compared with one member a round (see linked_sets); the last
    join, from rows to components, may be split by AQE where one set has many rows. What is broadcast are bitmaps of fixed size.
    """
    counts = leading_counts(docs, text_col, words, leading)
    rows = leading_parts(docs, counts, id_col, text_col, words, similar, leading)
    own = rows.where("_x is null").select("_id", "_h", "_g", "_size")
    distinct = own.where("_size > 0").groupBy("_h", "_g").agg(F.min("_id").alias("_first"))
    names = staged(distinct.withColumn("_name", F.monotonically_increasing_id()), "ngram-names")
    labels = linked_sets(docs, names, buckets(rows, names, similar, leading), id_col, text_col, words, similar)
    named = staged(names.join(labels, F.col("_name") == F.col("_node"), "left").select("_h", "_g", F.coalesce("_comp", "_name").alias("_comp"), "_first"), "ngram-components")
    comps = named.groupBy(F.col("_comp").alias("_c")).agg(F.min("_first").alias("_least"))
    firsts = named.join(comps, F.col("_comp") == F.col("_c")).select(F.col("_h").alias("_m"), F.col("_g").alias("_o"), "_least")
    keyed = own.withColumn("_k", F.when(F.col("_size") > 0, F.col("_h")).otherwise(F.xxhash64("_id", F.lit("empty"))))
    return keyed.join(firsts, (F.col("_k") == F.col("_m")) & (F.col("_g") == F.col("_o")), "left").select(
        F.col("_id").alias(id_col), F.col("_size").cast("long").alias("n_shingles"), F.when(F.col("_size") > 0, F.coalesce("_least", "_id")).otherwise(F.col("_id")).alias("component_id")
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents."""
    return near_duplicates(load(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + {WORDS - 1}], ' ') AS k FROM d, unnest(generate_series(1, greatest(len(ws) - {WORDS - 1}, 1))) t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {SIMILAR} * (x.n + y.n - o)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON d.doc_id = c.node
"""
