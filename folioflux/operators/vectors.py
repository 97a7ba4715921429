"""Nearest vectors by cosine (§2.13): coarse cells fitted on a bounded sample, an equi-join on the probed cells, exact ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Cells, how many a query probes by default, and the bound of the sample the index is fitted on. Vectors without clusters
#: lie in many directions at once: a recall of 0.9 then takes two thirds of the cells, clustered ones a few.
CELLS, PROBES, SAMPLE = 64, 44, 2048
#: Of the exact search: queries and vectors of a block, queries of it that are compared at once, and places of a cosine that
#: count for its rank.
ASKED, ENTERED, SLICE, TIED = 4096, 8192, 256, 9
#: Stands for the cosine of vectors whose lengths differ, which is null and comes last.
APART = -2.0


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of one length, 0 where either has no length; summed in order, as doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def pivots(vectors: DataFrame, id_col: str, vec_col: str, cells: int = CELLS, sample: int = SAMPLE) -> list[list[float]]:
    """The middles of `cells` cells at most: spherical k-means on the `sample` vectors with the smallest hashes of their id,
    which is what comes to the driver. The same in each run."""
    some = vectors.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(sample)
    rows = [r[0] for r in some.select(F.col(vec_col).cast("array<double>")).collect()]
    if not rows:
        return []
    m = np.array(rows, dtype=np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    found = m[:cells].copy()
    for _ in range(10):
        near = np.argmax(m @ found.T, axis=1)
        for k in range(len(found)):
            total = m[near == k].sum(axis=0)
            if np.linalg.norm(total) > 1e-9:
                found[k] = total / np.linalg.norm(total)
    return found.tolist()


def cells_of(vec: Column, around: list[list[float]], n: int) -> Column:
    """The numbers of the n nearest pivots, nearest first."""
    all_ = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in around])
    near = F.transform(all_, lambda p, i: F.struct((-cosine(vec, p)).alias("d"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(near), 1, n), lambda x: x["i"])


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", itself: bool = False) -> DataFrame:
    """query, rank, id and cosine as cosine_topk() has them, from all pairs: blocks of ASKED queries meet blocks of ENTERED vectors,
    a task holds one block of each, and what is shuffled on is k rows for each query and block. The work is the product of
    both sides, the memory is bounded."""
    kind = vectors.schema[id_col].dataType
    found = T.StructType([T.StructField("query", queries.schema[id_col].dataType), T.StructField("id", kind), T.StructField("cosine", T.DoubleType())])
    asked, entered = (df.where(F.col(vec_col).isNotNull()) for df in (queries, vectors))
    n_asked, n_entered = -(-asked.count() // ASKED) or 1, -(-entered.count() // ENTERED) or 1
    dealt = lambda n: (F.monotonically_increasing_id() % n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vec = F.col(vec_col).cast("array<double>").alias("_v")
    left = asked.select(F.col(id_col).alias("query"), F.col(id_col).cast(kind).alias("_own"), vec, dealt(n_asked).alias("_a")).withColumn("_e", every(n_entered))
    right = entered.select(F.col(id_col).alias("id"), vec, dealt(n_entered).alias("_e")).withColumn("_a", every(n_asked))
    if not itself:
        left, right = left.where("query is not null"), right.where("id is not null")

    found_arrow = to_arrow_schema(found)

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest(a, b, k, itself) if len(a) and len(b) else found_arrow.empty_table()

    met = left.groupBy("_a", "_e").cogroup(right.groupBy("_a", "_e")).applyInArrow(nearest, found)
    w = Window.partitionBy("query").orderBy(F.round("cosine", TIED).desc(), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "cosine")


def _nearest(a: pa.Table, b: pa.Table, k: int, itself: bool) -> pa.Table:
    """query, id and cosine of the k nearest rows of b (id, _v) for each row of a (query, _own, _v), ties by id."""
    (q, nq, live_q), (v, nv, live_v) = _matrices(a["_v"]), _matrices(b["_v"])
    codes = pc.rank(pa.chunked_array([*a["_own"].chunks, *b["id"].chunks]), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    own, ids = codes[: len(a)], codes[len(a) :]
    rows, cols, cosines = [], [], []
    for at in range(0, len(a), SLICE):
        part = slice(at, at + SLICE)
        near = np.where(live_q[part, None] & live_v[None, :], APART, 0.0)
        for d in q.keys() & v.keys():
            np.copyto(near, q[d][part] @ v[d].T, where=(nq[part, None] == d) & (nv[None, :] == d))
        if not itself:
            near[own[part, None] == ids[None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if k < len(b) else np.full(len(near), -np.inf)
        for i in range(len(near)):
            some = np.flatnonzero((near[i] >= least[i] - 1e-8) & (near[i] > -np.inf))  # equal ones too, whose last digits may differ
            exact, d = near[i, some], int(nq[at + i])
            if d in v and d in q:
                sums = np.einsum("ij,ij->i", v[d][some], np.broadcast_to(q[d][at + i], (len(some), d)))
                exact = np.where(nv[some] == d, sums, exact)
            best = np.lexsort((ids[some], -np.round(exact, TIED)))[:k]
            rows += [at + i] * len(best)
            cols += some[best].tolist()
            cosines += [None if c == APART else c for c in exact[best].tolist()]
    return pa.table({"query": a["query"].take(pa.array(rows, pa.int64())), "id": b["id"].take(pa.array(cols, pa.int64())), "cosine": pa.array(cosines, pa.float64())})


def _matrices(vecs: pa.ChunkedArray) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """By length of the vectors a matrix with all of them as rows of length 1, those of another length, of zeros or with missing
    numbers as zeros; the length of each vector; and which are not zero."""
    flat = pa.concat_arrays(vecs.chunks)
    n, values = flat.value_lengths().to_numpy(zero_copy_only=False), flat.flatten().to_numpy(zero_copy_only=False)
    starts, out, live = np.cumsum(n) - n, {}, np.zeros(len(n), dtype=bool)
    for d in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == d)
        own = values[starts[rows, None] + np.arange(d)]
        size = np.sqrt(np.einsum("ij,ij->i", own, own))
        live[rows] = size > 0
        out[d] = np.zeros((len(n), d))
        out[d][rows] = np.where((size > 0)[:, None], own / np.where(size > 0, size, 1.0)[:, None], 0.0)
    return out, n, live


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = CELLS, probes: int | None = PROBES, itself: bool = False) -> DataFrame:
    """query, rank, id and cosine of the k nearest vectors of each query, ties by id; without the query's own id unless
    `itself`.

    Every vector is entered in the cell of its nearest pivot; a query looks into its `probes` nearest cells, joined on the
    cell, and what it finds there is ranked by exact cosine; the result is what those cells hold. probes None means all
    cells, which need no index: see exact_topk(). Cosines that agree in nine places are ties. Ranking limits each query's rows before they are shuffled. Null vectors and
    queries without a vector give nothing; zero vectors have a cosine of 0."""
    if probes is None:
        return exact_topk(queries, vectors, k, id_col, vec_col, itself)
    around = pivots(vectors, id_col, vec_col, cells)
    if not around:
        return queries.sparkSession.createDataFrame([], f"query {queries.schema[id_col].dataType.simpleString()}, rank int, id {vectors.schema[id_col].dataType.simpleString()}, cosine double")
    n = min(probes, len(around))
    entered = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"), cells_of(F.col(vec_col), around, 1)[0].alias("_cell"))
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query"), F.col(vec_col).alias("_q"), F.explode(cells_of(F.col(vec_col), around, n)).alias("_cell"))
    met = entered.join(asked, "_cell").where(F.lit(itself) | (F.col("id") != F.col("query"))).select("query", "id", cosine(F.col("_q"), F.col("_v")).alias("cosine"))
    w = Window.partitionBy("query").orderBy(F.round("cosine", TIED).desc(), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "cosine")
