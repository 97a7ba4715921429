"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy, with thresholds by language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.arrowmap import map_texts
from folioflux.llm.common import staged, within
from folioflux.llm.wordarrays import Words, hash_ranges, words_of
from folioflux.sources.tables import load

#: Buckets of whole words and of their beginnings (the first 4 bytes); the row after them is padding.
WORD_BUCKETS, HEAD_BUCKETS, HEAD = 1 << 14, 1 << 13, 4
PAD = WORD_BUCKETS + HEAD_BUCKETS
WIDTHS, FILTERS, SIZE = (1, 2, 3), 12, 12
#: Bound on the labelled documents that training reads, half of them of each label where there are so many.
MAX_TRAIN = 4000
#: Bound on the words of those documents together; one that doesn't fit any more is passed over.
MAX_WORDS = 8_000_000
#: Buckets that fewer training texts have stay zero: they could only tell these texts apart, not others.
RARE = 3


@dataclass
class Model:
    """Embeddings E, for each width k the filters W[k] (one matrix a place, the last word first) and their bias, the
    output weights, and a line that turns logits into calibrated scores."""

    E: np.ndarray
    W: list[np.ndarray]
    b: list[np.ndarray]
    v: np.ndarray
    c: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] | None = None

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's two rows of the embedding table."""
    whole = (words.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int32)
    head = hash_ranges(words.data, words.start, np.minimum(words.end, words.start + HEAD), 1)
    return whole, (head % np.uint64(HEAD_BUCKETS)).astype(np.int32) + WORD_BUCKETS


def padded(whole: np.ndarray, head: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words with padding before each text, so that no window spans two, and where each text's words stand."""
    lead = max(WIDTHS) - 1
    docs = len(bounds) - 1
    ids = np.full((2, len(whole) + lead * docs + 1), PAD, dtype=np.int32)
    place = np.arange(len(whole)) + lead * (np.repeat(np.arange(docs), np.diff(bounds)) + 1)
    ids[0, place], ids[1, place] = whole, head
    start = bounds[:-1] + lead * np.arange(1, docs + 1)
    return ids[0], ids[1], start, start + np.diff(bounds)


def convolve(model: Model, x: np.ndarray) -> np.ndarray:
    """Each filter at each place: windows end there."""
    out = []
    for k, w, b in zip(WIDTHS, model.W, model.b, strict=True):
        z = x @ w[0]
        for j in range(1, k):
            z[j:] += x[:-j] @ w[j]
        out.append(z + b)
    return np.concatenate(out, axis=1)


def pooled(z: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest value of each filter over each text, 0 at least."""
    most = np.maximum.reduceat(z, np.stack([start, end], axis=1).ravel(), axis=0)[::2]
    most[start == end] = 0
    return np.maximum(most, 0)


def logits(model: Model, whole: np.ndarray, head: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    a, b, start, end = padded(whole, head, bounds)
    return pooled(convolve(model, model.E[a] + model.E[b]), start, end) @ model.v + model.c


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int | None = None, batch: int = 24, rate: float = 0.004, seed: int = 7) -> Model:
    """Adam on the log loss of batches, half of each label, about twice over
    the toxic texts. The first embedding dimension starts from the log-odds of
    each bucket over the sample, shrunk for rare ones, and one filter of width 1 reads it; all else starts at random."""
    rng = np.random.default_rng(seed)
    count = np.zeros((2, PAD + 1))
    for (whole, head), y in zip(docs, labels, strict=True):
        count[y, np.unique(whole)] += 1
        count[y, np.unique(head)] += 1
    of = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())], dtype=float)
    prior = 2 * of / of.sum()
    odds = np.log((count[1] + prior[1]) / prior[1]) - np.log((count[0] + prior[0]) / prior[0])
    E = (rng.normal(size=(PAD + 1, SIZE)) * 0.1).astype(np.float32)
    E[:, 0] = np.clip(odds, -3, 6) / 4
    rare = count.sum(axis=0) < RARE
    rare[PAD] = True
    E[rare] = 0
    W = [(rng.normal(size=(k, SIZE, FILTERS)) * 0.2).astype(np.float32) for k in WIDTHS]
    W[0][0][:, 0] = 0
    W[0][0][0, 0] = 1
    v = (np.abs(rng.normal(size=FILTERS * len(WIDTHS))) * 0.1).astype(np.float32)
    v[0] = 2
    model = Model(E, W, [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], v, -1.5)
    steps = int(np.clip(4 * (labels == 1).sum() / batch, 60, 900)) if steps is None else steps
    if not (labels == 0).any() or not (labels == 1).any():
        model.v[:] = 0
        model.c = 3.0 if (labels == 1).any() else -3.0
        return model

    params = [model.E, *model.W, *model.b, model.v, np.array([model.c], dtype=np.float32)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pools = [np.flatnonzero(labels == y) for y in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, batch // 2) for p in pools])
        y = labels[pick].astype(np.float32)
        a, b, start, end = padded(np.concatenate([docs[i][0] for i in pick]), np.concatenate([docs[i][1] for i in pick]), np.cumsum([0, *(len(docs[i][0]) for i in pick)]))
        x = model.E[a] + model.E[b]
        z = convolve(model, x)
        top = pooled(z, start, end)
        grad = (1 / (1 + np.exp(-np.clip(top @ model.v + params[-1][0], -30, 30))) - y) / len(pick)
        back = (grad[:, None] * model.v) * (top > 0)
        where = np.stack([i + z[i:j].argmax(axis=0) if j > i else np.full(z.shape[1], i) for i, j in zip(start, end, strict=True)])
        g = [np.zeros_like(p) for p in params]
        g[-2], g[-1][0] = top.T @ grad, grad.sum()
        for n, k in enumerate(WIDTHS):
            f = slice(n * FILTERS, (n + 1) * FILTERS)
            g[1 + len(WIDTHS) + n] = back[:, f].sum(axis=0)
            for j in range(k):
                at = where[:, f] - j
                g[1 + n][j] = np.einsum("dfs,df->sf", x[at], back[:, f])
                flow = (back[:, f, None] * model.W[n][j].T[None]).reshape(-1, SIZE)
                np.add.at(g[0], a[at].ravel(), flow)
                np.add.at(g[0], b[at].ravel(), flow)
        g[0][rare] = 0
        for p, q, u, w in zip(params, g, m, s, strict=True):
            u += 0.1 * (q - u)
            w += 0.01 * (q * q - w)
            p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.99**step)) + 1e-6)
    model.c = float(params[-1][0])
    return model


def calibrate(model: Model, logit: np.ndarray, labels: np.ndarray, langs: list[str | None], least: int = 20, weights: np.ndarray | None = None) -> None:
    """Fits the line from logits to scores on documents that training did not see (Newton steps on the log loss, the
    rarer label weighed up by the root of its share, with a weak pull to slope 1), then for each language with `least` documents and both labels the threshold of best F1.
    `weights` says how many documents of the table each one stands for, so that both mean the same whatever was sampled."""
    each = np.ones(len(labels)) if weights is None else weights * (len(labels) / weights.sum())
    w = np.array([1.0, 0.0])
    if (labels == 0).any() and (labels == 1).any():
        x = np.stack([logit, np.ones_like(logit)], axis=1)
        even = each * np.sqrt(len(labels) / 2 / np.where(labels == 1, each[labels == 1].sum(), each[labels == 0].sum()))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            pull = 0.02 * len(labels) / 10
            h = (x * (even * p * (1 - p))[:, None]).T @ x + np.diag([pull, pull]) + 1e-6 * np.eye(2)
            w = w - np.linalg.solve(h, x.T @ (even * (p - labels)) + pull * (w - np.array([1.0, 0.0])))
        if w[0] <= 0:
            w = np.array([1.0, 0.0])
    model.scale, model.shift = float(w[0]), float(w[1])
    score, model.thresholds = model.score(logit), {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        s, y, n = score[own], labels[own], each[own]
        if len(y) < least or y.min() == y.max():
            continue
        order = np.argsort(-s, kind="stable")
        s, y, n = s[order], y[order], n[order]
        hit = np.cumsum(n * y)
        f1 = 2 * hit / (np.cumsum(n) + hit[-1])
        f1[:-1][s[:-1] == s[1:]] = 0
        best = int(f1.argmax())
        below = s[best + 1] if best + 1 < len(s) else 0.0
        model.thresholds[lang] = float(np.clip((s[best] + below) / 2, 0.2, 0.8))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> Model:
    """A model from the documents that `labels` marks 0 or 1 in label_col; an id marked both ways counts as 1.

    At most max_train documents are read: of each label the half with the smallest hash of their id, so that the choice
    is the same in each run. Which these are is decided on the labels alone; only their ids are broadcast, and only rows
    of buckets come to the driver, of max_words words at most: a document that doesn't fit is passed over. Of rows that
    repeat an id the one with the smallest hash of its text is read; null ids have no label. Without labels, or without
    documents, nothing is learned. A quarter of them is kept from training for calibration, where each stands for as many
    labelled ids as there are for one chosen of its label: a label that is cut by max_train keeps its share of the table.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    order = F.xxhash64(F.col("_id"), F.lit(1))
    chosen = marks.where("_y = 1").orderBy(order, "_id").limit(max_train // 2).union(marks.where("_y = 0").orderBy(order, "_id").limit(max_train // 2))
    labelled = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    picked = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_id", "_y", (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("_lang"), F.col(text_col).alias("_t"))
    picked = picked.groupBy("_id", "_y").agg(F.min_by(F.struct("_lang", "_t"), F.xxhash64("_t", "_lang")).alias("_r")).select("_id", "_y", "_r._lang", "_r._t")

    def make():
        def rows(data, offsets, texts):
            words = words_of(data, offsets, accents=True)
            whole, head = buckets(words)
            bounds = pa.array(words.bounds, type=pa.int32())
            return [pa.ListArray.from_arrays(bounds, pa.array(whole)), pa.ListArray.from_arrays(bounds, pa.array(head))]

        return rows

    read = staged(map_texts(picked, "_t", "whole array<int>, head array<int>", make, ["_id", "_y", "_lang"]).select("_row._id", "_row._y", "_row._lang", "whole", "head"), "toxicity-train")
    got = within(read, read.select("_id", F.lit(0).alias("_g"), F.xxhash64("_id", F.lit(1)).alias("_o"), F.size("whole").alias("_n")), max_words).toArrow()
    order = pc.sort_indices(got["_id"]).to_numpy() if got.num_rows else np.zeros(0, dtype=np.int64)
    y = got["_y"].to_numpy().astype(np.int64)[order] if got.num_rows else np.zeros(0, dtype=np.int64)
    langs = [got["_lang"][int(i)].as_py() for i in order]
    seqs = [tuple(np.asarray(got[c][int(i)].values) for c in ("whole", "head")) for i in order]  # views: the sample is held once
    del got
    aside = np.arange(len(y)) % 4 == 3
    if not (y[~aside] == 1).any() or not (y[aside] == 1).any():
        aside[:] = False
    model = train([s for s, x in zip(seqs, aside, strict=True) if not x], y[~aside])
    held = [s for s, x in zip(seqs, aside, strict=True) if x]
    if held:
        out = np.array([logits(model, a, b, np.array([0, len(a)]))[0] for a, b in held])
        stands = np.array([max(1.0, labelled.get(k, 0) / max(1, max_train // 2)) for k in (0, 1)])
        calibrate(model, out, y[aside], [x for x, z in zip(langs, aside, strict=True) if z], weights=stands[y[aside]])
    del seqs, held
    pa.default_memory_pool().release_unused()  # the sample's memory goes back before the driver plans further stages
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """_row (a struct of `columns` of each row, all by default) and score, 0 to 1, of each whole text.

    One pass over the rows in their partitions: no shuffle, memory bounded by a slice of an Arrow batch. Null and empty
    texts get the score of no words at all; rows that repeat are scored each; an empty table gives no rows; the struct
    keeps columns of any name apart from the score.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def rows(data, offsets, texts):
            words = words_of(data, offsets, accents=True)
            return [pa.array(model.score(logits(model, *buckets(words), words.bounds)).astype(np.float64))]

        return rows

    return map_texts(docs, text_col, "score double", make, columns)


def threshold_of(model: Model, lang: Column) -> Column:
    """The language's threshold; 0.5 where none was calibrated."""
    found = F.lit(0.5)
    for name, value in (model.thresholds or {}).items():
        found = F.when(lang == name, F.lit(value)).otherwise(found)
    return found


def held_out(id_col: str, parts: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == rest


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents; learns from labels that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    scored = score_texts(docs, model, columns=["doc_id"]).select("_row.doc_id", "score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
