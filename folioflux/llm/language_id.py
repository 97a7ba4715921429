"""Language identification of words in code-switched text: a linear-chain conditional random field in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.llm.arrowmap import map_texts
from folioflux.llm.common import staged, within
from folioflux.llm.toxicity import held_out
from folioflux.llm.wordarrays import Words, hash_ranges, words_of
from folioflux.sources.tables import load

#: Buckets of the hashed features: whole words (the lexicon), affixes of 2 and 3 bytes, and byte 3-grams.
LEXICON, AFFIX, GRAM = 1 << 15, 1 << 12, 1 << 14
#: Bound on the documents of each language that training reads.
MAX_DOCS = 300
#: Bound on the words of a language's documents together; one that doesn't fit any more is passed over.
MAX_WORDS = 1_000_000
#: Columns over which a chain is cut so that all of them step together.
COLUMNS = 1024


@dataclass
class Model:
    """Labels, emission weights by feature (rows) and label, transitions between labels (from, to), and start weights."""

    labels: list[str]
    lexicon: np.ndarray
    affix: list[np.ndarray]
    gram: np.ndarray
    step: np.ndarray
    start: np.ndarray


def affixes(words: Words) -> list[np.ndarray]:
    """Buckets of prefixes and suffixes of 2 and 3 bytes; shorter words give what they have."""
    out = []
    for n in (2, 3):
        for a, b in ((words.start, np.minimum(words.end, words.start + n)), (np.maximum(words.start, words.end - n), words.end)):
            out.append((hash_ranges(words.data, a, b, 1) % np.uint64(AFFIX)).astype(np.int32))
    return out


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 3-grams of each word with its edges marked, and where each word's begin."""
    size = words.end - words.start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first - words.start, size)
    byte = words.data[at].astype(np.int64)
    before = np.where(np.arange(len(at)) == np.repeat(first, size), 1, np.concatenate([[1], byte[:-1]]))
    after = np.where(np.arange(len(at)) == np.repeat(first + size - 1, size), 2, np.concatenate([byte[1:], [2]]))
    code = (before * 65_599 + byte) * 65_599 + after
    return ((code ^ (code >> 15)) % GRAM).astype(np.int32), first


def emissions(model: Model, words: Words) -> np.ndarray:
    """A score of each label for each word: the sum of its features' weights, 3-grams as their mean."""
    if not len(words.start):
        return np.zeros((0, len(model.labels)), dtype=np.float32)
    score = model.lexicon[(words.hashes() % np.uint64(LEXICON)).astype(np.int32)].copy()
    for table, ids in zip(model.affix, affixes(words), strict=True):
        score += table[ids]
    ids, first = grams(words)
    size = (words.end - words.start).astype(np.float32)
    score += np.add.reduceat(model.gram[ids], first, axis=0) / size[:, None]
    return score


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis=axis, keepdims=True))
    return x / x.sum(axis=axis, keepdims=True)


def forward_backward(model: Model, score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's label probabilities. `first` marks the words that begin a text, where the chain starts anew.

    All chains are laid end to end and cut into columns of equal length that step together: a first sweep multiplies
    each column's transfer matrices, the column ends are linked one after another, and a second sweep gives the messages.
    Messages are scaled to sum 1 at each step, which leaves probabilities as they are.
    """
    n, k = score.shape
    if not n:
        return np.zeros((0, k))
    e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64) + 1e-9
    move, begin = np.exp(model.step - model.step.max()), np.exp(model.start - model.start.max())
    columns = max(1, min(COLUMNS, n // 16, (1 << 22) // max(1, len(model.labels) ** 2)))
    rows = -(-n // columns)
    pad = rows * columns - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(columns, rows, k)
    first = np.concatenate([first, np.ones(pad, dtype=bool)]).reshape(columns, rows)
    restart = np.tile(begin, (k, 1))

    def sweep(order, transfer):
        """Messages after each step of all columns, where transfer(t) gives each column's matrix (from, to)."""
        total = np.tile(np.eye(k), (columns, 1, 1))
        for t in order:
            total = total @ transfer(t)
            total /= total.sum(axis=(1, 2), keepdims=True)
        return total

    def into(t):  # from the word before to word t, with what word t itself says
        return np.where(first[:, t, None, None], restart, move) * e[:, t, None, :]

    total, entry = sweep(range(rows), into), np.full((columns, k), 1 / k)
    for c in range(1, columns):
        m = entry[c - 1] @ total[c - 1]
        entry[c] = m / m.sum()
    alpha, m = np.empty((rows, columns, k)), entry
    for t in range(rows):
        m = np.einsum("ck,ckj->cj", m, into(t))
        m /= m.sum(axis=1, keepdims=True)
        alpha[t] = m

    def back(t):  # from word t + 1, with what it says, to word t
        after = first[:, t + 1] if t + 1 < rows else np.concatenate([first[1:, 0], [True]])
        says = e[:, t + 1] if t + 1 < rows else np.concatenate([e[1:, 0], np.ones((1, k))])
        return np.where(after[:, None, None], 1 / k, move.T * says[:, :, None])

    total, entry = sweep(range(rows - 1, -1, -1), back), np.full((columns, k), 1 / k)
    for c in range(columns - 2, -1, -1):
        m = entry[c + 1] @ total[c + 1]
        entry[c] = m / m.sum()
    m = entry
    for t in range(rows - 1, -1, -1):
        m = np.einsum("ck,ckj->cj", m, back(t))
        m /= m.sum(axis=1, keepdims=True)
        alpha[t] *= m
    p = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
    return p / p.sum(axis=1, keepdims=True)


def train(rows: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], steps: int = 250, batch: int = 128, length: int = 48, rate: float = 0.15, seed: int = 11) -> Model:
    """Gradient ascent (Adagrad) on the conditional log-likelihood of code-switched sequences.

    Only texts as a whole carry a label. A training sequence is spliced from stretches of 4 to 48 words of different
    training texts, each labelled with its text's language, so that transitions between languages are seen and learned.
    """
    rng, k = np.random.default_rng(seed), len(labels)
    ids = [np.concatenate([r[0][f] for r in rows]) for f in range(5)]
    gram, size = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    gram_end = np.cumsum(size)
    words = np.cumsum([0, *(len(r[2]) for r in rows)])
    tables = [np.zeros((LEXICON, k), dtype=np.float32), *(np.zeros((AFFIX, k), dtype=np.float32) for _ in range(4)), np.zeros((GRAM, k), dtype=np.float32)]
    step, start = np.eye(k) * 2.0, np.zeros(k)
    seen = [np.full(t.shape, 1e-3, dtype=np.float32) for t in tables]
    seen_step, seen_start = np.full((k, k), 1e-3), np.full(k, 1e-3)
    by_label = [np.flatnonzero((y == c) & (np.diff(words) > 0)) for c in range(k)]
    usable = [c for c in range(k) if len(by_label[c])]
    for _ in range(steps if usable else 0):
        at, gold = np.empty((batch, length), dtype=np.int64), np.empty((batch, length), dtype=np.int64)
        for b in range(batch):
            t = 0
            while t < length:
                c = usable[rng.integers(len(usable))]
                d = by_label[c][rng.integers(len(by_label[c]))]
                have = words[d + 1] - words[d]
                want = min(int(rng.integers(4, 49)), length - t, have)
                begin = words[d] + rng.integers(have - want + 1)
                at[b, t : t + want], gold[b, t : t + want] = np.arange(begin, begin + want), c
                t += want
        flat, truth = at.ravel(), gold.ravel()
        take = size[flat]
        spread = np.repeat(gram_end[flat] - take, take) + np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
        g = gram[spread]
        model = Model(labels, tables[0], tables[1:5], tables[5], step, start)
        score = tables[0][ids[0][flat]].copy()
        for f in range(1, 5):
            score += tables[f][ids[f][flat]]
        score += np.add.reduceat(tables[5][g], np.cumsum(take) - take, axis=0) / take[:, None]
        e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64).reshape(batch, length, k) + 1e-9
        move, begin = np.exp(step - step.max()), np.exp(start - start.max())
        alpha, beta = np.empty((length, batch, k)), np.empty((length, batch, k))
        m = begin * e[:, 0]
        alpha[0] = m / m.sum(axis=1, keepdims=True)
        for t in range(1, length):
            m = (alpha[t - 1] @ move) * e[:, t]
            alpha[t] = m / m.sum(axis=1, keepdims=True)
        beta[-1] = 1 / k
        for t in range(length - 2, -1, -1):
            m = (beta[t + 1] * e[:, t + 1]) @ move.T
            beta[t] = m / m.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        says = beta[1:] * e.transpose(1, 0, 2)[1:]
        share = alpha[:-1] / ((alpha[:-1] @ move) * says).sum(axis=2, keepdims=True)
        pair = move * (share.reshape(-1, k).T @ says.reshape(-1, k))
        want_step, want_start = np.zeros((k, k)), np.bincount(gold[:, 0], minlength=k)
        np.add.at(want_step, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        error = (np.eye(k)[truth] - p.transpose(1, 0, 2).reshape(-1, k)).astype(np.float32)
        for table, memory, where, grad in [*((tables[f], seen[f], ids[f][flat], error) for f in range(5)), (tables[5], seen[5], g, np.repeat(error / take[:, None], take, axis=0))]:
            rows_, inverse = np.unique(where, return_inverse=True)
            total = np.stack([np.bincount(inverse, weights=grad[:, c], minlength=len(rows_)) for c in range(k)], axis=1).astype(np.float32) - 1e-3 * table[rows_]
            memory[rows_] += total * total
            table[rows_] += rate * total / np.sqrt(memory[rows_])
        for table, memory, total in ((step, seen_step, (want_step - pair) / batch), (start, seen_start, (want_start - p[0].sum(axis=0)) / batch)):
            memory += total * total
            table += rate * total / np.sqrt(memory)
    return Model(labels, tables[0], tables[1:5], tables[5], step, start)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model:
    """A model of all values of lang_col, from max_docs whole texts of each: those with the smallest hashes of their id and
    their text. What comes to the driver is bounded by rows and words a language; each partition sends so many of a
    language at most. A row counts by its id, language and text: null ids and rows that repeat an id are rows like
    others, equal rows are read once. Without rows the model has no language, and all is `und`."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labels = sorted(r[0] for r in known.select(lang_col).distinct().collect())
    if not labels:
        return Model([], np.zeros((LEXICON, 0)), [np.zeros((AFFIX, 0))] * 4, np.zeros((GRAM, 0)), np.zeros((0, 0)), np.zeros(0))
    rows_of = known.select(F.xxhash64(id_col, lang_col, text_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_t"), F.xxhash64(F.col(id_col), F.lit(3)).alias("_o"))
    ranked = rows_of.select("_id", "_lang", "_o").withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_o", "_id")))
    chosen = ranked.where(F.col("_n") <= max_docs).select(F.col("_id").alias("_chosen")).distinct()
    picked = rows_of.join(F.broadcast(chosen), F.col("_id") == F.col("_chosen"), "left_semi").groupBy("_id").agg(F.min(F.struct("_o", "_lang", "_t")).alias("_r")).select("_id", "_r._o", "_r._lang", "_r._t")

    def make():
        def rows(data, offsets, texts):
            words = words_of(data, offsets, accents=True)
            bounds = pa.array(words.bounds, type=pa.int32())
            lexicon = (words.hashes() % np.uint64(LEXICON)).astype(np.int32)
            ids, first = grams(words)
            ends = np.concatenate([first, [len(ids)]])
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (lexicon, *affixes(words))]
            return [*lists, pa.ListArray.from_arrays(pa.array(ends[words.bounds], type=pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(bounds, pa.array((words.end - words.start).astype(np.int32)))]

        return rows

    fields = ", ".join(f"{c} array<int>" for c in ("f0", "f1", "f2", "f3", "f4", "gram", "size"))
    read = staged(map_texts(picked, "_t", fields, make, ["_id", "_o", "_lang"]).select("_row._id", "_row._o", "_row._lang", "f0", "f1", "f2", "f3", "f4", "gram", "size"), "language-train")
    got = within(read, read.select("_id", F.col("_lang").alias("_g"), "_o", F.size("f0").alias("_n")), max_words).toArrow()
    got = got.sort_by([("_o", "ascending"), ("_id", "ascending")])
    column = lambda c: [np.asarray(x.values) for x in got[c]]
    features = list(zip(*(column(f"f{i}") for i in range(5)), strict=True))
    rows = [(list(f), g, s) for f, g, s in zip(features, column("gram"), column("size"), strict=True)]
    place = {x: i for i, x in enumerate(labels)}
    y = np.array([place.get(x, -1) for x in got["_lang"].to_pylist()])
    return train([r for r, c in zip(rows, y, strict=True) if c >= 0], y[y >= 0], labels)


def tag_words(model: Model, words: Words) -> np.ndarray:
    """Each word's label probabilities, by forward-backward over its text."""
    first = np.zeros(len(words.start), dtype=bool)
    first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
    return forward_backward(model, emissions(model, words), first)


def identify(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None, spans: bool = False) -> DataFrame:
    """_row (a struct of `columns` of each row, all by default), lang_pred and score for each row, and with `spans` the
    runs of words of one language, array<struct<lang, first_word, last_word>>.

    lang_pred is the label with the largest share of the text's words, their probabilities summed; score is that share.
    A null text, or one without a letter, is `und` with score 0; letters without a word cannot be. Rows that repeat are
    rows of their own; an empty table gives no rows; the struct keeps columns of any name. One pass over the
    rows in their partitions: no shuffle, memory bounded by a slice of an Arrow batch.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def rows(data, offsets, texts):
            words = words_of(data, offsets, accents=True)
            docs, k = len(offsets) - 1, len(model.labels)
            p = tag_words(model, words) if k else np.zeros((len(words.start), 0))
            total = np.stack([np.bincount(words.doc, weights=p[:, c], minlength=docs) for c in range(k)], axis=1) if k else np.zeros((docs, 1))
            best, n = total.argmax(axis=1), np.maximum(1, np.diff(words.bounds))
            ascii_letter = np.concatenate([[0], np.cumsum((words.data >= 97) & (words.data <= 122))])
            has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for i in np.flatnonzero(~has & (np.diff(words.bounds) > 0)):
                has[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
            has &= bool(k)
            lang = pa.array([model.labels[b] if h else "und" for b, h in zip(best, has, strict=True)], type=pa.string())
            share = np.clip(total[np.arange(docs), best] / n, 0, 1)
            out = [lang, pa.array(np.where(has, share, 0.0))]
            if spans:
                tag = p.argmax(axis=1) if k else np.zeros(0, dtype=np.int64)
                new = np.ones(len(tag), dtype=bool)
                new[1:] = (tag[1:] != tag[:-1]) | (words.doc[1:] != words.doc[:-1])
                a = np.flatnonzero(new)
                b = np.concatenate([a[1:], [len(tag)]]) - 1 if len(a) else a
                base = words.bounds[words.doc[a]]
                runs = pa.StructArray.from_arrays([pa.array([model.labels[tag[i]] for i in a], type=pa.string()), pa.array(a - base, type=pa.int64()), pa.array(b - base, type=pa.int64())], names=["lang", "first_word", "last_word"])
                out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(words.doc[a], np.arange(docs + 1)), type=pa.int32()), runs))
            return out

        return rows

    fields = "lang_pred string, score double" + (", spans array<struct<lang:string,first_word:long,last_word:long>>" if spans else "")
    return map_texts(docs, text_col, fields, make, columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents; learns from rows that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    found = identify(docs, model, columns=["doc_id"])
    return found.select("_row.doc_id", held_out("_row.doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
