"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for the benchmark's windows of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflux.llm.arrowmap import packed
from folioflux.llm.fm_index import FMIndex
from folioflux.llm.wordarrays import hash_ranges, slices, words_of
from folioflux.sources.tables import load

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Bytes of benchmark text compiled and broadcast at a time; more items are searched for in further passes.
BENCHMARK_BYTES = 8_000_000
#: A shard is closed at so many symbols, or so many bytes of documents that wait for it.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 18, 12_000_000
#: Symbols of one index; those of a larger shard, as of one very long text, go into several that overlap.
INDEX_SYMBOLS = 1 << 19

FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<first_word:long,last_word:long,start:long,end:long>>"


@dataclass
class Phrases:
    """The windows of a set of items: their words' hashes, in order, and per window its symbols and its items."""

    first: np.ndarray  # 64-bit hashes of the vocabulary, sorted
    second: np.ndarray  # an independent hash of each
    maybe: np.ndarray  # by the low 16 bits of the first hash: may be in the vocabulary
    patterns: np.ndarray  # right-aligned symbols, one window a row
    sizes: np.ndarray
    item_bounds: np.ndarray  # window i has the items item_of[item_bounds[i]:item_bounds[i + 1]]
    item_of: np.ndarray
    names: list[str | None]
    shortest: int

    def symbols(self, words) -> np.ndarray:
        """2 up for words of the vocabulary, 0 for others; both hashes must agree."""
        h = words.hashes()
        found = np.zeros(len(h), dtype=np.int32)
        near = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.first, h[near]), len(self.first) - 1)
        same = self.first[at] == h[near]
        near, at = near[same], at[same]
        found[near] = at + 2
        return found


def compile_phrases(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases | None:
    """Windows of (item id, text) pairs; None if no item has a word. An item without id names nothing."""
    texts = pa.array([t.encode() for _, t in items], type=pa.large_binary())
    per_item: list[np.ndarray] = []
    seconds = []
    for _, _, data, offsets in slices(texts):
        words = words_of(data, offsets)
        h = words.hashes()
        seconds.append((h, words.hashes(1)))
        per_item += [h[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    if not per_item or not sum(map(len, per_item)):
        return None
    first, where = np.unique(np.concatenate([h for h, _ in seconds]), return_index=True)
    second = np.concatenate([s for _, s in seconds])[where]
    rows, owners = [], []
    for k, h in enumerate(per_item):
        ids = (np.searchsorted(first, h) + 2).astype(np.int32)
        if len(ids) >= window:
            cut = np.lib.stride_tricks.sliding_window_view(ids, window)
        elif len(ids):
            cut = np.concatenate([np.zeros(window - len(ids), dtype=np.int32), ids])[None]
        else:
            continue
        rows.append(cut)
        owners.append(np.full(len(cut), k))
    patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([of.ravel(), np.concatenate(owners)], axis=1), axis=0)
    pairs = pairs[np.array([n is not None for n, _ in items])[pairs[:, 1]]]
    sizes = (patterns > 0).sum(axis=1)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(first & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Phrases(first, second, maybe, patterns, sizes, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1], [n for n, _ in items], int(sizes.min()))


class Shard:
    """Documents whose runs of benchmark words go into one index.

    An occurrence of a window lies within a run of words that are all in the benchmark's vocabulary and that is at least
    as long as the shortest window. Other words can be in no occurrence, so the index holds these runs alone, each
    closed by a symbol that no window has; nothing else is left out.
    """

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.parts, self.size, self.n_words = phrases, 0, [], 0, []

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words = words_of(data, offsets)
        self.n_words.append(np.diff(words.bounds))
        symbol = self.phrases.symbols(words) if self.phrases else np.zeros(0, dtype=np.int32)
        if len(symbol):
            new = np.ones(len(symbol), dtype=bool)
            new[1:] = ((symbol[1:] > 0) != (symbol[:-1] > 0)) | (words.doc[1:] != words.doc[:-1])
            run = np.cumsum(new) - 1
            kept = np.flatnonzero((symbol > 0) & (np.bincount(run)[run] >= self.phrases.shortest))
            # the second hash only for what is kept: a word that differs in it closes its run
            if len(kept):
                self._append(words, symbol, run, kept, data, offsets)
        self.docs += len(offsets) - 1

    def _append(self, words, symbol, run, kept, data, offsets) -> None:
        other = hash_ranges(words.data, words.start[kept], words.end[kept], 1) != self.phrases.second[symbol[kept] - 2]
        chars = np.cumsum((data & 0xC0) != 0x80)
        at = lambda byte: np.where(byte > 0, chars[byte - 1], 0)  # noqa: E731  code points before a byte
        doc = words.doc[kept]
        base = at(offsets[doc])
        closes = np.concatenate([run[kept][1:] != run[kept][:-1], [True]])
        place = np.arange(len(kept)) + np.cumsum(closes) - closes
        total = len(kept) + int(closes.sum())
        made = {"symbol": np.ones(total, dtype=np.int64)} | {k: np.full(total, -1, dtype=np.int64) for k in ("doc", "word", "start", "end")}
        made["symbol"][place] = np.where(other, 1, symbol[kept])
        made["doc"][place] = doc + self.docs
        made["word"][place] = kept - words.bounds[doc]
        made["start"][place] = at(words.start[kept]) - base
        made["end"][place] = at(words.end[kept]) - base
        self.parts.append(made)
        self.size += total

    def results(self) -> list[pa.Array]:
        """n_words, n_hit, items and spans of the shard's documents."""
        p, docs = self.phrases, self.docs
        hit, spans, pairs = np.zeros(docs, dtype=np.int64), None, np.zeros((0, 2), dtype=np.int64)
        if self.parts:
            text = {k: np.concatenate([x[k] for x in self.parts]) for k in self.parts[0]}
            places, windows = [], []
            # a window that begins in the last symbols of an index lies whole in the next one; found twice counts once
            for begin in range(0, len(text["symbol"]), INDEX_SYMBOLS):
                index = FMIndex(text["symbol"][begin : begin + INDEX_SYMBOLS + p.patterns.shape[1] - 1], len(p.first) + 1)
                low, high = index.search(p.patterns, p.sizes)
                count = high - low
                windows.append(np.repeat(np.arange(len(count)), count))
                rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                places.append(index.locate(rows) + begin)
            place, window = np.concatenate(places), np.concatenate(windows)
            cover = np.zeros(len(text["symbol"]) + 1, dtype=np.int64)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + p.sizes[window], -1)
            covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            hit = np.bincount(text["doc"][covered], minlength=docs)
            if len(covered):
                new = np.concatenate([[True], (np.diff(covered) > 1) | (np.diff(text["doc"][covered]) != 0)])
                first, last = covered[new], covered[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(covered) - 1]])]
                spans = (text["doc"][first], text["word"][first], text["word"][last], text["start"][first], text["end"][last])
            # each window once a document, before the items that share it
            met = np.unique(np.stack([text["doc"][place], window], axis=1), axis=0)
            n = np.diff(p.item_bounds)[met[:, 1]]
            item = p.item_of[np.repeat(p.item_bounds[met[:, 1]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            pairs = np.unique(np.stack([np.repeat(met[:, 0], n), item], axis=1), axis=0)
        bounds = lambda of: pa.array(np.searchsorted(of, np.arange(docs + 1)), type=pa.int32())
        names = pa.array([p.names[k] for k in pairs[:, 1]], type=pa.string())
        if spans is None:
            spans = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        fields = pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in spans[1:]], names=["first_word", "last_word", "start", "end"])
        return [
            pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *self.n_words]), type=pa.int64()),
            pa.array(hit, type=pa.int64()),
            pa.ListArray.from_arrays(bounds(pairs[:, 0]), names),
            pa.ListArray.from_arrays(bounds(spans[0]), fields),
        ]


def search(docs: DataFrame, phrases: Phrases | None, text: str, columns: list[str] | None = None) -> DataFrame:
    """_row and FIELDS for each row of `docs`, searched for one set of phrases. `text` is a column, or row.name where the
    text is a field of the column row: texts are then sent once."""
    whole, _, inner = text.partition(".")
    rows, text_in = packed(docs, whole, columns)
    schema = rows.select("_row").schema
    for field in StructType.fromDDL(FIELDS).fields:
        schema = schema.add(field)
    names = schema.names
    held = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, size = Shard(held.value), [], 0

        def close():
            found, done = shard.results(), 0
            for row in waiting:
                yield pa.RecordBatch.from_arrays([row, *(f.slice(done, len(row)) for f in found)], names=names)
                done += len(row)

        for batch in batches:
            texts = text_in(batch).field(inner) if inner else text_in(batch)
            for at, to, data, offsets in slices(texts):
                shard.add(data, offsets)
                waiting.append(batch.column(0).slice(at, to - at))
                size += len(data)
                if shard.size >= SHARD_SYMBOLS or size >= SHARD_BYTES:
                    yield from close()
                    shard, waiting, size = Shard(held.value), [], 0
        if waiting:
            yield from close()

    return rows.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", columns: list[str] | None = None, window: int = WINDOW, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """_row (a struct of `columns` of each row, all by default), n_words, n_hit, items and spans for each row of `docs`.

    Words are `[0-9a-z]` and everything outside ASCII, after A-Z are lower-cased. A window is `window` consecutive words
    of a benchmark item; an item of fewer words, but not none, is one window. spans are the merged ranges to remove:
    first and last word, and code points from start to end (exclusive). items are the ids, as text and sorted, of items
    with a window that occurs.

    Each task cuts its documents into shards, builds an FM-index of each and searches it backward for all windows at
    once: no shuffle, no key that could be hot, memory bounded by the shard, or by the longest text, whose index is cut. The benchmark is compiled on the driver and
    broadcast; its bytes are summed first, and a larger one than `benchmark_bytes` is searched for in several passes of
    about so many bytes each, chained over the same rows. Words are compared by two independent 64-bit hashes.

    Null and empty texts have no words, and so no hits; null items too; windows of an item with a null id hit like
    others and name no item. Items that repeat an id count as one. An empty table on either side gives no hits. Rows with null or
    repeated ids are rows of their own.
    """
    known = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // benchmark_bytes))
    part = known.withColumn("part", F.expr(f"pmod(xxhash64(item, text), {passes})"))
    names = columns or docs.columns
    inside = text_col in names and "." not in text_col
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *([] if inside else [F.col(f"`{text_col}`").alias("t")]))
    for k in range(passes):
        items = part.where(F.col("part") == k).select("item", "text").collect()
        carried = [c for c in state.columns if c != "t" or k < passes - 1]
        found = search(state, compile_phrases(sorted(((r.item, r.text) for r in items), key=lambda x: (x[0] or "", x[1])), window), f"row.{text_col}" if inside else "t", carried)
        state = _merged(found, carried) if k else found.select(*[f"_row.{c}" for c in carried], "n_words", "n_hit", "items", "spans")
    return state.select(F.col("row").alias("_row"), "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), "spans")


def _merged(found: DataFrame, carried: list[str]) -> DataFrame:
    """Two passes over the same rows as one: spans that overlap or touch become one, hits are counted anew."""
    both = F.array_sort(F.concat(F.col("_row.spans"), F.col("spans")))

    def join(seen, x):
        last = F.try_element_at(seen, F.lit(-1))
        wider = F.struct(last["first_word"].alias("first_word"), F.greatest(last["last_word"], x["last_word"]).alias("last_word"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        meets = F.coalesce(x["first_word"] <= last["last_word"] + 1, F.lit(False))
        return F.when(meets, F.concat(F.slice(seen, 1, F.size(seen) - 1), F.array(wider))).otherwise(F.concat(seen, F.array(x)))

    spans = F.aggregate(both, F.expr("cast(array() as array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>>)"), join)
    rest = [f"_row.{c}" for c in carried if c in ("row", "t")]
    merged = found.select(*rest, "n_words", F.concat("_row.items", "items").alias("items"), spans.alias("spans"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last_word"] - x["first_word"] + 1)
    return merged.withColumn("n_hit", hits)


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without its spans."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    starts = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text).cast("long")))
    return F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), "")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of documents."""
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
v AS (SELECT DISTINCT item, least({WINDOW}, len(ws)) AS n, array_to_string(ws[p:p + least({WINDOW}, len(ws)) - 1], ' ') AS k
      FROM i, unnest(generate_series(1, greatest(len(ws) - {WINDOW - 1}, 1))) t(p) WHERE len(ws) > 0),
s AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, p, s.n, array_to_string(ws[p:p + s.n - 1], ' ') AS k FROM d, s, unnest(generate_series(1, len(ws) - s.n + 1)) t(p) WHERE len(ws) >= s.n),
h AS (SELECT doc_id, p, g.n, item FROM g JOIN v ON g.k = v.k AND g.n = v.n),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(generate_series(p, p + n - 1)) u(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
