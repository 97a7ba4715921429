"""Alignment of two tokenizers over a corpus: groups of tokens between common byte ends, interned in a group dictionary.

A text is tokenized by units, a space and the word after it, which a task meets again and again: neither tokenizer joins
tokens across a single space between characters that are no spaces, so a unit has the tokens it has in the whole text.
test_token_alignment.py holds this against whole texts.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflux.llm.common import staged
from folioflux.llm.wordarrays import slices
from folioflux.sources.tables import load

#: Where the vocabulary files are, and their names: A is a byte-level BPE of the library tokenizers, B of sentencepiece.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How A cuts a text into words before it merges bytes, as its kind (byte-level) does (fixed value).
WORDS_OF_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters up to which a unit is merged by the faster of two libraries, whose time grows with a word's square.
SHORT = 200
#: ASCII bytes that are white space, and first bytes of characters among which such are (U+0085, A0, 1680, 2000 on, 3000).
BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Units whose tokens a task remembers, and pairs and groups that it counts before it hands the counts on.
MAX_UNITS, MAX_PAIRS = 300_000, 400_000
#: Bytes of text, and distinct groups of rows, worked on at a time.
SLICE_BYTES, SLICE_GROUPS = 2_000_000, 500_000
#: Groups that are looked up in a broadcast table: the most frequent ones, so many at most and none longer than this.
FREQUENT, FREQUENT_CHARS = 1 << 16, 64


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<string>, times array<long>"


@dataclass(frozen=True)
class Files:
    """The two vocabulary files' bytes: read on the driver, so that executors need no path. They don't grow with the data."""

    a: bytes
    b: bytes

    @classmethod
    def read(cls, folder: str = FOLDER, a: str = FILE_A, b: str = FILE_B) -> Files:
        return cls(Path(folder, a).read_bytes(), Path(folder, b).read_bytes())


def byte_level() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes in
    order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=files.b)
        table = byte_level()
        self.a_bytes = [bytes(table.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        special = set(self.a.get_added_tokens_decoder())
        # the same merges in the order of their ids, for short words: test_token_alignment.py holds both against each other
        self.short = tiktoken.Encoding("a", pat_str=WORDS_OF_A, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.sizes = [np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes)]

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of texts that begin with a space, which B adds itself."""
        a = [self.short.encode_ordinary(t) if len(t) <= SHORT else self.a.encode(t, add_special_tokens=False).ids for t in texts]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)


def written(a, b) -> str:
    """A group's key: decimal ids of A and of B in order."""
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def expanded(key: str) -> list[tuple[int, int, int]]:
    """The links of a group as (A id, B id, how many pairs of occurrences)."""
    a, b = (Counter(map(int, side.split(","))) for side in key.split("|"))
    return [(x, y, n * m) for x, n in a.items() for y, m in b.items()]


def unit_bounds(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in texts that stand end to end in `data`, each with a space first, at `starts`.

    A unit begins with a text, and at each single space between characters that are no spaces. Characters whose bytes
    could be those of a space outside ASCII count as such: that only makes a unit longer."""
    space = np.flatnonzero(data == 32)
    first = np.isin(space, starts, assume_unique=True)
    space = space[~first]
    before, after = data[space - 1], np.concatenate([data, [32]])[space + 1]
    cut = ~BLANK[before] & ~BLANK[after] & ~WIDE[after]
    for back in (2, 3):
        cut &= ~WIDE[data[np.maximum(space - back, 0)]]
    return np.sort(np.concatenate([starts, space[cut]]))


class Units:
    """A task's dictionaries: of units, with their tokens and groups, and of the distinct groups in them."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {}
        self.groups: dict[str, int] = {}
        self.counts = np.zeros((0, 4), dtype=np.int64)  # of a unit: A, B, groups, links; A is -1 where bytes differ
        self.members = np.zeros(0, dtype=np.int64)  # the units' groups, one unit after the other
        self.keys = pa.array([], type=pa.large_string())

    def _intern(self, found: list[str]) -> np.ndarray:
        return np.array([self.groups.setdefault(k, len(self.groups)) for k in found], dtype=np.int64)

    def _numbers(self, a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The number of each group, group i being a[ends[0][i - 1]:ends[0][i]] with b likewise. Groups of a shape are made
        distinct together before their keys are written."""
        to = ends
        size = [np.diff(e, prepend=0) for e in to]
        out = np.empty(len(to[0]), dtype=np.int64)
        shape = size[0] * 64 + np.minimum(size[1], 63)
        for one in np.unique(shape):
            at = np.flatnonzero(shape == one)
            n, m = int(size[0][at[0]]), int(size[1][at[0]])
            if n + m > 12:
                out[at] = self._intern([written(a[to[0][i] - size[0][i] : to[0][i]], b[to[1][i] - size[1][i] : to[1][i]]) for i in at])
                continue
            rows = np.concatenate([a[to[0][at, None] - n + np.arange(n)], b[to[1][at, None] - m + np.arange(m)]], axis=1)
            if n == m == 1:
                code, inverse = np.unique(rows[:, 0] << 32 | rows[:, 1], return_inverse=True)
                distinct = np.stack([code >> 32, code & 0xFFFFFFFF], axis=1)
            else:
                distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
            out[at] = self._intern([written(r[:n], r[n:]) for r in distinct.tolist()])[inverse.ravel()]
        return out

    def add(self, new: list[bytes]) -> None:
        """Tokens and groups of units that are met for the first time; all their tokens are cut together."""
        lists = self.encoders.ids([x.decode() for x in new])
        names = (self.encoders.a_bytes, self.encoders.b_bytes)
        flat = [list(chain.from_iterable(x)) for x in lists]
        fine = np.ones(len(new), dtype=bool)
        if any(b"".join([of[i] for i in x]) != b"".join(new) for of, x in zip(names, flat, strict=True)):
            fine = np.array([all(b"".join([of[i] for i in x[k]]) == unit for of, x in zip(names, lists, strict=True)) for k, unit in enumerate(new)])
            flat = [list(chain.from_iterable(y for y, f in zip(x, fine, strict=True) if f)) for x in lists]
        ids = [np.array(x, dtype=np.int64) for x in flat]
        ends = [np.cumsum(size[x]) for size, x in zip(self.encoders.sizes, ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        to = tuple(np.searchsorted(e, common) + 1 for e in ends)
        group = self._numbers(*ids, to)
        good = np.flatnonzero(fine)
        unit = good[np.searchsorted(np.cumsum([len(new[k]) for k in good]), common)] if len(good) else good
        sizes = [np.diff(x, prepend=0) for x in to]
        counts = np.zeros((len(new), 4), dtype=np.int64)
        for k, value in enumerate((*sizes, np.ones(len(common), dtype=np.int64), sizes[0] * sizes[1])):
            np.add.at(counts[:, k], unit, value)
        counts[~fine, 0] = -1
        self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
        self.counts = np.concatenate([self.counts, counts])
        self.members = np.concatenate([self.members, group])
        self.keys = pa.array(list(self.groups), type=pa.large_string())  # in the order of their numbers

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, and the distinct groups of each text with how often they stand in it."""
        n = len(offsets) - 1
        use = np.flatnonzero(readable(data, offsets))
        totals, shas = np.zeros((n, 4), dtype=np.int64), np.full(n, "", dtype=object)
        group = row = np.zeros(0, dtype=np.int64)
        if len(use):
            parts = [bytes(data[offsets[i] : offsets[i + 1]]) for i in use]
            spaced = np.frombuffer(b" " + b" ".join(parts), dtype=np.uint8)
            starts = np.cumsum([0, *(len(x) + 1 for x in parts)])[:-1]
            at = unit_bounds(spaced, starts)
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(spaced)).astype(np.int64)), pa.py_buffer(spaced)]).dictionary_encode()
            names = found.dictionary.to_pylist()
            if len(self.of) > MAX_UNITS:
                self.clear()
            new = [x for x in names if x not in self.of]
            if new:
                self.add(new)
            unit = np.array([self.of[x] for x in names], dtype=np.int64)[found.indices.to_numpy()]
            bounds = np.searchsorted(at, starts)
            fine = np.minimum.reduceat(self.counts[unit, 0], bounds) >= 0
            totals[use[fine]] = np.add.reduceat(self.counts[unit], bounds, axis=0)[fine]
            own = np.repeat(np.arange(len(use)), np.diff(np.append(bounds, len(unit))))
            unit, own = unit[fine[own]], own[fine[own]]
            size = self.counts[unit, 2]
            first = np.cumsum(self.counts[:, 2]) - self.counts[:, 2]
            group = self.members[np.repeat(first[unit], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
            row = use[np.repeat(own, size)]
            ends = pa.array(np.append(np.searchsorted(row, use[fine]), len(row)), type=pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, self.keys.take(pa.array(group))), pa.scalar(";", type=pa.large_string()))
            shas[use[fine]] = [sha256(x.encode()).hexdigest() for x in joined.to_pylist()]
        code, times = np.unique(row * max(1, len(self.groups)) + group, return_counts=True)
        row, group = np.divmod(code, max(1, len(self.groups)))
        ends = pa.array(np.searchsorted(row, np.arange(n + 1)), type=pa.int32())
        keys = self.keys.take(pa.array(group)).cast(pa.string())
        return [*(pa.array(totals[:, k]) for k in range(4)), pa.array(shas, type=pa.string()), pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, pa.array(times, type=pa.int64()))]


def readable(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts aren't empty and are UTF-8: tokens can't give back other bytes."""
    full = np.diff(offsets) > 0
    begins = offsets[:-1][full]
    try:
        data.tobytes().decode()
        if not ((data[begins] & 0xC0) == 0x80).any():
            return full
    except UnicodeDecodeError:
        pass
    for i in np.flatnonzero(full):
        try:
            data[offsets[i] : offsets[i + 1]].tobytes().decode()
        except UnicodeDecodeError:
            full[i] = False
    return full


def tokenized(docs: DataFrame, files: Files, text_col: str, columns: list[str]) -> DataFrame:
    """_row (the columns), _rid and what Units.rows gives for each row. Rows stay in their partition; a task keeps bounded
    dictionaries and one slice of texts, or one longer text."""
    held = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.monotonically_increasing_id().alias("_rid"), F.col(f"`{text_col}`").cast("binary").alias("_t"))
    schema = rows.drop("_t").schema
    for field in StructType.fromDDL(FIELDS).fields:
        schema = schema.add(field)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = None
        for batch in batches:
            units = units or Units(Encoders(held.value))
            for at, to, data, offsets in slices(batch.column(2), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, to - at) for k in (0, 1)), *units.rows(data, offsets)], names=names)

    return rows.mapInArrow(run, schema)


def document_counts(tokens: DataFrame) -> DataFrame:
    """(a, b, n): in how many rows of `tokens` ids a of A and b of B stand linked.

    A task interns the groups it meets and expands each into its pairs once; a row's pairs are the union of those of its
    distinct groups, so that a pair in several of its groups counts once. Counts are handed on whenever the dictionary is
    full, and added up by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, pairs, sizes, flat, counts = {}, {}, [], [], np.zeros(0, dtype=np.int64)

        def flush():
            ids, n = np.array(list(pairs), dtype=np.int64), counts[: len(pairs)]
            return pa.RecordBatch.from_arrays([pa.array((ids[n > 0] >> 32).astype(np.int32)), pa.array((ids[n > 0] & 0xFFFFFFFF).astype(np.int32)), pa.array(n[n > 0])], names=["a", "b", "n"])

        for batch in batches:
            lists = batch.column(0)
            keys = lists.flatten().dictionary_encode()
            if not len(keys):
                continue
            for key in keys.dictionary.to_pylist():
                if key not in groups:
                    groups[key] = len(groups)
                    links = [pairs.setdefault(x << 32 | y, len(pairs)) for x, y, _ in expanded(key)]
                    flat.extend(links)
                    sizes.append(len(links))
            number = np.array([groups[k] for k in keys.dictionary.to_pylist()], dtype=np.int64)[keys.indices.to_numpy()]
            size, member = np.array(sizes, dtype=np.int64), np.array(flat, dtype=np.int64)
            first = np.cumsum(size) - size
            counts = np.concatenate([counts, np.zeros(len(pairs) - len(counts), dtype=np.int64)])
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            at = 0
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_GROUPS, side="right")) - 1)
                own = number[ends[at] : ends[to]]
                n = size[own]
                row = np.repeat(np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])), n)
                met = member[np.repeat(first[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                counts += np.bincount(np.unique(row * len(pairs) + met) % len(pairs), minlength=len(pairs))
                at = to
            if len(pairs) > MAX_PAIRS or len(groups) > MAX_PAIRS:
                yield flush()
                groups, pairs, sizes, flat, counts = {}, {}, [], [], np.zeros(0, dtype=np.int64)
        if pairs:
            yield flush()

    return tokens.select("groups").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass
class Alignment:
    """documents: _row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. pairs: a, b, n, best. groups: g, n
    (documents with it), best and total (its links that are best, and the sum of all its links' counts)."""

    documents: DataFrame
    pairs: DataFrame
    groups: DataFrame


def group_links(groups: DataFrame) -> DataFrame:
    """(gid, a, b, w): each distinct group's links once, w pairs of occurrences each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = [(gid, *link) for gid, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for link in expanded(key)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["gid", "a", "b", "w"])

    return groups.select("gid", "g").mapInArrow(run, "gid long, a int, b int, w long")


def align(docs: DataFrame, files: Files | None = None, text_col: str = "text", columns: list[str] | None = None) -> Alignment:
    """Groups, links and link counts of every row's whole text under the two tokenizers of `files`.

    Texts are tokenized once: what is staged for a row is its distinct groups and how often each stands in it. Pairs are
    counted by document from those, then each distinct group of the corpus is expanded once and joined with the pairs'
    counts; what a group's links come to is multiplied by its times and summed by row. The groups of most documents (so
    many at most, short ones) are looked up in a broadcast table, so that no hot group is shuffled; all others are joined.

    Null and empty texts, and texts whose tokens' bytes aren't theirs (U+2581, broken UTF-8), have no tokens: zeros and ''.
    Rows with null or repeated ids are rows, and documents, of their own. An empty table gives no rows and no pairs.
    """
    tokens = staged(tokenized(docs, files or Files.read(), text_col, docs.columns if columns is None else columns), "alignment-tokens")
    counted = document_counts(tokens).withColumn("_most", F.expr("max(n) OVER (PARTITION BY a)"))
    pairs = staged(counted.select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best")), "alignment-pairs")
    distinct = tokens.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    groups = staged(distinct.select(F.monotonically_increasing_id().alias("gid"), "g", "n"), "alignment-groups")
    links = group_links(groups).join(pairs, ["a", "b"])
    values = links.groupBy("gid").agg(F.sum(F.when(F.col("best"), F.col("w")).otherwise(0)).alias("best"), F.sum(F.col("w") * F.col("n")).alias("total"))
    valued = staged(groups.join(values, "gid").select("g", "n", "best", "total"), "alignment-values")

    power = F.floor(F.log2("n")).cast("int")
    sizes = {r.p: r.c for r in valued.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()}  # at most 64 rows
    least, room = 64, FREQUENT
    while least and sizes.get(least - 1, 0) <= room:
        least, room = least - 1, room - sizes.get(least - 1, 0)
    often = (power >= least) & (F.length("g") <= FREQUENT_CHARS)
    found = ["g", "best", "total"]
    frequent = F.broadcast(valued.where(often).select(*found))
    each = tokens.select("_rid", F.explode(F.arrays_zip("groups", "times")).alias("x")).select("_rid", F.col("x.groups").alias("g"), F.col("x.times").alias("times"))
    summed = lambda met: met.groupBy("_rid").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("total") * F.col("times")).alias("count_sum"))
    parts = summed(each.join(frequent, "g")).unionByName(summed(each.join(frequent.select("g"), "g", "left_anti").join(valued.where(~often).select(*found), "g")))
    sums = parts.groupBy("_rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = tokens.drop("groups", "times").join(sums, "_rid", "left").fillna(0, ["n_best", "count_sum"])
    return Alignment(out.select("_row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs, valued)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of documents."""
    found = align(load(spark, sf_dir, "documents"), columns=["doc_id"]).documents
    return found.select("_row.doc_id", *[c for c in found.columns if c != "_row"])
