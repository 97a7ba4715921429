import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflux.llm import decontamination as d
from folioflux.llm.fm_index import FMIndex
from folioflux.llm.wordarrays import hash_ranges, words_of
from folioflux.sources.tables import load

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text, items):
    """n_words, n_hit and the items, by looking at every window at every place."""
    doc = words(text)
    hit, found = set(), set()
    for name, item in items:
        w = words(item)
        for size in [10] if len(w) >= 10 else [len(w)] if w else []:
            for i in range(len(w) - size + 1):
                for p in range(len(doc) - size + 1):
                    if doc[p : p + size] == w[i : i + size]:
                        hit |= set(range(p, p + size))
                        if name is not None:
                            found.add(str(name))
    return len(doc), len(hit), sorted(found)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away home"), (2, "short one"), (10, "É ñandú été"), (3, None), (4, ""), (5, "..."), (None, "short one"), (None, "nobody knows whose words these are"), (2, "other words entirely here"), (7, "a a a a a a a a a a a")]
DOCS = [
    None,
    "",
    "nothing",
    "x short, one! y SHORT ONE short one",
    "É ñandú été! é ñandú été",
    "the quick brown fox jumps over the lazy dog and runs away home the quick brown fox jumps over the lazy dog and runs away home",
    "quick brown fox jumps over the lazy dog and runs",
    "brown fox jumps over the lazy dog and runs away now",
    "a " * 40,
    "short\x00one 🎉 short one",
    "z" * 100_000 + " short one",
    "I say nobody knows whose words these are now",
]


def check(rows, items):
    for r in rows:
        n, hit, names = expected(r.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names), r.text[:80]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(DOCS)] + [(None, DOCS[5], None, 1), (3, DOCS[3], "twice", 2)], "doc_id long, text string, spans string, n_hit long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (d.BENCHMARK_BYTES, 40):
        rows = d.contamination(docs, items, benchmark_bytes=limit).select("_row.text", "n_words", "n_hit", "items", "spans").collect()
        assert len(rows) == len(DOCS) + 2
        check(rows, ITEMS)
    found = d.contamination(docs, items)
    cut = {r.doc_id: r.t for r in found.select("_row.doc_id", d.cut_spans(found["_row.text"], found["spans"]).alias("t")).collect()}
    assert cut[3] == "x ! y " and cut[2] == "nothing" and cut[4] == "! é ñandú été"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "short one")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contamination(docs.limit(0), items).count() == 0
    r = d.contamination(docs, items.limit(0)).first()
    assert (r.n_words, r.n_hit, r["items"], r.spans) == (2, 0, [], [])


def test_query_on_the_table(spark, sf_dir):
    items = [(r.item_id, r.text) for r in load(spark, sf_dir, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    rows = d.op4_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    windows = {}
    for name, item in items:
        w = words(item)
        size = min(10, len(w))
        for i in range(len(w) - size + 1):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    for r in rows:
        doc, hit, found = words(texts[r.doc_id]), set(), set()
        for p in range(len(doc)):
            for size in {len(w) for w in windows}:
                if names := windows.get(tuple(doc[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= names
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(doc), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert any(r.contaminated for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index(symbols, patterns):
    index = FMIndex(np.array(symbols, dtype=np.int64), 4)
    matrix = np.array([[0] * (4 - len(p)) + p for p in patterns])
    low, high = index.search(matrix, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        places = sorted(index.locate(np.arange(a, b)).tolist())
        assert places == [i for i in range(len(symbols) - len(p) + 1) if symbols[i : i + len(p)] == p]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9é .\x00É", max_size=12), min_size=1, max_size=6))
def test_words(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    got = words_of(data, np.cumsum([0, *map(len, raw)]))
    split = [words(t) for t in texts]
    assert [bytes(got.data[a:b]).decode() for a, b in zip(got.start, got.end, strict=True)] == sum(split, [])
    assert np.diff(got.bounds).tolist() == [len(x) for x in split]
    h = hash_ranges(got.data, got.start, got.end)
    assert len(set(h.tolist())) == len(set(sum(split, [])))


def test_long_texts_are_cut_into_overlapping_indexes(monkeypatch):
    rng = np.random.default_rng(11)
    items = [(str(k), " ".join(f"w{x}" for x in rng.integers(0, 3, n))) for k, n in enumerate((3, 10, 11, 14))]
    phrases = d.compile_phrases(items, 5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, n)).encode() for n in (0, 1, 2000, 30, 700)]

    def found(symbols):
        monkeypatch.setattr(d, "INDEX_SYMBOLS", symbols)
        shard = d.Shard(phrases)
        shard.add(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))
        return [x.to_pylist() for x in shard.results()]

    whole = found(1 << 19)
    assert sum(whole[1]) > 50 and all(found(n) == whole for n in (1, 7, 64, 500))


def test_a_text_of_more_symbols_than_one_index_can_have():
    items = [("x", "a b c d e f g h i j")]
    shard = d.Shard(d.compile_phrases(items))
    text = ("a b c a " * 550_000 + items[0][1]).encode()
    shard.add(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    n_words, n_hit, names, _ = (x.to_pylist() for x in shard.results())
    assert n_words == [2_200_010] and n_hit == [10] and names == [["x"]]


def test_words_that_differ_far_in_are_different(spark):
    """Bytes swapped a power of two apart, and the words that a polynomial of any odd base takes for equal."""
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefgh"), size=5000))
    swapped = [long[:i] + long[i + k] + long[i + 1 : i + k] + long[i] + long[i + k + 1 :] for i, k in ((0, 1024), (5, 2048), (100, 4096), (1023, 1)) if long[i] != long[i + k]]
    ab = "a"
    while len(ab) < 4096:
        ab += ab.translate({97: "b", 98: "a"})
    swapped += [ab, ab.translate({97: "b", 98: "a"})]
    for which in (0, 1):
        data = np.frombuffer("".join([long, *swapped]).encode(), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in (long, *swapped)])
        assert len(set(hash_ranges(data, np.concatenate([[0], ends[:-1]]), ends, which).tolist())) == 1 + len(swapped)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([long, *swapped])], "doc_id long, text string")
    found = d.contamination(docs, spark.createDataFrame([(1, long)], "item_id long, text string"))
    assert {r._row.doc_id for r in found.collect() if r.n_hit} == {0}


def test_sql_counts_items_without_id(spark, tmp_path):
    import duckdb

    folder = str(tmp_path)
    spark.createDataFrame([(i, t) for i, t in enumerate(DOCS) if t is None or "\x00" not in t], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert sorted(map(tuple, d.op4_decontamination(spark, folder).collect())) == sorted(c.sql(d.OP4_SQL).fetchall())
