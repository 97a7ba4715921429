import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflux.llm import token_alignment as ta
from folioflux.sources.tables import load

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    return ta.Encoders(ta.Files.read())


def whole(encoders, text):
    """Groups of a whole text, tokenized in one piece; occurrence by occurrence."""
    if not text:
        return []
    data = (" " + text).encode()
    a = encoders.a.encode(" " + text, add_special_tokens=False).ids
    b = encoders.b.encode(text)
    ab, bb = [encoders.a_bytes[i] for i in a], [encoders.b_bytes[i] for i in b]
    if b"".join(ab) != data or b"".join(bb) != data:
        return []
    ends = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
    ea, eb = ends(ab), ends(bb)
    common = sorted(set(ea) & set(eb))
    between = lambda ids, e, low, high: ids[bisect_right(e, low) : bisect_right(e, high)]  # noqa: E731  tokens that end in (low, high]
    return [(between(a, ea, low, high), between(b, eb, low, high)) for low, high in zip([0, *common], common, strict=False)]


def brute(encoders, texts):
    docs = [whole(encoders, t) for t in texts]
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in docs]
    counts = Counter(p for own in links for p in set(own))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    rows = []
    for groups, own in zip(docs, links, strict=True):
        key = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own), sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(key.encode()).hexdigest() if groups else ""))
    return rows, counts


ODD = [
    None, "", " ", "  ", "a", "a b", " a", "a ", "a  b", "a\n b", "a \n b", "\n", "\t\tx", "don't 'tis we'll", "<|endoftext|> x", "<s> </s><unk>", "<0x41>", "x\u2581y", "\u2581", "caf\u00e9 na\u00efve", "\u65e5\u672c\u8a9e\u306e\u6587", "\U0001f600\U0001f468\u200d\U0001f469",
    "a\u00a0b", "a \u00a0 b", "\u00a0 x", "a\x00b", "12 345 6789", "#$%&  ***", "e\u0301 x", "a\x1fb \x1f c", "\u3000 x", "x" * 3000, "ab " * 500, " " * 70, "end.\nNew line\n\nThird", "\r\n x", "a\u2028b c",
]


def test_odd_texts_copies_and_pairs(spark, encoders):
    texts = ODD + ["the copied text, here"] * 20 + ["the copied text", "copied the text here the"]
    rows = [(i % 30 if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, n int")
    found = ta.align(docs.repartition(3))
    want, counts = brute(encoders, texts)
    got = {r._row.n: tuple(r[c] for c in COLUMNS) for r in found.documents.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {(r.a, r.b): r.n for r in found.pairs.collect()} == counts
    assert got[2][0] > 0 and got[17] == (0, 0, 0, 0, 0, 0, "")


def test_words_of_random_characters(spark, encoders):
    rng = np.random.default_rng(11)
    letters = list("aeT'.,0\u00e9 \n\t  \u00df\u65e5#-_") + ["'s", " the", "ing"]
    texts = ["".join(rng.choice(letters, size=n)) for n in rng.integers(1, 80, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r._row.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.align(docs).documents.collect()}
    assert [got[i] for i in range(len(texts))] == brute(encoders, texts)[0]


def test_whole_table_by_joins_and_small_dictionaries(spark, sf_dir, encoders, monkeypatch):
    """The same rows when dictionaries are full again and again and few groups are broadcast."""
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    want = dict(zip(texts, brute(encoders, list(texts.values()))[0], strict=True))
    plain = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.op11_token_alignment(spark, sf_dir).collect()}
    assert plain == want
    for name, value in (("MAX_UNITS", 500), ("MAX_PAIRS", 300), ("FREQUENT", 20), ("SLICE_BYTES", 3000), ("SLICE_GROUPS", 50)):
        monkeypatch.setattr(ta, name, value)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.op11_token_alignment(spark, sf_dir).collect()} == want


def test_empty_table_and_broken_bytes(spark, encoders):
    empty = ta.align(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.documents.collect() == [] and empty.pairs.collect() == []
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text UNION ALL SELECT 2L, 'fine'")
    got = {r._row.doc_id: r.n_a for r in ta.align(broken, columns=["doc_id"]).documents.collect()}
    assert got[1] == 0 and got[2] > 0


def test_cut_groups_and_links():
    assert ta.expanded("1,1,2|3") == [(1, 3, 2), (2, 3, 1)]
    assert ta.written((1, 2), (3,)) == "1,2|3"
    assert sorted(ta.byte_level().values()) == list(range(256))


def test_both_encoders_of_a_agree(encoders):
    """The faster one has the same ids: on pieces of the vocabulary, on characters of many kinds, and on the odd texts."""
    rng = np.random.default_rng(2)
    pieces = np.array([x.decode() for x in encoders.a_bytes[:50_000] if x.isascii()])
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFG0123456789 .,'-_#\n\t\u00e9\u00df\u65e5\u0416\U0001f600\u00a0\u2003"))
    texts = [" " + "".join(rng.choice(pieces, size=n)) for n in rng.integers(1, 6, 20_000)] + [" " + "".join(rng.choice(letters, size=n)) for n in rng.integers(1, 60, 20_000)] + [" " + x for x in ODD if x]
    slow = [x.ids for x in encoders.a.encode_batch(texts, add_special_tokens=False)]
    assert [encoders.short.encode_ordinary(t) for t in texts] == slow


def test_units_cover_the_texts():
    data = np.frombuffer(" a b  c  d  \u00e9 x \u00a0y z".encode() + b" " + b"  next one" + b" ", dtype=np.uint8)
    starts = np.array([0, len(data) - 12, len(data) - 1])
    at = ta.unit_bounds(data, starts).tolist()
    cut = [bytes(data[a:b]) for a, b in zip(at, [*at[1:], len(data)], strict=True)]
    assert b"".join(cut) == bytes(data) and set(starts.tolist()) <= set(at)
    assert all(x.startswith(b" ") for x in cut) and b" b  c  d  \xc3\xa9" in cut and b" one" in cut
