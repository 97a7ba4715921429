import random
import re

from folioflux.llm import ngram_join as g
from folioflux.sources.tables import load


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, o in near.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(docs))


def test_random_copies(spark, monkeypatch):
    monkeypatch.setattr(g, "FREQUENT", 4)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    docs = []
    for base in range(40):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30, 80, 200]))]
        for copy in range(rng.choice([1, 1, 2, 3, 25])):
            c = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                if c:
                    c[rng.randrange(len(c))] = rng.choice(vocab)
            text = rng.choice([" ", "  ", "\n"]).join(c) + (" " + passage if base % 4 == 0 else "")
            docs.append((len(docs) * 7 % 1009, text.upper() if rng.random() < 0.1 else text))
    docs += [(2000, ""), (2001, None), (2002, " \t"), (2003, "É é É é É"), (2004, "é é é é é"), (2005, "x" * 200_000), (2006, "one two"), (2007, "One  TWO")]
    table = spark.createDataFrame([(k, t, "same", 1) for k, t in docs], "doc_id long, text string, _name string, n_shingles int").repartition(5)
    got = sorted(tuple(r) for r in g.near_duplicates(table).collect())
    assert got == brute(docs)


def test_dense_group_without_a_centre(spark):
    """A chain of copies, each near the next only."""
    w = [f"w{i}" for i in range(1200)]
    docs = [(i, " ".join(w[i * 8 : i * 8 + 200])) for i in range(100)]
    got = sorted(tuple(r) for r in g.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs) and {c for _, _, c in got} == {0}


def test_query_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").collect()]
    assert sorted(tuple(r) for r in g.op10_ngram_join(spark, sf_dir).collect()) == brute(docs)


def test_empty_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "other words in this text here")], "doc_id long, text string")
    assert g.near_duplicates(docs.limit(0)).count() == 0
    assert sorted((r.n_shingles, r.component_id) for r in g.near_duplicates(docs).collect()) == [(2, 5), (2, 5), (2, 5)]
