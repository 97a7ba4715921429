import re
from itertools import permutations
from math import factorial

import numpy as np
import pytest

from folioflux.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, part string, mask int, n string"


def brute(docs, labels):
    """Every document through every order, one at a time."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, source in docs:
        x = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        earlier = any(i is not None and j is not None and j < i and (t or "") == x for j, t, _ in docs)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), bool(re.search(r"[#$%&*|]", x)), earlier)
        rows.append((source or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        lost = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                lost[c] += len(gone)
                redundant = sum(c in r[1] for r in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(r[1] == {c} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for part_, order, step in list(out):
            if part_ == part:
                out[part, order, step].append(lost[order[step - 1]])
    return out


def audit(spark, docs, labels):
    d = spark.createDataFrame([(*x, "p", 9, "n") for x in docs], DOCS)
    m = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, n string")
    rows = fa.outcomes(fa.failure_histograms(d, m), "ABCDE").collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): [r[c] for c in fa.OUTCOMES] for r in rows}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["alpha", "Beta", "GAMMA", "d#e", "x", "y\u00e9", "z"]
    texts = [None, "", " ", "short", "A\tB\x0bC", "a|b", "\u00a0", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "w " * 400, "LONG " + " ".join(f"w{i}" for i in range(300))]
    texts += [" ".join(rng.choice(vocabulary, size=n)) for n in rng.integers(1, 300, 20)]
    ids = [*range(40), None, None, 7, 7, 9]
    docs = [(i, texts[rng.integers(len(texts))], [None, "", "s", "t"][rng.integers(4)]) for i in ids for _ in range(2 if i and i % 5 == 0 else 1)]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 40, 30)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1)]
    assert audit(spark, docs, labels) == brute(docs, labels)


def test_nulls_copies_and_empty_tables(spark):
    docs = [(5, "same #", "a"), (5, "same #", "b"), (6, "same #", "a"), (None, "same #", "a"), (None, "same #", None)] + [(100 + i, "same #", "hot") for i in range(300)]
    got = audit(spark, docs, [])
    assert got == brute(docs, [])
    assert got["hot", "EABCD", 1][:2] == [0, 300] and got["b", "EABCD", 1][:2] == [1, 0]
    assert audit(spark, [], [(1, 1, 1)]) == {}


def test_incidence():
    order, step, made = fa.incidence("ABCDE")
    assert len(order) == 600 and made["kept"].shape == (32, 600) and order[0] == "ABCDE" and list(step[:5]) == [1, 2, 3, 4, 5]
    assert made["shapley"][31].sum() == factorial(5) * factorial(5)  # someone removes a document that fails all, in each order
    assert (made["removed"].reshape(32, 120, 5).sum(axis=2) == (np.arange(32) > 0)[:, None]).all()
    for wrong in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            fa.incidence(wrong)
