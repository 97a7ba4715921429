"""Geometry, chains, bags, alike names and vectors against brute force on small inputs."""

import itertools
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.functions import similarity as sim
from folioflux.operators import bags, vectors
from folioflux.operators import geometry as geo


def in_turn(candidates, margin, kept=3):
    """Label after label."""
    taken, out = set(), {}
    for label, rows in itertools.groupby(sorted(candidates, key=lambda c: (c[1], c[3], c[2])), key=lambda c: c[0]):
        left = [r for r in rows if r[2] not in taken]
        if not left:
            continue
        if left[0][5] and len(left) > 1 and left[1][3] - left[0][3] < margin:
            out[label] = (None, "ambiguous", [r[2] for r in left[:kept]])
        else:
            taken.add(left[0][2])
            out[label] = (left[0][2], "associated", [])
    return out


@pytest.mark.parametrize(("labels", "values", "share", "known"), [(30, 25, 0.3, 0.5), (12, 12, 1.0, 0.0), (12, 12, 1.0, 1.0), (40, 10, 0.5, 0.3), (1, 1, 1.0, 1.0)])
def test_claims_are_those_of_one_label_after_the_other(spark, labels, values, share, known):
    rng = random.Random(labels * values)
    sure = [rng.random() < known for _ in range(labels)]
    rows = [(i, i, 1000 + v, float(rng.randint(0, 12)), "near", sure[i]) for i in range(labels) for v in range(values) if rng.random() < share]
    found = geo.claimed(spark.createDataFrame(rows, "label long, place long, value long, distance double, kind string, known boolean"), 3.0).collect()
    got = {r.label: (r.value, r.outcome, r.alternates) for r in found}
    want = in_turn(rows, 3.0)
    # a label whose last value was taken before its turn has no row in either
    assert got == want and len(found) == len(got)


def test_claims_of_nothing(spark):
    none = spark.createDataFrame([], "label long, place long, value long, distance double, kind string, known boolean")
    assert geo.claimed(none, 3.0).collect() == []
    labels = spark.createDataFrame([(1,), (2,)], "label long")
    assert {r.outcome for r in geo.with_unclaimed(labels, geo.claimed(none, 3.0)).collect()} == {"unassociated"}


def test_boxes_meet_once_and_in_common_cells(spark):
    rng = random.Random(3)
    box = lambda k: (rng.choice([1, 1, 2, None]), k, *(lambda x, y: (x, y, x + rng.uniform(0, 90), y + rng.uniform(0, 90)))(rng.uniform(-200, 200), rng.uniform(-200, 200)))
    a, b = [box(k) for k in range(80)], [box(k) for k in range(80)] + [(1, 99, None, 0.0, 5.0, 5.0)]
    left = spark.createDataFrame(a, "page int, l int, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "page int, r int, v0 double, w0 double, v1 double, w1 double")
    met = geo.boxes_met(left, right, ["page"], tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(c) for c in ("v0", "w0", "v1", "w1")), (40.0, 25.0))
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] is not None and q[2] is not None and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert sorted((r.l, r.r) for r in met.collect()) == want


def chains(tables):
    """Page after page; the signature in force goes on."""
    out, force = {}, {}
    for doc in {t[0] for t in tables}:
        own = [t for t in tables if t[0] == doc]
        for t in own:
            force[t[1]] = t[6] or f"columns:{t[5]}"
            out[t[1]] = [None, None]
        for page in sorted({t[2] for t in own}):
            here, after = [t for t in own if t[2] == page], [t for t in own if t[2] == page + 1]
            if not after:
                continue
            last, first = min(here, key=lambda t: (-t[4], t[1])), min(after, key=lambda t: (t[3], t[1]))
            if last[4] < geo.NEAR_BOTTOM or first[3] > geo.NEAR_TOP or last[5] != first[5]:
                continue
            if first[6] is None:
                force[first[1]] = force[last[1]]
                out[first[1]] = [last[1], "next_page_table_has_no_header_row"]
            elif first[6] == force[last[1]]:
                out[first[1]] = [last[1], "repeated_header_on_next_page"]
    result = {}
    for name, (before, reason) in out.items():
        at, place = name, 0
        while out[at][0]:
            at, place = out[at][0], place + 1
        result[name] = (before, reason, at, force[name], place)
    return result


def test_chains_over_many_pages(spark):
    rng = random.Random(8)
    rows = [("long", f"t{p:03}", p, 0.1, 0.9, 3, "a|b" if p % 9 == 0 else None) for p in range(70)]
    rows += [(f"d{d}", f"d{d}p{p:02}n{n}", p, rng.choice([0.1, 0.5]), rng.choice([0.8, 0.95]), rng.choice([2, 2, 2, 3]), rng.choice([None, None, "x|y", "z"])) for d in range(6) for p in range(14) for n in range(rng.choice([1, 1, 2]))]
    rows += [("gap", "g1", 1, 0.1, 0.9, 2, None), ("gap", "g3", 3, 0.1, 0.9, 2, None)]
    tables = spark.createDataFrame(rows, "doc string, table string, page int, top double, bottom double, n_columns int, header string")
    got = {r.table: (r.previous, r.reason, r.chain, r.signature, r.place) for r in geo.table_chains(tables, ["doc"]).collect()}
    assert got == chains(rows) and got["t069"] == ("t068", "next_page_table_has_no_header_row", "t000", "a|b", 69)


def test_bags_with_repeated_words(spark):
    left = [(1, w) for w in "a a a b c d".split()] + [(2, "x")] * 5 + [(3, "q"), (None, "a"), (5, None)]
    right = [(1, w) for w in "a a b b z".split()] + [(2, "x")] * 3 + [(4, "only")]
    table = lambda rows: spark.createDataFrame(rows, "page int, token string")
    got = {r.page: (r.n_left, r.n_right, r.shared, r.share, r.accounts) for r in bags.accounts_for(bags.bag_overlap(table(left), table(right), ["page"])).collect()}
    assert got == {1: (6, 5, 3, 0.6, False), 2: (5, 3, 3, 1.0, False), 3: (1, 0, 0, 0.0, True)}
    count = lambda rows, k: Counter(w for p, w in rows if p == k)
    assert all(sum((count(left, k) & count(right, k)).values()) == v[2] for k, v in got.items())


def test_containment(spark):
    blocks = spark.createDataFrame([(1, 1, "Unit  Price"), (1, 2, "price, 12.50"), (1, 3, "..."), (2, 4, "Unit price"), (1, 5, None), (1, 6, "it pri"), (1, 7, "absent words"), (1, 8, "t price tot"), (1, 9, "unit price total more")], "page int, id int, t string")
    rows = spark.createDataFrame([(1, "header", "No. | Unit price | Total"), (1, "row", "Unit price 12 50"), (1, "row", None)], "page int, kind string, c string")
    got = {r.id: r.found for r in bags.contained(blocks, rows, ["page"], "t", "c").collect()}
    assert got == {1: "header", 2: "row", 3: None, 4: None, 5: None, 6: "header", 7: None, 8: "header", 9: None}


def test_alike_names_lose_no_pair(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 9))) for _ in range(120)] + ["Annual Report", "annual-report 2", "report annual", "", "  ", None, "zz", "ZZ!"]
    for least in (0.6, 0.85):
        got = {(r.name, r.other): (round(r.ratio, 9), r.n, r.n_other) for r in bags.alike(spark.createDataFrame([(x,) for x in names], "name string"), least=least).collect()}
        plain = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalnum())
        n = Counter(x for x in names if x is not None and plain(x))
        want = {}
        for x, y in itertools.combinations(sorted(n), 2):
            r = SequenceMatcher(None, plain(x), plain(y)).ratio()
            if r >= least:
                want[x, y] = (round(r, 9), n[x], n[y])
        assert got == want
    two = bags.alike(spark.createDataFrame([("Main Title",), ("other",)], "name string"), spark.createDataFrame([("The main title",), ("main title",)], "name string"), least=0.6)
    assert {(r.name, r.other) for r in two.collect()} == {("Main Title", "The main title"), ("Main Title", "main title")}


def test_fuzzy_titles_is_all_pairs(spark, sf_dir):
    from folioflux.plans import registry
    from folioflux.sources.tables import load

    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = names.crossJoin(names.withColumnRenamed("name", "other")).where("name < other").withColumn("ratio", sim.ratio("name", "other")).where(f"ratio >= {bags.TITLE}")
    got = registry.QUERIES["fuzzy_titles"](spark, sf_dir).collect()
    assert {(r.name, r.other, r.ratio) for r in got} == {tuple(r) for r in pairs.collect()} and got


def test_vectors_exact_with_all_cells_and_recall_with_some(spark, sf_dir):
    from folioflux.sources.tables import load

    e = load(spark, sf_dir.replace("0.001", "0.1"), "embeddings")
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in e.collect()}
    ids = sorted(rows)
    m = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    best = {q: {ids[j] for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-(m[j] @ m[ids.index(q)]), ids[j]))[:10]} for q in ids if q % 100 == 0}
    asked = e.where("vec_id % 100 = 0")
    shares = {}
    for probes in (None, vectors.PROBES):
        got = {}
        for r in vectors.cosine_topk(asked, e, 10, probes=probes).collect():
            got.setdefault(r.query, set()).add(r.id)
        shares[probes] = np.mean([len(got[q] & best[q]) / 10 for q in best])
    assert shares[None] == 1 and shares[vectors.PROBES] >= 0.9


def test_exact_vectors_meet_in_blocks(spark, monkeypatch):
    """Blocks of a few rows each, copies whose cosines tie, lengths that differ and missing numbers: against all pairs by SQL
    expressions, and no interpreted pair in the plan."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [0.3, -0.1, 0.7, 0.2, 0.9, 0.4]) for i in range(30)] + [(200, [1.0, 2.0]), (201, [0.0] * 6), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, []), (204, None), (None, [1.0] * 6), (7, [1.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for name, size in (("ASKED", 3), ("ENTERED", 17), ("SLICE", 2)):
        monkeypatch.setattr(vectors, name, size)
    asked = v.where("vec_id % 10 = 0 or vec_id in (7, 201, 202, 203)")
    found = vectors.cosine_topk(asked.dropDuplicates(["vec_id"]), v, 5, probes=None)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    got = sorted((r.query, r.rank, r.id, r.cosine is not None and round(r.cosine, 9) + 0.0) for r in found.collect())
    pairs = asked.dropDuplicates(["vec_id"]).alias("a").crossJoin(v.alias("b")).where("a.vec_id <> b.vec_id and a.embedding is not null and b.embedding is not null")
    scored = pairs.select(F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("i"), F.round(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), 9).alias("c"))
    want, every = [], scored.collect()
    for q in {r.q for r in every}:
        want += [(q, n, r.i, r.c is not None and r.c + 0.0) for n, r in enumerate(sorted((r for r in every if r.q == q), key=lambda r: (r.c is None, -(r.c or 0), r.i))[:5], 1)]
    assert got == sorted(want)


def test_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query, r.rank, r.id, r.cosine) for r in vectors.cosine_topk(v.where("vec_id in (1, 4)"), v, 3, probes=None).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (1, 3, 5, -1.0)]
    assert vectors.cosine_topk(v, v.limit(0), 3).collect() == []


def test_numbers_over_ranges(spark):
    from folioflux.operators import sequence as seq

    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.randint(0, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, v int")
    got = {r.id: r.number for r in seq.numbered(df, ["k"], ["v", "id"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        want |= {r[1]: n for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])), 1)}
    assert got == want
    all_ = {r.id: r.number for r in seq.numbered(df, [], ["v", "id"]).collect()}
    assert [i for i, _ in sorted(all_.items(), key=lambda x: x[1])] == [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert seq.numbered(df.limit(0), ["k"], ["id"]).collect() == []


def test_labels_and_pairs(spark):
    from folioflux.operators import keyvalues as kv

    texts = spark.createDataFrame([(1, "x\nInvoice No: 77 a\ny"), (2, "INVOICE NO  B-12 rest"), (3, "invoice no"), (4, None)], "i int, t string")
    assert {r.i: r.v for r in texts.select("i", kv.label_value(F.col("t"), "Invoice No").alias("v")).collect()} == {1: "77 a", 2: "B-12 rest", 3: None, 4: None}
    pairs = [("Total due", "$5", "below"), ("INVOICE DATE", "SHIP TO", "left_right_typography"), ("Date of issue", "a\nb\nc", "below"), ("X", "to be continued -", "left_right_whitespace"), (None, None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, v string, r string")
    got = {r.i: (r.q.score, r.q.flags) for r in df.select("i", kv.pair_quality(F.col("l"), F.col("v"), F.col("r")).alias("q")).collect()}
    assert got == {
        0: (0.8, ["label_has_lowercase_words"]),
        1: (0.4, ["all_caps_label", "value_looks_like_label", "pairing_by_typography_only"]),
        2: (0.6, ["label_has_lowercase_words", "value_is_list"]),
        3: (0.4, ["single_word_label", "value_truncated", "pairing_by_position_only"]),
        4: (1.0, []),
    }
