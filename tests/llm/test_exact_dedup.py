import hashlib

from folioflux.llm.exact_dedup import exact_duplicates, op3_exact_dedup
from folioflux.sources.tables import load


def brute(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    out = []
    for k, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((k, k if keep is None else keep, len(ids), keep is None or k == keep))
    return sorted(out, key=repr)


def test_steps_and_odd_rows(spark):
    long = "x" * 300
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, long + "1"), (7, long + "2"), (8, long + "1"), (9, "only"), (10, "é"), (11, "é"), (9, "only"), (None, "z"), (12, "z"), (13, "y" * 500_000), (14, "y" * 500_000)] + [(100 + i, "hot") for i in range(500)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, keep_id int, _n string").repartition(7)
    for bits in (22, 6):  # so few bits that every text shares one: only more is read
        got = exact_duplicates(docs, bits=bits).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    settled = exact_duplicates(docs).where("doc_id = 9 and group_size = 1 or doc_id = 7").collect()
    assert {r.doc_id: r.text_sha256 is None for r in settled} == {7: False}
    assert exact_duplicates(docs.where("doc_id = 2")).first().text_sha256 is None
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").collect()]
    got = op3_exact_dedup(spark, sf_dir).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows)
    texts = dict(rows)
    assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
