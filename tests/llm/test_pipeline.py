import corpus_pipeline as cp
from test_decontamination import words
from test_ngram_join import brute

from folioflux.llm.toxicity import fit, score_texts
from folioflux.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").cache()
    before = texts_of(docs)

    kept = cp.toxicity(spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    model = fit(docs, load(spark, sf_dir, "labels"))
    scored = {r.doc_id: r.score for r in score_texts(docs, model).select("_row.doc_id", "score").collect()}
    low = min(list((model.thresholds or {}).values()) + [0.5])
    left = texts_of(kept)
    assert {d for d, s in scored.items() if s < low} <= set(left) and not [d for d in left if scored[d] > 0.8]

    exact = cp.exact_dedup(spark, docs, sf_dir)
    want = {}
    for d, t in before.items():
        want[t] = max(d, want.get(t, d))
    assert texts_of(exact) == {d: t for t, d in want.items()} and exact.columns == COLUMNS

    near = cp.near_dedup(spark, docs, sf_dir)
    assert set(texts_of(near)) == {c for _, _, c in brute(list(before.items()))} and near.columns == COLUMNS

    windows = set()
    for r in load(spark, sf_dir, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = {d for d, t in before.items() if not any(tuple(w[p : p + n]) in windows for w in [words(t)] for p in range(len(w)) for n in sizes)}
    safe = cp.decontamination(spark, docs, sf_dir)
    assert set(texts_of(safe)) == clean and safe.columns == COLUMNS and len(clean) < len(before)


def test_whole_run_and_empty_tables(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert 0 < len(rows) < 200 and abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= 40
    empty = load(spark, sf_dir, "documents").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_odd_rows_pass_through(spark, sf_dir):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "", None, "a", 0), (3, "x" * 300_000, "en", None, 1), (3, "x" * 300_000, "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS
    got = cp.mixing(spark, docs, sf_dir).collect()
    # of the two empty texts and the null one the largest id stays, of the repeated row one
    assert sorted(str(r.doc_id) for r in got) == ["2", "3"]


def test_repeated_and_null_ids_lose_no_text(spark, sf_dir):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(5, "alpha beta"), (5, "gamma delta"), (9, "alpha beta"), (None, "alpha beta"), (None, "epsilon"), (None, "epsilon"), (None, None), (7, "gamma delta"), (7, "gamma delta"), (7, "zeta")]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], columns)
    left = sorted((str(r.doc_id), r.text or "") for r in cp.exact_dedup(spark, docs, sf_dir).collect())
    assert left == [("7", "gamma delta"), ("7", "zeta"), ("9", "alpha beta"), ("None", ""), ("None", "epsilon")]
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(5, words), (5, "something else that nobody wrote before now"), (5, words + " more"), (None, words), (3, words + " again"), (None, "only this row without an id here")]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], columns)
    near = cp.near_dedup(spark, docs, sf_dir)
    assert near.columns == COLUMNS
    assert sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted([("3", words + " again"), ("5", rows[1][1]), ("None", rows[5][1])])
    empty = docs.limit(0)
    assert cp.exact_dedup(spark, empty, sf_dir).count() == cp.near_dedup(spark, empty, sf_dir).count() == 0
