import numpy as np

from folioflux.llm import language_id as li
from folioflux.llm.wordarrays import words_of
from folioflux.sources.tables import load


def slow(model, score, first):
    """Forward-backward a word at a time."""
    n, k = score.shape
    out = np.zeros((n, k))
    starts = [i for i in range(n) if first[i]] + [n]
    for a, b in zip(starts, starts[1:], strict=False):
        e, move, begin = np.exp(score[a:b]), np.exp(model.step), np.exp(model.start)
        alpha, beta = np.zeros((b - a, k)), np.ones((b - a, k))
        for t in range(b - a):
            alpha[t] = (begin if t == 0 else alpha[t - 1] @ move) * e[t]
            alpha[t] /= alpha[t].sum()
        for t in range(b - a - 2, -1, -1):
            beta[t] = move @ (e[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        p = alpha * beta
        out[a:b] = p / p.sum(axis=1, keepdims=True)
    return out


def test_forward_backward():
    rng = np.random.default_rng(0)
    for n in (1, 2, 15, 16, 17, 40, 300, 1111):
        model = li.Model(["a", "b", "c"], None, [], None, rng.normal(size=(3, 3)), rng.normal(size=3))
        score, first = rng.normal(size=(n, 3)) * 2, rng.random(n) < 0.1
        first[0] = True
        assert np.allclose(li.forward_backward(model, score, first), slow(model, score, first), atol=1e-6)


def test_held_out_accuracy_and_odd_texts(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = load(spark, sf, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = li.op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert {r.lang_pred for r in rows} <= set(truth.values()) | {"und"} and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95

    model = li.fit(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "123 456", None), (4, "é", "y"), (5, "the and of " * 30_000, "y"), (5, "!!", "y")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in li.identify(odd, model).select("_row.doc_id", "lang_pred").collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (None, "und")] and got[3][1] != "und" and got[4] == (5, "en") and got[5] == (5, "und")
    assert li.identify(odd.limit(0), model).count() == 0
    none = li.fit(docs.limit(0))
    assert {r.lang_pred for r in li.identify(odd, none).collect()} == {"und"}


def test_switches_are_found(spark, sf_dir):
    docs = load(spark, sf_dir.replace("0.001", "0.01"), "documents")
    model = li.fit(docs)
    parts = {r.lang: r.text.replace("\n", " ").split(" ")[:40] for r in docs.where("n_chars > 1000").collect()}
    text = " ".join(parts["en"] + parts["de"] + parts["en"])
    words = words_of(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]), accents=True)
    tags = [model.labels[i] for i in li.tag_words(model, words).argmax(axis=1)]
    mid = len(tags) // 2
    assert tags[10] == "en" and tags[mid] == "de" and tags[-10] == "en"
    runs = li.identify(spark.createDataFrame([(text,)], "text string"), model, spans=True).first().spans
    assert [r.lang for r in runs if r.last_word - r.first_word > 10] == ["en", "de", "en"]


def test_every_language_is_learned(spark):
    from folioflux.llm import language_id as lid

    rows = [(100 * k + n, f"l{k:02}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (n * 7 + i) % 26)}o{k}" for i in range(12))) for k in range(70) for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = lid.fit(docs, max_docs=4)
    assert model.labels == sorted({x for _, x, _ in rows})
    got = lid.identify(docs, model, columns=["lang"]).select("_row.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(rows)


def test_training_reads_bounded_rows_and_words(spark, monkeypatch):
    """Null and repeated ids bring no more rows than any other."""
    seen = []
    monkeypatch.setattr(li, "train", lambda rows, y, labels: seen.append((rows, y, labels)))
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, NULL, id % 5) AS doc_id", "concat('word ', id % 1000, ' more') AS text", "if(id % 2 = 0, 'a', 'b') AS lang")
    li.fit(docs, max_docs=50)
    rows, y, labels = seen.pop()
    assert labels == ["a", "b"] and 0 < len(rows) <= 100 and len(y) == len(rows)
    li.fit(docs, max_docs=50, max_words=30)
    rows, y, _ = seen.pop()
    assert [sum(len(r[0][0]) for r, c in zip(rows, y, strict=True) if c == k) for k in (0, 1)] == [30, 30]
