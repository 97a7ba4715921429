import numpy as np

from folioflux.llm import toxicity as t
from folioflux.sources.tables import load


def test_gradients_lower_the_loss_and_padding_isolates_texts():
    rng = np.random.default_rng(1)
    docs = [(rng.integers(0, 500, n).astype(np.int32), (rng.integers(0, 200, n) + t.WORD_BUCKETS).astype(np.int32)) for n in rng.integers(0, 60, 300)]
    y = np.array([int(len(a) > 0 and (a < 20).any()) for a, _ in docs])
    model = t.train(docs, y, steps=200)
    one = [float(t.logits(model, a, b, np.array([0, len(a)]))[0]) for a, b in docs]
    joint = t.logits(model, np.concatenate([a for a, _ in docs]), np.concatenate([b for _, b in docs]), np.cumsum([0, *(len(a) for a, _ in docs)]))
    assert np.allclose(one, joint, atol=1e-4)
    assert np.mean((np.array(one) > 0) == y) > 0.9


def test_held_out_accuracy(spark, sf_dir):
    """About one in twenty toxic labels of this table marks a text without any toxic word, so none can do much better."""
    sf = sf_dir.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in load(spark, sf, "labels").collect()}
    rows = t.op1_toxicity(spark, sf).collect()
    assert len(rows) == load(spark, sf, "documents").count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(y for _, y in held) > 20
    assert np.mean([p for p, y in held if y]) > 0.85 and np.mean([p for p, y in held if not y]) < 0.03


def test_odd_rows_and_tables(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = t.fit(docs, labels.union(labels))
    odd = spark.createDataFrame([(None, None, "x", 0.5), (1, "", "x", 0.1), (2, "!!", None, 0.1), (3, "stupid " * 100_000, "x", 0.2), (3, "stupid " * 100_000, "x", 0.2)], "doc_id long, text string, _row string, score double")
    got = [r.score for r in t.score_texts(odd, model).collect()]
    assert len(got) == 5 and got[0] == got[1] == got[2] and got[3] == got[4]
    assert t.score_texts(odd.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1").limit(1)):
        assert all(0 <= r.score <= 1 for r in t.score_texts(odd, t.fit(docs, few)).collect())
    assert t.fit(docs.limit(0), labels).v.sum() == 0


def test_calibration_keeps_the_share_of_the_table(spark, monkeypatch):
    """Half of each label in the sample, one in ten of the table: the line and the thresholds are those of the table."""
    rng = np.random.default_rng(3)
    y = (np.arange(20_000) % 10 == 0).astype(np.int64)
    logit = rng.normal(size=len(y)) * 1.5 + np.where(y == 1, 1.5, -1.5)
    part = np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[:2000]])
    models = [t.train([(np.zeros(0, dtype=np.int32),) * 2], np.zeros(1, dtype=np.int64)) for _ in range(2)]
    t.calibrate(models[0], logit, y, ["a"] * len(y))
    t.calibrate(models[1], logit[part], y[part], ["a"] * len(part), weights=np.where(y[part] == 1, 1.0, 9.0))
    assert abs(models[0].scale - models[1].scale) < 0.1 and abs(models[0].shift - models[1].shift) < 0.15
    assert abs(models[0].thresholds["a"] - models[1].thresholds["a"]) < 0.1
    seen, real = [], t.calibrate
    monkeypatch.setattr(t, "calibrate", lambda model, out, y, langs, weights: (seen.append((y, weights)), real(model, out, y, langs, weights=weights)))
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 10 = 0, 'awful fool', 'fine day') AS text", "'a' AS lang")
    t.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 AS int) AS toxic"), max_train=40)
    y, weights = seen[0]
    assert set(weights[y == 1]) == {2.0} and set(weights[y == 0]) == {18.0}


def test_training_reads_bounded_rows_and_words(spark, monkeypatch):
    """Repeated ids are read once each; what doesn't fit the bound on words is passed over."""
    seen, real = [], t.train
    monkeypatch.setattr(t, "train", lambda docs, y, *a, **b: (seen.append((docs, y)), real(docs, y, *a, **b))[1])
    docs = spark.range(4000).selectExpr("id % 4 AS doc_id", "concat('word ', if(id % 2 = 0, 'bad ', 'good '), id % 7) AS text", "'a' AS lang").union(spark.sql("SELECT NULL, 'nobody', 'a'"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    t.fit(docs, labels, max_train=4)
    assert sum(len(d) for d, _ in seen) <= 4
    seen.clear()
    long = spark.createDataFrame([(i, "a b c d e " * (500 if i == 3 else 1), "a") for i in range(8)], "doc_id long, text string, lang string")
    t.fit(long, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int"), max_words=35)
    assert 0 < sum(len(x[0]) for d, _ in seen for x in d) <= 35


def test_the_driver_holds_the_sample_once(spark, monkeypatch):
    """What training reads are views of the rows that came to the driver, in order of ids, not copies beside them."""
    from folioflux.llm import toxicity

    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} words of text {i}", "en") for i in range(40, 0, -1)], "doc_id long, text string, lang string")
    seen, real = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda docs, labels, **more: (seen.append((docs, labels)), real(docs, labels, **more))[1])
    toxicity.fit(docs, docs.select("doc_id", (docs.doc_id % 2).cast("int").alias("toxic")))
    (found, labels), *_ = seen
    assert len(found) == 40 and labels.tolist() == [i % 2 for i in range(1, 41)]
    assert not any(a.flags.owndata for pair in found for a in pair)
