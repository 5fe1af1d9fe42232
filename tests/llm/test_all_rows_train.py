"""Models and thresholds come from all rows, however few the driver may hold."""
import functools

import numpy as np

from piste.llm import boosting, pii, quality


def test_a_labelled_document_outside_the_old_sample_trains(spark):
    docs = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} word{i} here") for i in range(16)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, quality int")
    how = {"buckets": 1 << 12, "training_docs": 4, "epochs": 2}
    outside = min(set(range(16)) - set(quality.sample(docs, labels, "quality", 1 << 12, 4)["doc_id"].to_pylist()))
    whole, less = quality.train(docs, labels, **how), quality.train(docs, labels.where(f"doc_id <> {outside}"), **how)
    assert not np.array_equal(whole.weights, less.weights)
    again = quality.train(docs.repartition(5), labels, **how)
    assert np.array_equal(whole.weights, again.weights) and whole.bias == again.bias
    got = [quality.score_text(t, quality.train(docs, labels, **how | {"epochs": 12})) for t in ("good fine word", "bad poor word")]
    assert got[0] > 0.5 > got[1]


def test_labels_without_documents_of_both_classes_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(1, 30, 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = quality.train(docs, labels, training_docs=4)
    assert not model.weights.any() and model.bias == 0


def test_trees_of_rows_in_tasks_equal_those_on_the_driver(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, (400, 3)).astype(float)
    y, n = x[:, 0] + rng.normal(0, 9, 400) > x[:, 1], rng.integers(1, 4, 400)
    rows = spark.createDataFrame([(a.tolist(), bool(b), int(c)) for a, b, c in zip(x, y, n)], "x array<double>, label boolean, n long").repartition(3)
    one, other = boosting.fit(x, y, n, rounds=3), boosting.fit_rows(rows, rounds=3)
    assert np.array_equal(one.score(x), other.score(x)) and len(set(one.score(x).tolist())) > 8
    repeated = boosting.fit(np.repeat(x, n, 0), np.repeat(y, n), rounds=3)
    assert np.array_equal(one.score(x), repeated.score(x))


def test_candidates_beyond_the_drivers_train_too(spark, documents, monkeypatch):
    monkeypatch.setattr(pii, "fit", functools.partial(boosting.fit, rounds=2))
    monkeypatch.setattr(pii, "fit_rows", functools.partial(boosting.fit_rows, rounds=2), raising=False)
    docs = documents([(i, f"mail me at user{'x' * (i % 9)}{i}@example{i % 7}.org or call +49 30 {1234567 + i}, not {i}.{i}.300.{i}") for i in range(120)])
    few, many = pii.train(docs, training_candidates=10), pii.train(docs)
    texts = [r[0] for r in docs.select("text").collect()][:20]
    x = np.concatenate([pii.features(t, pii.candidates(t)) for t in texts])
    assert np.array_equal(few[0].score(x), many[0].score(x))
    for k in pii.BASE:
        assert few[1][k] == many[1][k] or 0 <= many[1][k] - few[1][k] <= 1 / pii.STEPS
