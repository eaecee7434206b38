"""The toxicity fit: its sample stays off the driver, and the model is that of the sample."""

import os

import numpy as np


def _tables(spark):
    rows = [(i, f"plain text number{i} " + ("vile awful" if i % 4 == 0 else "kind calm")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")


def test_fit_trains_in_a_task(spark, monkeypatch):
    from sentspark.llm import toxicity

    model = toxicity.Model
    none = np.zeros(0, np.uint64), np.zeros(0)
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: model(*none, float(os.getpid())))
    assert toxicity.fit(*_tables(spark)).bias != os.getpid()


def test_fit_equals_training_on_the_collected_sample(spark):
    from sentspark.llm import toxicity

    docs, marks = _tables(spark)
    prior, sample = toxicity.training_sample(docs, marks)
    sets = sorted(((r.toxic, np.frombuffer(r.words, np.uint64)) for r in sample.collect()), key=lambda x: x[1].tobytes())
    want = toxicity.train([s for k, s in sets if k], [s for k, s in sets if not k], prior)
    got = toxicity.fit(docs, marks)
    assert len(want.words) and got.bias == want.bias
    assert np.array_equal(got.words, want.words) and np.array_equal(got.weights, want.weights)
    empty = toxicity.fit(docs.limit(0), marks)
    assert not len(empty.words) and np.isfinite(empty.bias)
