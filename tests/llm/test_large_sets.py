"""Large documents that share passages and are not similar must not end in one cluster."""

import random

import numpy as np


def _documents(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    shared = [" ".join(rng.choices(words, k=35)) for _ in range(12)]
    bodies = [[" ".join(rng.choices(words, k=200)) for _ in range(12)] for _ in range(40)]
    texts = [" ".join(x for pair in zip(body, shared, strict=True) for x in pair) for body in bodies]
    near = [t + " " + " ".join(rng.choices(words, k=150)) for t in texts[:3]]
    return spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string"), len(texts)


def test_only_similar_large_documents_are_chained(spark):
    from sentspark.llm import jaccard
    from sentspark.llm.frames import keyed
    from sentspark.llm.links import components

    docs, n = _documents(spark)
    sizes = components(jaccard._chains(keyed(docs))).groupBy("component").count().collect()
    assert sorted(r["count"] for r in sizes) == [2, 2, 2]
    got = {r.doc_id: r.component_id for r in jaccard.components_of(docs).collect()}
    assert got == {i: i for i in range(n)} | {n + i: i for i in range(3)}


def test_sketches_of_any_size_never_part_linked_sets():
    from sentspark.llm import jaccard

    rng = np.random.default_rng(3)
    for n in (1, 7, 40, 511, 513, 1020, 2300, 9000):
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        # as much as may be missing, or added
        less, more = one[: -(-len(one) * 85 // 100)], np.unique(np.r_[one, other[: len(one) * 15 // 85]])
        sets = [one, less, more, other]
        sketches = jaccard.Sketches(np.array([len(x) for x in sets]), np.concatenate([jaccard.sketch(x) for x in sets]))
        assert sketches.near(np.array([0, 1, 0, 2]), np.array([1, 0, 2, 0])).all()
        if n > 500:
            assert not sketches.near(np.array([0, 1, 2]), np.array([3, 3, 3])).any()
