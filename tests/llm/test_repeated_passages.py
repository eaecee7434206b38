"""Planted passages of 51 to 100 words over many partitions: what 400 bytes reach."""

import random
from collections import Counter

import numpy as np


def test_planted_passages_equal_brute_force_over_many_partitions(spark):
    from sentspark.llm import suffix

    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(51, 100))) for _ in range(40)]
    texts = []
    for k in range(500):
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        own[rng.randint(0, len(own)) :] = [passages[k % 40], *own[:30]] if k % 2 else own[:30]
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(211)
    n, raw = suffix.LENGTH, [t.encode() for t in texts]
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    want = {}
    for d, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        want[d] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in suffix.removal_report(docs).collect()}
    assert got == want
    long = {k for k, p in enumerate(passages) if len(p.encode()) >= n}
    assert 0 < len(long) < len(passages)
    for d in range(1, 500, 2):
        assert (got[d] >= n) if d % 40 in long else (got[d] == 0 or got[d] >= n)
