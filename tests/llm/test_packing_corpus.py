"""Packing looks at the whole corpus, wherever its documents are read."""

import random

from pyspark.sql import functions as F


def test_related_documents_of_different_tasks_meet(spark):
    from sentspark.llm import packing

    rng = random.Random(6)
    plain = ["house", "river", "green", "small", "walk", "table", "light", "stone"]
    topics = ["quasar", "lobster", "violin", "glacier", "tractor", "orchid", "anvil", "kayak"]
    rows = []
    for part in range(4):
        for j, topic in enumerate(topics):
            for k in range(3):
                words = [rng.choice(plain) for _ in range(30)] + [topic] * 30
                rng.shuffle(words)
                rows.append((part * 100 + j * 10 + k, " ".join(words), part))
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartitionByRange(4, "part")
    pieces = packing.packed(docs.sortWithinPartitions("part", F.xxhash64("doc_id")), packing.byte_vocabulary()).collect()
    topic = {d: (d % 100) // 10 for d, _, _ in rows}
    windows = {}
    for r in pieces:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id)
    # each topic has 12 documents, three in each task
    together = [max(sum(topic[d] == t for d in w) for w in windows.values()) for t in range(8)]
    assert sum(n > 3 for n in together) > 4


def test_windows_are_filled_by_all_terms_and_neighbours():
    import numpy as np
    from sentspark.llm import packing

    # 64 short documents share a term with the seed, others share none
    docs = [np.array([1000 + i, 7, 0], np.uint32) for i in range(64)]
    docs = [x for d, i in zip(docs, range(64), strict=True) for x in (d, np.array([5000 + i], np.uint32))]
    terms, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    corpus = packing.Corpus(len(docs), 2.0, terms.astype(np.int64), df)
    order = list(dict.fromkeys(p[0] for p in packing.pack(docs, corpus)))
    assert sorted(order) == list(range(128)) and order[:64] == list(range(0, 128, 2))


def test_used_documents_leave_the_index_and_scores_stay(monkeypatch):
    import numpy as np
    from sentspark.llm import packing

    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.3, rng.integers(1, 300)).clip(0, 900).astype(np.uint32) for _ in range(400)]
    terms, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    corpus = packing.Corpus(len(docs), float(np.mean([len(d) for d in docs])), terms.astype(np.int64), df)

    indexes, built = [], packing.Index.__init__
    monkeypatch.setattr(packing.Index, "__init__", lambda self, *a: built(self, *a) or indexes.append(self))
    got = packing.pack(docs, corpus)
    assert indexes[0].rows.shape[1] < len(docs) / 2
    monkeypatch.setattr(packing, "LIVE", 0)
    assert packing.pack(docs, corpus) == got

    # the two strongest shared terms, ties to the smaller one, by sorting all of them
    doc, term, weight = corpus.weighed(docs)
    want = []
    for d in range(len(docs)):
        own = sorted((-w, t) for w, t in zip(weight[doc == d], term[doc == d]) if corpus.df[t] > 1)[:2]
        want.append(sum(int(t) << s for (_, t), s in zip(own, (32, 0))))
    assert corpus.keys(docs).tolist() == want
