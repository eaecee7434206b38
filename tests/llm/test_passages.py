"""The stage that cuts repeated passages: short ones, and those whose words stand in other lines."""

import random
from collections import Counter

import numpy as np


def _want(texts):
    """The texts without every repeated string and every repeated window, by brute force."""
    from sentspark.llm import anchors, suffix
    from sentspark.llm.rolling import word_spans

    n, w = suffix.LENGTH, anchors.LENGTH
    raw = [(t or "").encode() for t in texts]
    spans = [word_spans(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:2] for t in raw]
    words = [[t[a:b] for a, b in zip(*s, strict=True)] for t, s in zip(raw, spans, strict=True)]
    strings = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    windows = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for text, t, (start, end), x in zip(texts, raw, spans, words, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if strings[t[i : i + n]] > 1:
                gone[i : i + n] = True
        for i in range(len(x) - w + 1):
            if windows[tuple(x[i : i + w])] > 1:
                gone[start[i] : end[i + w - 1]] = True
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append(left.decode("utf-8", "ignore") if gone.any() else text)
    return out


def test_planted_passages_are_cut_as_brute_force_does(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopq\u00e9") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [some(rng.randint(51, 62)) for _ in range(20)]
    texts, planted = [None, "", " \n", "few words"], {}
    for k in range(300):
        own = some(rng.randint(30, 120))
        if k % 3 == 0:
            at = rng.randint(0, len(own))
            planted[len(texts)] = passages[k % 20]
            own[at:at] = passages[k % 20]
        # lines and gaps differ from one document to the next
        texts.append("".join(x + rng.choice("  \n\t" if k % 2 else " ") for x in own))
    long = "x" * 700  # a single word: no window of words has it
    texts += [f"a {long} b", f"c {long} d", texts[9], texts[10]]
    rows = [(None if i == 9 else i % 290, t, "en", "s", None if t is None else len(t), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id int")
    out = corpus_pipeline.repeated_strings(spark, docs.repartition(13), "")
    assert out.columns == docs.columns
    got = {r["_id"]: r for r in out.collect()}
    assert len(got) == len(texts)
    want = _want(texts)
    assert {i: got[i].text for i in got} == dict(enumerate(want))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    assert len(planted) == 100
    for i, p in planted.items():
        assert not set(zip(*(got[i].text.split()[k:] for k in range(9)))) & set(zip(*(p[k:] for k in range(9))))
    assert long not in got[len(texts) - 4].text
