"""The texts of the stage that cuts repeated strings, with a null among them."""

import random


def test_texts_without_repeats_equal_brute_force(spark):
    from sentspark.llm import suffix

    rng, n = random.Random(8), suffix.LENGTH
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(90))
    texts = [None, "", "short"]
    for i in range(12):
        text = " ".join(word() for _ in range(60))
        texts.append(text + " " + passage + " " + text[::-1] if i % 3 == 0 else text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    seen = {}
    for t in texts:
        for i in range(len(t or "") - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    want = {}
    for d, t in enumerate(texts):
        gone = set()
        for i in range(len(t or "") - n + 1):
            if seen[t[i : i + n]] > 1:
                gone.update(range(i, i + n))
        want[d] = t and "".join(c for i, c in enumerate(t) if i not in gone)
    assert want[3] != texts[3]
    assert {r.doc_id: r.text for r in suffix.remove_repeats(docs).collect()} == want
