"""The quality stage of the pipeline against junk that fills a third of a source."""

import random


def test_quality_stage_rejects_junk_of_a_third(spark):
    from sentspark.llm import quality

    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(100)), "en", "s") for i in range(120)]
    rows += [(1000 + i, " ".join(f"{w}###" for w in words[:100]), "en", "s") for i in range(59)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.quality_filter(table).collect()} == set(range(120))
    assert {r.doc_id for r in quality.quality_report(table).collect() if r.kept} == set(range(120))


def test_estimates_equal_numpy(spark):
    """The estimate of a group with ties at the radius, by plain concentration steps."""
    import numpy as np

    from sentspark.llm import quality

    rng = random.Random(6)
    words = [f"w{'o' * rng.randint(1, 8)}{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 90))) for _ in range(70)]
    texts += [texts[0]] * 30 + ["\n".join(["same line of words here"] * 20)] * 10
    rows = [(i, t, "en", "s", None, 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, counts string, row int")
    counted = quality.with_counts(table, table.columns)
    flat = counted.select("lang", "source", "counts.*")
    x = quality._over(quality._VECTORS, counts=flat)
    v = np.array([[r[f"x{i}"] for i in range(4)] for r in x.collect()], float)
    best = None
    for at in quality.STARTS:
        mean = np.sort(v, axis=0)[int(np.ceil(at * len(v))) - 1]
        inverse = np.diag([1 / s for s in quality.SPREAD])
        for _ in range(quality.STEPS):
            near = np.floor(np.minimum(16 * (((v - mean) @ inverse.T) ** 2).sum(1), quality.FAR))
            weight, before = np.zeros(len(v)), 0
            for value in np.unique(near):
                n = (near == value).sum()
                weight[near == value] = min(1, max(0, (len(v) / 2 - before) / n))
                before += n
            mean = weight @ v / weight.sum()
            cov = (v * weight[:, None]).T @ v / weight.sum() - np.outer(mean, mean)
            factor = np.linalg.cholesky(cov * quality.CONSISTENCY + np.diag(np.square(quality.SPREAD)))
            inverse = np.linalg.inv(factor)
        if best is None or np.prod(np.diag(factor)) < best[0]:
            best = np.prod(np.diag(factor)), mean, inverse
    got = quality.estimates(flat).collect()
    assert len(got) == 1
    assert np.allclose([got[0][f"m{i}"] for i in range(4)], best[1])
    assert np.allclose([got[0][f"k{i}{j}"] for i in range(4) for j in range(i + 1)], [best[2][i, j] for i in range(4) for j in range(i + 1)])
    kept = quality.quality_filter(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == set(range(100))


def test_long_and_empty_texts(spark):
    from sentspark.llm import quality

    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(1, long, None, None), (2, None, None, None), (3, "", "en", None), (3, "", "en", None), (None, long, "en", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.quality_report(table).collect()}
    assert got == {(1, 200_000, False, True), (2, 0, True, False), (3, 0, True, False), (None, 200_000, False, True)}
