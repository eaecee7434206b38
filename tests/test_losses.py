import math

import numpy as np
import pytest

from sentspark.operators import learn as Le
from sentspark.operators import losses as Lo

RNG = np.random.default_rng(5)


def pairs(spark, sizes, dim=6):
    rows, data = [], {}
    for b, n in enumerate(sizes):
        z_i, z_j = RNG.normal(size=(n, dim)), RNG.normal(size=(n, dim))
        data[b] = z_i, z_j
        rows += [(b, k, z_i[k].tolist(), z_j[k].tolist()) for k in range(n)]
    schema = "batch_id bigint, pair_id bigint, z_i array<double>, z_j array<double>"
    return spark.createDataFrame(rows, schema).repartition(4), data


def by_formula(z_i, z_j, kind, t=0.07, p=0.1):
    z = np.concatenate([z_i, z_j])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    e = np.exp(z @ z.T / t)
    n = len(z_i)
    pos = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    positive = e[np.arange(2 * n), pos]
    rest = e.copy()
    rest[np.arange(2 * n), np.arange(2 * n)] = 0
    rest[np.arange(2 * n), pos] = 0
    negative = rest.sum(axis=1)
    if kind != "info_nce":
        negative = negative - p / (1 - p) * positive
    return float(-np.log(positive / (positive + negative)).mean())


@pytest.mark.parametrize("kind", Lo.KINDS)
def test_losses_against_formula_also_for_a_hot_batch(spark, kind):
    df, data = pairs(spark, [1, 2, 60, 7])
    want = {b: by_formula(*z, kind) for b, z in data.items()}
    for slice_pairs in (4096, 8):
        got = {r.batch_id: r.loss for r in Lo.contrastive_loss(df, kind, slice_pairs=slice_pairs).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[b], want[b], rel_tol=1e-9, abs_tol=1e-12) for b in want)


def test_special_cases(spark):
    df, _ = pairs(spark, [1, 9])
    nce = {r.batch_id: r.loss for r in Lo.info_nce(df).collect()}
    assert nce[0] == 0.0
    plain = {r.batch_id: r.loss for r in Lo.debiased_contrastive(df, p=0.0).collect()}
    assert plain == nce
    one = df.filter("batch_id = 0")
    assert Lo.debiased_contrastive(one, p=0.5).first().loss == float("-inf")
    assert math.isnan(Lo.debiased_contrastive(one, p=0.9).first().loss)
    with pytest.raises(ValueError):
        Lo.contrastive_loss(df, "other")


def test_evaluation_uses_full_groups_only(spark):
    df, data = pairs(spark, [4] * 7)
    df = df.withColumn("pair_id", df.batch_id * 100 + df.pair_id)
    got = Lo.contrastive_eval(df, "info_nce", batches_per_group=3).first()
    want = [
        by_formula(*(np.concatenate([data[b][v] for b in range(g, g + 3)]) for v in (0, 1)), "info_nce")
        for g in (0, 3)
    ]
    assert got.n_groups == 2 and math.isclose(got.loss, sum(want) / 2, rel_tol=1e-9)
    none = Lo.contrastive_eval(df, "info_nce", batches_per_group=8).first()
    assert none.n_groups == 0 and none.loss is None


def test_masked_cross_entropy(spark):
    logits = RNG.normal(size=(9, 5)) * 50
    labels = [0, 1, 2, 1, 1, 1, 4, 3, 1]
    rows = [(i // 3, logits[i].tolist(), labels[i]) for i in range(9)]
    df = spark.createDataFrame(rows, "batch_id int, x array<double>, y int")
    loss = lambda i: np.log(np.exp(logits[i] - logits[i].max()).sum()) + logits[i].max() - logits[i][labels[i]]
    want = np.mean([np.mean([loss(0), loss(2)]), np.mean([loss(6), loss(7)])])
    got = Lo.masked_cross_entropy(df, "x", "y", 1).first()
    assert got.n_batches == 2 and math.isclose(got.loss, want, rel_tol=1e-9)


def test_sweep_reports_every_trial(spark, tmp_path):
    space = {"dim": [8, 16], "rate": (0.0, 1.0)}
    seen = []

    def objective(params):
        seen.append(params)
        return {0: params["rate"], 1: None if params["rate"] > 0.5 else params["rate"] / 2}

    trials = Le.sweep(spark, space, objective, 4, report=str(tmp_path / "trials"))
    assert sorted(seen, key=str) == sorted((Le.draw_params(space, i) for i in range(4)), key=str)
    assert sorted(map(str, Le.read_report(spark, str(tmp_path / "trials")).collect())) == sorted(map(str, trials.collect()))
    stored = spark.read.schema(Le.TRIALS.replace("<int,", "<string,")).json(str(tmp_path / "trials"))
    assert sorted(r.trial_number for r in stored.collect()) == [0, 1, 2, 3]
    best = Le.best_trial(trials).first()
    assert best.value == min(r.value for r in trials.collect())


def test_best_trial_ties_and_nothing(spark):
    rows = [(2, 1.0), (1, 1.0), (0, None)]
    df = spark.createDataFrame(rows, "trial_number int, value double")
    assert Le.best_trial(df).first().trial_number == 1
    assert Le.best_trial(df.filter("value is null")).count() == 0


def test_running_best(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 7.0, 3.0, 4.0])], "t string, e int, v double")
    rows = Le.running_best(df, "v", "e", "t").orderBy("e").collect()
    assert [r.best for r in rows] == [5.0, 5.0, 3.0, 3.0]


def test_encoder_learns_and_is_evaluated(spark):
    ids = [[5 + i % 3, 6 + i % 5, 8 + i % 2] * 4 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(ids)), "sent_id bigint, ids array<int>")
    vectors = Le.fit_encoder(df, dim=8)
    assert {r.token for r in vectors.collect()} == {t for row in ids for t in row}
    from sentspark.operators.examples import make_batches

    got = Le.evaluate_encoder(make_batches(df, 16), vectors, batches_per_group=4).first()
    assert got.n_groups == 4 and got.loss is not None
