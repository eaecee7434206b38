import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sentspark.functions import vectors as Vc
from sentspark.operators import examples as E


def frame(spark, lengths):
    rows = [(i, [5 + (i + j) % 90 for j in range(n)]) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "sent_id bigint, ids array<int>").repartition(4)


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_masking_against_brute_force(spark):
    lengths = [0, 1, 3, 10, 30, 70, 129, 5]
    for r in E.mlm_examples(frame(spark, lengths), 100, epoch=3).collect():
        n = len(r.ids)
        assert r.attention_mask == [1] * n
        keys = [md5("42:mlm:3", r.sent_id, i) for i in range(n)]
        k = max(1, int(round(n * 0.15)))
        picked = set(sorted(range(n), key=keys.__getitem__)[:k])
        inputs, labels = [], []
        for i, token in enumerate(r.ids):
            u, v = int(keys[i][16:24], 16) / 2**32, int(keys[i][24:32], 16) / 2**32
            new = 0 if u < 0.8 else int(v * 100) if u < 0.9 else token
            inputs.append(new if i in picked else token)
            labels.append(token if i in picked else 1)
        assert (r.input_ids, r.labels) == (inputs, labels)


def test_predicted_count_rounds_half_to_even(spark):
    df = spark.range(400).select("id", E.predicted_count(F.col("id").cast("int")).alias("k"))
    assert all(r.k == max(1, int(round(r.id * 0.15))) for r in df.collect())


def test_mask_rule_shares(spark):
    df = frame(spark, [100] * 400)
    rows = E.mlm_examples(df, 1000).select(F.explode(F.arrays_zip("ids", "input_ids", "labels")).alias("t"))
    r = rows.filter("t.labels <> 1").agg(
        F.avg((F.col("t.input_ids") == 0).cast("int")), F.avg((F.col("t.input_ids") == F.col("t.ids")).cast("int"))
    ).first()
    assert abs(r[0] - 0.8) < 0.02 and abs(r[1] - 0.1) < 0.02


def test_batches_and_padding(spark):
    df = E.contrastive_examples(frame(spark, [i % 17 for i in range(1000)]))
    batches = E.make_batches(df, 32, buffer=128)
    by_block = E.pad_batches(batches, by=("block", "batch_id")).collect()
    plain = E.pad_batches(batches).collect()
    assert sorted((r.sent_id, r.ids) for r in by_block) == sorted((r.sent_id, r.ids) for r in plain)
    groups = defaultdict(list)
    for r in plain:
        groups[r.batch_id].append(r)
    assert sorted(len(g) for g in groups.values()) == [1000 % 32] + [32] * (1000 // 32)
    for g in groups.values():
        tokens = [(r.sent_id % 17) + 2 for r in g]
        for r, n in zip(g, tokens):
            assert len(r.ids) == len(r.padding_mask) == max(tokens)
            assert r.padding_mask == [False] * n + [True] * (max(tokens) - n)
            assert r.ids[0] == 3 and r.ids[n - 1] == 4 and r.ids[n:] == [1] * (max(tokens) - n)


def test_batch_cap_equals_a_filter(spark):
    df = frame(spark, [3] * 700)
    every = {(r.sent_id, r.batch_id) for r in E.make_batches(df, 32, buffer=64).collect()}
    capped = {(r.sent_id, r.batch_id) for r in E.make_batches(df, 32, buffer=64, max_batches=5).collect()}
    assert capped == {x for x in every if x[1] < 5} and len(capped) == 160
    assert E.make_batches(df, 32, max_batches=0).count() == 0


def test_epochs_differ(spark):
    df = frame(spark, [40] * 50)
    a, b = (E.mlm_examples(df, 100, epoch=e).orderBy("sent_id").collect() for e in (0, 1))
    assert any(x.labels != y.labels for x, y in zip(a, b))


def test_one_hot_rejects_out_of_range(spark):
    df = spark.createDataFrame([(0,), (2,)], "i int")
    assert [r[0] for r in df.select(Vc.one_hot("i", 3)).collect()] == [[1, 0, 0], [0, 0, 1]]
    with pytest.raises(Exception, match="outside"):
        df.select(Vc.one_hot("i", 2)).collect()


def test_inference_batches_keep_order_and_mark_tokens(spark):
    rows = E.inference_batches(frame(spark, [1 + i % 5 for i in range(200)]), 64).collect()
    for r in rows:
        n = 1 + r.sent_id % 5
        assert r.batch_id == r.sent_id // 64
        assert r.attention_mask == [1] * n + [0] * (5 - n) and r.ids[n:] == [1] * (5 - n)
    with pytest.raises(ValueError):
        E.pad_batches(frame(spark, [1]), mask="other")


def test_labels_are_padded_with_the_ids(spark):
    df = E.mlm_examples(frame(spark, [3, 9]), 100).withColumn("batch_id", F.lit(0))
    for r in E.pad_batches(df, "input_ids", "labels").collect():
        n = len(r.ids)
        assert len(r.input_ids) == len(r.labels) == 9 and r.labels[n:] == [1] * (9 - n)


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("Exchange hashpartitioning") + final.count("Exchange rangepartitioning")


def test_batches_move_the_rows_once(spark):
    df = E.contrastive_examples(frame(spark, [1 + i % 17 for i in range(3000)]))
    want = {r.sent_id: (r.batch_id, tuple(r.ids)) for r in E.pad_batches(E.make_batches(df, 32, buffer=128)).collect()}
    once = E.pad_batches(E.make_batches(df, 32, buffer=128), by=("bucket", "batch_id"))
    assert _exchanges(once) == 1
    assert {r.sent_id: (r.batch_id, tuple(r.ids)) for r in once.collect()} == want
    assert _exchanges(E.inference_batches(df, 64)) == 1
    # rows of later buckets are not moved
    few = E.make_batches(df, 32, buffer=128, max_batches=2)
    assert _exchanges(few) == 1 and {r.sent_id for r in few.collect()} == {k for k, (b, _) in want.items() if b < 2}


@pytest.mark.parametrize("batch", [7, 48, 500])
def test_batches_across_blocks_stay_in_one_bucket(spark, batch):
    df = frame(spark, [1 + i % 11 for i in range(2000)])
    rows = E.pad_batches(E.make_batches(df, batch, buffer=32), by=("bucket", "batch_id")).collect()
    assert sorted(r.shuffled for r in rows) == list(range(2000))
    longest = defaultdict(int)
    for r in rows:
        longest[r.batch_id] = max(longest[r.batch_id], 1 + r.sent_id % 11)
        assert r.batch_id == r.shuffled // batch
    assert all(len(r.ids) == longest[r.batch_id] for r in rows)
