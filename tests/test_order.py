import random

import pytest
from pyspark.sql import functions as F

from sentspark.operators import corpus as C
from sentspark.operators import order as O
from sentspark.plans.prepare import prepare_corpus


def ids(spark, values, parts=4):
    return spark.createDataFrame([(v,) for v in values], "sent_id bigint").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_ordinals_are_dense_and_ordered(spark, parts):
    values = random.Random(1).sample(range(10**12), 5000)
    rows = O.with_ordinals(ids(spark, values, parts), ["sent_id"]).collect()
    assert {r.sent_id: r.pos for r in rows} == {v: i for i, v in enumerate(sorted(values))}


def test_ordinals_of_nothing(spark):
    assert O.with_ordinals(ids(spark, [], 1), ["sent_id"]).count() == 0


def test_shuffles_are_permutations(spark):
    df = ids(spark, range(0, 30000, 3))
    full = [r.pos for r in O.shuffle_full(df).collect()]
    assert sorted(full) == list(range(10000))
    local = O.shuffle_buffered(O.with_ordinals(df, ["sent_id"]), buffer=64).collect()
    assert sorted(r.shuffled for r in local) == list(range(10000))
    assert all(r.pos // 64 == r.shuffled // 64 for r in local)
    assert any(r.pos != r.shuffled for r in local)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 117324])
def test_split_has_exact_size(spark, n):
    df = spark.range(n).withColumnRenamed("id", "sent_id")
    counts = {r.split: r.n_lines for r in C.split_counts(C.train_test_split(df)).collect()}
    train = int(n * (1 - 0.1))
    assert counts == {k: v for k, v in {"train": train, "test": n - train}.items() if v}


def test_split_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(O, "_FINISH_ROWS", 1)
    got = []
    for parts in (1, 4, 16):
        rows = C.train_test_split(spark.range(0, 3000, 1, parts).withColumnRenamed("id", "sent_id")).collect()
        got.append({r.sent_id: r.split for r in rows})
    assert got[0] == got[1] == got[2]
    assert sum(s == "train" for s in got[0].values()) == 2700


def test_split_adds_no_shuffle(spark):
    plan = C.train_test_split(spark.range(100).withColumnRenamed("id", "sent_id"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50} ") for i in range(3000)] + [(5000, "t1"), (5001, "T1 ")]
    df = spark.createDataFrame(rows, "sent_id bigint, text string").repartition(8)
    once = C.dedup_lines(df)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {r.text: r.sent_id for r in once.collect()} == first
    assert sorted(C.dedup_lines(once).collect()) == sorted(once.collect())
    r = C.dedup_report(df).first()
    assert (r.total_lines, r.unique_lines, r.duplicate_lines) == (3002, len(first), 3002 - len(first))


def test_dedup_report_of_nothing(spark):
    r = C.dedup_report(spark.createDataFrame([], "sent_id bigint, text string")).first()
    assert (r.total_lines, r.unique_lines, r.duplicate_lines) == (0, 0, 0)


def test_prepare_without_dedup_keeps_copies(spark):
    df = spark.createDataFrame([(i, "x") for i in range(20)], "sent_id bigint, text string")
    assert prepare_corpus(df, dedup=False).count() == 20
    assert prepare_corpus(df).count() == 1


@pytest.mark.parametrize("values", [[5], [1, 2], [1, 1, 1, 9], [1] * 7 + [10**11] * 8, list(range(9999))])
def test_weighted_median(spark, values):
    import statistics

    hist = ids(spark, values).groupBy("sent_id").agg(F.count("*").alias("n"))
    assert O.weighted_median(hist, "sent_id", "n") == statistics.median(values)


@pytest.mark.parametrize("n", [0, 1, 3, 999, 1000])
def test_rows_dealt_in_order(spark, n):
    from pyspark.sql import types as T

    values = random.Random(n).sample(range(10**6), n)
    schema = T.StructType([T.StructField(c, t) for c, t in (("s", T.StringType()), ("k", T.LongType()), ("x", T.LongType()))])
    rows = [(None if v % 7 == 0 else f"g{v % 3}", v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = O.deal_in_order(df, ["s", "k"], 3).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert {r.k: r.pos for r in got} == {r[1]: i for i, r in enumerate(order)}
    buckets = {r.pos // 3: set() for r in got}
    for r in got:
        buckets[r.pos // 3].add(r.bucket)
    assert all(len(b) == 1 for b in buckets.values())
    assert n < 999 or len({r.bucket for r in got}) > 8
    first = O.deal_in_order(df, ["s", "k"], 3, first=100).collect()
    assert {r.k: r.pos for r in first} == {r[1]: i for i, r in enumerate(order[:100])}
