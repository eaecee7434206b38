"""The driver of the top-k search sees one block, however many queries and partitions there are."""

import numpy as np
from pyspark.sql import functions as F


def _vectors(spark, n=3000, dim=16):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=dim) * (1 + i % 7)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(12)


def test_queries_are_not_copied_to_slots_or_broadcast(spark):
    from sentspark.llm import topk

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        usable = topk.integer_vectors(_vectors(spark))
        found = topk.top_k(usable, usable.filter(F.col("id") % 50 == 0))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Generate" not in plan
        got = sorted(tuple(r) for r in found.collect())
        v = {r.id: np.array(r.v) for r in usable.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for q in range(0, 3000, 50):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[: topk.K]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_only_the_first_block_comes_to_the_driver(spark, monkeypatch):
    from sentspark.llm import topk

    monkeypatch.setattr(topk, "CELLS", 64)
    usable = topk.integer_vectors(_vectors(spark, 400))
    blocks = topk._blocks(usable.repartitionByRange(8, F.desc("length")).sortWithinPartitions("dim", F.desc("length"), "id"))
    first = topk._first(topk.materialise(blocks, "topk-test"))
    ids, _ = topk._read(bytes(first.ids), bytes(first.vectors), 16)
    longest = [r.id for r in usable.orderBy(F.desc("length"), "id").limit(4).collect()]
    assert ids.tolist() == longest
