import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentspark.functions import vectors as V
from sentspark.operators import blocks as B
from sentspark.operators import pooling as P
from sentspark.operators import search as S
from sentspark.sources import embeddings as Em
from sentspark.storage import fingerprint, read_or_build

RNG = np.random.default_rng(3)
CORPUS = RNG.normal(size=(400, 8))
CORPUS[100:240] = CORPUS[7]  # a third of the rows are copies
CORPUS[300] = 0
QUERIES = np.concatenate([RNG.normal(size=(11, 8)) * 3, CORPUS[7:8], np.zeros((1, 8))])


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def vectors(spark, m, id="vec_id", name="embedding", parts=5):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{id} bigint, {name} array<double>").repartition(parts)


def brute(k):
    sims = np.round(unit(QUERIES) @ unit(CORPUS).T, 12)
    out = []
    for q, row in enumerate(sims):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        out += [(q, rank + 1, i) for rank, i in enumerate(order)]
    return out


def hits(df):
    return sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 150, 1000])
@pytest.mark.parametrize("how", [{}, {"limit": 3, "slice_rows": 60}, {"limit": 0}])
def test_search_against_brute_force(spark, k, how):
    q = vectors(spark, QUERIES, "query_id")
    assert hits(S.semantic_search(q, vectors(spark, CORPUS), k, **how)) == brute(k)


@pytest.mark.parametrize("parts", [1, 16])
def test_search_does_not_depend_on_partitions_or_blocks(spark, parts, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK_CELLS", 100)
    q = vectors(spark, QUERIES, "query_id")
    assert hits(S.semantic_search(q, vectors(spark, CORPUS, parts=parts), 10)) == brute(10)


def test_long_vectors_are_sliced_by_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_VALUES", 5 * 8)
    monkeypatch.setattr(B, "BLOCK_VALUES", 60 * 8)
    monkeypatch.setattr(B, "GROUP_VALUES", 7 * 8)
    q, c = vectors(spark, QUERIES, "query_id"), vectors(spark, CORPUS)
    assert S._query_matrix(q, ["embedding"], 10_000) is None
    sizes = [r.n for r in B.corpus_blocks(c).select("n").collect()]
    assert sum(sizes) == 400 and max(sizes) <= 60
    assert B.query_blocks(q, ["embedding"]).rdd.getNumPartitions() == 2
    assert hits(S.semantic_search(q, c, 10)) == brute(10)


def test_the_corpus_is_not_shuffled_for_many_queries(spark):
    q = vectors(spark, QUERIES, "query_id")
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(CORPUS)], "vec_id bigint, embedding array<double>")
    met = B.meet(B.corpus_blocks(c), B.query_blocks(q, ["embedding"]), ["embedding"], lambda p: iter(()), S.HITS)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_chunks_that_a_task_holds_whole_stay_there(spark):
    """400 rows in the order of their ids in four tasks, chunks of 30: only those at the borders of
    tasks, and the last one, which is short, are exchanged."""
    rows = [(i // 30, [float(x) for x in v]) for i, v in enumerate(CORPUS)]
    chunks = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "chunk_id bigint, embedding array<double>")
    blocks = B.chunk_blocks(chunks, 30)
    assert sorted(r.n for r in blocks.select("n").collect()) == [10] + [30] * 13
    stored = spark.read.parquet(next(f for f in blocks.inputFiles()).rsplit("/", 1)[0])
    # borders at 100, 200 and 300; of these 300 is also a border of chunks
    assert sorted(r.chunk_id for r in stored.filter("not complete").collect()) == [3, 3, 6, 6, 13]


@pytest.mark.parametrize("order", [1, -1, 7])
def test_chunks_in_any_order_are_put_together(order, monkeypatch):
    monkeypatch.setattr(B, "HELD_CHUNKS", 2)
    n, size = 90, 10
    at = np.arange(n)[::order] if abs(order) == 1 else np.arange(n) * order % n
    chunks, found = B._Chunks(size), []
    for lo in range(0, n, 8):
        ids = at[lo : lo + 8]
        found += chunks.add(ids // size, ids[:, None].astype(float))
        assert chunks.rows <= 2 * size
    found += chunks.rest()
    assert sorted(int(x) for _, v, _ in found for x in v[:, 0]) == list(range(n))
    assert all((v[:, 0] // size == c).all() for c, v, _ in found)
    assert all(len(v) == size for _, v, whole in found if whole)
    assert abs(order) != 1 or all(whole for _, _, whole in found)


def test_more_queries_than_a_broadcast_takes(spark):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(10_001, 4)), rng.normal(size=(300, 4))
    q = vectors(spark, q, "query_id")
    got = S.semantic_search(q, vectors(spark, c), 3)
    want = S.semantic_search(q, vectors(spark, c), 3, limit=20_000)
    assert got.count() == 30_003 and got.exceptAll(want).count() == 0


def test_search_with_nothing(spark):
    q, c = vectors(spark, QUERIES, "query_id"), vectors(spark, CORPUS)
    for how in ({}, {"limit": 0}):
        assert S.semantic_search(q, c.limit(0), **how).count() == 0
        assert S.semantic_search(q.limit(0), c, **how).count() == 0


def pairs(spark):
    q = vectors(spark, QUERIES, "query_id", "query")
    originals = np.concatenate([CORPUS[20:32], CORPUS[300:301]])
    return q.join(vectors(spark, originals, "query_id", "original"), "query_id"), originals


@pytest.mark.parametrize("how", [{}, {"limit": 3, "slice_rows": 70}])
def test_ranks_against_brute_force(spark, how):
    df, originals = pairs(spark)
    sims = unit(QUERIES) @ unit(CORPUS).T
    reference = (unit(QUERIES) * unit(originals)).sum(axis=1)
    want = {q: 1 + int((sims[q] > reference[q] + 1e-12).sum()) for q in range(len(QUERIES))}
    corpus = vectors(spark, CORPUS)
    assert {r.query_id: r["rank"] for r in S.rank_eval(df, corpus, **how).collect()} == want

    own = unit(originals) @ unit(CORPUS).T
    want = {q: 1 for q in range(len(QUERIES))}
    for lo in range(0, len(CORPUS), 30):
        for q in want:
            want[q] += int((sims[q, lo : lo + 30] > own[q, lo : lo + 30].max() + 1e-12).sum())
    got = S.rank_eval(df, corpus, "chunk_max", chunk_size=30, **how)
    assert {r.query_id: r["rank"] for r in got.collect()} == want


def test_rank_of_itself_is_one_and_empty_corpus(spark):
    df = vectors(spark, CORPUS[:50], "query_id", "query").withColumn("original", F.col("query"))
    assert {r["rank"] for r in S.rank_eval(df, vectors(spark, CORPUS)).collect()} == {1}
    assert {r["rank"] for r in S.rank_eval(df, vectors(spark, CORPUS).limit(0)).collect()} == {1}
    with pytest.raises(ValueError):
        S.rank_eval(df, df, mode="other")


def test_rank_metrics(spark):
    ranks = [1, 1, 1, 1, 1, 49, 1211, 1497, 1645, 13819]
    df = spark.createDataFrame(list(enumerate(ranks)), "query_id int, rank bigint")
    r = S.rank_metrics(df).first()
    assert (r.n_queries, r.hit_at_1, r.hit_at_10, r.hit_at_100, r.median_rank) == (10, 0.5, 0.5, 0.6, 25.0)
    assert round(r.mrr, 4) == 0.5023


def test_texts_of_hits_by_both_joins(spark):
    h = S.semantic_search(vectors(spark, QUERIES, "query_id"), vectors(spark, CORPUS), 3)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "vec_id bigint, text string")
    a = sorted(S.with_text(h, texts, 39).collect())
    assert a == sorted(S.with_text(h, texts, 39, limit=0).collect())
    assert len(a) == 39 and all(r.text == f"t{r.vec_id}" for r in a)


def test_query_sources(spark):
    lines = spark.createDataFrame([(0, "x"), (1, "x")], "line_no bigint, text string")
    assert sorted(map(tuple, S.query_union(spark, "lit", lines).collect())) == [(0, "lit"), (1, "x"), (2, "x")]
    assert S.query_union(spark, None, lines).count() == 2
    assert S.query_union(spark, "lit", None).count() == 1
    with pytest.raises(ValueError):
        S.query_union(spark, None, None)
    with pytest.raises(ValueError):
        S.aligned_pairs(lines, lines.limit(1))


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.l2_normalize("a").alias("n"), V.cosine("a", "b").alias("c")).collect()
    assert rows[0].n == [0.6, 0.8] and rows[1].n == [0.0, 0.0]
    assert [round(r.c, 6) for r in rows] == [0.96, 0.0]


def test_chunks_and_embedding_table(spark, tmp_path):
    df = vectors(spark, CORPUS)
    manifest = sorted(map(tuple, Em.chunk_manifest(df, 30).collect()))
    assert len(manifest) == 14 and manifest[-1] == (13, 10, 390, 399) and manifest[2] == (2, 30, 60, 89)
    Em.write_embeddings(df, str(tmp_path / "e"), 30)
    stored = Em.read_embeddings(spark, str(tmp_path / "e"))
    plan = stored.filter("chunk_id = 11")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(chunk_id), EqualTo(chunk_id,11)]" in plan
    assert hits(S.semantic_search(vectors(spark, QUERIES, "query_id"), stored, 10)) == brute(10)


def test_mean_pool_with_mask_and_empty_group(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [100.0, 100.0], 0), ("b", [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "g string, v array<double>, m int").repartition(4)
    got = {r.g: r.embedding for r in P.mean_pool(df, "g", "v", "m").collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


def test_encode_in_place_and_by_join(spark):
    ids = [[5, 6, 6], [], [99], [5, 99], [7] * 40]
    df = spark.createDataFrame(list(enumerate(ids)), "sent_id bigint, ids array<int>").repartition(3)
    table = {5: [1.0, 0.0], 6: [0.0, 3.0], 7: [2.0, 2.0]}
    tv = spark.createDataFrame(list(table.items()), "token int, vector array<float>")
    want = {0: [1 / 3, 2.0], 1: [0, 0], 2: [0, 0], 3: [1, 0], 4: [2, 2]}
    for limit in (1000, 4):
        got = {r.sent_id: r.embedding for r in P.encode(df, tv, limit=limit).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i]) for i in want)


def test_pluggable_encoder_runs_once_per_task(spark):
    def make_encoder():
        calls = []

        def encode(texts):
            calls.append(1)
            return [[len(t), len(calls)] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(200)], "sent_id bigint, text string").coalesce(1)
    rows = P.embed_batches(df, make_encoder).orderBy("sent_id").collect()
    assert [r.embedding[0] for r in rows] == list(range(200))
    assert sorted({r.embedding[1] for r in rows}) == [1, 2, 3, 4]


def test_reuse_or_rebuild(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    spark.range(5).write.parquet(source)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    for new, n in ((False, 1), (False, 1), (True, 2)):
        stamp = fingerprint(spark.read.parquet(source))
        assert read_or_build(spark, out, build, stamp, new).count() == 5
        assert len(built) == n
    spark.range(7).write.mode("append").parquet(source)
    assert read_or_build(spark, out, build, fingerprint(spark.read.parquet(source))).count() == 12
    assert len(built) == 3


def test_nan_and_null_vectors_are_no_hits(spark):
    from sentspark.operators.search import semantic_search

    rows = [(i, [float(i), 1.0]) for i in range(50)]
    rows += [(100 + i, [float("nan"), 1.0]) for i in range(10)] + [(200, None)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, embedding array<float>")
    hits = semantic_search(queries, corpus, k=10).collect()
    assert sorted(h.vec_id for h in hits) == list(range(40, 50))


@pytest.fixture
def letters():
    """An encoder: how many characters and how many letters e. Made here, as the workers cannot
    import this module."""

    def make():
        return lambda texts: [[len(t), t.count("e")] for t in texts]

    return make


def test_batches_of_an_encoder_are_even_across_arrow_borders(spark, letters):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        # short and long texts take turns
        rows = [(i, "e" * (500 if i % 2 else 3)) for i in range(256)] + [(256, None), (257, "")]
        df = spark.createDataFrame(rows, "sent_id bigint, text string").coalesce(1)
        encoded = P.embed_batches(df, letters, lengths=True)
        assert {r.sent_id: r.embedding for r in encoded.collect()} == {i: [len(t or "")] * 2 for i, t in rows}
        waste = P.padding_waste(encoded).first()
        # in the order of the rows it would be near a half
        assert waste.n_rows == 258 and waste.waste < 0.02
        assert P.padding_waste(encoded.limit(0)).first().waste is None
        assert P.embed_batches(df.limit(0), letters).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pools_are_bounded_by_rows_and_characters(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "ENCODER_POOL", 5)
    monkeypatch.setattr(P, "ENCODER_POOL_CHARS", 100)
    texts = ["a", "b" * 99, "c"] + ["d"] * 13
    batches = [pa.record_batch([pa.array(range(lo, min(lo + 6, 16))), pa.array(texts[lo : lo + 6])], ["i", "t"]) for lo in (0, 6, 12)]
    pools = [(ids.to_pylist(), t) for ids, t in P._pools(iter(batches))]
    assert [len(t) for _, t in pools] == [2, 5, 5, 4]
    assert [i for ids, _ in pools for i in ids] == list(range(16)) and [x for _, t in pools for x in t] == texts


def test_text_search_and_ranks_from_text(spark, letters):
    from sentspark.plans.search import rank_by_text, search_by_text

    embed = lambda df: P.embed_batches(df, letters, "vec_id")
    texts = ["eee", "xxx", "exx", "eex", "", "eee"]
    lines = spark.createDataFrame(list(enumerate(texts)), "vec_id bigint, text string")
    asked = [(0, "ee"), (1, None), (2, "ee"), (3, "x")]
    queries = spark.createDataFrame(asked, "query_id bigint, text string")
    found = search_by_text(queries, lines, embed(lines), embed, 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.query, r.text) for r in found) == [
        (0, 1, 0, "ee", "eee"), (0, 2, 5, "ee", "eee"), (1, 1, 0, None, "eee"), (1, 2, 1, None, "xxx"),
        (2, 1, 0, "ee", "eee"), (2, 2, 5, "ee", "eee"), (3, 1, 1, "x", "xxx"), (3, 2, 2, "x", "exx"),
    ]
    assert search_by_text(queries.limit(0), lines, embed(lines), embed).count() == 0
    pairs = spark.createDataFrame([(0, "e", "eex"), (1, "x", "x"), (2, None, "e")], "query_id bigint, query string, original string")
    for mode in ("true", "chunk_max"):
        got = {r.query_id: r["rank"] for r in rank_by_text(pairs, embed(lines), embed, mode).collect()}
        assert got[1] == 1 and got[2] == 1
    assert {r.query_id: r["rank"] for r in rank_by_text(pairs, embed(lines), embed).collect()}[0] == 3


def test_ranks_at_the_limit_are_exact():
    """Vectors about as similar as the reference: nearer than single precision tells, and farther."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 24))
    vectors = np.concatenate([base, base + 1e-8 * rng.normal(size=base.shape), base, np.zeros((1, 24))])
    vectors /= np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-12)
    query, original = vectors[:700:3] + 0.1, vectors[1:701:3]
    for part in (vectors, np.repeat(vectors[:1], 900, axis=0), vectors[:0]):
        reference = (query * original).sum(axis=1)
        want = [(v.sum(axis=1) > r + S._MARGIN).sum() for v, r in zip(part[None] * query[:, None], reference)]
        assert S._better(query, reference, part).tolist() == want


def test_counting_better_rows_needs_no_table_of_all_pairs():
    rng = np.random.default_rng(6)
    query, vectors = rng.normal(size=(2000, 8)), rng.normal(size=(2000, 8))
    tracemalloc.start()
    S._better(query, np.zeros(2000), vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000  # 2000 x 2000 numbers are 32 MB
