"""Token vectors, chunked embeddings and their stamps."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentspark.functions.vectors import l2_normalize
from sentspark.operators import learn as Le
from sentspark.plans.embed import embed_in_chunks
from sentspark.sources import embeddings as E
from sentspark.storage import provenance, read_or_build


def rows(n=60):
    rng = np.random.default_rng(3)
    out = [(i, [int(x) for x in rng.zipf(1.6, rng.integers(0, 12)) if x < 40]) for i in range(n)]
    return out + [(n, []), (n + 1, None), (n + 2, [7]), (n + 3, [5, 5, 5, 5])]


def counted(data, window):
    counts = Counter()
    for _, ids in data:
        for i, a in enumerate(ids or []):
            for d in range(1, window + 1):
                if i + d < len(ids):
                    counts[a, ids[i + d]] += window + 1 - d
                    counts[ids[i + d], a] += window + 1 - d
    return counts


def test_cooccurrences_and_vectors_equal_plain_sums(spark):
    data = rows()
    df = spark.createDataFrame(data, "sent_id bigint, ids array<int>")
    counts = counted(data, 3)
    got = {(r.token, r.context): r.n for r in Le.cooccurrences(df, 3).collect()}
    assert got == dict(counts)
    alone, every = Counter(), sum(counts.values())
    for (a, _), n in counts.items():
        alone[a] += n
    q = {p: round(1024 * math.log(n * every / (alone[p[0]] * alone[p[1]]))) for p, n in counts.items()}
    weights = {(r.token, r.context): r.q for r in Le.association(Le.cooccurrences(df, 3)).collect()}
    assert weights == {p: x for p, x in q.items() if x > 0}
    signs = {r.t: r.u for r in spark.range(40).select(F.col("id").alias("t"), Le._signs(F.col("id"), 8, 42).alias("u")).collect()}
    vectors = {r.token: np.array(r.vector) for r in Le.fit_encoder(df, dim=8, window=3).collect()}
    for token in {a for a, _ in weights}:
        x = sum(w * np.array(signs[c], float) for (a, c), w in weights.items() if a == token)
        length = np.sqrt((x * x).sum())
        want = np.round(x * Le.UNIT / length) / Le.UNIT if length else x
        assert np.abs(vectors.pop(token) - want).max() <= 1 / Le.UNIT
    assert not vectors


def test_vectors_do_not_depend_on_the_partitioning(spark):
    df = spark.createDataFrame(rows(), "sent_id bigint, ids array<int>")
    results = [
        sorted((r.token, tuple(r.vector)) for r in Le.fit_encoder(df.repartition(n), dim=16, epochs=3).collect()) for n in (1, 4, 16)
    ]
    assert results[0] == results[1] == results[2] and results[0]


def test_rare_tokens_and_empty_tables(spark):
    data = [(0, [1, 9, 2]), (1, [1, 2]), (2, [2, 1, 8])]
    df = spark.createDataFrame(data, "sent_id bigint, ids array<int>")
    kept = Le._without_rare(df, "ids", 2)
    assert sorted(r.ids for r in kept.collect()) == [[1, 2], [1, 2], [2, 1]]
    assert {r.token for r in Le.fit_encoder(df, dim=4, min_count=2).collect()} <= {1, 2}
    assert Le.fit_encoder(df.limit(0), dim=4, epochs=2).count() == 0


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(i * 7, f"t{i}") for i in range(97)], "sent_id bigint, text string").repartition(5)


def number(df):
    return df.select("vec_id", F.array(F.lit(3.0), F.substring("text", 2, 9).cast("double")).alias("embedding"))


def test_chunks_are_full_and_resumed(spark, lines, tmp_path):
    path, built = str(tmp_path / "corpus"), []

    def embed(df):
        built.append(1)
        return number(df)

    embedded, manifest = embed_in_chunks(lines, embed, path, "one", size=10, segments=3)
    assert [tuple(r) for r in manifest.orderBy("chunk_id").collect()] == [
        (k, min(10, 97 - 10 * k), 10 * k, min(10 * k + 9, 96)) for k in range(10)
    ]
    assert len(built) == 3
    got = {r.vec_id: (r.embedding, r.norm) for r in embedded.collect()}
    assert len(got) == 97 and all(abs(np.hypot(*e) - 1) < 1e-6 and np.isclose(n, np.hypot(3, i)) for i, (e, n) in got.items())
    # one segment is lost: only it is built again; another stamp builds all
    spark.createDataFrame([("",)], "value string").coalesce(1).write.mode("overwrite").text(E._segment(path, 1) + ".stamp")
    embed_in_chunks(lines, embed, path, "one", size=10, segments=3)
    assert len(built) == 4
    embed_in_chunks(lines, embed, path, "two", size=10, segments=3)
    assert len(built) == 7
    none, manifest = embed_in_chunks(lines.limit(0), embed, str(tmp_path / "none"), "one", size=10)
    assert none.count() == 0 and manifest.count() == 0


def test_provenance_tells_inputs_and_settings_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    df = spark.read.parquet(path)
    first = provenance(df, seed=1, size=2)
    assert first == provenance(df, size=2, seed=1)
    assert len({first, provenance(df, seed=2, size=2), provenance(df, "made of that", seed=1, size=2)}) == 3
    build = lambda n: lambda: spark.range(n)
    out = str(tmp_path / "out")
    assert read_or_build(spark, out, build(2), first).count() == 2
    assert read_or_build(spark, out, build(5), first).count() == 2
    assert read_or_build(spark, out, build(5), provenance(df, seed=2, size=2)).count() == 5


def test_ranges_of_settings():
    space = {"a": (1e-4, 1e-1, "log"), "b": (2, 6, 2), "c": [1, 2], "d": (0.0, 1.0)}
    drawn = [Le.draw_params(space, k) for k in range(200)]
    assert {d["b"] for d in drawn} == {2, 4, 6}
    assert all(1e-4 <= d["a"] <= 1e-1 for d in drawn) and 60 < sum(d["a"] < 10**-2.5 for d in drawn) < 140


def test_cooccurrences_of_many_windows(spark):
    data = rows()
    df = spark.createDataFrame(data, "sent_id int, ids array<int>")
    got = {(r.token, r.context): (r.n_2, r.n_6) for r in Le.cooccurrences_by_window(df, [2, 6]).collect()}
    narrow, wide = counted(data, 2), counted(data, 6)
    assert got == {p: (narrow[p], wide[p]) for p in wide}


def test_pairs_across_the_parts_of_a_task_are_counted_once(monkeypatch):
    monkeypatch.setattr(Le, "GATHERED", 7)
    data = rows()
    flat = np.array([x for _, ids in data for x in ids or []], np.int64)
    lengths = np.array([len(ids or []) for _, ids in data])
    got = Counter()
    for left, right, (n,) in Le._near(flat, lengths, np.array([[0, 3, 2, 1]])):
        for a, b, k in zip(left.tolist(), right.tolist(), n.tolist()):
            got[a, b] += k
            got[b, a] += k
    assert got == counted(data, 3)


def test_one_pass_over_the_rows_gives_the_counts(spark, monkeypatch):
    """Neighbours are counted before they leave the Python of a task: no row for each of them."""
    flat, lengths = np.zeros(1000, np.int64), np.array([1000])
    rows = list(Le._near(flat, lengths, np.array([[0, 5, 4, 3, 2, 1]])))
    assert [(list(a), list(b), [list(s) for s in n]) for a, b, n in rows] == [
        ([0], [0], [[999 * 5 + 998 * 4 + 997 * 3 + 996 * 2 + 995]])
    ]


def test_length_of_a_vector_is_found_once(spark):
    """It is the argument of the function over the components, not a part of it."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalize("v").alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0]]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "array(greatest(" in plan
