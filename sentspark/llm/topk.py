"""Exact top-k inner products over vectors sorted by length.

Components become integers, ``floor(1024 * x)``, so scores are exact. Vectors are
range-partitioned by descending length and cut into blocks. The block of the longest
vectors gives each query a first threshold (its k-th best score there) and a rotation: its
leading right singular vectors. A query block meets a candidate block only if the longest
query-candidate product could reach some query's threshold. Within a pair of blocks the
rotated leading coordinates give partial sums; by Cauchy-Schwarz the rest adds at most the
product of the residual lengths, and only pairs whose bound reaches the threshold are
scored in full.

Candidate blocks are dealt by number and written, so that long vectors are not neighbours.
Every task streams the query blocks, of a group of at most ``GROUP`` numbers at a time, past
the candidate blocks it reads, so neither side passes through the driver or one task. Only
the first block, of at most ``CELLS`` numbers, is collected and sent to all tasks.

Vectors that are null or hold a null or non-finite component, and rows without an id, take
no part. Only vectors of the same length of array are compared. A row is no candidate for
queries of its own id; rows that share an id count once each as candidates, and as
queries they are ranked together. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.frames import buckets
from sentspark.session import ship_package
from sentspark.storage import materialise

#: Numbers in a block of vectors.
CELLS = 1 << 16
#: Numbers of query vectors that a task streams past its candidate blocks.
GROUP = 1 << 20
#: Rotated coordinates that bound a score.
LEADING = 16
SCALE = 1024
K, EVERY = 10, 100

_BLOCK = "block long, dim int, longest double, ids binary, vectors binary"


def integer_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``v`` (integers), ``dim`` and ``length`` of the vectors that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    usable = vectors.filter(x.isNotNull() & F.col(id).isNotNull() & ~bad)
    return usable.select(F.col(id).cast("long").alias("id"), whole.alias("v"), F.size(x).alias("dim")).withColumn(
        "length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double")))
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of neighbouring rows; each block has one ``dim``."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
            length, lists = batch.column("length").to_numpy(), batch.column("v")
            flat, first = lists.values.to_numpy(), lists.offsets.to_numpy()
            start = 0
            while start < len(dims):
                dim = int(dims[start])
                same = np.flatnonzero(dims[start:] != dim)
                end = min(start + max(CELLS // max(dim, 1), 1), start + int(same[0]) if len(same) else len(dims))
                yield pa.record_batch(
                    {
                        "block": pa.array([number], pa.int64()),
                        "dim": pa.array([dim], pa.int32()),
                        "longest": pa.array([float(length[start:end].max())]),
                        "ids": pa.array([ids[start:end].tobytes()], pa.binary()),
                        "vectors": pa.array([flat[first[start] : first[end]].tobytes()], pa.binary()),
                    }
                )
                start, number = end, number + 1

    return rows.select("id", "v", "dim", "length").mapInArrow(run, _BLOCK)


def _read(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), dim)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum stays under 2**53."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Leading right singular vectors, as columns."""
    return np.linalg.svd(vectors.astype(np.float64), full_matrices=False)[2][:LEADING].T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def thresholds(q_ids, q, ids, vectors, k: int) -> np.ndarray:
    """Each query's k-th best score in a block, or minus infinity."""
    scores = _product(q, vectors).astype(np.float64)
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(q), -np.inf)
    return np.partition(scores, -k, axis=1)[:, -k]


def search(q_ids, q, least, ids, c, turn, k: int):
    """Query, candidate and score of all pairs that may be among the query's best ``k``."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    ql, cl = np.sqrt((qf**2).sum(1)), np.sqrt((cf**2).sum(1))
    qh, ch = qf @ turn, cf @ turn
    qr = np.sqrt(np.maximum(ql**2 - (qh**2).sum(1), 0))
    cr = np.sqrt(np.maximum(cl**2 - (ch**2).sum(1), 0))
    slack = 1e-9 * np.outer(ql, cl) + 1e-3
    possible = qh @ ch.T + np.outer(qr, cr) + slack >= least[:, None]
    possible &= q_ids[:, None] != ids[None, :]
    hit = np.flatnonzero(possible.any(0))
    if not len(hit):
        return
    scores, ids, possible = _product(q, c[hit]), ids[hit], possible[:, hit]
    for i in np.flatnonzero(possible.any(1)):
        some = np.flatnonzero(possible[i] & (scores[i] >= least[i]))
        top = some[_best(scores[i][some], ids[some], k)]
        if len(top):
            yield np.full(len(top), q_ids[i]), ids[top], scores[i][top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; both inputs from :func:`integer_vectors`."""
    spark = vectors.sparkSession
    n = buckets(spark)
    ordered = vectors.repartitionByRange(n, F.desc("length")).sortWithinPartitions("dim", F.desc("length"), "id")
    blocks = materialise(_blocks(ordered).repartition(n, "block"), "topk-blocks")
    results = None
    numbers = queries.agg(F.sum("dim")).first()[0] or 0
    groups = max(-(-numbers // GROUP), 1)
    asked = materialise(_blocks(queries.repartition(groups, "id").sortWithinPartitions("dim", "id")), "topk-queries")
    for dim in [r.dim for r in asked.select("dim").distinct().orderBy("dim").toLocalIterator()]:
        found = _search_dim(blocks.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim), dim, k, groups)
        results = found if results is None else results.union(found)
    if results is None:
        results = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _first(blocks: DataFrame) -> Row:
    """The block of the longest vectors: found by its number, so that no other comes to the driver."""
    number = blocks.select("longest", "block").orderBy(F.desc("longest"), "block").first().block
    return blocks.filter(F.col("block") == number).select("ids", "vectors").first()


def _search_dim(blocks: DataFrame, asked: DataFrame, dim: int, k: int, groups: int) -> DataFrame:
    first = _first(blocks)
    top_ids, top = _read(bytes(first.ids), bytes(first.vectors), dim)
    turn = rotation(top) if dim else np.zeros((0, 0))

    def prepare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _read(row["ids"], row["vectors"], dim)
                least = thresholds(q_ids, q, top_ids, top, k)
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need = np.where(length > 0, least / np.maximum(length, 1e-9), np.where(least > 0, np.inf, -np.inf))
                yield pa.record_batch(
                    {
                        "need": pa.array([float(need.min()) * (1 - 1e-9) - 1e-3 if need.min() > 0 else -1.0]),
                        "q_ids": pa.array([row["ids"]], pa.binary()),
                        "queries": pa.array([row["vectors"]], pa.binary()),
                        "least": pa.array([least.tobytes()], pa.binary()),
                    }
                )

    ready = asked.mapInArrow(prepare, "need double, q_ids binary, queries binary, least binary")
    ready = materialise(ready, "topk-ready").coalesce(groups)
    pairs = blocks.hint("shuffle_replicate_nl").join(ready, blocks["longest"] >= ready["need"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _read(row["q_ids"], row["queries"], dim)
                ids, c = _read(row["ids"], row["vectors"], dim)
                found = list(search(q_ids, q, np.frombuffer(row["least"], np.float64), ids, c, turn, k))
                if found:
                    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.record_batch({"query_id": a, "vec_id": b, "score": s})

    return pairs.select("ids", "vectors", "q_ids", "queries", "least").mapInArrow(
        run, "query_id long, vec_id long, score long"
    )


ORACLE = f"""
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {EVERY} = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= {K}"""


@query("op8_norm_sorted_topk", ORACLE)
def op8_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("id") % EVERY == 0))
