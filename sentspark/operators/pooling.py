"""Sentence vectors: mean pooling and encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentspark.functions import ragged as R
from sentspark.functions import vectors as V

# Largest table of token vectors sent to every executor (values; 4 bytes each).
BROADCAST_VALUES = 32_000_000
TOKEN_SALT = 32
# Values gathered at once while pooling a batch.
_BLOCK_VALUES = 4_000_000
# Sentences per call of a caller's encoder, and those put in order of their length at once.
ENCODER_BATCH = 64
ENCODER_POOL = 4096
ENCODER_POOL_CHARS = 16_000_000


def mean_pool(df: DataFrame, group: str | list[str], vector: str, mask: str | None = None) -> DataFrame:
    """Mean of the vectors of each group whose mask is 1: the group columns, embedding.

    A group without such a vector gives a zero vector. One buffer per group and partial
    sums before the shuffle, so one large group is no burden.
    """
    keys = [group] if isinstance(group, str) else group
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    weighted = F.transform(vector, lambda x: x.cast("double") * weight)
    total = vector_to_array(Summarizer.sum(F.col("_v")))
    return (
        df.select(*keys, weight.alias("_w"), array_to_vector(weighted).alias("_v"))
        .groupBy(*keys)
        .agg(total.alias("_sum"), F.greatest(F.sum("_w"), F.lit(V.MIN_COUNT)).alias("_n"))
        .select(*keys, F.transform("_sum", lambda x: x / F.col("_n")).alias("embedding"))
    )


def encode(
    df: DataFrame,
    token_vectors: DataFrame,
    ids: str = "ids",
    id: str = "sent_id",
    limit: int = BROADCAST_VALUES,
) -> DataFrame:
    """Replace the id arrays by ``embedding``, the mean vector of the known tokens.

    Token vectors (token int, vector array<float>) of at most ``limit`` values in all go
    to the executors and rows are pooled in place, without a shuffle. A larger table is
    joined, and pooled by ``id``.
    """
    first = token_vectors.select(F.size("vector").alias("d")).first()
    dim = first.d if first else 0
    rows = limit // max(dim, 1)
    table = token_vectors.select("token", "vector").limit(rows + 1).toArrow()
    if table.num_rows > rows:
        return _encode_by_join(df, token_vectors, ids, id, dim)
    tokens = table["token"].to_numpy()
    order = np.argsort(tokens)
    vectors = R.matrix(table["vector"], np.float32).reshape(len(tokens), dim)
    shared = df.sparkSession.sparkContext.broadcast((tokens[order], vectors[order]))

    @F.arrow_udf("array<double>")
    def pool(column: pa.Array) -> pa.Array:
        tokens, vectors = shared.value
        flat, lengths = R.flat_list(column, np.int64)
        if len(tokens) == 0:
            return R.list_array(np.zeros(0), np.zeros(len(lengths), int), pa.float64())
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        known = tokens[at] == flat
        out = np.zeros((len(lengths), vectors.shape[1]), np.float64)
        ends = np.cumsum(lengths)
        lo = 0
        while lo < len(lengths):
            begin = ends[lo] - lengths[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, begin + _BLOCK_VALUES // max(dim, 1), "right")))
            part = slice(begin, ends[hi - 1])
            gathered = vectors[at[part]].astype(np.float64) * known[part, None]
            total = R.sum_rows(gathered, lengths[lo:hi])
            n = R.sum_rows(known[part].astype(np.float64), lengths[lo:hi])
            out[lo:hi] = total / np.maximum(n, V.MIN_COUNT)[:, None]
            lo = hi
        return R.list_array(out.ravel(), np.full(len(lengths), vectors.shape[1]), pa.float64())

    return df.withColumn("embedding", pool(ids)).drop(ids)


def _encode_by_join(df: DataFrame, token_vectors: DataFrame, ids: str, id: str, dim: int) -> DataFrame:
    # One token may be a third of all occurrences, so both sides are salted.
    salt = F.pmod(F.xxhash64(id, "pos"), F.lit(TOKEN_SALT)).cast("int")
    occurrences = df.select(id, F.posexplode(ids).alias("pos", "token")).withColumn("salt", salt)
    salts = F.explode(F.sequence(F.lit(0), F.lit(TOKEN_SALT - 1)))
    vectors = token_vectors.select("token", "vector").withColumn("salt", salts)
    pooled = mean_pool(occurrences.join(vectors, ["token", "salt"]), id, "vector")
    zero = F.array_repeat(F.lit(0.0), dim)
    return (
        df.drop(ids)
        .join(pooled, id, "left")
        .withColumn("embedding", F.coalesce("embedding", zero))
    )


def embed_batches(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    id: str = "sent_id",
    text: str = "text",
    batch_size: int = ENCODER_BATCH,
    measure: Callable[[str], int] = len,
    lengths: bool = False,
) -> DataFrame:
    """Vectors from a caller's encoder: id, embedding.

    ``make_encoder`` runs once per task; the encoder it returns gets lists of texts and
    gives one vector per text. Texts of a task are put in order of their ``measure`` before they
    are cut into batches, ``ENCODER_POOL`` rows or ``ENCODER_POOL_CHARS`` characters at a time, so
    that a batch pads little whatever the order of the rows. With ``lengths``, the columns
    ``length`` and ``padded_to`` (the longest of its batch) tell how much: see
    :func:`padding_waste`. A null text is encoded as an empty one.
    """

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for ids, texts in _pools(batches):
            size = np.array([measure(t) for t in texts], np.int64)
            order = np.argsort(size, kind="stable")
            for lo in range(0, len(order), batch_size):
                at = order[lo : lo + batch_size]
                m = np.asarray(encoder([texts[i] for i in at]), np.float32)
                out = [ids.take(pa.array(at)), R.list_array(m.ravel(), np.full(len(m), m.shape[1]), pa.float32())]
                if lengths:
                    out += [pa.array(size[at]), pa.array(np.full(len(at), size[at].max()))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id, "embedding", "length", "padded_to"][: 4 if lengths else 2]
    kind = df.schema[id].dataType.simpleString()
    schema = f"{id} {kind}, embedding array<float>" + ", length bigint, padded_to bigint" * lengths
    return df.select(id, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(embed, schema)


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of the rows of a task, across the borders of its Arrow batches."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    chars = 0
    for b in batches:
        own, lo = b.column(1).to_pylist(), 0
        for hi, t in enumerate(own, 1):
            chars += len(t)
            if len(texts) + hi - lo >= ENCODER_POOL or chars >= ENCODER_POOL_CHARS:
                yield pa.concat_arrays([*ids, b.column(0).slice(lo, hi - lo)]), texts + own[lo:hi]
                ids, texts, chars, lo = [], [], 0, hi
        if lo < len(own):
            ids.append(b.column(0).slice(lo))
            texts += own[lo:]
    if texts:
        yield pa.concat_arrays(ids), texts


def padding_waste(encoded: DataFrame) -> DataFrame:
    """One row: n_rows, length, padded_to (sums) and waste, the share of padding in what the encoder
    got (NULL without rows). ``encoded`` comes from :func:`embed_batches` with ``lengths``."""
    length, padded = F.sum("length"), F.sum("padded_to")
    return encoded.agg(
        F.count("*").alias("n_rows"),
        length.alias("length"),
        padded.alias("padded_to"),
        F.when(padded > 0, 1 - length / padded).alias("waste"),
    )
