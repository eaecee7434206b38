"""Training examples from id arrays: masking, batches, padding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentspark.functions import arrays as A
from sentspark.functions import text as T
from sentspark.functions.draws import below, uniform
from sentspark.operators.order import deal_in_order, shuffle_buffered

# Share of tokens to predict; of these, 80% become the mask token, 10% a
# random token and 10% stay.
MASK_RATIO = 0.15
MASKED_UP_TO = 0.8
RANDOM_UP_TO = 0.9

SHUFFLE_BUFFER = 2048
INFERENCE_BATCH = 64


def predicted_count(n: Column, mask_ratio: float = MASK_RATIO) -> Column:
    """At least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(mask_ratio)).cast("int"))


def mlm_examples(
    df: DataFrame,
    vocab_size: int,
    mask_ratio: float = MASK_RATIO,
    seed: int = 42,
    epoch: int | Column = 0,
    ids: str = "ids",
    id: str = "sent_id",
) -> DataFrame:
    """Add input_ids, attention_mask and labels; labels are padding where nothing is
    predicted. ``epoch`` may be a column, for rows of several epochs.

    One md5 per token gives its place in the random order (first half) and both draws
    (second half), so a row needs nothing but itself.
    """
    tokens = F.col(ids)
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    # a column of its own, as a lambda would build it again for every token
    purpose = F.concat_ws(":", F.lit(f"{seed}:mlm"), epoch.cast("string"), F.col(id).cast("string"), F.lit(""))
    keys = F.transform(tokens, lambda _, i: F.md5(F.concat("_purpose", i.cast("string"))))
    n_predicted = predicted_count(F.size(tokens), mask_ratio)
    last = F.get(F.sort_array("_keys"), n_predicted - 1)

    def corrupted(token: Column, key: Column) -> Column:
        u = uniform(key, 17)
        other = (
            F.when(u < MASKED_UP_TO, F.lit(T.MASK))
            .when(u < RANDOM_UP_TO, below(key, vocab_size, 25))
            .otherwise(token)
        )
        return F.when(key <= F.col("_last"), other).otherwise(token)

    def label(token: Column, key: Column) -> Column:
        return F.when(key <= F.col("_last"), token).otherwise(F.lit(T.PAD))

    # A row shorter than the predicted count (the empty one) has no last key.
    return (
        df.withColumn("_purpose", purpose)
        .withColumn("_keys", keys)
        .withColumn("_last", last)
        .withColumn("input_ids", F.zip_with(ids, "_keys", corrupted))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(tokens)))
        .withColumn("labels", F.zip_with(ids, "_keys", label))
        .drop("_purpose", "_keys", "_last")
    )


def contrastive_examples(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Add the start and the end id."""
    return df.withColumn(ids, A.with_bounds(ids))


def make_batches(
    df: DataFrame,
    batch_size: int,
    seed: int = 42,
    epoch: int = 0,
    buffer: int = SHUFFLE_BUFFER,
    max_batches: int = -1,
    id: str = "sent_id",
    pos: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Shuffle locally and number the batches: block, shuffled, batch_id. The last batch
    may be short.

    Pass ``pos`` if the rows carry dense positions already; otherwise they are numbered
    in the order of ``id``, dealt by the added column ``bucket`` and moved once. With
    ``max_batches`` only the blocks that can hold the first batches are shuffled; -1 keeps all.
    ``stored`` says that ``df`` is a scan of a table, which need not be written first.
    """
    kept = -(-max_batches * batch_size // buffer) * buffer if max_batches >= 0 else None
    within: tuple[str, ...] = ()
    if pos is None:
        pos, within = "pos", ("bucket",)
        # a batch that two blocks share stays in one bucket
        df = deal_in_order(df, [id], math.lcm(buffer, batch_size), stored, kept)
    elif kept is not None:
        df = df.filter(F.col(pos) < kept)
    out = shuffle_buffered(df, pos, seed, epoch, buffer, within=within).withColumn(
        "batch_id", F.floor(F.col("shuffled") / F.lit(batch_size)).cast("bigint")
    )
    return out.filter(F.col("batch_id") < max_batches) if max_batches >= 0 else out


def pad_batches(
    df: DataFrame,
    ids: str = "ids",
    labels: str | None = None,
    by: tuple[str, ...] = ("batch_id",),
    pad_id: int = T.PAD,
    mask: str = "padding",
) -> DataFrame:
    """Pad every row to the longest of its batch.

    Adds ``padding_mask``, true on padding, or with ``mask="attention"`` the opposite
    ``attention_mask``, 1 on tokens, as encoders take it.

    If the rows are already dealt by a column whose groups hold whole batches, as by the
    ``bucket`` of :func:`make_batches`, pass ``by=("bucket", "batch_id")``: no further
    shuffle is needed then.
    """
    if mask not in ("padding", "attention"):
        raise ValueError(f"mask must be 'padding' or 'attention', not {mask!r}")
    make_mask = A.padding_mask if mask == "padding" else A.attention_mask
    length = F.max(F.size(ids)).over(Window.partitionBy(*by))
    out = df.withColumn("batch_length", length).withColumn(
        f"{mask}_mask", make_mask(ids, F.col("batch_length"))
    )
    for column in [ids] + ([labels] if labels else []):
        out = out.withColumn(column, A.pad(column, F.col("batch_length"), pad_id))
    return out


def inference_batches(
    df: DataFrame,
    batch_size: int = INFERENCE_BATCH,
    ids: str = "ids",
    id: str = "sent_id",
    stored: bool = False,
) -> DataFrame:
    """Batches in the order of ``id``, unshuffled, padded, with an attention mask.

    The rows move once; ``stored`` as for :func:`make_batches`.
    """
    numbered = deal_in_order(df, [id], batch_size, stored)
    batch = F.floor(F.col("pos") / F.lit(batch_size)).cast("bigint")
    return pad_batches(numbered.withColumn("batch_id", batch), ids, by=("bucket", "batch_id"), mask="attention")
