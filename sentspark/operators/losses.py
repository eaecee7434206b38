"""Contrastive and masked-token losses as batch jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentspark.functions import ragged as R
from sentspark.functions import vectors as V

TEMPERATURE = 0.07
DEBIAS = 0.1
KINDS = ("info_nce", "debiased_contrastive")
# Pairs of a batch handled by one task; larger batches are cut into slices.
SLICE_PAIRS = 4_096
# Similarities held at once by a task.
_BLOCK_CELLS = 4_000_000

_SUMS = "{batch} bigint, pair_id bigint, view int, others double"


def pair_views(df: DataFrame, batch: str, pair: str, view: str, vector: str) -> DataFrame:
    """Two rows per pair, with ``view`` 0 and 1, as one row: batch, pair_id, z_i, z_j."""
    side = lambda v, name: df.filter(F.col(view) == v).select(
        batch, F.col(pair).alias("pair_id"), F.col(vector).alias(name)
    )
    return side(0, "z_i").join(side(1, "z_j"), [batch, "pair_id"])


def _others(anchors, positives, anchor_pairs, z, z_pairs, temperature):
    """For each anchor, the sum over rows z of other pairs of exp((s - s_positive) / T)."""
    s_pos = (anchors * positives).sum(axis=1)
    out = np.zeros(len(anchors))
    step = max(1, _BLOCK_CELLS // max(len(z), 1))
    for lo in range(0, len(anchors), step):
        part = slice(lo, lo + step)
        s = (anchors[part] @ z.T - s_pos[part, None]) / temperature
        other = anchor_pairs[part, None] != z_pairs[None, :]
        with np.errstate(over="ignore"):
            out[part] = np.where(other, np.exp(s), 0.0).sum(axis=1)
    return out


def _sides(t: pa.Table):
    """Both views of the pairs of a table, one below the other."""
    z_i, z_j = R.normalised(R.matrix(t["z_i"])), R.normalised(R.matrix(t["z_j"]))
    pairs = t["pair_id"].to_numpy()
    views = np.repeat(np.array([0, 1], np.int32), len(pairs))
    return np.concatenate([z_i, z_j]), np.concatenate([z_j, z_i]), np.concatenate([pairs, pairs]), views


def _anchor_sums(df: DataFrame, batch: str, temperature: float, slice_pairs: int) -> DataFrame:
    """batch, pair_id, view, others for every anchor."""
    schema = _SUMS.format(batch=batch)
    rows = df.select(F.col(batch).cast("bigint"), F.col("pair_id").cast("bigint"), "z_i", "z_j")

    def sums(t: pa.Table, z: pa.Table) -> pa.Table:
        anchors, positives, pairs, views = _sides(t)
        rows_z, _, z_pairs, _ = _sides(z)
        others = _others(anchors, positives, pairs, rows_z, z_pairs, temperature)
        ids = pa.array(np.full(len(pairs), t[batch][0].as_py()), pa.int64())
        columns = [ids, pa.array(pairs, pa.int64()), pa.array(views), pa.array(others)]
        return pa.Table.from_arrays(columns, names=[batch, "pair_id", "view", "others"])

    sizes = rows.groupBy(batch).agg(F.count("*").alias("_size"))
    if not sizes.filter(F.col("_size") > slice_pairs).head(1):
        return rows.groupBy(batch).applyInArrow(lambda t: sums(t, t), schema)

    # Some batch is too large for one task: every slice of a batch meets every other.
    n = F.ceil(F.col("_size") / F.lit(slice_pairs)).cast("bigint")
    cut = (
        rows.join(sizes, batch)
        .withColumn("_n", n)
        .withColumn("_own", F.pmod(F.xxhash64("pair_id"), F.col("_n")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
        .drop("_size", "_n")
    )
    left = cut.withColumnsRenamed({"_own": "_l", "_other": "_r"}).groupBy(batch, "_l", "_r")
    # toDF gives the second use of the rows columns of its own.
    right = cut.withColumnsRenamed({"_own": "_r", "_other": "_l"})
    right = right.toDF(*right.columns).groupBy(batch, "_l", "_r")
    empty = pa.table({batch: [], "pair_id": [], "view": [], "others": []}).cast(
        pa.schema([(batch, pa.int64()), ("pair_id", pa.int64()), ("view", pa.int32()), ("others", pa.float64())])
    )

    def slice_sums(t: pa.Table, z: pa.Table) -> pa.Table:
        return sums(t, z) if t.num_rows and z.num_rows else empty

    partial = left.cogroup(right).applyInArrow(slice_sums, schema)
    return partial.groupBy(batch, "pair_id", "view").agg(F.sum("others").alias("others"))


def _log(x: Column) -> Column:
    """Logarithm with the limits of floating point instead of NULL."""
    return (
        F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    )


def contrastive_loss(
    df: DataFrame,
    kind: str = "info_nce",
    temperature: float = TEMPERATURE,
    p: float = DEBIAS,
    batch: str = "batch_id",
    slice_pairs: int = SLICE_PAIRS,
) -> DataFrame:
    """Mean loss per batch: batch, loss. ``df`` has batch, pair_id, z_i, z_j.

    Both views of all pairs of a batch are anchors. Divided by the positive's own term,
    the losses are log(1 + S) and log(1 + S - p / (1 - p)), S being the sum over the
    rows of other pairs of exp((s - s_positive) / T).
    """
    if kind not in KINDS:
        raise ValueError(f"loss must be one of {KINDS}, not {kind!r}")
    correction = p / (1 - p) if kind == "debiased_contrastive" else 0.0
    sums = _anchor_sums(df, batch, temperature, slice_pairs)
    loss = _log(F.lit(1.0) + F.col("others") - F.lit(correction))
    return sums.groupBy(batch).agg(F.avg(loss).alias("loss"))


def info_nce(df: DataFrame, temperature: float = TEMPERATURE, batch: str = "batch_id") -> DataFrame:
    return contrastive_loss(df, "info_nce", temperature, batch=batch)


def debiased_contrastive(
    df: DataFrame, temperature: float = TEMPERATURE, p: float = DEBIAS, batch: str = "batch_id"
) -> DataFrame:
    return contrastive_loss(df, "debiased_contrastive", temperature, p, batch)


def contrastive_eval(
    df: DataFrame,
    kind: str = "debiased_contrastive",
    batches_per_group: int = 8,
    temperature: float = TEMPERATURE,
    p: float = DEBIAS,
) -> DataFrame:
    """Mean loss over full groups of consecutive batches: n_groups, loss.

    The batches of a group form one large contrastive batch. A trailing group with fewer
    batches is left out, as the evaluation defines it; without a full group the loss is
    NULL.
    """
    grouped = df.withColumn(
        "group_id", F.floor(F.col("batch_id") / F.lit(batches_per_group)).cast("bigint")
    )
    batches = grouped.select("group_id", "batch_id").distinct()
    full = (
        batches.groupBy("group_id")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") == batches_per_group)
        .select("group_id")
    )
    losses = contrastive_loss(
        grouped.join(full, "group_id", "left_semi"), kind, temperature, p, "group_id"
    )
    return losses.agg(F.count("*").alias("n_groups"), F.avg("loss").alias("loss"))


def masked_cross_entropy(
    df: DataFrame, logits: str, label: str, ignore: int, batch: str = "batch_id"
) -> DataFrame:
    """Mean over batches of the mean loss of the positions whose label is not ``ignore``:
    n_batches, loss. A batch with nothing to predict has no loss."""
    per_batch = (
        df.filter(F.col(label) != ignore)
        .groupBy(batch)
        .agg(F.avg(V.cross_entropy(logits, label)).alias("loss"))
    )
    return per_batch.agg(F.count("*").alias("n_batches"), F.avg("loss").alias("loss"))
