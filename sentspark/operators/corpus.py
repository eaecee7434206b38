"""Exact duplicates and exact-size splits of a line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentspark.functions.draws import draw_key
from sentspark.operators.order import cut_key


def dedup_lines(df: DataFrame, text: str = "text", id: str = "sent_id") -> DataFrame:
    """Each distinct text once, with the id of its first occurrence.

    A hash aggregate whose buffer is one bigint: copies collapse before the shuffle,
    so a text that holds a third of the corpus sends one row per input partition.
    """
    return df.groupBy(text).agg(F.min(id).alias(id)).select(id, text)


def dedup_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Total, unique and duplicate lines."""
    groups = df.groupBy(text).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(
        total.alias("total_lines"),
        F.count("*").alias("unique_lines"),
        (total - F.count("*")).alias("duplicate_lines"),
    )


def line_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_lines"))


def train_size(n: int, test_size: float) -> int:
    return int(n * (1 - test_size))


def train_test_split(
    df: DataFrame, test_size: float = 0.1, seed: int = 42, id: str = "sent_id"
) -> DataFrame:
    """Add ``split``: exactly ``train_size(n)`` random rows are train, the others test.

    The rows are ordered by a seeded hash and cut at the right place. Finding the cut
    takes two small aggregations; the split itself is a comparison per row, without a
    shuffle. ``df`` is read for each of the three, so pass a table, not a long plan.
    """
    key = draw_key(seed, "split", id)
    _, _, cut = cut_key(
        df.select(key.alias("_key"), id), "_key", id, lambda n: train_size(n, test_size)
    )
    return df.withColumn("split", _side(key, id, cut))


def _side(key: Column, id: str, cut: tuple[str, int] | None) -> Column:
    if cut is None:
        return F.lit("test")
    in_train = (key < F.lit(cut[0])) | ((key == F.lit(cut[0])) & (F.col(id) <= F.lit(cut[1])))
    return F.when(in_train, "train").otherwise("test")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_lines"))
