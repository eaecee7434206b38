"""Helpers of the operators: documents with a key, spans joined back to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that stands for this part of all rows, or more, is hot.
HOT = 500


def keyed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``tk`` (a hash that tells rows of one id apart) and ``data`` (bytes)."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tk"), body.alias("data"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tk"] == b["tk"])


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_rows(counted: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The rows of ``counted`` (one for each key) that stand for a ``HOT``-th of ``total`` or more.

    As the counts of all keys add up to ``total`` at most, these are ``2 * HOT`` rows at most.
    """
    return counted.filter(F.col(n) >= max(total // HOT, 2))


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key``.

    ``hot`` are the rows of ``right`` (or of a superset of its columns) with hot keys, of bounded
    number: rows of ``left`` with such a key stay where they are, all others are dealt by the key.
    """
    keys = F.broadcast(hot.select(key))
    stay = left.join(F.broadcast(hot.select(*right.columns)), key)
    dealt = left.join(keys, key, "left_anti").join(right, key, how)
    return stay.unionByName(dealt)


def buckets(spark) -> int:
    """Buckets of packed rows: one per shuffle partition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
