"""Line tables: scans of text files and of document tables, and line sinks.

Rows carry explicit ids, since a DataFrame has no positions. (doc_id, line_no) is the key;
``sent_id`` is the same as one number: packed into 64 bits where both parts fit, or dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.functions import text as T
from sentspark.operators.order import with_ordinals

# Bits of the line number in a packed id; the document's number has the other 37, with its sign.
LINE_BITS = 27
# A table below this size, one default file split, may be dealt out over the cores.
SPREAD_BYTES = 128 << 20


def _packed_id(doc_id: Column, line_no: Column) -> Column:
    most = 1 << (63 - LINE_BITS)
    fits = doc_id.isNull() | (doc_id.between(-most, most - 1) & (line_no < 1 << LINE_BITS))
    too_large = F.raise_error(
        F.concat(F.lit("ids of this document do not fit, number its lines densely: "), doc_id.cast("string"))
    ).cast("bigint")
    return F.when(fits, doc_id * F.lit(1 << LINE_BITS) + line_no).otherwise(too_large)


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """Deal the rows of a table of at most ``most`` bytes out over all cores if its files give
    fewer tasks than that. Larger tables stay as they are: their texts are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if n_bytes <= most and df.rdd.getNumPartitions() < cores else df


def lines_from_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: bool = False
) -> DataFrame:
    """One row per line of every document: sent_id, doc_id, line_no, text.

    A projection and a generator, so no shuffle; documents of any number are cut up
    where they are read. ``sent_id`` is ``doc_id * 2**27 + line_no``, which holds for documents
    below 134 million lines and numbers below 68 billion; what does not fit is an error. ``dense``
    takes any 64-bit ids (hashes, say) and any number of lines: it numbers the lines from 0
    in the order of (doc_id, line_no), which sorts the lines once. ``doc_id`` is unique.
    """
    lines = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.posexplode(T.lines(text)).alias("line_no", "text")
    )
    if dense:
        return with_ordinals(lines, ["doc_id", "line_no"], "sent_id").select("sent_id", *lines.columns)
    return lines.select(_packed_id(F.col("doc_id"), F.col("line_no")).alias("sent_id"), *lines.columns)


def read_lines(spark: SparkSession, path: str | list[str], bad_bytes: str = "drop") -> DataFrame:
    """Lines of text files: file, block, row, text.

    (file, block, row) orders the lines as they stand in the files: ``block`` is the
    byte offset of the split and ``row`` counts within the task that reads it. Use
    :func:`sentspark.operators.order.with_ordinals` for dense line numbers.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        T.valid_utf8("value", bad_bytes).alias("text"),
    )


def training_lines(df: DataFrame, max_words: int = T.MAX_WORDS, text: str = "text") -> DataFrame:
    """Trimmed lines of at most ``max_words`` words; blank lines stay, as ''."""
    return df.filter(T.within_word_limit(text, max_words)).withColumn(text, T.trim(text))


def search_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Trimmed lines without the blank ones."""
    return df.withColumn(text, T.trim(text)).filter(F.col(text) != "")


def split_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence: the other columns, ``sentence_no`` and the sentence."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(T.sentences(text)).alias("sentence_no", text))


def read_in_order(spark: SparkSession, path: str | list[str], bad_bytes: str = "drop") -> DataFrame:
    """line_no, text: the lines of text files, one file after another, numbered from 0."""
    rows = read_lines(spark, path, bad_bytes)
    return with_ordinals(rows, ["file", "block", "row"], "line_no").select("line_no", "text")


def write_lines(df: DataFrame, path: str, text: str = "text", order: str | list[str] | None = None) -> None:
    """One text per line; null texts are left out. A text that itself holds a line end would be
    read as two.

    With ``order``, the files read one after another by name give the lines in that order: rows are
    dealt by range, and a task's number is in the name of its file.
    """
    rows = df.filter(F.col(text).isNotNull())
    if order is not None:
        keys = [order] if isinstance(order, str) else order
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_split_lines(df: DataFrame, path: str, order: str | list[str], text: str = "text") -> None:
    """One folder of ordered line files per value of ``split``, as :func:`write_lines` writes
    them. One job writes them all and they are committed together."""
    keys = [order] if isinstance(order, str) else order
    rows = df.filter(F.col(text).isNotNull()).repartitionByRange(*keys).sortWithinPartitions("split", *keys)
    rows.select(F.col(text).alias("value"), "split").write.mode("overwrite").partitionBy("split").text(path)


def write_split(df: DataFrame, path: str) -> None:
    """Train and test side by side, one folder per value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
