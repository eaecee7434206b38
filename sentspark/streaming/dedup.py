"""Duplicate removal on arriving text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentspark.storage import new_path


def dedup_stream(
    df: DataFrame, text: str = "text", event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """First arrival of each text of a streaming ``df``.

    Without an event time every distinct text stays in the state for good; on large
    streams set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB store. With one, and
    a ``delay``, texts are forgotten once the watermark has passed them, and a copy that
    arrives later than that counts as new.
    """
    if event_time is None:
        return _collapsed(df, text).dropDuplicates([text])
    if delay is None:
        raise ValueError("an event time needs a delay")
    kept = _collapsed(df, text, event_time).withWatermark(event_time, delay)
    return kept.dropDuplicatesWithinWatermark([text])


def _collapsed(df: DataFrame, text: str, event_time: str | None = None) -> DataFrame:
    """Drop copies within each Arrow batch, before the shuffle to the state.

    Streaming duplicate removal has no partial step of its own, so without this every
    copy of a hot text would go to one task. With an event time the latest copy stays: the
    watermark drops late rows only afterwards, and must not take an on-time text with it.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(text).dictionary_encode().indices.fill_null(-1).to_numpy()
            order = np.arange(len(codes))
            if event_time is not None:
                times = b.column(event_time).cast(pa.int64()).fill_null(-(1 << 62)).to_numpy()
                order = np.argsort(-times, kind="stable")
            _, first = np.unique(codes[order], return_index=True)
            yield b.take(pa.array(np.sort(order[first])))

    return df.mapInArrow(collapse, df.schema)


def run_available(stream: DataFrame, label: str = "stream", path: str | None = None) -> DataFrame:
    """Process what has arrived, and return the table written so far.

    Output and progress lie at ``path``, or in a new folder of the shared one. A restarted
    driver that names the same path goes on from the last finished batch.
    """
    spark = stream.sparkSession
    out = path or new_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
