"""Corpus preparation as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sentspark.operators.corpus import dedup_lines, train_test_split
from sentspark.storage import materialise


def prepare_corpus(
    df: DataFrame,
    dedup: bool = True,
    test_size: float = 0.1,
    seed: int = 42,
    text: str = "text",
    id: str = "sent_id",
) -> DataFrame:
    """Unique lines with their ``split``. The unique lines are written once and the
    split reads them back, so the duplicate removal runs only once."""
    kept = dedup_lines(df, text, id) if dedup else df.select(id, text)
    return train_test_split(materialise(kept, "unique-lines"), test_size, seed, id)
