"""The encoder as one artifact: token vectors, their vocabulary, and the settings they come from.

A folder holds ``vectors`` and ``vocab`` as tables and a manifest, written last: format version,
settings, number of rows and check sum of each table. A folder without a manifest is an unfinished
save and is refused, like one whose tables differ from the manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def _sum(df: DataFrame) -> list[str]:
    """Rows and check sum of a table, whatever the order of its rows."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return [str(x) for x in row]


def save_encoder(path: str, token_vectors: DataFrame, vocab: DataFrame, **settings) -> None:
    """Write token vectors (token, vector), their vocabulary (token, id) and the settings."""
    spark = token_vectors.sparkSession
    base = path.rstrip("/")
    empty = spark.createDataFrame([], "value string")
    empty.write.mode("overwrite").text(f"{base}/manifest")
    sums = {}
    for name, df in (("vectors", token_vectors.select("token", "vector")), ("vocab", vocab.select("token", "id"))):
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        sums[name] = _sum(spark.read.parquet(f"{base}/{name}"))
    stored = json.dumps({"version": VERSION, "settings": settings, "tables": sums}, sort_keys=True)
    spark.createDataFrame([(stored,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/manifest")


def load_encoder(spark: SparkSession, path: str, **expected) -> tuple[DataFrame, DataFrame, dict]:
    """(token vectors, vocabulary, settings) of a saved encoder.

    ValueError if the save was not finished, the format is another one, a table is not the one
    that was saved, or a setting named in ``expected`` has another value.
    """
    base = path.rstrip("/")
    rows = spark.read.text(f"{base}/manifest").collect()
    if len(rows) != 1:
        raise ValueError(f"the encoder at {base} is incomplete")
    manifest = json.loads(rows[0].value)
    if manifest["version"] != VERSION:
        raise ValueError(f"the encoder at {base} has format {manifest['version']}, not {VERSION}")
    settings = manifest["settings"]
    other = {k: settings.get(k) for k, v in expected.items() if settings.get(k) != v}
    if other:
        raise ValueError(f"the encoder at {base} was made with {other}, not {expected}")
    tables = {name: spark.read.parquet(f"{base}/{name}") for name in ("vectors", "vocab")}
    for name, df in tables.items():
        if _sum(df) != manifest["tables"][name]:
            raise ValueError(f"{name} of the encoder at {base} is not the table that was saved")
    return tables["vectors"], tables["vocab"], settings
