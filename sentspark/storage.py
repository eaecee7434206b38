"""Intermediate tables: written once, read back with a short lineage.

Every table goes to the shared folder of the session, so losing an executor costs a
re-read and not a recomputation of everything before it.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder of its own. On a
    cluster a missing setting is an error, since a machine-local folder would not be
    visible to the other machines.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sentspark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """Identity of the files behind a file-based ``df``: their paths, sizes and times.

    The files are listed, one row for each; none is read.
    """
    paths = [unquote(p) for p in df.inputFiles()]
    if not paths:
        return "0:None"
    files = df.sparkSession.read.format("binaryFile").load(paths).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("time")
    )
    row = files.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("path", "size", "time").cast("decimal(38,0)")).alias("h"),
    ).first()
    return f"{row.n}:{row.h}"


def provenance(*sources: DataFrame | str, **settings) -> str:
    """The stamp of a result: of the files it is built from (or of their own stamps), and of all
    settings. Any change of either gives another stamp."""
    parts = [s if isinstance(s, str) else fingerprint(s) for s in sources]
    parts += [f"{k}={settings[k]!r}" for k in sorted(settings)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def read_or_build(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    stamp: str,
    new: bool = False,
) -> DataFrame:
    """Reuse the table at ``path`` when it was built from ``stamp``; otherwise build it.

    The stamp is written last, so an unfinished build is never reused. ``new`` forces
    a rebuild.
    """
    stamp_path = path.rstrip("/") + ".stamp"
    if not new:
        try:
            stored = [r.value for r in spark.read.text(stamp_path).limit(2).collect()]
            if stored == [stamp]:
                return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    spark.range(0).selectExpr("cast(id as string) as value").write.mode("overwrite").text(stamp_path)
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(stamp_path)
    return spark.read.parquet(path)
