import pyarrow.parquet as pq
import pytest

from sentspark.catalog import QUERIES, load
from sentspark.streaming.dedup import dedup_stream, run_available


def test_stream_keeps_each_text_once(spark, tmp_path):
    rows = [("a",), ("b",), ("a",), ("A",)]
    for i in range(2):
        spark.createDataFrame(rows + [(f"only{i}",)], "text string").write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in/*"))
    out = run_available(dedup_stream(stream))
    assert sorted(r.text for r in out.collect()) == ["A", "a", "b", "only0", "only1"]


def test_watermarked_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "text string, ts string").selectExpr("text", "cast(ts as timestamp) ts")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = run_available(dedup_stream(stream, event_time="ts", delay="1 hour"))
    assert sorted(r.text for r in out.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        dedup_stream(stream, event_time="ts")


def test_late_copy_does_not_hide_an_on_time_text(spark, tmp_path):
    def arrive(n, rows):
        df = spark.createDataFrame(rows, "text string, ts string").selectExpr("text", "cast(ts as timestamp) ts")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    def run():
        stream = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in/*"))
        return run_available(dedup_stream(stream, event_time="ts", delay="1 minute"), path=str(tmp_path / "out"))

    arrive(0, [("first", "2024-01-01 12:00:00")])
    run()
    arrive(1, [("x", "2024-01-01 10:00:00"), ("x", "2024-01-01 12:05:00"), ("first", "2024-01-01 12:00:30")])
    # the second run goes on where the first one ended
    assert sorted(r.text for r in run().collect()) == ["first", "x"]


def test_stream_dedup_reads_one_file_and_a_folder_of_files(spark, tmp_path):
    load()
    docs = spark.createDataFrame([(1, "a\nb"), (2, "b\nc"), (3, None), (4, "a")], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder/documents.parquet"))
    pq.write_table(docs.toArrow(), tmp_path / "documents.parquet")
    for path in (tmp_path / "folder", tmp_path):
        got = QUERIES["stream_dedup"](spark, str(path)).collect()
        assert sorted(r.text for r in got) == ["a", "b", "c"]
