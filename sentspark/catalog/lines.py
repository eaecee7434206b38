"""Lines, duplicates, splits, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentspark.catalog import query
from sentspark.catalog.inputs import (
    LINES_SQL,
    TRAINING_SQL,
    document_lines,
    lines_sql,
    SPACE_SQL,
    table,
    trim_sql,
)
from sentspark.operators import corpus as C
from sentspark.operators import order as O
from sentspark.operators import search as S
from sentspark.plans.prepare import prepare_corpus
from sentspark.sources import lines as L
from sentspark.storage import new_path
from sentspark.streaming.dedup import dedup_stream, run_available

UNIQUE_SQL = "uniq AS (SELECT min(sent_id) AS sent_id, text FROM lines GROUP BY text)"


def split_sql(source: str, columns: str) -> str:
    return f"""
SELECT {columns},
       CASE WHEN row_number() OVER (ORDER BY md5('42:split:' || sent_id), sent_id)
                 <= (SELECT floor(count(*)::DOUBLE * (1 - 0.1::DOUBLE)) FROM {source})
            THEN 'train' ELSE 'test' END AS split
FROM {source}"""


@query("lines_from_documents", f"WITH {LINES_SQL} SELECT * FROM lines")
def _(spark, sf_dir):
    return document_lines(spark, sf_dir)


@query("line_count", f"WITH {LINES_SQL} SELECT count(*) AS n_lines FROM lines")
def _(spark, sf_dir):
    return C.line_count(document_lines(spark, sf_dir))


@query(
    "line_ordinals",
    f"WITH {LINES_SQL} SELECT sent_id, row_number() OVER (ORDER BY sent_id) - 1 AS pos FROM lines",
)
def _(spark, sf_dir):
    return O.with_ordinals(document_lines(spark, sf_dir).select("sent_id"), ["sent_id"])


@query("training_lines", f"WITH {LINES_SQL}, {TRAINING_SQL} SELECT sent_id, text FROM training")
def _(spark, sf_dir):
    return L.training_lines(document_lines(spark, sf_dir)).select("sent_id", "text")


@query(
    "search_corpus",
    f"WITH {LINES_SQL} SELECT sent_id, {trim_sql()} AS text FROM lines WHERE {trim_sql()} <> ''",
)
def _(spark, sf_dir):
    return L.search_lines(document_lines(spark, sf_dir)).select("sent_id", "text")


@query("dedup_lines", f"WITH {LINES_SQL}, {UNIQUE_SQL} SELECT sent_id, text FROM uniq")
def _(spark, sf_dir):
    return C.dedup_lines(document_lines(spark, sf_dir))


@query(
    "dedup_report",
    f"""WITH {LINES_SQL}
SELECT count(*) AS total_lines, count(DISTINCT text) AS unique_lines,
       count(*) - count(DISTINCT text) AS duplicate_lines FROM lines""",
)
def _(spark, sf_dir):
    return C.dedup_report(document_lines(spark, sf_dir))


@query("train_test_split", f"WITH {LINES_SQL} {split_sql('lines', 'sent_id, text')}")
def _(spark, sf_dir):
    return C.train_test_split(document_lines(spark, sf_dir).select("sent_id", "text"))


@query(
    "split_counts",
    f"WITH {LINES_SQL}, s AS ({split_sql('lines', 'sent_id')}) "
    "SELECT split, count(*) AS n_lines FROM s GROUP BY split",
)
def _(spark, sf_dir):
    return C.split_counts(C.train_test_split(document_lines(spark, sf_dir).select("sent_id")))


@query("prepare_corpus", f"WITH {LINES_SQL}, {UNIQUE_SQL} {split_sql('uniq', 'sent_id, text')}")
def _(spark, sf_dir):
    return prepare_corpus(document_lines(spark, sf_dir))


@query(
    "shuffle_full",
    f"""WITH {LINES_SQL}
SELECT sent_id, row_number() OVER (ORDER BY md5('42:shuffle:0:' || sent_id), sent_id) - 1 AS pos
FROM lines""",
)
def _(spark, sf_dir):
    return O.shuffle_full(document_lines(spark, sf_dir).select("sent_id"))


BUFFERED_SQL = f"""
{LINES_SQL},
ordinals AS (SELECT sent_id, row_number() OVER (ORDER BY sent_id) - 1 AS pos FROM lines),
shuffled AS (
  SELECT sent_id, pos, pos // 2048 AS block,
         (pos // 2048) * 2048 + row_number() OVER (
           PARTITION BY pos // 2048 ORDER BY md5('42:buffer:0:' || pos), pos) - 1 AS shuffled
  FROM ordinals
)"""


@query("shuffle_buffered", f"WITH {BUFFERED_SQL} SELECT * FROM shuffled")
def _(spark, sf_dir):
    ids = document_lines(spark, sf_dir).select("sent_id")
    return O.shuffle_buffered(O.with_ordinals(ids, ["sent_id"]))


@query("stream_dedup", f"WITH {LINES_SQL} SELECT DISTINCT text FROM lines")
def _(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").select("doc_id", "text").schema
    # as a pattern the path may name one file or a folder of files
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    return run_available(dedup_stream(L.lines_from_documents(arriving).select("text")), "unique-texts")


QUERY_UNION_SQL = f"""WITH {lines_sql('benchmark', 'item_id')}
SELECT 0::BIGINT AS query_id, 'the first query' AS text
UNION ALL
SELECT row_number() OVER (ORDER BY sent_id), {trim_sql()} FROM lines WHERE {trim_sql()} <> ''"""


@query("query_union", QUERY_UNION_SQL)
def _(spark, sf_dir):
    lines = L.search_lines(L.lines_from_documents(table(spark, sf_dir, "benchmark"), "item_id"))
    numbered = O.with_ordinals(lines.select("sent_id", "text"), ["sent_id"], "line_no")
    return S.query_union(spark, "the first query", numbered)


PAIRED_SQL = """WITH p AS (
  SELECT a.conv_id, a.turn, a.text AS query, b.text AS original
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'
)
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS query_id, query, original FROM p"""


@query("paired_eval_set", PAIRED_SQL)
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.filter(F.col("role") == "user").drop("role")
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), "text"
    )
    keys = ["conv_id", "turn"]
    queries = O.with_ordinals(asked.join(answered, keys, "left_semi"), keys, "line_no")
    originals = O.with_ordinals(answered.join(asked, keys, "left_semi"), keys, "line_no")
    return S.aligned_pairs(queries, originals)


# -- files: what is written is read back ---------------------------------------------


@query(
    "unique_line_file",
    f"""WITH {LINES_SQL}, {UNIQUE_SQL}
SELECT row_number() OVER (ORDER BY sent_id) - 1 AS line_no, text FROM uniq""",
)
def _(spark, sf_dir):
    path = new_path(spark, "unique-lines")
    L.write_lines(C.dedup_lines(document_lines(spark, sf_dir)), path, order="sent_id")
    return L.read_in_order(spark, path)


@query(
    "split_line_files",
    f"""WITH {LINES_SQL}, {UNIQUE_SQL}, split_lines AS ({split_sql('uniq', 'sent_id, text')})
SELECT split, row_number() OVER (PARTITION BY split ORDER BY sent_id) - 1 AS line_no, text FROM split_lines""",
)
def _(spark, sf_dir):
    path = new_path(spark, "split-lines")
    L.write_split_lines(prepare_corpus(document_lines(spark, sf_dir)), path, "sent_id")
    train, test = (
        L.read_in_order(spark, f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "test")
    )
    return train.unionByName(test).select("split", "line_no", "text")


@query(
    "sentence_file",
    rf"""WITH {lines_sql()}, marked AS (
  SELECT sent_id, string_split(
    regexp_replace(text, '([。！？.!?…！？؟।:;]){SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM lines
), sentences AS (SELECT sent_id, unnest(range(len(parts))) AS sentence_no, unnest(parts) AS text FROM marked)
SELECT row_number() OVER (ORDER BY sent_id, sentence_no) - 1 AS line_no, text FROM sentences""",
)
def _(spark, sf_dir):
    path = new_path(spark, "sentences")
    sentences = L.split_sentences(document_lines(spark, sf_dir).select("sent_id", "text"))
    L.write_lines(sentences, path, order=["sent_id", "sentence_no"])
    return L.read_in_order(spark, path)


#: Bytes that are no UTF-8 beside characters that are: lone, cut off, overlong, a surrogate, U+FFFD.
_BAD, _GOOD = ("FF", "C3", "E282", "C0AF", "EDA080", "F09F98"), "\ufffd\u00e9"


@query(
    "text_file_lines",
    f"""WITH {LINES_SQL}
SELECT sent_id % 3 AS line_end, row_number() OVER (PARTITION BY sent_id % 3 ORDER BY sent_id) - 1 AS line_no,
       text || '{_GOOD}x' AS text
FROM lines""",
)
def _(spark, sf_dir):
    """Lines are written with bad bytes and one of three line ends, and read without them."""
    lines = document_lines(spark, sf_dir).select("sent_id", "text")
    bad = [F.unhex(F.lit(x)).cast("string") for x in _BAD]
    spoilt = F.concat(bad[0], F.col("text"), *bad[1:3], F.lit(_GOOD), *bad[3:], F.lit("x"), bad[1])
    path, out = new_path(spark, "spoilt-lines"), None
    for k, end in enumerate(("\n", "\r\n", "\r")):
        own = lines.filter(F.pmod("sent_id", F.lit(3)) == k).withColumn("text", spoilt)
        rows = own.repartitionByRange("sent_id").sortWithinPartitions("sent_id").select("text")
        rows.write.option("lineSep", end).text(f"{path}/{k}")
        read = L.read_in_order(spark, f"{path}/{k}").withColumn("line_end", F.lit(k).cast("bigint"))
        out = read if out is None else out.unionByName(read)
    return out.select("line_end", "line_no", "text")
