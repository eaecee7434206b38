"""Inputs the queries share, in Spark and as SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.functions import text as T
from sentspark.operators import vocab as V
from sentspark.operators.losses import pair_views
from sentspark.operators.pooling import mean_pool
from sentspark.sources.lines import lines_from_documents, spread, training_lines
from sentspark.storage import provenance, read_or_build, shared_dir

# Size of the word-level vocabulary of the encoding and example queries; with the reserved tokens 35,000.
N_WORDS = 34_995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_documents(documents(spark, sf_dir))


def reusable_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    tag = hashlib.md5(f"{spark.sparkContext.applicationId}:{sf_dir}".encode()).hexdigest()[:12]
    return f"{shared_dir(spark).rstrip('/')}/{name}-{tag}"


def reusable(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], **settings) -> DataFrame:
    """A result that this application keeps in the shared folder while the documents and the
    ``settings`` it is built with stay the same."""
    stamp = provenance(table(spark, sf_dir, "documents"), **settings)
    return read_or_build(spark, reusable_path(spark, sf_dir, name), build, stamp)


def worded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, words of the training lines that have any.

    Lines without words go before they are split. A filter on the words, or on their ids, would be
    pushed below both, and texts would be split and encoded once for it and once more for the rows.
    """
    lines = training_lines(document_lines(spark, sf_dir).filter(T.has_words("text")))
    return lines.select("sent_id", T.words("text").alias("words"))


def word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, ids of the training lines that have any, by a word-level vocabulary."""
    return V.encode_words(worded_lines(spark, sf_dir), word_vocabulary(spark, sf_dir))


def word_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of :func:`word_ids`."""
    lines = training_lines(document_lines(spark, sf_dir))
    # split within the generator: filters that Spark infers on a column of words split them again
    build = lambda: V.top_words(V.word_frequency(lines, T.words("text")), N_WORDS)
    return reusable(spark, sf_dir, "word-vocab", build, n_words=N_WORDS)


def joined(column: str, as_: str | None = None):
    """An array as text, numbers apart by one space."""
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(as_ or column)


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, z_i, z_j: neighbouring vectors as two views of one thing."""
    e = table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("all"),
        F.floor(F.col("vec_id") / 2).cast("bigint").alias("pair"),
        (F.col("vec_id") % 2).alias("view"),
        "embedding",
    )
    return pair_views(e, "all", "pair", "view", "embedding").drop("all")


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label as a query: query_id, embedding."""
    e = table(spark, sf_dir, "embeddings")
    return mean_pool(e, "label", "embedding").select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries with the first vector of the label as their original."""
    first = (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.col("label").cast("bigint").alias("query_id"))
        .agg(F.min_by("embedding", "vec_id").alias("original"))
    )
    queries = label_queries(spark, sf_dir).withColumnRenamed("embedding", "query")
    return queries.join(first, "query_id")


# -- SQL ---------------------------------------------------------------------------

# White space as in the text functions.
_SPACES = r"\t-\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_SQL = f"[{_SPACES}]"
NOT_SPACE_SQL = f"[^{_SPACES}]"
LETTERS_SQL = r"\p{L}\p{M}\p{Nd}\p{Nl}"


def lines_sql(source: str = "documents", id: str = "doc_id") -> str:
    return rf"""
lines AS (
  SELECT doc_id * 134217728 + line_no AS sent_id, doc_id, line_no::INTEGER AS line_no, text
  FROM (
    SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS text
    FROM (
      SELECT {id} AS doc_id,
             string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS parts
      FROM {source} WHERE text <> ''
    )
  )
)"""


LINES_SQL = lines_sql()


def trim_sql(text: str = "text") -> str:
    return f"regexp_replace({text}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


TRAINING_SQL = rf"""
training AS (
  SELECT sent_id, {trim_sql()} AS text
  FROM lines WHERE len(regexp_extract_all(text, '{NOT_SPACE_SQL}+')) <= 128
)"""


def normalize_sql(text: str = "text") -> str:
    return rf"lower(regexp_replace({text}, '\p{{P}}', '', 'g'))"


def words_sql(text: str = "text") -> str:
    return rf"regexp_extract_all({normalize_sql(text)}, '[{LETTERS_SQL}_]+|[^{LETTERS_SQL}_{_SPACES}]+')"


WORD_IDS_SQL = f"""
{LINES_SQL},
{TRAINING_SQL},
occurrences AS (
  SELECT sent_id, unnest(range(len(w))) AS pos, unnest(w) AS word
  FROM (SELECT sent_id, {words_sql()} AS w FROM training)
),
vocab AS (
  SELECT word, row_number() OVER (ORDER BY freq DESC, word) + 4 AS id
  FROM (SELECT word, count(*) AS freq FROM occurrences GROUP BY word)
  ORDER BY freq DESC, word LIMIT {N_WORDS}
),
tokens AS (
  SELECT sent_id, pos, coalesce(id, 2)::INTEGER AS token
  FROM occurrences LEFT JOIN vocab USING (word)
),
coded AS (
  SELECT sent_id, count(*) AS n, list(token ORDER BY pos) AS ids FROM tokens GROUP BY sent_id
)"""


def joined_sql(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


# First 8 of the hex digits that start at the given place, as a number in [0, 1).
def uniform_sql(key: str, digit: int = 1) -> str:
    return f"(('0x' || substr({key}, {digit}, 8))::BIGINT / 4294967296.0::DOUBLE)"


VECTORS_SQL = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
flat AS (SELECT vec_id, label, unnest(range(len(v))) AS d, unnest(v) AS x FROM e)"""


def cosine_sql(a: str, b: str) -> str:
    norm = lambda x: f"greatest(sqrt(list_dot_product({x}, {x})), 1e-12::DOUBLE)"
    return f"(list_dot_product({a}, {b}) / ({norm(a)} * {norm(b)}))"


LABEL_QUERIES_SQL = f"""
{VECTORS_SQL},
queries AS (
  SELECT label::BIGINT AS query_id, list(m ORDER BY d) AS q
  FROM (SELECT label, d, avg(x) AS m FROM flat GROUP BY label, d) GROUP BY label
),
sims AS (
  SELECT query_id, vec_id, {cosine_sql('q', 'v')} AS s FROM queries, e
)"""

LABEL_PAIRS_SQL = f"""
{LABEL_QUERIES_SQL},
originals AS (SELECT label::BIGINT AS query_id, arg_min(v, vec_id) AS o FROM e GROUP BY label),
original_sims AS (
  SELECT query_id, vec_id, {cosine_sql('o', 'v')} AS s FROM originals, e
)"""

TRUE_RANK_SQL = f"""
{LABEL_PAIRS_SQL},
true_ranks AS (
  SELECT query_id, (count(*) FILTER (s > reference + 1e-12::DOUBLE) + 1)::BIGINT AS rank
  FROM sims JOIN (
    SELECT query_id, {cosine_sql('q', 'o')} AS reference FROM queries JOIN originals USING (query_id)
  ) USING (query_id)
  GROUP BY query_id
)"""

PAIRS_SQL = f"""
{VECTORS_SQL},
pairs AS (
  SELECT a.vec_id // 2 AS pair_id, a.v AS z_i, b.v AS z_j
  FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0
)"""


def contrastive_sql(batch: str, source: str = "pairs", kind: str = "info_nce") -> str:
    """Loss per batch by the formulas over all rows of a batch; T = 0.07, p = 0.1."""
    if kind == "info_nce":
        loss = "-(pos / 0.07::DOUBLE) + ln(neg + exp(pos / 0.07::DOUBLE))"
    else:
        e = "exp(pos / 0.07::DOUBLE)"
        loss = f"-ln({e} / ({e} + neg - (0.1::DOUBLE / 0.9::DOUBLE) * {e}))"
    return f"""
views AS (
  SELECT {batch} AS batch, pair_id, 0 AS side, z_i AS z FROM {source}
  UNION ALL SELECT {batch}, pair_id, 1, z_j FROM {source}
),
anchors AS (
  SELECT a.batch, a.pair_id, a.side,
         sum(CASE WHEN a.pair_id = b.pair_id THEN {cosine_sql('a.z', 'b.z')} END) AS pos,
         coalesce(sum(CASE WHEN a.pair_id <> b.pair_id
                           THEN exp({cosine_sql('a.z', 'b.z')} / 0.07::DOUBLE) END), 0) AS neg
  FROM views a JOIN views b ON a.batch = b.batch AND (a.pair_id <> b.pair_id OR a.side <> b.side)
  GROUP BY ALL
),
losses AS (SELECT batch, avg({loss}) AS loss FROM anchors GROUP BY batch)"""
