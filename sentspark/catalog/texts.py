"""Text functions, words, subwords."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentspark.catalog import query
from sentspark.catalog.inputs import (
    LETTERS_SQL,
    LINES_SQL,
    SPACE_SQL,
    WORD_IDS_SQL,
    _SPACES,
    document_lines,
    documents,
    joined,
    joined_sql,
    normalize_sql,
    word_ids,
    words_sql,
)
from sentspark.functions import text as T
from sentspark.operators import vocab as V
from sentspark.sources import lines as L

WORDS_SQL = f"""
{LINES_SQL},
words AS (
  SELECT word, count(*) AS freq
  FROM (SELECT unnest({words_sql()}) AS word FROM lines) GROUP BY word
)"""


@query(
    "sentence_split",
    rf"""WITH marked AS (
  SELECT doc_id, string_split(
    regexp_replace(text, '([。！？.!?…！？؟।:;]){SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM documents
)
SELECT doc_id, unnest(range(len(parts)))::INTEGER AS sentence_no, unnest(parts) AS text FROM marked""",
)
def _(spark, sf_dir):
    return L.split_sentences(documents(spark, sf_dir))


@query("normalize_text", f"WITH {LINES_SQL} SELECT sent_id, {normalize_sql()} AS text FROM lines")
def _(spark, sf_dir):
    return document_lines(spark, sf_dir).select("sent_id", T.normalize_text("text").alias("text"))


@query("strip_accents", f"WITH {LINES_SQL} SELECT sent_id, strip_accents(lower(text)) AS text FROM lines")
def _(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        "sent_id", T.normalize_text("text", keep_punctuation=True, keep_accents=False).alias("text")
    )


@query(
    "pretokenize",
    f"WITH {LINES_SQL}, w AS (SELECT sent_id, {words_sql()} AS words FROM lines) "
    f"SELECT sent_id, len(words)::INTEGER AS n_words, {joined_sql('words')} AS words FROM w",
)
def _(spark, sf_dir):
    words = document_lines(spark, sf_dir).select("sent_id", T.words("text").alias("words"))
    return words.select("sent_id", F.size("words").alias("n_words"), joined("words"))


_MARKS = r"\p{P}$+<=>^`|~"


@query(
    "pretokenize_punct",
    f"""WITH {LINES_SQL}, w AS (
  SELECT sent_id, regexp_extract_all(
    lower(text), '[{LETTERS_SQL}]+|[{_MARKS}]|[^{LETTERS_SQL}{_MARKS}{_SPACES}]+') AS words
  FROM lines
)
SELECT sent_id, len(words)::INTEGER AS n_words, {joined_sql('words')} AS words FROM w""",
)
def _(spark, sf_dir):
    words = document_lines(spark, sf_dir).select(
        "sent_id", T.words("text", keep_punctuation=True).alias("words")
    )
    return words.select("sent_id", F.size("words").alias("n_words"), joined("words"))


@query("word_frequency", f"WITH {WORDS_SQL} SELECT word, freq FROM words")
def _(spark, sf_dir):
    return V.word_frequency(document_lines(spark, sf_dir), T.words("text"))


@query(
    "bpe_pair_counts",
    f"""WITH {WORDS_SQL},
symbols AS (
  SELECT freq, substr(word, i, 1) AS l, substr(word, i + 1, 1) AS r
  FROM (SELECT word, freq, unnest(range(1, len(word))) AS i FROM words)
)
SELECT l AS "left", r AS "right", sum(freq)::BIGINT AS freq FROM symbols GROUP BY l, r""",
)
def _(spark, sf_dir):
    return V.pair_counts(V.word_frequency(document_lines(spark, sf_dir), T.words("text")))


@query("encode_corpus", f"WITH {WORD_IDS_SQL} SELECT sent_id, {joined_sql('ids')} AS ids FROM coded")
def _(spark, sf_dir):
    return word_ids(spark, sf_dir).select("sent_id", joined("ids"))
