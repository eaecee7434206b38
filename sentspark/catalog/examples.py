"""Training examples over the word-level ids of the training lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentspark.catalog import query
from sentspark.catalog.inputs import (
    N_WORDS,
    VECTORS_SQL,
    WORD_IDS_SQL,
    joined,
    joined_sql,
    table,
    uniform_sql,
    word_ids,
    worded_lines,
)
from sentspark.functions import vectors as V
from sentspark.operators import examples as E
from sentspark.operators.pooling import encode

VOCAB_SIZE = N_WORDS + 5
BATCH = 32


def mlm_sql(epoch: int) -> str:
    """Rows of masked examples of one epoch, as a SELECT over ``tokens`` and ``coded``."""
    u, r = uniform_sql("key", 17), uniform_sql("key", 25)
    return f"""
SELECT {epoch} AS epoch, sent_id,
       {joined_sql('list(CASE WHEN NOT picked THEN token ELSE masked END ORDER BY pos)')} AS input_ids,
       {joined_sql('list(1 ORDER BY pos)')} AS attention_mask,
       {joined_sql('list(CASE WHEN picked THEN token ELSE 1 END ORDER BY pos)')} AS labels
FROM (
  SELECT sent_id, pos, token,
         row_number() OVER (PARTITION BY sent_id ORDER BY key)
           <= greatest(1, round_even(n * 0.15::DOUBLE, 0)::BIGINT) AS picked,
         CASE WHEN {u} < 0.8::DOUBLE THEN 0
              WHEN {u} < 0.9::DOUBLE THEN floor({r} * {VOCAB_SIZE})::INTEGER ELSE token END AS masked
  FROM (
    SELECT sent_id, pos, token, n, md5('42:mlm:{epoch}:' || sent_id || ':' || pos) AS key
    FROM tokens JOIN coded USING (sent_id)
  )
) GROUP BY sent_id"""


def masked(ids: DataFrame, *epochs: int) -> DataFrame:
    """Masked examples of every epoch; the ids are made once for all of them."""
    each = ids.withColumn("epoch", F.explode(F.array(*map(F.lit, epochs))))
    return E.mlm_examples(each, VOCAB_SIZE, epoch=F.col("epoch")).select(
        "epoch", "sent_id", *[joined(c) for c in ("input_ids", "attention_mask", "labels")]
    )


@query("mlm_mask", f"WITH {WORD_IDS_SQL} {mlm_sql(0)}")
def _(spark, sf_dir):
    return masked(word_ids(spark, sf_dir), 0)


@query("epoch_examples", f"WITH {WORD_IDS_SQL} {mlm_sql(0)} UNION ALL {mlm_sql(1)}")
def _(spark, sf_dir):
    return masked(word_ids(spark, sf_dir), 0, 1)


@query(
    "contrastive_examples",
    f"WITH {WORD_IDS_SQL} SELECT sent_id, '3 ' || {joined_sql('ids')} || ' 4' AS ids FROM coded",
)
def _(spark, sf_dir):
    return E.contrastive_examples(word_ids(spark, sf_dir)).select("sent_id", joined("ids"))


@query(
    "encode_sentences",
    f"""WITH {WORD_IDS_SQL}, {VECTORS_SQL},
means AS (
  SELECT sent_id, d, avg(x) AS m FROM tokens JOIN flat ON vec_id = token GROUP BY sent_id, d
)
SELECT sent_id, {joined_sql("list(round(coalesce(m, 0) * 10000)::BIGINT ORDER BY d)")} AS embedding
FROM (SELECT sent_id, unnest(range(64)) AS d FROM coded) LEFT JOIN means USING (sent_id, d)
GROUP BY sent_id""",
)
def _(spark, sf_dir):
    # The stored vectors stand in for token vectors; ids without one are unknown tokens.
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("token"), F.col("embedding").alias("vector")
    )
    pooled = encode(word_ids(spark, sf_dir), vectors)
    # Ten-thousandths, as whole numbers.
    whole = F.transform("embedding", lambda x: F.round(x * 10000).cast("bigint"))
    return pooled.withColumn("embedding", whole).select("sent_id", joined("embedding"))


BATCHES_SQL = f"""
{WORD_IDS_SQL},
ordinals AS (SELECT *, row_number() OVER (ORDER BY sent_id) - 1 AS pos FROM coded),
shuffled AS (
  SELECT *, (pos // 2048) * 2048 + row_number() OVER (
              PARTITION BY pos // 2048 ORDER BY md5('42:buffer:0:' || pos), pos) - 1 AS shuffled
  FROM ordinals
),
batches AS (SELECT *, shuffled // {BATCH} AS batch_id FROM shuffled)"""


@query("make_batches", f"WITH {BATCHES_SQL} SELECT sent_id, pos, shuffled, batch_id FROM batches")
def _(spark, sf_dir):
    ids = worded_lines(spark, sf_dir).select("sent_id")
    return E.make_batches(ids, BATCH).select("sent_id", "pos", "shuffled", "batch_id")


@query("capped_batches", f"WITH {BATCHES_SQL} SELECT sent_id, batch_id FROM batches WHERE batch_id < 10")
def _(spark, sf_dir):
    ids = worded_lines(spark, sf_dir).select("sent_id")
    return E.make_batches(ids, BATCH, max_batches=10).select("sent_id", "batch_id")


@query(
    "pad_batches",
    f"""WITH {BATCHES_SQL},
padded AS (
  SELECT sent_id, batch_id, list_concat(list_concat([3], ids), [4]) AS ids, n + 2 AS n,
         max(n + 2) OVER (PARTITION BY batch_id) AS longest
  FROM batches
)
SELECT sent_id, batch_id,
       {joined_sql("list_concat(ids, list_transform(range(longest - n), lambda x: 1))")} AS ids,
       {joined_sql("list_transform(range(longest), lambda i: CASE WHEN i >= n THEN 'true' ELSE 'false' END)")}
         AS padding_mask
FROM padded""",
)
def _(spark, sf_dir):
    examples = E.contrastive_examples(word_ids(spark, sf_dir))
    batches = E.make_batches(examples, BATCH)
    return E.pad_batches(batches, by=("bucket", "batch_id")).select(
        "sent_id", "batch_id", joined("ids"), joined("padding_mask")
    )


@query(
    "inference_batches",
    f"""WITH {BATCHES_SQL},
padded AS (
  SELECT sent_id, pos // 64 AS batch_id, ids, n, max(n) OVER (PARTITION BY pos // 64) AS longest
  FROM ordinals
)
SELECT sent_id, batch_id,
       {joined_sql("list_concat(ids, list_transform(range(longest - n), lambda x: 1))")} AS ids,
       {joined_sql("list_transform(range(longest), lambda i: CASE WHEN i < n THEN '1' ELSE '0' END)")}
         AS attention_mask
FROM padded""",
)
def _(spark, sf_dir):
    return E.inference_batches(word_ids(spark, sf_dir)).select(
        "sent_id", "batch_id", joined("ids"), joined("attention_mask")
    )


@query(
    "one_hot",
    f"""SELECT vec_id, {joined_sql(
        "list_transform(range(10), lambda i: CASE WHEN i = label THEN '1.0' ELSE '0.0' END)"
    )} AS one_hot FROM embeddings""",
)
def _(spark, sf_dir):
    hot = table(spark, sf_dir, "embeddings").select("vec_id", V.one_hot("label", 10).alias("one_hot"))
    return hot.select("vec_id", joined("one_hot"))
