"""Vectors, search, ranks, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentspark.catalog import query
from sentspark.catalog.inputs import (
    LABEL_PAIRS_SQL,
    LABEL_QUERIES_SQL,
    PAIRS_SQL,
    TRUE_RANK_SQL,
    VECTORS_SQL,
    contrastive_sql,
    cosine_sql,
    label_pairs,
    label_queries,
    table,
    vector_pairs,
)
from sentspark.functions import vectors as V
from sentspark.operators import losses as Lo
from sentspark.operators import search as S
from sentspark.operators.learn import best_trial, running_best
from sentspark.operators.pooling import mean_pool
from sentspark.sources import embeddings as Em
from sentspark.storage import new_path

# The tables hold few vectors, so chunks are small.
CHUNK = 100
TOP_K = 10
# Pairs per batch of the losses, and of the small batches of the evaluation.
PAIRS = 32
SMALL = 8


def rounded(column, digits: int = 4):
    """Rounded, with a plain zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


HITS_SQL = f"""
{LABEL_QUERIES_SQL},
hits AS (
  SELECT query_id, vec_id, s,
         row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank
  FROM sims QUALIFY rank <= {TOP_K}
)"""


@query(
    "semantic_search",
    f"WITH {HITS_SQL} SELECT query_id, rank, round(s, 4) + 0.0::DOUBLE AS score, vec_id FROM hits",
)
def _(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = S.semantic_search(label_queries(spark, sf_dir), corpus, TOP_K)
    return hits.withColumn("score", rounded("score"))


@query(
    "semantic_search_text",
    f"""WITH {HITS_SQL}
SELECT query_id, rank, round(s, 4) + 0.0::DOUBLE AS score, vec_id, text
FROM hits JOIN documents ON doc_id = vec_id""",
)
def _(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = label_queries(spark, sf_dir)
    hits = S.semantic_search(queries, corpus, TOP_K).withColumn("score", rounded("score"))
    sentences = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return S.with_text(hits, sentences, queries.count() * TOP_K)


@query("true_rank", f"WITH {TRUE_RANK_SQL} SELECT query_id, rank FROM true_ranks")
def _(spark, sf_dir):
    return S.rank_eval(label_pairs(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query(
    "chunk_max_rank",
    f"""WITH {LABEL_PAIRS_SQL},
best AS (
  SELECT query_id, vec_id // {CHUNK} AS chunk_id, max(s) AS reference FROM original_sims GROUP BY ALL
)
SELECT query_id, (count(*) FILTER (s > reference + 1e-12::DOUBLE) + 1)::BIGINT AS rank
FROM (SELECT *, vec_id // {CHUNK} AS chunk_id FROM sims) JOIN best USING (query_id, chunk_id)
GROUP BY query_id""",
)
def _(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    return S.rank_eval(label_pairs(spark, sf_dir), corpus, "chunk_max", CHUNK)


@query(
    "rank_metrics",
    f"""WITH {TRUE_RANK_SQL}
SELECT count(*) AS n_queries,
       round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_1,
       round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_10,
       round(avg(CASE WHEN rank <= 100 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_100,
       round(avg(1.0::DOUBLE / rank), 4) AS mrr, median(rank)::DOUBLE AS median_rank
FROM true_ranks""",
)
def _(spark, sf_dir):
    ranks = S.rank_eval(label_pairs(spark, sf_dir), table(spark, sf_dir, "embeddings"))
    m = S.rank_metrics(ranks)
    return m.select(
        "n_queries",
        *[rounded(c).alias(c) for c in ("hit_at_1", "hit_at_10", "hit_at_100", "mrr")],
        "median_rank",
    )


@query(
    "cosine_pairs",
    f"""WITH {PAIRS_SQL}
SELECT pair_id, round({cosine_sql('z_i', 'z_j')}, 4) + 0.0::DOUBLE AS cosine FROM pairs""",
)
def _(spark, sf_dir):
    cosine = V.cosine("z_i", "z_j")
    return vector_pairs(spark, sf_dir).select("pair_id", rounded(cosine).alias("cosine"))


@query(
    "l2_normalize",
    f"""WITH {VECTORS_SQL},
scaled AS (SELECT vec_id, d, x * label AS x FROM flat),
lengths AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12::DOUBLE) AS n FROM scaled GROUP BY vec_id)
SELECT vec_id, d::INTEGER AS d, round(x / n, 4) + 0.0::DOUBLE AS value
FROM scaled JOIN lengths USING (vec_id)""",
)
def _(spark, sf_dir):
    # The stored vectors have unit length already; times the label they do not.
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    return unit.select("vec_id", F.posexplode(V.l2_normalize("v")).alias("d", "value")).withColumn(
        "value", rounded("value")
    )


@query(
    "embedding_scan",
    f"""WITH {VECTORS_SQL}
SELECT vec_id, vec_id // {CHUNK} AS chunk_id, len(v)::INTEGER AS dim,
       round(sqrt(list_dot_product(v, v)), 4) AS norm FROM e""",
)
def _(spark, sf_dir):
    path = new_path(spark, "embeddings")
    Em.write_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path, CHUNK)
    return Em.read_embeddings(spark, path).select(
        "vec_id", "chunk_id", F.size("embedding").alias("dim"), rounded("norm").alias("norm")
    )


@query(
    "chunk_manifest",
    f"""SELECT vec_id // {CHUNK} AS chunk_id, count(*) AS n_rows, min(vec_id) AS first_id,
       max(vec_id) AS last_id FROM embeddings GROUP BY ALL""",
)
def _(spark, sf_dir):
    return Em.chunk_manifest(table(spark, sf_dir, "embeddings").select("vec_id"), CHUNK)


@query(
    "mean_pool",
    f"""WITH {VECTORS_SQL},
weighted AS (SELECT label, d, x, (v[1] > 0)::INTEGER AS w FROM flat JOIN e USING (vec_id, label))
SELECT label, d::INTEGER AS d, round(sum(x * w) / greatest(sum(w), 1e-9::DOUBLE), 4) + 0.0::DOUBLE AS value
FROM weighted GROUP BY label, d""",
)
def _(spark, sf_dir):
    mask = (F.element_at("embedding", 1) > 0).cast("int")
    e = table(spark, sf_dir, "embeddings").select("label", "embedding", mask.alias("mask"))
    pooled = mean_pool(e, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("embedding").alias("d", "value")).withColumn(
        "value", rounded("value")
    )


def batched_pairs(spark, sf_dir, size):
    batch = F.floor(F.col("pair_id") / size).cast("bigint")
    return vector_pairs(spark, sf_dir).withColumn("batch_id", batch)


def loss_sql(kind: str) -> str:
    return f"""WITH {PAIRS_SQL}, {contrastive_sql(f'pair_id // {PAIRS}', kind=kind)}
SELECT batch AS batch_id, round(loss, 4) + 0.0::DOUBLE AS loss FROM losses"""


@query("info_nce", loss_sql("info_nce"))
def _(spark, sf_dir):
    return Lo.info_nce(batched_pairs(spark, sf_dir, PAIRS)).withColumn("loss", rounded("loss"))


@query("debiased_contrastive", loss_sql("debiased_contrastive"))
def _(spark, sf_dir):
    loss = Lo.debiased_contrastive(batched_pairs(spark, sf_dir, PAIRS))
    return loss.withColumn("loss", rounded("loss"))


@query(
    "contrastive_eval",
    f"""WITH {PAIRS_SQL},
full_groups AS (
  SELECT group_id FROM (
    SELECT pair_id // {SMALL * 8} AS group_id, count(DISTINCT pair_id // {SMALL}) AS n
    FROM pairs GROUP BY ALL
  ) WHERE n = 8
),
kept AS (SELECT * FROM pairs WHERE pair_id // {SMALL * 8} IN (SELECT group_id FROM full_groups)),
{contrastive_sql(f'pair_id // {SMALL * 8}', 'kept', 'debiased_contrastive')}
SELECT count(*) AS n_groups, round(avg(loss), 4) + 0.0::DOUBLE AS loss FROM losses""",
)
def _(spark, sf_dir):
    return Lo.contrastive_eval(batched_pairs(spark, sf_dir, SMALL)).withColumn("loss", rounded("loss"))


@query(
    "masked_cross_entropy",
    f"""WITH {VECTORS_SQL},
totals AS (SELECT vec_id, ln(sum(exp(x))) AS lse FROM flat GROUP BY vec_id),
per_batch AS (
  SELECT vec_id // {PAIRS} AS batch_id, avg(lse - v[label + 1]) AS loss
  FROM e JOIN totals USING (vec_id) WHERE label <> 1 GROUP BY ALL
)
SELECT count(*) AS n_batches, round(avg(loss), 4) + 0.0::DOUBLE AS loss FROM per_batch""",
)
def _(spark, sf_dir):
    batch = F.floor(F.col("vec_id") / PAIRS).cast("bigint").alias("batch_id")
    e = table(spark, sf_dir, "embeddings").select(batch, "embedding", "label")
    return Lo.masked_cross_entropy(e, "embedding", "label", 1).withColumn("loss", rounded("loss"))


SERIES_SQL = """
series AS (
  SELECT event_type AS trial, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch,
         sum(round(value * 100)::BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS value
  FROM events GROUP BY ALL
)"""


def daily_series(spark, sf_dir):
    """Mean value per event type and day, as the loss per epoch of a trial. Values have
    two decimals; summed as whole cents, the mean does not depend on the order."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("trial"), day.alias("epoch")).agg(
        (cents / F.count("*") / F.lit(100.0)).alias("value")
    )


@query(
    "running_best",
    f"""WITH {SERIES_SQL}
SELECT trial, epoch, value, min(value) OVER (PARTITION BY trial ORDER BY epoch) AS best
FROM series""",
)
def _(spark, sf_dir):
    return running_best(daily_series(spark, sf_dir), "value", "epoch", "trial")


@query(
    "best_trial",
    f"""WITH {SERIES_SQL},
trials AS (SELECT trial, count(*) AS n_epochs, min(value) AS value FROM series GROUP BY trial)
SELECT trial, n_epochs, value FROM trials ORDER BY value, trial LIMIT 1""",
)
def _(spark, sf_dir):
    trials = daily_series(spark, sf_dir).groupBy("trial").agg(
        F.count("*").alias("n_epochs"), F.min("value").alias("value")
    )
    return best_trial(trials, "value", "trial")
