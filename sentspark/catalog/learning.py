"""Queries on learnt vocabularies and vectors.

The SQL of the vocabulary merges one pair per step in a recursive query. Token vectors
have no SQL.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.catalog import QUERIES, query
from sentspark.catalog.inputs import (
    LINES_SQL,
    N_WORDS,
    WORD_IDS_SQL,
    cosine_sql,
    document_lines,
    joined,
    joined_sql,
    reusable,
    reusable_path,
    table,
    trim_sql,
    word_ids,
    word_vocabulary,
    words_sql,
)
from sentspark.catalog.lines import PAIRED_SQL, QUERY_UNION_SQL, UNIQUE_SQL, split_sql
from sentspark.operators import learn as Le
from sentspark.functions import text as T
from sentspark.operators import vocab as V
from sentspark.operators.examples import make_batches
from sentspark.operators.order import with_ordinals
from sentspark.operators.pooling import embed_batches, encode
from sentspark.plans.embed import embed_in_chunks, encode_lines, learn_vocabulary
from sentspark.plans.prepare import prepare_corpus
from sentspark.plans.search import rank_by_text, search_by_text
from sentspark.sources import lines as L
from sentspark.sources.encoder import load_encoder, save_encoder
from sentspark.storage import materialise, new_path, provenance

# The size that the SQL of the vocabulary can follow, and the usual one.
VOCAB_SIZE, FULL_SIZE = 300, 35_000
DIM, EPOCHS, WINDOW, SEED = 32, 2, 5, 42
CHUNK = 1_000
TOP_K = 10
SPACE = {"dim": [16, 32], "window": (2, 6, 2), "dropout": (0.02, 0.2, "log")}
TRIALS = 8
BATCH, GROUP = 32, 8


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reusable(spark, sf_dir, "split", lambda: prepare_corpus(document_lines(spark, sf_dir)))


def train_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_lines(spark, sf_dir).filter(F.col("split") == "train").drop("split")
    return L.training_lines(train).filter(F.col("text") != "")


def vocabulary(spark: SparkSession, sf_dir: str, size: int = VOCAB_SIZE) -> tuple[DataFrame, DataFrame]:
    """Learnt from the train lines once, and reused."""
    train = split_lines(spark, sf_dir).filter(F.col("split") == "train")
    learn = functools.cache(lambda: learn_vocabulary(train, size))
    vocab = reusable(spark, sf_dir, f"vocab-{size}", lambda: learn()[0], size=size)
    return vocab, reusable(spark, sf_dir, f"merges-{size}", lambda: learn()[1], size=size)


def train_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: encode_lines(train_lines(spark, sf_dir), *vocabulary(spark, sf_dir))
    return reusable(spark, sf_dir, f"train-ids-{VOCAB_SIZE}", build)


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"dim": DIM, "epochs": EPOCHS, "window": WINDOW, "seed": SEED}
    build = lambda: Le.fit_encoder(word_ids(spark, sf_dir), **settings)
    return reusable(spark, sf_dir, "token-vectors", build, n_words=N_WORDS, **settings)


# One row per distinct word (kind 0: ids in brackets, frequency among the train lines),
# token (kind 1) and merge (kind 2). Words of other lines have frequency 0 and are merged
# along, which encodes them. Ids have five digits, so pairs sort by their ids.
BPE_SQL = f"""
{LINES_SQL}, {UNIQUE_SQL},
split_lines AS ({split_sql('uniq', 'sent_id, text')}),
train_words AS (
  SELECT word, count(*) AS freq
  FROM (SELECT unnest({words_sql()}) AS word FROM split_lines WHERE split = 'train') GROUP BY word
),
line_words AS (
  SELECT sent_id, unnest(range(len(w))) AS pos, unnest(w) AS word
  FROM (SELECT sent_id, {words_sql()} AS w FROM lines)
),
words AS (
  SELECT word, coalesce(freq, 0) AS freq, row_number() OVER (ORDER BY word) AS k
  FROM (SELECT DISTINCT word FROM line_words) LEFT JOIN train_words USING (word)
),
chars AS (
  SELECT k, freq, unnest(range(len(word))) AS i, unnest(string_split(word, '')) AS c FROM words
),
alphabet AS (
  SELECT c, 4 + row_number() OVER (ORDER BY unicode(c)) AS id
  FROM (SELECT DISTINCT c FROM chars WHERE freq > 0)
),
state(kind, k, s, n) USING KEY (kind, k) AS (
  SELECT 0, k, string_agg('<' || lpad(coalesce(id, 2)::VARCHAR, 5, '0') || '>', '' ORDER BY i),
         any_value(freq)::BIGINT
  FROM chars LEFT JOIN alphabet USING (c) GROUP BY k
  UNION ALL SELECT 1, id, c, id FROM alphabet
  UNION ALL SELECT 1, id, token, id
  FROM (SELECT unnest(range(5)) AS id, unnest(['<mask>', '<pad>', '<unk>', '<s>', '</s>']) AS token)
  UNION ALL (
    WITH best AS (
      SELECT substr(s, 7 * i + 1, 14) AS p, sum(n) AS f
      FROM (SELECT s, n, unnest(range(len(s) // 7 - 1)) AS i FROM recurring.state WHERE kind = 0 AND n > 0)
      GROUP BY p ORDER BY f DESC, p LIMIT 1
    ),
    merge AS (
      SELECT p, l.s || r.s AS token, l.s || ' ' || r.s AS names,
             (SELECT count(*) FROM recurring.state WHERE kind = 2) AS rank,
             coalesce((SELECT min(k) FROM recurring.state WHERE kind = 1 AND s = l.s || r.s),
                      (SELECT max(k) + 1 FROM recurring.state WHERE kind = 1)) AS id
      FROM best JOIN recurring.state l ON l.kind = 1 AND l.k = substr(p, 2, 5)::BIGINT
                JOIN recurring.state r ON r.kind = 1 AND r.k = substr(p, 9, 5)::BIGINT
      WHERE (SELECT count(*) FROM recurring.state WHERE kind = 1) < {VOCAB_SIZE}
    )
    SELECT 0, k, replace(s, p, '<' || lpad(id::VARCHAR, 5, '0') || '>'), n
    FROM recurring.state, merge WHERE kind = 0 AND contains(s, p)
    UNION ALL SELECT 1, id, token, id FROM merge
    UNION ALL SELECT 2, rank, names, id FROM merge
  )
)"""


@query(
    "learn_bpe",
    f"""WITH RECURSIVE {BPE_SQL}
SELECT k::INTEGER AS rank, split_part(s, ' ', 1) AS "left", split_part(s, ' ', 2) AS "right",
       n::INTEGER AS id
FROM state WHERE kind = 2""",
)
def _(spark, sf_dir):
    _, merges = vocabulary(spark, sf_dir)
    return merges.select("rank", "left", "right", "id")


@query(
    "bpe_encode",
    rf"""WITH RECURSIVE {BPE_SQL},
coded AS (
  SELECT sent_id, string_agg(s, '' ORDER BY pos) AS ids
  FROM line_words JOIN words USING (word) JOIN state ON kind = 0 AND state.k = words.k
  GROUP BY sent_id
)
SELECT sent_id, coalesce(rtrim(regexp_replace(ids, '<0*(\d+)>', '\1 ', 'g')), '') AS ids
FROM lines LEFT JOIN coded USING (sent_id)""",
)
def _(spark, sf_dir):
    lines = document_lines(spark, sf_dir).select("sent_id", "text")
    return encode_lines(lines, *vocabulary(spark, sf_dir)).select("sent_id", joined("ids"))


@query("learn_bpe_full")
def _(spark, sf_dir):
    _, merges = vocabulary(spark, sf_dir, FULL_SIZE)
    return merges.select("rank", "left", "right", "id")


@query("bpe_encode_full")
def _(spark, sf_dir):
    lines = document_lines(spark, sf_dir).select("sent_id", "text")
    return encode_lines(lines, *vocabulary(spark, sf_dir, FULL_SIZE)).select("sent_id", joined("ids"))


def _epochs_sql() -> str:
    """Token vectors after every epoch: u1, u2, ..."""
    steps = []
    for k in range(1, EPOCHS + 1):
        steps.append(f"""x{k} AS MATERIALIZED (
  SELECT a.token, d, sum(q * u[d])::DOUBLE AS x
  FROM association a JOIN u{k - 1} v ON a.context = v.token, range(1, {DIM + 1}) t(d) GROUP BY a.token, d
),
u{k} AS MATERIALIZED (
  SELECT token, list(round(x * {Le.UNIT} / length)::BIGINT ORDER BY d) AS u
  FROM (SELECT token, d, x, sqrt(sum(x * x) OVER (PARTITION BY token)) AS length FROM x{k}) GROUP BY token
)""")
    return ",\n".join(steps)


_NEAR_SQL = " UNION ALL ".join(
    f"SELECT token, lead(token, {d}) OVER (PARTITION BY sent_id ORDER BY pos) AS context, {WINDOW + 1 - d} AS w FROM tokens"
    for d in range(1, WINDOW + 1)
)

ENCODER_SQL = f"""{WORD_IDS_SQL},
near AS (SELECT * FROM ({_NEAR_SQL}) WHERE context IS NOT NULL),
pairs AS MATERIALIZED (
  SELECT token, context, sum(w)::BIGINT AS n
  FROM (SELECT token, context, w FROM near UNION ALL SELECT context, token, w FROM near) GROUP BY token, context
),
alone AS MATERIALIZED (SELECT token, sum(n)::BIGINT AS n FROM pairs GROUP BY token),
association AS MATERIALIZED (
  SELECT * FROM (
    SELECT p.token, p.context, round(1024 * ln((p.n::DOUBLE * (SELECT sum(n)::DOUBLE FROM alone))
                                               / (a.n::DOUBLE * b.n::DOUBLE)))::BIGINT AS q
    FROM pairs p JOIN alone a ON p.token = a.token JOIN alone b ON p.context = b.token
  ) WHERE q > 0
),
u0 AS MATERIALIZED (
  SELECT token, list_transform(range({DIM}),
    lambda d: 2 * ((('0x' || substr(h, d // 4 + 1, 1))::INTEGER >> (d % 4)::INTEGER) & 1) - 1) AS u
  FROM (SELECT token, md5('{SEED}:project:0:' || token) AS h FROM (SELECT DISTINCT token FROM association))
),
{_epochs_sql()}"""


@query(
    "fit_encoder",
    f"""WITH {ENCODER_SQL}
SELECT token, {joined_sql('u')} AS vector FROM u{EPOCHS}""",
)
def _(spark, sf_dir):
    whole = F.transform("vector", lambda x: F.round(x * Le.UNIT).cast("bigint"))
    return token_vectors(spark, sf_dir).withColumn("vector", whole).select("token", joined("vector"))


@query(
    "encoder_artifact",
    f"""WITH {ENCODER_SQL}, names AS (
  SELECT word AS token, id FROM vocab
  UNION ALL SELECT unnest(['<mask>', '<pad>', '<unk>', '<s>', '</s>']), unnest(range(5))
)
SELECT names.token, id::INTEGER AS id, {joined_sql('u')} AS vector FROM names JOIN u{EPOCHS} ON u{EPOCHS}.token = id""",
)
def _(spark, sf_dir):
    """What was saved, loaded again: every token of the vocabulary that has a vector."""
    path = reusable_path(spark, sf_dir, "encoder")
    settings = {"dim": DIM, "epochs": EPOCHS, "window": WINDOW, "seed": SEED}
    vocab = word_vocabulary(spark, sf_dir)
    special = spark.createDataFrame(list(zip(T.SPECIAL_TOKENS, range(5))), "token string, id int")
    save_encoder(path, token_vectors(spark, sf_dir), special.union(vocab.select("token", "id")), **settings)
    vectors, vocab, _ = load_encoder(spark, path, **settings)
    whole = F.transform("vector", lambda x: F.round(x * Le.UNIT).cast("bigint"))
    named = vectors.withColumn("vector", whole).select(F.col("token").alias("id"), joined("vector"))
    return vocab.join(named, "id").select("token", "id", "vector")


@query(
    "vocabulary_round_trip",
    f"""WITH RECURSIVE {BPE_SQL}
SELECT s AS token, k::INTEGER AS id, count(*) OVER () AS vocab_size FROM state WHERE kind = 1""",
)
def _(spark, sf_dir):
    path = new_path(spark, "vocabulary")
    V.write_vocabulary(*vocabulary(spark, sf_dir), path)
    vocab, _ = V.read_vocabulary(spark, path)
    return vocab.select("token", "id", F.lit(V.vocabulary_size(vocab)).cast("bigint").alias("vocab_size"))


def word_embedder(spark: SparkSession, sf_dir: str):
    """From vec_id, text to vec_id, embedding, by the words of the word-level vocabulary."""
    vocab, vectors = word_vocabulary(spark, sf_dir), token_vectors(spark, sf_dir)

    def embed(numbered: DataFrame) -> DataFrame:
        words = numbered.withColumn("words", T.words("text")).drop("text")
        return encode(V.encode_words(words, vocab), vectors, id="vec_id")

    return embed


def embedded_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings of the non-blank lines in chunks, and their manifest."""
    lines = L.search_lines(document_lines(spark, sf_dir).select("sent_id", "text"))
    documents = table(spark, sf_dir, "documents")
    stamp = provenance(documents, n_words=N_WORDS, dim=DIM, epochs=EPOCHS, window=WINDOW, seed=SEED, chunk=CHUNK)
    embed = word_embedder(spark, sf_dir)
    return embed_in_chunks(lines, embed, reusable_path(spark, sf_dir, "corpus"), stamp, CHUNK, segments=4)


SEARCH_LINES_SQL = f"""
numbered AS (
  SELECT row_number() OVER (ORDER BY sent_id) - 1 AS vec_id, text
  FROM (SELECT sent_id, {trim_sql()} AS text FROM lines) WHERE text <> ''
)"""


def pooled_sql(name: str, source: str, id: str = "vec_id", text: str = "text", e: str = "m") -> str:
    """CTEs up to ``name``: id and e, the vector of length 1 of each text with known tokens."""
    return f"""{name}_tokens AS (
  SELECT key, coalesce(id, 2)::INTEGER AS token
  FROM (SELECT {id} AS key, unnest({words_sql(text)}) AS word FROM {source}) LEFT JOIN vocab USING (word)
),
{name}_means AS (
  SELECT key, d, sum(u[d]) / {Le.UNIT}::DOUBLE / count(*) AS m
  FROM {name}_tokens JOIN u{EPOCHS} USING (token), range(1, {DIM + 1}) t(d) GROUP BY key, d
),
{name} AS MATERIALIZED (
  SELECT key AS {id}, list({e} ORDER BY d) AS e
  FROM (SELECT key, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY key)), 1e-12::DOUBLE) AS m FROM {name}_means)
  GROUP BY key
)"""


@query(
    "embed_corpus",
    f"""WITH {ENCODER_SQL}, {SEARCH_LINES_SQL},
{pooled_sql('pooled', 'numbered', e='round(m::FLOAT::DOUBLE * 1000)::BIGINT')}
SELECT vec_id, (vec_id // {CHUNK})::BIGINT AS chunk_id,
       coalesce({joined_sql('e')}, array_to_string(list_transform(range({DIM}), lambda d: 0), ' ')) AS embedding
FROM numbered LEFT JOIN pooled USING (vec_id)""",
)
def _(spark, sf_dir):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    embedded, _ = embedded_corpus(spark, sf_dir)
    return embedded.withColumn("embedding", rounded).select("vec_id", "chunk_id", joined("embedding"))


@query(
    "corpus_chunks",
    f"""WITH {LINES_SQL}, {SEARCH_LINES_SQL}
SELECT (vec_id // {CHUNK})::BIGINT AS chunk_id, count(*) AS n_rows, min(vec_id) AS first_id, max(vec_id) AS last_id
FROM numbered GROUP BY vec_id // {CHUNK}""",
)
def _(spark, sf_dir):
    return embedded_corpus(spark, sf_dir)[1]


# Vectors of the corpus as they are stored; a line without known tokens has zeros.
_ZEROS_SQL = f"list_transform(range({DIM}), lambda d: 0::DOUBLE)"
TEXT_CORPUS_SQL = f"""{pooled_sql('pooled', 'numbered', e='m::FLOAT::DOUBLE')},
corpus AS MATERIALIZED (
  SELECT vec_id, text, coalesce(e, {_ZEROS_SQL}) AS e FROM numbered LEFT JOIN pooled USING (vec_id)
)"""


@query(
    "search_by_text",
    f"""WITH {ENCODER_SQL}, {SEARCH_LINES_SQL}, {TEXT_CORPUS_SQL},
asked AS ({QUERY_UNION_SQL}),
{pooled_sql('asked_vectors', 'asked', 'query_id')},
queries AS (
  SELECT query_id, text AS query, coalesce(e, {_ZEROS_SQL}) AS q FROM asked LEFT JOIN asked_vectors USING (query_id)
),
hits AS (
  SELECT query_id, query, vec_id, text, s,
         row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank
  FROM (SELECT *, {cosine_sql('q', 'e')} AS s FROM queries, corpus) QUALIFY rank <= {TOP_K}
)
SELECT query_id, query, rank, round(s, 4) + 0.0::DOUBLE AS score, vec_id, text FROM hits""",
)
def _(spark, sf_dir):
    lines = L.search_lines(document_lines(spark, sf_dir).select("sent_id", "text"))
    numbered = with_ordinals(lines, ["sent_id"], "vec_id").select("vec_id", "text")
    corpus = embedded_corpus(spark, sf_dir)[0].select("vec_id", "embedding")
    queries = QUERIES["query_union"](spark, sf_dir)
    found = search_by_text(queries, numbered, corpus, word_embedder(spark, sf_dir), TOP_K)
    return found.withColumn("score", F.round("score", 4) + F.lit(0.0))


@query(
    "rank_by_text",
    f"""WITH {ENCODER_SQL}, {SEARCH_LINES_SQL}, {TEXT_CORPUS_SQL},
text_pairs AS ({PAIRED_SQL}),
{pooled_sql('query_vectors', 'text_pairs', 'query_id', 'query')},
{pooled_sql('original_vectors', 'text_pairs', 'query_id', 'original')},
compared AS (
  SELECT query_id, q, {cosine_sql('q', 'o')} AS reference FROM (
    SELECT query_id, coalesce(a.e, {_ZEROS_SQL}) AS q, coalesce(b.e, {_ZEROS_SQL}) AS o
    FROM text_pairs LEFT JOIN query_vectors a USING (query_id) LEFT JOIN original_vectors b USING (query_id)
  )
)
SELECT query_id, (count(*) FILTER ({cosine_sql('q', 'e')} > reference + 1e-12::DOUBLE) + 1)::BIGINT AS rank
FROM compared, corpus GROUP BY query_id""",
)
def _(spark, sf_dir):
    corpus = embedded_corpus(spark, sf_dir)[0].select("vec_id", "embedding")
    return rank_by_text(QUERIES["paired_eval_set"](spark, sf_dir), corpus, word_embedder(spark, sf_dir))


def letter_counter():
    """A caller's encoder that SQL can repeat: the vowels of a text, counted one by one."""
    return lambda texts: [[t.count(v) for v in "aeiou"] for t in texts]


@query(
    "encode_with_caller",
    f"""WITH {LINES_SQL}
SELECT sent_id, {joined_sql("list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: len(text) - len(replace(text, v, '')))")} AS embedding
FROM lines""",
)
def _(spark, sf_dir):
    encoded = embed_batches(document_lines(spark, sf_dir).select("sent_id", "text"), letter_counter)
    whole = F.transform("embedding", lambda x: x.cast("int"))
    return encoded.withColumn("embedding", whole).select("sent_id", joined("embedding"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of a sweep over the settings of the encoder, read back from their report."""
    train = train_ids(spark, sf_dir)
    test = split_lines(spark, sf_dir).filter(F.col("split") == "test").drop("split")
    test = L.training_lines(test).filter(F.col("text") != "")
    encode_test = lambda: Le.with_draws(make_batches(encode_lines(test, *vocabulary(spark, sf_dir)), BATCH))
    held_out = reusable(spark, sf_dir, "held-out", encode_test, size=VOCAB_SIZE, batch=BATCH)

    def objectives():
        """The loss of a setting; what settings share is made once, before they run side by side."""
        windows = sorted({Le.draw_params(SPACE, n)["window"] for n in range(TRIALS)})
        pairs = materialise(Le.cooccurrences_by_window(train, windows), "cooccurrences")
        near = lambda w: pairs.filter(F.col(f"n_{w}") > 0).select("token", "context", F.col(f"n_{w}").alias("n"))
        weights = {w: materialise(Le.association(near(w)), "association") for w in windows}
        # held-out lines of fewer batches than a group has are a group of their own
        group = max(min(held_out.select("batch_id").distinct().count(), GROUP), 1)

        def objective(params):
            epochs = Le.projections(weights[params["window"]], params["dim"], EPOCHS)
            losses = (Le.evaluate_drawn(held_out, v, params["dropout"], group) for v in epochs)
            return {k: loss.first().loss for k, loss in enumerate(losses)}

        return objective

    def sweep() -> DataFrame:
        report = reusable_path(spark, sf_dir, "trials")
        Le.sweep(spark, SPACE, objectives(), TRIALS, report=report)
        return Le.read_report(spark, report)

    return reusable(spark, sf_dir, "trial-table", sweep, space=SPACE, trials=TRIALS, epochs=EPOCHS, size=VOCAB_SIZE)


@query("sweep_trials")
def _(spark, sf_dir):
    return trials(spark, sf_dir)


@query("sweep_best_trial")
def _(spark, sf_dir):
    return Le.best_trial(trials(spark, sf_dir))


@query("sweep_running_best")
def _(spark, sf_dir):
    return Le.running_best(Le.trial_epochs(trials(spark, sf_dir)), "loss", "epoch", "trial_number")
