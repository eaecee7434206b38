"""Toxicity scores by non-negative learning from positive and unlabelled documents.

The training data is bounded: up to ``POSITIVES`` confirmed toxic documents and
``UNLABELLED`` documents of any kind, those with the least hash of their id, from rows
that are not held out. Only that sample is brought together, in one task, as hashes of the distinct
words of each document; the driver gets the model. A logistic classifier is trained in numpy on the risk

    prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)])

whose second part estimates the risk on clean documents from unlabelled ones; where it
falls under zero the step goes against it, so the classifier does not fit single
unlabelled documents. The prior is the share of toxic rows among the labelled ones.

Features are the words (letters, digits and non-ASCII characters, A-Z lower-cased) that
are found significantly more often in toxic documents than in unlabelled ones. Each counts
once per document, so the length of a text does not move its score. All documents are
scored over their whole texts by one pass with the small model in the task closure.

Null and empty texts get the score of a text without any feature. A document labelled
more than once is toxic if any row says so; null labels and labels without a document
count for nothing. Without toxic labels the score is the prior everywhere, and without any
labels ``DEFAULT_PRIOR``. Rows with a null id are scored and not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.rolling import LOWER_CODES, buffers, row_blocks, word_codes, word_spans
from sentspark.session import ship_package

#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 4000, 8000
#: A feature is found in so many toxic documents, so many standard errors above chance.
LEAST_DF, LEAST_Z = 3, 4.5
#: Most features of a model.
FEATURES = 4096
STEPS, RATE, DECAY = 400, 0.2, 1e-5
THRESHOLD = 0.7
DEFAULT_PRIOR = 0.01

#: Bytes between words: ASCII other than letters and digits.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _words(column: pa.Array):
    """Document number and hash of every word, block by block, with the block's rows."""
    data, offsets = buffers(column)
    for a, b in row_blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, first = word_spans(part, at, _BETWEEN)
        yield a, b, np.repeat(np.arange(b - a), np.diff(first)), word_codes(part, start, end, LOWER_CODES)


def _word_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for a, b, row, codes in _words(batch.column("data")):
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                out += [np.unique(codes[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch({"toxic": batch.column("toxic"), "words": pa.array(out, pa.binary())})

    return docs.mapInArrow(run, "toxic boolean, words binary")


def _body() -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data")


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[float, DataFrame]:
    """The prior, and the word sets of the bounded sample with their kind."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / n, 1e-4), 0.99) if n else DEFAULT_PRIOR
    rank = F.xxhash64("doc_id"), F.col("doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    some = ids.filter(~held_out(F.col("doc_id"))).distinct().orderBy(*rank).limit(UNLABELLED)
    sure = known.filter("toxic = 1").select("doc_id").join(ids, "doc_id", "left_semi").orderBy(*rank).limit(POSITIVES)
    chosen = sure.withColumn("toxic", F.lit(True)).union(some.withColumn("toxic", F.lit(False)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body())
    # at most POSITIVES + UNLABELLED rows of two columns
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("toxic", "doc_id").agg(F.min("data").alias("data"))
    return prior, _word_sets(one.select("toxic", "data"))


def _features(sets: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and shares of documents; ``sets`` holds distinct words of each document."""
    words, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    return words, count / max(n, 1)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fit the classifier; each document is the array of its distinct word hashes."""
    # the same set again (copies of a document) says nothing new
    positive = list({p.tobytes(): p for p in positive}.values())
    unlabelled = list({u.tobytes(): u for u in unlabelled}.values())
    start = float(np.log(prior / (1 - prior)))
    words, share = _features(positive, len(positive))
    keep = share * len(positive) >= LEAST_DF - 1e-9
    words, share = words[keep], share[keep]
    every, usual = _features(unlabelled, len(unlabelled))
    if not len(words) or not len(every):
        return Model(words[:0], np.zeros(0), start)
    at = np.minimum(np.searchsorted(every, words), len(every) - 1)
    base = np.where(every[at] == words, usual[at], 0)
    base = np.maximum(base, 1 / len(unlabelled))
    z = (share - base) / np.sqrt(base * (1 / len(positive) + 1 / len(unlabelled)))
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    words = words[best[z[best] >= LEAST_Z]]
    if not len(words):
        return Model(words, np.zeros(0), start)

    def matrix(sets):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        place = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[place] == flat
        return rows[hit], place[hit], len(sets)

    p, u = matrix(positive), matrix(unlabelled)
    weights, bias = np.zeros(len(words)), start
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)

    def chance(x):
        return 1 / (1 + np.exp(-np.clip(bias + np.bincount(x[0], weights[x[1]], x[2]), -30, 30)))

    def slope(x, by):
        return np.append(np.bincount(x[1], by[x[0]], len(words)), by.sum()) / x[2]

    for step in range(1, STEPS + 1):
        sp, su = chance(p), chance(u)
        clean = -np.log1p(-su).mean() + prior * np.log1p(-sp).mean()
        negative = slope(u, su) - prior * slope(p, sp)
        gradient = prior * slope(p, sp - 1) + negative if clean >= 0 else -negative
        gradient[:-1] += DECAY * weights
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(words, weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, trained in one task on the bounded sample."""
    prior, sample = training_sample(docs, labels)

    def run(batches):
        sets = []
        for batch in batches:
            words = (np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist())
            sets += zip(batch.column("toxic").to_pylist(), words, strict=True)
        sets.sort(key=lambda x: x[1].tobytes())
        model = train([s for k, s in sets if k], [s for k, s in sets if not k], prior)
        row = {"words": [model.words.tobytes()], "weights": [model.weights.tobytes()], "bias": [float(model.bias)]}
        yield pa.record_batch(row)

    found = sample.repartition(1).mapInArrow(run, "words binary, weights binary, bias double").collect()
    if not found:  # no document at all
        return train([], [], prior)
    return Model(np.frombuffer(found[0].words, np.uint64), np.frombuffer(found[0].weights), found[0].bias)


def scores(model: Model):
    """A column function from texts as bytes to scores."""

    @F.arrow_udf("double")
    def score(data: pa.Array) -> pa.Array:
        total = np.full(len(data), model.bias)
        if len(model.words):
            for a, b, row, codes in _words(data):
                place = np.minimum(np.searchsorted(model.words, codes), len(model.words) - 1)
                hit = model.words[place] == codes
                pairs = np.unique(row[hit] * len(model.words) + place[hit])
                total[a:b] += np.bincount(pairs // len(model.words), model.weights[pairs % len(model.words)], b - a)
        return pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    return score


def _score(model: Model) -> Column:
    return scores(model)(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those scored as toxic, in the same columns, which may have any further names."""
    return docs.filter(_score(fit(docs, labels)) < THRESHOLD)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document, and whether its label was held out."""
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        _score(fit(docs, labels)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query("op4_toxicity_nnpu")
def op4_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
