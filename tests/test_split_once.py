"""Texts are split into words once, and encoded once."""

import sys

from pyspark.sql import functions as F

from sentspark.catalog import QUERIES, inputs, load
from sentspark.functions import text as T
from sentspark.operators import vocab as V

SF_DIR = "/root/testdata/sf0.001"
load()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_has_words_is_whether_any_word_is_found(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = ["", " ", ".", " . ", "a", " a", ". a", "<s>", "- -"] + [chr(c) for c in points]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    assert df.filter(T.has_words("text") != (F.size(T.words("text")) > 0)).limit(5).collect() == []


def test_lines_are_split_and_encoded_once(spark):
    for ids in (inputs.word_ids(spark, SF_DIR), QUERIES["encode_corpus"](spark, SF_DIR)):
        assert plan(ids).count("look_up(") == 1
        assert plan(ids).count(T.WORDS) == 1


def test_the_vocabulary_splits_lines_once(spark, monkeypatch):
    built = []
    top_words = V.top_words
    monkeypatch.setattr(inputs.V, "top_words", lambda words, size: built.append(words) or top_words(words, size))
    monkeypatch.setattr(inputs, "reusable", lambda spark, sf_dir, name, build, **settings: build())
    inputs.word_vocabulary(spark, SF_DIR)
    assert plan(built[0]).count(T.WORDS) == 1


def test_batches_of_ids_alone_need_no_words(spark, monkeypatch):
    import sentspark.catalog.examples as C

    def unused(*args):
        raise AssertionError("lines are encoded, and the numbers of their words are not used")

    monkeypatch.setattr(C, "word_ids", unused)
    for name in ("make_batches", "capped_batches"):
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_epochs_share_the_ids(spark):
    assert plan(QUERIES["epoch_examples"](spark, SF_DIR)).count("look_up(") == 1
