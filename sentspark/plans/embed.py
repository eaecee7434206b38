"""From lines to a vocabulary, to id arrays, to sentence vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentspark.functions import text as T
from sentspark.operators.order import with_ordinals
from sentspark.operators.pooling import encode
from sentspark.operators.vocab import encode_corpus, learn_bpe, word_frequency
from sentspark.sources.embeddings import CHUNK_SIZE, chunk_manifest, read_segments, write_segments
from sentspark.storage import materialise


def learn_vocabulary(
    lines: DataFrame,
    vocab_size: int,
    keep_punctuation: bool = False,
    keep_accents: bool = True,
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Subword vocabulary of a line table: (vocab, merges). The words are counted once."""
    words = word_frequency(lines, T.words(text, keep_punctuation, keep_accents))
    return learn_bpe(materialise(words, "word-counts"), vocab_size)


def encode_lines(
    lines: DataFrame,
    vocab: DataFrame,
    merges: DataFrame,
    keep_punctuation: bool = False,
    keep_accents: bool = True,
    text: str = "text",
) -> DataFrame:
    """Replace the texts by subword ``ids``; no shuffle."""
    words = T.words_to_encode(text, keep_punctuation, keep_accents)
    return encode_corpus(lines.withColumn("words", words).drop(text), vocab, merges)


def embed_corpus(lines: DataFrame, vocab: DataFrame, merges: DataFrame, token_vectors: DataFrame) -> DataFrame:
    """Vectors of the non-blank lines: vec_id (the line's id) and embedding; no shuffle."""
    ids = encode_lines(lines.select("sent_id", "text"), vocab, merges)
    return encode(ids, token_vectors).select(F.col("sent_id").alias("vec_id"), "embedding")


def embed_in_chunks(
    lines: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    path: str,
    stamp: str,
    size: int = CHUNK_SIZE,
    segments: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """Embed a line table (sent_id, text) chunk by chunk: (embeddings, manifest).

    Lines are numbered densely in the order of ``sent_id``, so every chunk but the last is
    full. Texts are brought to their chunk before ``embed`` (from vec_id, text to vec_id,
    embedding) turns them into vectors; vectors are never moved. The corpus is written in
    ``segments`` of whole chunks, each with ``stamp`` once it is complete: a run after a lost
    driver goes on with the first segment that is missing. ``stamp`` names what the vectors
    are made of (see :func:`sentspark.storage.provenance`).
    """
    numbered = with_ordinals(lines.select("sent_id", "text"), ["sent_id"], "vec_id").select("vec_id", "text")
    n = write_segments(numbered, embed, path, stamp, size, segments)
    return read_segments(lines.sparkSession, path, n), manifest_of(lines, path, n, size)


def manifest_of(lines: DataFrame, path: str, n: int, size: int = CHUNK_SIZE) -> DataFrame:
    """One row per chunk of the written embeddings."""
    return chunk_manifest(read_segments(lines.sparkSession, path, n), size)
