"""BPE encoding with forced boundaries, and decoding.

Two neighbouring symbols of a word can only end up in one token if some token of the
vocabulary holds them side by side. Where no token does, the word is cut for certain, so
the fragments between such cuts are encoded independently and their ids concatenated.

The vocabulary file has byte-level symbols and marks the last symbol of a word. A text is
normalised as the file says (composed, lower case), split into pre-tokens with numpy, and
every distinct pre-token is encoded once per worker. Special tokens inside a text are
recognised, as the public library does.

Null text is empty: no ids, and the hashes of nothing. Repeated rows and extra columns
change nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.normalizers import NFC, Lowercase, Sequence

from sentspark.llm.catalog import query, table
from sentspark.llm.packing import byte_alphabet
from sentspark.llm.pretoken import Cache, encoded
from sentspark.session import ship_package

#: Texts encoded at once, and fragments remembered by a worker.
TEXTS, FRAGMENTS = 256, 1 << 18

_workers: dict[str, Vocabulary] = {}


#: Characters about which two versions of Unicode may differ.
_FAR = re.compile("[^\x00-\u04ff]")
_far = Sequence([NFC(), Lowercase()])


def normal(text: str) -> str:
    """Composed form in lower case, each character lower-cased alone."""
    if _FAR.search(text):
        return _far.normalize_str(text)
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Vocabulary:
    """A byte-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.letters = {b: c for c, b in byte_alphabet().items()}
        #: every pair of neighbouring symbols inside a token
        self.inside = {pair for token in self.ids for pair in zip(self.symbols(token), self.symbols(token)[1:], strict=False)}
        self.table = {i: t.encode() for t, i in (self.ids | self.special).items()}
        self.fragments: dict[tuple[str, ...], list[int]] = {}
        self.cache = Cache(self.word)

    def symbols(self, token: str) -> list[str]:
        """A token's bytes as characters, the last one with the suffix if the token ends a word."""
        if token.endswith(self.suffix) and token != self.suffix:
            plain = token[: -len(self.suffix)]
            return [*plain[:-1], plain[-1] + self.suffix]
        return list(token)

    def fragment(self, symbols: tuple[str, ...]) -> list[int]:
        """Apply the merges to a fragment, lowest rank first, leftmost first."""
        if symbols in self.fragments:
            return self.fragments[symbols]
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            merged, k = [], 0
            while k < len(parts):
                if k < len(ranks) and ranks[k] == best:
                    merged.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    merged.append(parts[k])
                    k += 1
            parts = merged
        found = [self.ids[p] for p in parts if p in self.ids]
        if len(self.fragments) >= FRAGMENTS:
            self.fragments.clear()
        self.fragments[symbols] = found
        return found

    def word(self, word: str) -> list[int]:
        """Ids of a pre-token: cut at the forced boundaries, encode the fragments."""
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        out, start = [], 0
        for k in range(1, len(symbols) + 1):
            if k == len(symbols) or (symbols[k - 1], symbols[k]) not in self.inside:
                out += self.fragment(tuple(symbols[start:k]))
                start = k
        return out

    def encode(self, texts: list[str]):
        return encoded(texts, self.cache, False, self.special, normal)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with one space between them; the file has no decoder of its own."""
        return b" ".join(map(self.table.__getitem__, ids.tolist()))


def vocabulary(path: str) -> Vocabulary:
    if path not in _workers:
        _workers[path] = Vocabulary(path)
    return _workers[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every text."""

    def run(batches):
        known = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                ids = list(known.encode([t or "" for t in part.column("text").to_pylist()]))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": pa.array(ids, pa.list_(pa.int32())),
                        "decoded": pa.array([known.decode(x).decode() for x in ids], pa.string()),
                    }
                )

    return _narrow(docs, text, id).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _narrow(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encoding_report(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Token count and hashes of the ids and of the decoded text."""

    def run(batches):
        known = vocabulary(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            texts = batch.column("text")
            for k in range(0, batch.num_rows, TEXTS):
                for x in known.encode([t or "" for t in texts.slice(k, TEXTS).to_pylist()]):
                    n.append(len(x))
                    ids.append(hashlib.sha256(x.astype("<u4")).hexdigest())
                    decoded.append(hashlib.sha256(known.decode(x)).hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_sha256": pa.array(ids, pa.string()),
                    "decoded_sha256": pa.array(decoded, pa.string()),
                }
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _narrow(docs, text, id).mapInArrow(run, schema)


def word_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op6_forced_boundary_bpe")
def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return encoding_report(table(spark, sf_dir, "documents"), word_vocabulary())
