"""Packing of documents into training sequences by lexical retrieval.

Documents are tokenised once and written with their ids; document frequencies and the mean
length are counted over the whole corpus. Documents are then ordered by their two terms of
the highest BM25 weight (shared by at least two documents), which brings related ones
together wherever they were read, and gathered in that order into shards of bounded size. A
shard has a BM25 inverted index over token ids with the weights of the corpus. A seed
document starts a window; all its terms search, and its nearest unused documents follow
until the window is full or none is left that shares a term; a document that does not fit
is cut. The rest of a cut document is the next seed, otherwise the next unused document is.
What remains at the end of a shard goes into sequences whose lengths are powers of two, so
nothing is padded.

Documents in different shards do not meet.

Null text is empty and still has its end id. Repeated rows are packed once each; a null id
stays null. Sequence ids are unique: the partition's number, then a running number.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.pretoken import Cache, encoded
from sentspark.session import ship_package
from sentspark.storage import materialise

#: Longest sequence, and the id that ends a document.
LENGTH, END_ID = 1024, 0
#: Documents and tokens of a shard; a shard is closed by the document that reaches either.
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 21
#: Terms of more than this share of a shard's documents have a row for all of them.
DENSE = 1 / 16
#: Used documents are taken out of the index when fewer than this share of it is unused.
LIVE = 3 / 4
K1, B = 1.2, 0.75
#: Texts tokenised at once.
TEXTS = 256

TOKENISED = pa.schema(
    [("doc_id", pa.int64()), ("number", pa.int64()), ("size", pa.int64()), ("ids", pa.binary())]
    + [(c, pa.list_(pa.int64())) for c in ("terms", "df")]
)

_workers: dict[str, tuple[Cache, dict[str, int]]] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _encoder(path: str) -> tuple[Cache, dict[str, int]]:
    """The worker's cache of pre-tokens for the vocabulary file, and the special tokens."""
    if path not in _workers:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in t): i for t, i in stored["model"]["vocab"].items() if t not in special}
        # each pre-token is encoded alone, so the pattern takes whatever it is given
        model = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        _workers[path] = Cache(model.encode_ordinary), special
    return _workers[path]


def document_ids(texts: list[str], path: str):
    """Token ids of every text with the end id."""
    cache, special = _encoder(path)
    for ids in encoded(texts, cache, True, special):
        yield np.append(ids, np.uint32(END_ID))


class Corpus:
    """Documents, document frequencies and mean length of the whole corpus."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean = n, mean
        self.df = np.zeros(int(terms.max(initial=0)) + 1, np.int64)
        self.df[terms] = df

    def weighed(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and BM25 weight of every distinct pair, by document and term."""
        size = np.array([len(d) for d in docs])
        width = len(self.df)
        # in four bytes where they fit, which are sorted faster
        kind = np.uint32 if len(docs) * width < 1 << 32 else np.int64
        pairs = np.repeat((np.arange(len(docs)) * width).astype(kind), size) + np.concatenate(docs).astype(kind)
        pairs.sort()
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        tf = np.diff(np.r_[first, len(pairs)])
        doc, term = (x.astype(np.int64) for x in np.divmod(pairs[first], kind(width)))
        df = self.df[term]
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / self.mean)
        return doc, term, idf * tf * (K1 + 1) / (tf + norm[doc])

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        """The two strongest terms of every document that another one has, in one number."""
        doc, term, weight = self.weighed(docs)
        shared = self.df[term] > 1
        doc, term, weight = doc[shared], term[shared], weight[shared]
        out = np.zeros(len(docs), np.int64)
        if not len(doc):
            return out
        # documents lie one after the other, terms ascend in each: the first of the best is taken
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        many = np.diff(np.r_[first, len(doc)])
        for shift in (32, 0):
            best = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, first), many))
            best = best[np.r_[True, doc[best[1:]] != doc[best[:-1]]]]
            best = best[weight[best] > -np.inf]
            out[doc[best]] += term[best] << shift
            weight[best] = -np.inf
        return out


class Index:
    """BM25 over the token ids of a shard, with the weights of the corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        n = len(docs)
        doc, term, weight = corpus.weighed(docs)
        every = np.bincount(term, minlength=len(corpus.df))
        terms = np.flatnonzero(every)
        df, number = every[terms], (np.cumsum(every > 0) - 1)[term]
        # numbers of two bytes are sorted by digits
        order = np.argsort(number.astype(np.uint16) if len(terms) <= 1 << 16 else number, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.many, self.df = df, df
        self.terms, self.bounds = number, np.searchsorted(doc, np.arange(n + 1))
        usual = np.flatnonzero(df > max(1, DENSE * n))
        self.row = np.full(len(terms), -1)
        self.row[usual] = np.arange(len(usual))
        self.rows = np.zeros((len(usual), n))
        at = self.row[number] >= 0
        self.rows[self.row[number[at]], doc[at]] = weight[at]
        self.first = np.cumsum(df) - df
        #: The documents that are scored: all that are unused, and some that were used of late.
        self.unused, self.live = np.ones(n, bool), np.arange(n)

    def _without_used(self, left: np.ndarray) -> None:
        """Take out the used ones of ``live``; scores of the others stay as they are."""
        term = np.repeat(np.arange(len(self.many)), self.many)
        keep = left[self.doc]
        self.doc, self.weight = (np.cumsum(left) - 1)[self.doc[keep]], self.weight[keep]
        self.many = np.bincount(term[keep], minlength=len(self.many))
        self.first = np.cumsum(self.many) - self.many
        # take() keeps a row's numbers side by side
        self.rows, self.live = self.rows.take(np.flatnonzero(left), 1), self.live[left]

    def neighbours(self, seed: int) -> np.ndarray:
        """All unused documents that share a term with a seed, best first."""
        left = self.unused[self.live]
        if left.sum() < LIVE * len(left):
            self._without_used(left)
            left = self.unused[self.live]
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(0)
        terms = terms[(row < 0) & (self.df[terms] > 1)]
        if len(terms):
            many = self.many[terms]
            at = np.repeat(self.first[terms] - np.cumsum(many) + many, many) + np.arange(many.sum())
            score += np.bincount(self.doc[at], self.weight[at], len(score))
        best = np.flatnonzero(left & (score > 0))
        return self.live[best[np.argsort(-score[best], kind="stable")]]


def pack(docs: list[np.ndarray], corpus: Corpus) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a shard as (document, start, length, sequence, offset)."""
    index, n = Index(docs, corpus), len(docs)
    unused, size = index.unused, [len(d) for d in docs]
    sizes = np.array(size)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, filled, coming = 0, 0, 0

    def place(doc: int, start: int, length: int) -> None:
        nonlocal sequence, filled
        pieces.append((doc, start, length, sequence, filled))
        filled += length
        if filled == LENGTH:
            sequence, filled = sequence + 1, 0

    def place_all(doc: int, start: int = 0) -> None:
        while start < size[doc]:
            length = min(LENGTH - filled, size[doc] - start)
            place(doc, start, length)
            start += length

    seed = None
    while True:
        if seed is None:
            while coming < n and not unused[coming]:
                coming += 1
            if coming == n:
                break
            seed = coming
            unused[seed] = False
            place_all(seed)
        if not filled:
            seed = None
            continue
        near = index.neighbours(seed)
        fitting = near[sizes[near] <= LENGTH - filled]
        while filled and len(fitting):
            doc, fitting = int(fitting[0]), fitting[1:]
            unused[doc] = False
            place_all(doc)
            fitting = fitting[sizes[fitting] <= LENGTH - filled]
        near = near[unused[near]]
        if filled and len(near):
            cut = int(near[0])
            unused[cut] = False
            place_all(cut)
            seed = cut
        else:
            seed = None
    return _without_padding(pieces, sequence, filled)


def _without_padding(pieces, sequence: int, filled: int) -> list[tuple[int, int, int, int, int]]:
    """Deal the last, partial sequence out to sequences of a power of two."""
    if not filled:
        return pieces
    out = [p for p in pieces if p[3] != sequence]
    room = 1 << (filled.bit_length() - 1)
    offset = 0
    for doc, start, length, _, _ in (p for p in pieces if p[3] == sequence):
        while length:
            now = min(length, room - offset)
            out.append((doc, start, now, sequence, offset))
            start, length, offset = start + now, length - now, offset + now
            if offset == room:
                filled -= room
                sequence, offset = sequence + 1, 0
                room = 1 << max(filled.bit_length() - 1, 0)
    return out


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _tokenised(docs: DataFrame, vocabulary: str, text: str, id: str) -> DataFrame:
    """Documents with their token ids and a number of their own; and, without ids, the
    document frequencies of each task."""

    def run(batches):
        number, df = TaskContext.get().partitionId() << 33, np.zeros(0, np.int64)
        for batch in batches:
            every, texts = batch.column("doc_id"), batch.column("text")
            for k in range(0, batch.num_rows, TEXTS):
                some = [t or "" for t in texts.slice(k, TEXTS).to_pylist()]
                found = [d.astype("<u4") for d in document_ids(some, vocabulary)]
                terms = np.concatenate([np.unique(d) for d in found])
                count = np.bincount(terms, minlength=len(df))
                count[: len(df)] += df
                df, n = count, len(found)
                yield pa.record_batch(
                    {
                        "doc_id": every.slice(k, n),
                        "number": np.arange(number, number + n),
                        "size": pa.array([len(d) for d in found], pa.int64()),
                        "ids": pa.array([d.tobytes() for d in found], pa.binary()),
                        "terms": pa.nulls(n, pa.list_(pa.int64())),
                        "df": pa.nulls(n, pa.list_(pa.int64())),
                    }
                )
                number += n
        terms = np.flatnonzero(df)
        if len(terms):
            counted = {"terms": terms.tolist(), "df": df[terms].tolist()}
            none = {"doc_id": None, "number": None, "size": None, "ids": None}
            yield pa.RecordBatch.from_pylist([none | counted], TOKENISED)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, number long, size long, ids binary, terms array<long>, df array<long>"
    return materialise(rows.mapInArrow(run, schema), "packing-ids")


def corpus_counts(tokenised: DataFrame) -> Corpus:
    """The counts of the whole corpus; as many terms as the vocabulary has come to the driver."""
    n, tokens = tokenised.filter("ids is not null").agg(F.count("*"), F.sum("size")).first()
    each = tokenised.filter("df is not null").select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.*")
    found = each.groupBy("terms").agg(F.sum("df").alias("df")).toArrow()
    terms, df = (np.asarray(found.column(c).to_numpy(), np.int64) for c in ("terms", "df"))
    return Corpus(n, (tokens or 0) / max(n, 1), terms, df)


def packed(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The pieces of all documents; ``vocabulary`` is the path of a byte-level BPE file."""
    tokenised = _tokenised(docs, vocabulary, text, id)
    corpus = corpus_counts(tokenised)

    @F.arrow_udf("long")
    def key(ids: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for k in range(0, len(ids), TEXTS):
            out.append(corpus.keys([np.frombuffer(x, "<u4") for x in ids.slice(k, TEXTS).to_pylist()]))
        return pa.array(np.concatenate(out))

    def run(batches):
        partition = TaskContext.get().partitionId()
        base, ids, shard, tokens = partition << 32, [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc = np.frombuffer(data.as_py(), "<u4")
                ids.append(doc_id)
                shard.append(doc)
                tokens += len(doc)
                if len(shard) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    out, used = _rows(ids, shard, base, corpus)
                    yield out
                    base, ids, shard, tokens = base + used, [], [], 0
        if shard:
            yield _rows(ids, shard, base, corpus)[0]

    rows = tokenised.filter("ids is not null").select("doc_id", "number", "ids").withColumn("key", key("ids"))
    # the number deals out documents of one key and id
    near = rows.repartitionByRange("key", "doc_id", "number").sortWithinPartitions("key", "doc_id", "number")
    return near.select("doc_id", "ids").mapInArrow(run, SCHEMA)


def _rows(ids: list, docs: list[np.ndarray], base: int, corpus: Corpus) -> tuple[pa.RecordBatch, int]:
    pieces = pack(docs, corpus)
    doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    crc = [zlib.crc32(docs[d][s : s + n].astype("<u4")) for d, s, n, _, _ in pieces]
    out = pa.record_batch(
        {
            "doc_id": pa.array(ids, pa.int64()).take(pa.array(doc)),
            "start": start,
            "length": length,
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": np.array([len(d) for d in docs])[doc],
            "sequence_id": sequence + base,
            "offset": offset,
        }
    )
    return out, int(sequence.max()) + 1


def byte_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_lexical_packing")
def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packed(table(spark, sf_dir, "documents"), byte_vocabulary())
