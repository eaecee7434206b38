"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Every text is encoded twice, with a byte-level BPE vocabulary (A) and a piece model (B). Both
token sequences cover the same bytes: a space and the text. A block of documents is aligned
at once: its A tokens lie side by side, as do its B tokens, with the byte where each one
ends. A lane is a document, or a piece of a long one between two bytes where both sequences
have a border. One NumPy state holds the A and the B pointer of every lane. A step emits the
link of each lane's two current tokens, compares their ends, emits a cut where they are
equal, and moves the pointer of the token that ends first (both at a cut); finished lanes
leave the state. So a block takes as many steps as its longest lane has tokens.

How often a pair of ids is linked in the whole corpus is counted from one row per block and
pair. The totals go back to the blocks through a join by pair, so a task only holds the
pairs of its block, and neither the driver nor a broadcast holds any of them. The highest
count per B id is as many rows as B has ids.

A text that is null or empty, or whose A or B bytes differ from space + text (the piece model
writes U+2581 as a space), has no tokens: zeros and an empty text instead of the hash. Repeated
rows are documents of their own and count each. Null ids stay null, extra columns change
nothing, an empty table gives no rows. Special tokens' strings inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.packing import _encoder, byte_alphabet, byte_vocabulary
from sentspark.llm.pretoken import CHARS, REMEMBERED, Cache, blocks, code_points, encoded
from sentspark.llm.rolling import Sums, mix, numbers, planes, ramp
from sentspark.session import ship_package
from sentspark.storage import materialise

#: Bytes of text aligned together, and bytes after which a lane of a long document may end.
BLOCK, LANE = 2 << 20, 512
#: Bytes of a packed number of a pair within its block, and of a packed multiplicity.
_PLACE, _TIMES = 4, 4

_BORDER = 0x110000
_pieces: dict[str, Pieces] = {}
_letters: dict[str, tuple[Tokens, Words]] = {}


class Tokens:
    """The bytes and the decimal form of every id."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(t) for t in table])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        written = [str(i).encode() for i in range(len(table))]
        self.width = np.array([len(w) for w in written])
        if self.width.max(initial=0) > 7:
            raise ValueError("ids of more than seven digits")
        # the digits are the low bytes of a number, with room for a sign after them
        self.digits = np.array([int.from_bytes(w, "little") for w in written], np.uint64)

    def __len__(self) -> int:
        return len(self.size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens side by side."""
        size = self.size[ids]
        return self.flat[np.repeat(self.first[ids], size) + ramp(size)]

    def written(self, ids: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The decimal form of every id with a sign after it, as eight bytes filled up with zeros."""
        return self.digits[ids] + (after.astype(np.uint64) << (8 * self.width[ids]).astype(np.uint64))


class Words(Cache):
    """A cache that first looks into a table by the leading bits of a word's hash."""

    BITS = 20

    def clear(self) -> None:
        super().clear()
        self.seen = np.zeros(1 << self.BITS, np.uint64)
        self.entry = np.zeros(1 << self.BITS, np.int64)

    def numbers(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.int64)
        if len(self.keys) > REMEMBERED:
            self.clear()
        keys = Sums(mix(cp.astype(np.uint64) + np.uint64(1))).spans(start, end)
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.entry[slot]
        other = np.flatnonzero(self.seen[slot] != keys)
        if len(other):
            out[other] = super().numbers(cp, start[other], end[other])
            self.seen[slot[other]], self.entry[slot[other]] = keys[other], out[other]
        return out


def byte_tokens(path: str) -> tuple[Tokens, Words]:
    """Byte-level decoded entries of the vocabulary file, and the worker's encoded words."""
    if path not in _letters:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_alphabet()
        table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        _letters[path] = Tokens(table), Words(_encoder(path)[0].compute)
    return _letters[path]


class Pieces:
    """A piece model that encodes every distinct word once.

    No piece has a space after another character, so none reaches over such a place: a text
    is cut there, and its words (spaces and what follows them) are encoded alone. Texts with
    U+2581, which the model reads as a space, are the exception; their bytes differ anyway.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"{path} has pieces that hold a space inside")
        table = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(names)
        ]
        self.tokens = Tokens(table)
        self.cache = Words(self._word)

    def _word(self, word: str) -> list[int]:
        # the model writes the first space itself, but none for an empty text
        return self.model.encode(word[1:], num_threads=1) if word != " " else [self.model.piece_to_id("▁")]

    def encode(self, texts: list[str]):
        """The ids of every text, which begins with the space that the model would add."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            at = 0
            while len(text) - at > 2 * CHARS and (end := _word_start(text, at + CHARS)) > 0:
                parts.append(text[at:end])
                owner.append(k)
                at = end
            parts.append(text[at:] if at else text)
            owner.append(k)
        ids, now = [], 0
        for a, b in blocks([len(p) for p in parts]):
            cp = code_points(parts[a:b])
            space = cp == 0x20
            new = np.r_[True, space[1:] & ~space[:-1]]
            new[1:] |= cp[:-1] == _BORDER
            border = cp == _BORDER
            start = np.flatnonzero(new & ~border)
            stop = np.flatnonzero(new | border)
            end = stop[np.searchsorted(stop, start, "right")]
            flat, begins = self.cache.values(self.cache.numbers(cp, start, end))
            borders = np.r_[0, np.cumsum([len(p) + 1 for p in parts[a:b]])]
            cuts = begins[np.searchsorted(start, borders)]
            for k in range(a, b):
                if owner[k] != now:
                    yield np.concatenate(ids)
                    ids, now = [], owner[k]
                ids.append(flat[cuts[k - a] : cuts[k - a + 1]])
        if ids:
            yield np.concatenate(ids)


def _word_start(text: str, at: int) -> int:
    """A place at or after ``at`` where a space follows another character; 0 if there is none."""
    while (at := text.find(" ", at)) > 0:
        if text[at - 1] != " ":
            return at
        at += 1
    return 0


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def lockstep(ends_a, ends_b, a, b, last_a):
    """Links and cuts of lanes that begin at the tokens ``a`` and ``b`` and end before ``last_a``.

    ``ends_a`` and ``ends_b`` are the bytes at which the tokens end. Returns the linked A and
    B tokens, and the A and B tokens before each cut.
    """
    links, cuts = [], []
    while len(a):
        links.append((a, b))
        x, y = ends_a[a], ends_b[b]
        both = np.flatnonzero(x == y)
        if len(both):
            cuts.append((a[both], b[both]))
        a, b = a + (x <= y), b + (y <= x)
        live = a < last_a
        if not live.all():
            a, b, last_a = a[live], b[live], last_a[live]
    none = np.zeros(0, np.int64)
    link_a, link_b = (np.concatenate([p[k] for p in links]) if links else none for k in (0, 1))
    cut_a, cut_b = (np.sort(np.concatenate([p[k] for p in cuts])) if cuts else none for k in (0, 1))
    return link_a, link_b, cut_a, cut_b


class Block:
    """Documents with both token sequences, aligned."""

    def __init__(self, texts: list[str], path_a: str, path_b: str):
        n = len(texts)
        asked = [" " + t for t in texts]
        (self.tokens_a, words), known_b = byte_tokens(path_a), pieces(path_b)
        self.tokens_b = known_b.tokens
        a = [x.astype(np.int64) for x in encoded(asked, words, True, {})]
        b = [x.astype(np.int64) for x in known_b.encode(asked)]
        self._drop_unlike(asked, a, b)
        none = np.zeros(0, np.int64)
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([none, *side]) for side in (a, b))
        self.first_a, self.first_b = (np.r_[0, np.cumsum(m)] for m in (self.n_a, self.n_b))
        self.ends_a, self.ends_b = np.cumsum(self.tokens_a.size[self.a]), np.cumsum(self.tokens_b.size[self.b])
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(self.ends_a, self.ends_b, *self._lanes())
        self.doc_a = np.repeat(np.arange(n), self.n_a)
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=n)
        self.n_groups = np.bincount(self.doc_a[self.cut_a], minlength=n)

    def _drop_unlike(self, texts: list[str], a: list[np.ndarray], b: list[np.ndarray]) -> None:
        """Take the tokens from texts that are only the added space, or whose tokens have other bytes."""
        whole = [t.encode() for t in texts]
        size = np.array([len(w) for w in whole])
        unlike = size == 1
        for tokens, side in ((self.tokens_a, a), (self.tokens_b, b)):
            owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
            ids = np.concatenate([np.zeros(0, np.int64), *side])
            unlike |= np.bincount(owner, tokens.size[ids], len(side)).astype(np.int64) != size
            flat = tokens.joined(ids[~unlike[owner]])
            same = np.frombuffer(b"".join(w for w, x in zip(whole, unlike, strict=True) if not x), np.uint8)
            doc = np.flatnonzero(~unlike)
            differ = np.flatnonzero(flat != same)
            unlike[doc[np.unique(np.searchsorted(np.cumsum(size[doc]), differ, "right"))]] = True
        for k in np.flatnonzero(unlike):
            a[k] = b[k] = np.zeros(0, np.int64)

    def _lanes(self):
        """First A and B token of every lane, and its last A token plus one."""
        if not len(self.a):
            return (np.zeros(0, np.int64),) * 3
        # bytes where documents end, and where both sequences have a border near a multiple of LANE
        docs = self.ends_a[self.first_a[1:][self.n_a > 0] - 1]
        near = self.ends_a[np.searchsorted(self.ends_a, np.arange(LANE, self.ends_a[-1], LANE))]
        at = np.searchsorted(self.ends_b, near)
        near = near[self.ends_b[np.minimum(at, len(self.ends_b) - 1)] == near]
        last = np.unique(np.r_[docs, near])
        end_a, end_b = (np.searchsorted(e, last, "right") for e in (self.ends_a, self.ends_b))
        # a token without bytes would stand at the end of a lane; neither vocabulary makes one
        return np.r_[0, end_a[:-1]], np.r_[0, end_b[:-1]], end_a

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every document."""
        n_a, n_b = len(self.a), len(self.b)
        group_a, group_b = _groups(self.cut_a, n_a), _groups(self.cut_b, n_b)
        # all A tokens of a group come before its B tokens
        before_b = np.r_[0, self.cut_b + 1]
        at_a = np.arange(n_a) + before_b[group_a]
        at_b = np.arange(n_b) + self.cut_a[group_b] + 1 if n_b else np.zeros(0, np.int64)
        after_a, after_b = np.full(n_a, ord(","), np.uint8), np.full(n_b, ord(","), np.uint8)
        after_a[self.cut_a], after_b[self.cut_b] = ord("|"), ord(";")
        written, width = np.empty(n_a + n_b, np.uint64), np.empty(n_a + n_b, np.int64)
        written[at_a], written[at_b] = self.tokens_a.written(self.a, after_a), self.tokens_b.written(self.b, after_b)
        width[at_a], width[at_b] = self.tokens_a.width[self.a], self.tokens_b.width[self.b]
        spread = written.astype("<u8").view(np.uint8)
        flat = spread[spread != 0].tobytes()
        ends = np.r_[0, np.cumsum(width + 1)][self.first_a + self.first_b]
        return [flat[x : max(y - 1, x)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def pairs(self):
        """Distinct id pairs and their links; per document the places of its pairs, and their links."""
        code = self.a[self.link_a] * len(self.tokens_b) + self.b[self.link_b]
        distinct, place, links = np.unique(code, return_inverse=True, return_counts=True)
        own, times = np.unique(self.doc_a[self.link_a] * len(distinct) + place, return_counts=True)
        doc, place = np.divmod(own, max(len(distinct), 1))
        return distinct, links, np.searchsorted(doc, np.arange(len(self.n_a) + 1)), place, times


def _blocks_of(batches):
    """Ids and texts of at most ``BLOCK`` bytes (or of one longer text)."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1].encode())
            if size >= BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _groups(last: np.ndarray, n: int) -> np.ndarray:
    """The group of each of ``n`` tokens, where ``last`` are the last ones of the groups."""
    first = np.zeros(n + 1, np.int64)
    first[last + 1] = 1
    return np.cumsum(first[:-1])


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its packed pairs, and one row per block and distinct pair."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks_of(batches):
            block, n = Block(texts, path_a, path_b), len(ids)
            distinct, links, first, place, times = block.pairs()
            bounds = first.tolist()
            own = list(zip(bounds, bounds[1:], strict=False))
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in block.group_texts()]
            yield pa.record_batch(
                {
                    "block": np.full(n, number),
                    "pair": pa.nulls(n, pa.int64()),
                    "links": pa.nulls(n, pa.int64()),
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_a": block.n_a,
                    "n_b": block.n_b,
                    "n_groups": block.n_groups,
                    "n_links": block.n_links,
                    "groups_sha256": pa.array(sha, pa.string()),
                    "places": pa.array([planes(place[x:y], _PLACE) for x, y in own], pa.binary()),
                    "times": pa.array([planes(times[x:y], _TIMES) for x, y in own], pa.binary()),
                }
            )
            if len(distinct):
                m = len(distinct)
                none = {c: pa.nulls(m, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
                yield pa.record_batch(
                    {"block": np.full(m, number), "pair": distinct, "links": links}
                    | none
                    | {"groups_sha256": pa.nulls(m, pa.string())}
                    | {c: pa.nulls(m, pa.binary()) for c in ("places", "times")}
                )
            number += 1

    return docs.mapInArrow(run, f"block long, pair long, links long, {_DOC}, places binary, times binary")


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """``pair``, ``total`` (links of the corpus) and ``best``: whether it is its B id's highest."""
    totals = pairs.groupBy("pair").agg(F.sum("links").alias("total"))
    totals = materialise(totals.withColumn("b", F.col("pair") % width), "alignment-totals")
    # as many rows as B has ids
    highest = F.broadcast(totals.groupBy("b").agg(F.max("total").alias("highest")))
    return totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Token, group and link counts, corpus-wide counts of the links, and the groups' hash."""
    rows = materialise(_aligned(_narrow(docs, text, id), path_a, path_b), "alignment-blocks")
    pairs = rows.filter("pair is not null").select("block", "pair", "links")
    counts = pair_counts(pairs, len(pieces(path_b).tokens))
    known = pairs.join(counts, "pair").select(F.col("block").alias("own_block"), "pair", "total", "best")
    own = rows.filter("pair is null").select("block", *(c.split()[0] for c in _DOC.split(", ")), "places", "times")

    def scored(documents: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("pair")
        total = totals.column("total").to_numpy()
        best = totals.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        n_best, count_sum = [], []
        for p, t in zip(documents.column("places"), documents.column("times"), strict=True):
            place, times = numbers(p.as_py(), _PLACE).astype(np.int64), numbers(t.as_py(), _TIMES).astype(np.int64)
            n_best.append(int((times * best[place]).sum()))
            count_sum.append(int((times * total[place]).sum()))
        kept = documents.select([c.split()[0] for c in _DOC.split(", ")])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(count_sum, pa.int64())
        )

    found = own.groupBy("block").cogroup(known.groupBy("own_block")).applyInArrow(scored, f"{_DOC}, n_best long, count_sum long")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Both ids of every document, the groups' ends in them, and the links as places in them."""

    def run(batches):
        for ids, texts in _blocks_of(batches):
            block = Block(texts, path_a, path_b)
            order = np.lexsort((block.link_b, block.link_a))
            link_a, link_b = block.link_a[order], block.link_b[order]
            doc_cut = block.doc_a[block.cut_a]
            doc_link = block.doc_a[link_a]
            starts = lambda doc: np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)

            def lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))

            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "a_ids": lists(block.a, block.first_a.astype(np.int32)),
                    "b_ids": lists(block.b, block.first_b.astype(np.int32)),
                    "a_ends": lists(block.cut_a - block.first_a[doc_cut] + 1, starts(doc_cut)),
                    "b_ends": lists(block.cut_b - block.first_b[doc_cut] + 1, starts(doc_cut)),
                    "links_a": lists(link_a - block.first_a[doc_link], starts(doc_link)),
                    "links_b": lists(link_b - block.first_b[doc_link], starts(doc_link)),
                }
            )

    arrays = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_ends", "b_ends", "links_a", "links_b"))
    return _narrow(docs, text, id).mapInArrow(run, f"doc_id long, {arrays}")


def _narrow(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_lockstep_alignment")
def op11_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return alignment_report(table(spark, sf_dir, "documents"), byte_vocabulary(), piece_model())
