"""Removal of word sequences that are repeated anywhere, by fixed-block anchors.

Every window of ``LENGTH`` words that starts at two places is removed at all of them.

1. *Index and probes.* Each document is cut into blocks of ``BLOCK_WORDS`` words side by
   side; every window of ``LENGTH`` words holds exactly one whole block first. The blocks
   are the index, and every rolling window of ``BLOCK_WORDS`` words of the corpus is a
   probe. A block that only its own probe hits lies in no repeated window.
2. *Extension.* Hits are extended to maximal repeats without pairing places. The windows
   around a hit block are dealt into runs that share an anchor, their word of least hash
   among the first ``BLOCK_WORDS``. A run whose whole stretch of words is found again is
   repeated throughout; one whose words after the anchor are found once is not repeated at
   all; only the runs at the ends of repeats have their windows counted one by one. Marked
   windows that overlap make up the maximal exact repeats.

Probes carry no place, only 40 bits of hash besides the slot they are dealt to, sorted and
written as differences; a false hit only costs an extension that finds nothing. Words
that decide are compared by two 64-bit hashes. Everything is dealt by hash of the words,
so a passage that very many documents share spreads over as many slots as it has words.

Words are runs of bytes other than space and 0x09 to 0x0D, unchanged. Null text has no
words. Documents with fewer than ``LENGTH`` words are kept. Repeated rows are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.frames import buckets, keyed
from sentspark.llm.rolling import Sums, buffers, mix, numbers, planes, ramp, row_blocks, word_codes, word_spans
from sentspark.llm.suffix import ENTRY, combined, per_row, ranges_of, sorted_entries
from sentspark.session import ship_package

#: Words of a window, and of a block: every window holds a whole block.
LENGTH = 35
BLOCK_WORDS = (LENGTH + 1) // 2
#: Probes gathered before they are dealt out.
FLUSH = 1 << 22

_U = np.uint64
_LOW = _U((1 << 40) - 1)
_INDEX = _U((1 << 30) - 1)


def _documents(batch: pa.RecordBatch):
    """Block by block: first row, running sums of the words, and each row's first word."""
    data, offsets = buffers(batch.column("data"))
    for a, b in row_blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, first = word_spans(part, at)
        yield a, Sums(word_codes(part, start, end)), first


def _deal(slot: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by slot, and each slot's range in it."""
    order = np.argsort(slot, kind="stable")
    ordered = slot[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order, list(zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(slot)], strict=True))


_PACKED = "slot int, kind int, a binary, b binary, c binary, d binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.record_batch(
        {n: pa.array(c, t) for n, c, t in zip(("slot", "kind", *"abcd"), columns, kinds, strict=True)}
    )


def _index(docs: DataFrame, n: int) -> DataFrame:
    """Probes (kind 0) and blocks (kind 1) of all documents, packed by slot."""

    def deal(hashes, blocks):
        probes = np.sort(np.concatenate(hashes))
        probes, count = np.unique(probes, return_counts=True)
        order, ranges = _deal((probes >> _U(40)) % _U(n))
        low = probes[order] & _LOW
        twice = np.minimum(count[order], 2).astype(np.uint8)
        out = []
        for s, a, b in ranges:
            by = np.argsort(low[a:b])
            steps = np.diff(low[a:b][by], prepend=_U(0))
            out.append((s, 0, planes(steps, 5), twice[a:b][by].tobytes(), None, None))
        h, doc, tk, number = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order, ranges = _deal((h >> _U(40)) % _U(n))
        h, doc, tk, number = h[order] & _LOW, doc[order], tk[order], number[order]
        for s, a, b in ranges:
            out.append((s, 1, planes(h[a:b], 5), doc[a:b].tobytes(), tk[a:b].tobytes(), planes(number[a:b], 8)))
        return _packed(out)

    def run(batches):
        hashes, blocks, total = [], [], 0
        for batch in batches:
            ids, tks = batch.column("row").to_numpy(), batch.column("tk").to_numpy()
            for a, sums, first in _documents(batch):
                size = np.diff(first)
                size[size < LENGTH] = 0
                rolling = sums.windows(BLOCK_WORDS)
                count = np.maximum(size - BLOCK_WORDS + 1, 0)
                hashes.append(rolling[np.repeat(first[:-1], count) + ramp(count)])
                count = size // BLOCK_WORDS
                number = ramp(count)
                owner = np.repeat(np.arange(len(size)), count)
                blocks.append((rolling[first[owner] + number * BLOCK_WORDS], ids[a + owner], tks[a + owner], number))
                total += len(hashes[-1])
                if total >= FLUSH:
                    yield deal(hashes, blocks)
                    hashes, blocks, total = [], [], 0
        if total:
            yield deal(hashes, blocks)

    return docs.mapInArrow(run, _PACKED)


def _hits(packed: DataFrame, n: int) -> DataFrame:
    """Blocks that are hit by another probe than their own."""

    def run(batches):
        probes, counts, blocks = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                high = _U(row["slot"]) << _U(40)
                if row["kind"] == 0:
                    probes.append(np.cumsum(numbers(row["a"], 5)) + high)
                    counts.append(np.frombuffer(row["b"], np.uint8))
                else:
                    blocks.append(
                        (
                            numbers(row["a"], 5) + high,
                            np.frombuffer(row["b"], np.int64),
                            np.frombuffer(row["c"], np.int64),
                            numbers(row["d"], 8).astype(np.int64),
                        )
                    )
        if not blocks:
            return
        key, count = np.concatenate(probes), np.concatenate(counts)
        del probes, counts
        order = np.argsort(key)
        key, count = key[order], count[order]
        again = count > 1
        again[1:] |= key[1:] == key[:-1]
        found = key[again]
        for h, doc, tk, number in blocks:
            if not len(found):
                return
            hit = found[np.minimum(np.searchsorted(found, h), len(found) - 1)] == h
            yield pa.record_batch({"row": doc[hit], "tk": tk[hit], "number": number[hit]})

    return packed.repartition(n, "slot").mapInArrow(run, "row long, tk long, number long")


def _rows(text: str, docs: DataFrame, id: str) -> DataFrame:
    return keyed(docs, text, id).withColumn("row", F.coalesce("doc_id", F.lit(0)))


def _runs(sums: Sums, codes_first: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the ``wanted`` windows with one anchor: start, number, and the two hashes."""
    order = mix(codes_first.copy()) & ~_INDEX
    key = order | np.arange(len(order), dtype=np.uint64)
    least, step = key, 1
    while step * 2 <= BLOCK_WORDS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < BLOCK_WORDS:
        rest = BLOCK_WORDS - step
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least[wanted] & _INDEX).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(wanted) != 1)])
    count = np.diff(np.r_[starts, len(wanted)])
    lo, anchor = wanted[starts], anchor[starts]
    return lo, count, sums.spans(anchor, anchor + LENGTH - BLOCK_WORDS + 1), sums.spans(lo, lo + count - 1 + LENGTH)


def _entries(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Runs of windows around the hit blocks."""
    listed = hits.groupBy("row", "tk").agg(F.collect_list("number").alias("numbers"))
    # all columns of the rows, as in the other joins with texts, so that texts are dealt out once
    joined = rows.join(listed, ["row", "tk"]).select(*(rows[c] for c in rows.columns), "numbers")

    def parts(batches):
        for batch in batches:
            ids, tks, lists = batch.column("row"), batch.column("tk"), batch.column("numbers")
            for a, sums, first in _documents(batch):
                los = []
                for d in range(len(first) - 1):
                    n = int(first[d + 1] - first[d])
                    at = np.unique(lists[a + d].values.to_numpy()) * BLOCK_WORDS
                    windows = (at[:, None] + np.arange(1 - BLOCK_WORDS, 1)).ravel()
                    los.append(first[d] + windows[(windows >= 0) & (windows <= n - LENGTH)])
                wanted = np.concatenate(los)
                if not len(wanted):
                    continue
                lo, count, common, context = _runs(sums, sums.windows(1), wanted)
                owner = np.searchsorted(first, lo, "right") - 1
                place = pa.array(owner + a)
                lo, count = pa.array(lo - first[owner]), pa.array(count.astype(np.int32))
                yield common, context, ids.take(place), tks.take(place), lo, count

    return joined.mapInArrow(lambda batches: combined(parts(batches)), ENTRY)


def window_entries(batch: pa.RecordBatch):
    """Runs of all windows of the documents of ``batch``, without the index of blocks."""
    ids, tks = batch.column("doc_id"), batch.column("tk")
    for a, sums, first in _documents(batch):
        count = np.maximum(np.diff(first) - LENGTH + 1, 0)
        wanted = np.repeat(first[:-1], count) + ramp(count)
        if not len(wanted):
            continue
        lo, n, common, context = _runs(sums, sums.windows(1), wanted)
        owner = np.searchsorted(first, lo, "right") - 1
        at = pa.array(owner + a)
        yield common, context, ids.take(at), tks.take(at), pa.array(lo - first[owner]), pa.array(n.astype(np.int32))


def window_places(batch: pa.RecordBatch, lists: pa.Array, id: str = "doc_id"):
    """Every window of ``lists`` (ranges of each row), with its hash as ``context``."""
    ids, tks = batch.column(id), batch.column("tk").to_numpy()
    for a, sums, first in _documents(batch):
        for d in range(len(first) - 1):
            ranges = lists[a + d].values
            if not len(ranges):
                continue
            common, lo, n = (ranges.field(k).to_numpy() for k in range(3))
            at = np.repeat(lo, n) + ramp(n)
            start = first[d] + at
            yield (
                np.repeat(common, n).view(np.uint64),
                sums.spans(start, start + LENGTH),
                ids.take(pa.array(np.full(len(at), a + d))),
                pa.array(np.full(len(at), tks[a + d])),
                pa.array(at),
                pa.array(np.ones(len(at), np.int32)),
            )


def _windows(rows: DataFrame, borders: DataFrame) -> DataFrame:
    """Every window of the border runs."""
    listed = per_row(borders, "common", "lo", "n")
    joined = rows.join(listed, (rows["row"] == listed["doc_id"]) & (rows["tk"] == listed["tk"])).select(
        *(rows[c] for c in rows.columns), "ranges"
    )

    def parts(batches):
        for batch in batches:
            yield from window_places(batch, batch.column("ranges"), "row")

    return joined.mapInArrow(lambda batches: combined(parts(batches)), ENTRY)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``row``, ``tk`` and ranges (``lo``, ``n``) of windows that are repeated."""
    n = buckets(rows.sparkSession)
    found = sorted_entries(_entries(rows, _hits(_index(rows, n), n)))
    ranges = ranges_of(found, _windows(rows, found.filter("border")))
    return ranges.withColumnRenamed("doc_id", "row")


def _kept(data: np.ndarray, start: np.ndarray, end: np.ndarray, ranges) -> tuple[int, bytes]:
    """Number of removed words, and the kept words joined by one space."""
    edges = np.zeros(len(start) + 1, np.int64)
    for r in ranges:
        edges[r["lo"]] += 1
        edges[min(r["lo"] + r["n"] - 1 + LENGTH, len(start))] -= 1
    keep = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]
    return len(start) - len(keep), b" ".join(words)


def removal_report(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """What is removed of every document, and the hash of what is kept."""
    rows = _rows(text, docs, id)
    found = repeated_windows(rows)
    cut = rows.join(found, ["row", "tk"], "left").select(*(rows[c] for c in rows.columns), "ranges")

    def run(batches):
        for batch in batches:
            out = []
            data, offsets = buffers(batch.column("data"))
            lists = batch.column("ranges")
            for a, b in row_blocks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, first = word_spans(part, at)
                for d in range(b - a):
                    some = slice(first[d], first[d + 1])
                    removed, kept = _kept(
                        part[at[d] : at[d + 1]], start[some] - at[d], end[some] - at[d], lists[a + d].as_py() or ()
                    )
                    out.append((int(first[d + 1] - first[d]), removed, hashlib.sha256(kept).hexdigest()))
            words, removed, kept = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(words, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array(kept, pa.string()),
                }
            )

    return cut.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@query("op5_fixed_block_anchors")
def op5_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return removal_report(table(spark, sf_dir, "documents"))
