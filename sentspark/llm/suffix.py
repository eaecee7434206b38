"""Removal of byte strings that are repeated anywhere, by prefix-free parsing.

Every string of ``LENGTH`` bytes that starts at two places is removed at all of them. The
text is never expanded into one row per byte; the parse stands for it:

1. *Parse.* The trigger of a position is the place of the least rolling hash of ``WINDOW``
   bytes among the ``REACH`` places from there on. It depends on the string that starts at
   the position alone, so equal strings have their trigger at the same distance. Triggers
   cut the text into phrases; the positions that share a trigger are one entry of the
   parse, named by the string that all of them have in common, from the trigger on
   (``common``), and by all bytes that their strings cover (``context``).
2. *Parse suffixes.* Entries are sorted by the names, which puts equal suffixes of the
   parse, as far as ``LENGTH`` bytes need them, next to each other. An entry whose
   ``common`` is found once has no repeated position. An entry whose ``context`` is found
   twice has only repeated positions. Both are decided per entry, not per byte.
3. *Dictionary suffixes.* What remains are entries at the borders of repeats: their
   phrases differ, but suffixes of them may agree. Only for these, and one entry for each
   context that shares their ``common``, is every position named by its own string, and
   sorted within its ``common``.

So the two sorted suffix lists, of the parse and of the dictionary, are combined as far as
equality of ``LENGTH`` bytes asks; a total order of the corpus is never built. Strings are
compared by two 64-bit hashes together (``common`` and ``context``, or ``common`` and the
string).

Null text is empty. Repeated rows are repeated text like any other. Texts shorter than
``LENGTH`` bytes are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.frames import free, keyed, same_row
from sentspark.llm.rolling import BLOCK, buffers, byte_sums, ramp, row_blocks
from sentspark.session import ship_package
from sentspark.storage import materialise

LENGTH = 400
#: Bytes of a rolling-hash window, and places among which the least one is the trigger.
WINDOW, REACH = 16, 128
#: Entries gathered before they are combined.
GATHER = 1 << 18

_U = np.uint64
_INDEX = _U((1 << 22) - 1)


def _pieces(offsets: np.ndarray):
    """Blocks as (first row, rows, first byte within the row, bytes from, bytes to)."""
    for a, b in row_blocks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= 2 * BLOCK:
            yield a, b - a, 0, lo, hi
            continue
        for at in range(0, max(hi - lo - LENGTH + 1, 1), BLOCK):
            yield a, 1, at, lo + at, min(lo + at + BLOCK + LENGTH - 1, hi)


def _parse(part: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of a block: row, first position, positions, and the two names."""
    sums = byte_sums(part)
    n = len(part)
    limit = np.repeat(borders[1:], np.diff(borders)) - LENGTH
    place = np.arange(n)
    inside = place <= limit
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    key = (sums.windows(WINDOW) & ~_INDEX) | place[: n - WINDOW + 1].astype(np.uint64)
    step = 1
    while step < REACH:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    valid = np.flatnonzero(inside[: len(key)])
    trigger = (key[valid] & _INDEX).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (np.diff(valid) != 1)])
    count = np.diff(np.r_[starts, len(valid)])
    lo, trigger = valid[starts], trigger[starts]
    row = np.searchsorted(borders, lo, "right") - 1
    common = sums.spans(trigger, trigger + (LENGTH - REACH + 1))
    context = sums.spans(lo, lo + count - 1 + LENGTH)
    return row, lo - borders[row], count, common, context


ENTRY = "common long, context long, doc_id long, tk long, lo long, n int, mark int"
#: Bits of ``mark``: found again, found with another context, dealt by both names.
AGAIN, VARIED, APART = 1, 2, 4


def combined(parts) -> Iterator[pa.RecordBatch]:
    """Entries (the columns of ``ENTRY`` but the last), combined before they are dealt out.

    Among entries that are gathered together, the first of those with one ``common`` stands
    for it. The first of each further ``context`` is known to vary, and can be dealt by both
    names. All others repeat both names: they are known to be whole and go on under a number
    of their own. So what very many places share is not dealt to one task place by place.
    """
    held: list[tuple] = []
    total, number = 0, -(TaskContext.get().partitionId() + 1) << 36

    def flush():
        nonlocal number
        common, context = (np.concatenate([part[k] for part in held]).view(np.int64) for k in range(2))
        doc_id, tk, lo, n = (pa.concat_arrays([part[k] for part in held]) for k in range(2, 6))
        mark = np.zeros(len(common), np.int32)
        order = np.lexsort((context, common))
        near = common[order][1:] == common[order][:-1]
        same = near & (context[order][1:] == context[order][:-1])
        mark[order[:-1][same]] |= AGAIN
        mark[order[1:][near & ~same]] |= VARIED | APART
        # the first of a common varies if any entry of its stretch does
        first = np.flatnonzero(np.r_[True, ~near])
        mark[order[first]] |= np.maximum.reduceat(mark[order], first) & VARIED
        spare = np.sort(order[1:][same])
        mark[spare] = AGAIN
        common[spare] = number + np.arange(len(spare))
        context[spare] = 0
        number += len(spare)
        columns = (pa.array(common), pa.array(context), doc_id, tk, lo, n, pa.array(mark))
        return pa.record_batch(dict(zip(("common", "context", "doc_id", "tk", "lo", "n", "mark"), columns, strict=True)))

    for part in parts:
        held.append(part)
        total += len(part[0])
        if total >= GATHER:
            yield flush()
            held, total = [], 0
    if total:
        yield flush()


def string_entries(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The entries of the documents of ``batch``, block by block, as :func:`combined` takes them."""
    data, offsets = buffers(batch.column("data"))
    ids, tks = batch.column("doc_id"), batch.column("tk")
    for first, rows, skip, a, b in _pieces(offsets):
        borders = offsets[first : first + rows + 1] - a if rows > 1 or not skip else np.array([0, b - a])
        borders = np.clip(borders, 0, b - a)
        row, lo, count, common, context = _parse(data[a:b], borders)
        at = pa.array(row + first)
        yield common, context, ids.take(at), tks.take(at), pa.array(lo + skip), pa.array(count.astype(np.int32))


def _entries(docs: DataFrame) -> DataFrame:
    def parts(batches):
        for batch in batches:
            yield from string_entries(batch)

    return docs.mapInArrow(lambda batches: combined(parts(batches)), ENTRY)


def _copies() -> Column:
    return F.lit(1) + F.col("mark").bitwiseAND(AGAIN)


def sorted_entries(entries: DataFrame) -> DataFrame:
    """Entries that may hold repeats: ``whole`` ones, and ``border`` ones to be looked into."""
    apart = F.col("mark").bitwiseAND(APART) > 0
    dealt = entries.withColumn("deal", F.when(apart, F.xxhash64("common", "context")).otherwise(F.col("common")))
    same = Window.partitionBy("deal", "common", "context")
    order = same.orderBy("doc_id", "tk", "lo")
    suffix = Window.partitionBy("deal")
    marked = dealt.repartition("deal").select(
        "*",
        F.sum(_copies()).over(same).alias("copies"),
        F.row_number().over(order).alias("copy"),
        ((F.count("*").over(suffix) > 1) | (F.max("mark").over(suffix) > 0)).alias("found"),
        (
            (F.min("context").over(suffix) != F.max("context").over(suffix))
            | (F.max(F.col("mark").bitwiseAND(VARIED)).over(suffix) > 0)
        ).alias("varied"),
    )
    return marked.filter("found").select(
        "common",
        "doc_id",
        "tk",
        "lo",
        "n",
        (F.col("copies") > 1).alias("whole"),
        (F.col("varied") & (F.col("copy") == 1)).alias("border"),
    )


def per_row(ranges: DataFrame, *columns: str) -> DataFrame:
    return ranges.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*columns)).alias("ranges"))


def string_positions(batch: pa.RecordBatch, lists: pa.Array) -> Iterator[tuple]:
    """Every position of ``lists`` (ranges of each row), with the hash of its string as ``context``."""
    data, offsets = buffers(batch.column("data"))
    flat = lists.flatten()
    los, ns, commons = (flat.field(k).to_numpy() for k in (1, 2, 0))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    for i in range(batch.num_rows):
        k = slice(ends[i], ends[i + 1])
        order = np.argsort(los[k])
        lo, n, common = los[k][order], ns[k][order], commons[k][order]
        text = data[offsets[i] : offsets[i + 1]]
        out = []
        # neighbouring ranges are hashed together, a bounded stretch at a time
        for group in _stretches(lo, n):
            base = lo[group[0]]
            sums = byte_sums(text[base : lo[group[-1]] + n[group[-1]] - 1 + LENGTH])
            at = np.repeat(lo[group] - base, n[group]) + ramp(n[group])
            out.append((sums.spans(at, at + LENGTH), at + base, np.repeat(common[group], n[group])))
        if out:
            h, at, c = (np.concatenate(x) for x in zip(*out, strict=True))
            doc_id = pa.array([batch.column("doc_id")[i].as_py()] * len(h), pa.int64())
            tk = pa.array(np.full(len(h), batch.column("tk")[i].as_py(), np.int64))
            yield c.view(np.uint64), h, doc_id, tk, pa.array(at), pa.array(np.ones(len(h), np.int32))


def _positions(docs: DataFrame, borders: DataFrame) -> DataFrame:
    """Every position of the border entries."""
    listed = per_row(borders, "common", "lo", "n")
    joined = docs.join(listed, same_row(docs, listed)).select(docs["doc_id"], docs["tk"], "data", "ranges")

    def parts(batches):
        for batch in batches:
            yield from string_positions(batch, batch.column("ranges"))

    return joined.mapInArrow(lambda batches: combined(parts(batches)), ENTRY)


def ranges_of(found: DataFrame, named: DataFrame) -> DataFrame:
    """Ranges of the whole entries, and of the border positions whose string is found again."""
    again = Window.partitionBy("common", "context")
    inner = named.withColumn("copies", F.sum(_copies()).over(again)).filter("copies > 1")
    whole = found.filter("whole").select("doc_id", "tk", "lo", "n")
    single = inner.select("doc_id", "tk", "lo", F.lit(1).alias("n"))
    return per_row(whole.union(single), "lo", "n")


def _stretches(lo: np.ndarray, n: np.ndarray):
    start = 0
    for k in range(1, len(lo) + 1):
        if k == len(lo) or lo[k] - lo[k - 1] > LENGTH or lo[k] - lo[start] > BLOCK:
            yield np.arange(start, k)
            start = k


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tk`` and ranges (``lo``, ``n``) of positions of repeated strings.

    ``docs`` has the columns of :func:`sentspark.llm.frames.keyed`.
    """
    found = materialise(sorted_entries(_entries(docs)), "suffix-entries")
    named = _positions(docs, found.filter("border"))
    return ranges_of(found, named)


def cut_spans(ranges: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs, from ranges of positions whose strings go."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["lo"] + r["n"] - 1 + LENGTH) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return [(a, min(b, size)) for a, b in out]


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, in the same columns.

    A character that a cut divides is dropped. ``n_chars`` follows the text where it is a
    column. Documents are kept even when nothing of their text is left. Further columns may
    have any names.
    """
    id, tk, ranges = free(docs, "_id", "_tk", "_ranges")
    found = repeats(keyed(docs, text)).select(
        F.col("doc_id").alias(id), F.col("tk").alias(tk), F.col("ranges").alias(ranges)
    )

    @F.arrow_udf("string")
    def trimmed(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            # also called for rows that nothing is cut from
            if t is None or r is None:
                out.append(t)
                continue
            data = t.encode()
            out.append(kept(data, cut_spans(r, len(data))).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    on = F.col("doc_id").cast("long").eqNullSafe(F.col(id)) & (F.xxhash64(F.col(text)) == F.col(tk))
    cut = docs.join(found, on, "left").withColumn(
        text, F.when(F.col(ranges).isNull(), F.col(text)).otherwise(trimmed(text, ranges))
    )
    if "n_chars" in docs.columns:
        size = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col(ranges).isNull(), F.col("n_chars")).otherwise(size))
    return cut.select(*docs.columns)


def removal_report(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """What is removed of every document, and the hash of what is kept."""
    rows = keyed(docs, text, id)
    found = repeats(rows)
    cut = rows.join(found, same_row(rows, found), "left").select(rows["doc_id"], "data", "ranges")

    def run(batches):
        for batch in batches:
            removed, spans, left, size = [], [], [], []
            for t, r in zip(batch.column("data").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                cuts = cut_spans(r, len(t))
                size.append(len(t))
                removed.append(sum(b - a for a, b in cuts))
                spans.append(len(cuts))
                left.append(hashlib.sha256(kept(t, cuts)).hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array(size, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array(left, pa.string()),
                }
            )

    return cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return removal_report(table(spark, sf_dir, "documents"))
