"""Removal of repeated passages from texts: of repeated byte strings and word sequences together.

A byte string is repeated as :mod:`sentspark.llm.suffix` has it, a sequence of words as
:mod:`sentspark.llm.anchors` has it; both are judged on the input, and what either finds is
cut. A passage of words that falls short of ``suffix.LENGTH`` bytes, or whose words stand
in other lines, is cut as words; a long string of few words is cut as bytes.

Entries of both kinds go through one shuffle, and the texts through one other, which serves
the look at the borders of repeats and the cut. The places of windows are told from those
of strings by their sign (:func:`_windowed`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentspark.llm import anchors, suffix
from sentspark.llm.frames import free
from sentspark.llm.rolling import buffers, word_spans
from sentspark.llm.suffix import ENTRY, combined, cut_spans, kept, per_row, ranges_of, sorted_entries
from sentspark.storage import materialise


def _windowed(parts):
    """Entries of windows, at negative places."""
    for common, context, doc_id, tk, lo, n in parts:
        yield common, context, doc_id, tk, pa.array(~lo.to_numpy()), n


def _entries(rows: DataFrame) -> DataFrame:
    def parts(batches):
        for batch in batches:
            yield from suffix.string_entries(batch)
            yield from _windowed(anchors.window_entries(batch))

    return rows.mapInArrow(lambda batches: combined(parts(batches)), ENTRY)


def _by_kind(ranges: Column) -> list[Column]:
    """``ranges`` of strings, and those of windows at their places."""
    windows = F.transform(
        F.filter(ranges, lambda r: r["lo"] < 0),
        lambda r: F.struct(r["common"].alias("common"), (-1 - r["lo"]).alias("lo"), r["n"].alias("n")),
    )
    return [F.filter(ranges, lambda r: r["lo"] >= 0), windows]


def _named(joined: DataFrame, id: str, tk: str, text: str, strings: str, windows: str) -> DataFrame:
    """Every place of the border entries, with the hash of its string or window."""

    def parts(batches):
        for batch in batches:
            columns = {"doc_id": batch.column(id), "tk": batch.column(tk), "data": batch.column(text).cast(pa.binary())}
            rows = pa.record_batch(columns)
            yield from suffix.string_positions(rows, batch.column(strings))
            yield from _windowed(anchors.window_places(rows, batch.column(windows)))

    return joined.mapInArrow(lambda batches: combined(parts(batches)), ENTRY)


def _spans(data: bytes, ranges: list[dict]) -> list[tuple[int, int]]:
    """Bytes to be cut, from the ranges of both kinds."""
    spans = cut_spans([r for r in ranges if r["lo"] >= 0], len(data))
    words = [(~r["lo"], r["n"]) for r in ranges if r["lo"] < 0]
    if words:
        start, end, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        spans += [(int(start[lo]), int(end[lo + n + anchors.LENGTH - 2])) for lo, n in words]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated strings and repeated windows of words cut out of ``text``, in the
    same columns.

    A character that a cut divides is dropped. ``n_chars`` follows the text where it is a
    column. Documents are kept even when nothing of their text is left. Further columns may
    have any names.
    """
    id, tk, strings, windows, ranges, row, key = free(docs, "_id", "_tk", "strings", "windows", "_ranges", "_row", "_key")
    rows = docs.withColumns({id: F.col("doc_id").cast("long"), tk: F.xxhash64(F.col(text))})
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data")
    found = _entries(rows.select(F.col(id).alias("doc_id"), F.col(tk).alias("tk"), body))
    found = materialise(sorted_entries(found), "passages-entries")

    def with_texts(listed: DataFrame, how: str) -> DataFrame:
        listed = listed.withColumnsRenamed({"doc_id": row, "tk": key, "ranges": ranges})
        on = rows[id].eqNullSafe(listed[row]) & (rows[tk] == listed[key])
        return rows.join(listed, on, how).drop(row, key)

    borders = with_texts(per_row(found.filter("border"), "common", "lo", "n"), "inner")
    kinds = [c.alias(name) for c, name in zip(_by_kind(F.col(ranges)), (strings, windows), strict=True)]
    # all columns of the rows, so that this join and the next read texts that are dealt out once
    named = _named(borders.select(*rows.columns, *kinds), id, tk, text, strings, windows)

    @F.arrow_udf("string")
    def trimmed(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            # also called for rows that nothing is cut from
            if t is None or r is None:
                out.append(t)
                continue
            data = t.encode()
            out.append(kept(data, _spans(data, r)).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    cut = with_texts(ranges_of(found, named), "left").withColumn(
        text, F.when(F.col(ranges).isNull(), F.col(text)).otherwise(trimmed(text, ranges))
    )
    if "n_chars" in docs.columns:
        size = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col(ranges).isNull(), F.col("n_chars")).otherwise(size))
    return cut.select(*docs.columns)
