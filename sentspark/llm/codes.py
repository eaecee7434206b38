"""Vector code compression: exact nearest codebook entries by slices of sorted coordinates.

Vectors become integers, ``floor(1024 * x)``, and are cut into ``PARTS`` consecutive parts.
Each part position has a codebook of at most ``ENTRIES`` entries, which Lloyd rounds move
to the rounded-down means of the parts assigned to them. A vector's code is the index of
the nearest entry of each part.

For every dimension a codebook keeps its entries' coordinates in order, and for every
prefix of that order a bit mask of the entries in it. A part starts from an initial radius:
the distance to the best of a few entries next to it in the widest dimension. The radius
selects a range of coordinates per dimension; the prefix masks at its two ends give the
mask of the entries inside; the masks of all dimensions, ANDed, hold every entry that can
be as near as the radius. Only those are measured, so the result is exact, ties included.

A task reduces its vectors to one sum per entry and component before anything is shuffled.
Codebooks are the only thing on the driver, ``ENTRIES`` vectors at most.

Null vectors and vectors with a null or non-finite component are dropped. The first entries
are the vectors of the smallest ids (null ids last; rows of one id in the order of their
components); with fewer vectors there are fewer entries. Repeated rows are coded once each.
Vectors whose length differs from that of the first entry cannot be compared with it: their
code and error are null, and they move no entry. A length that four does not divide is cut
as evenly as it goes. An empty table gives no rows. Squared distances must fit 64 bits
(components below 2**26 in amount do, in parts of up to 1,024 numbers).
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.functions.ragged import flat_list
from sentspark.llm.catalog import query, table
from sentspark.session import ship_package
from sentspark.storage import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries next to a part in the widest dimension that give its initial radius.
BESIDE = 8
#: Parts compared at once.
CHUNK = 4096
#: Labels up to which their sums are broadcast; above, the sums are dealt by salted labels.
LABELS, SALTS = 100_000, 32


class Book:
    """The entries of one part, with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        words = -(-n // 64)
        own = np.zeros((n, words), np.uint64)
        own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.prefix = np.zeros((width, n + 1, words), np.uint64)
        for k in range(width):
            np.bitwise_or.accumulate(own[order[:, k]], axis=0, out=self.prefix[k, 1:])
        spread = self.sorted[-1] - self.sorted[0] if width else np.zeros(1)
        self.widest = int(np.argmax(spread))
        self.order = order[:, self.widest] if width else np.arange(n)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """An upper bound of each part's distance to its nearest entry, rounded down."""
        n = len(self.entries)
        beside = min(BESIDE, n)
        at = np.searchsorted(self.sorted[:, self.widest], x[:, self.widest]) if x.shape[1] else np.zeros(len(x), int)
        first = np.clip(at - beside // 2, 0, n - beside)
        best = np.full(len(x), np.iinfo(np.int64).max)
        for k in range(beside):
            best = np.minimum(best, ((x - self.entries[self.order[first + k]]) ** 2).sum(1))
        root = np.sqrt(best.astype(np.float64)).astype(np.int64)
        root += (root + 1) ** 2 <= best
        return root - (root**2 > best)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The entries within ``radius`` of each part in every dimension, as bits."""
        mask = np.broadcast_to(self._all(), (len(x), -(-len(self.entries) // 64))).copy()
        for k in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, k], x[:, k] - radius, "left")
            high = np.searchsorted(self.sorted[:, k], x[:, k] + radius, "right")
            mask &= self.prefix[k, high] & ~self.prefix[k, low]
        return mask

    def _all(self) -> np.ndarray:
        bits = np.zeros(-(-len(self.entries) // 64) * 64, np.uint8)
        bits[: len(self.entries)] = 1
        return np.packbits(bits, bitorder="little").view("<u8")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry, ties to the lower index."""
        index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for a in range(0, len(x), CHUNK):
            part = x[a : a + CHUNK]
            mask = self.candidates(part, self.radius(part))
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            far = ((part[row] - self.entries[entry]) ** 2).sum(1)
            first = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(far, first)
            hit = np.flatnonzero(far == least[row])
            hit = hit[np.searchsorted(row[hit], np.arange(len(part)))]
            index[a : a + CHUNK], distance[a : a + CHUNK] = entry[hit], least
        return index, distance


def _cuts(dim: int) -> list[int]:
    return [dim * p // PARTS for p in range(PARTS + 1)]


class Codebooks:
    """One :class:`Book` per part position."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.cuts = np.cumsum([0, *(e.shape[1] for e in entries)]).tolist()
        self._books: list[Book] = []

    def __getstate__(self):
        return {"entries": self.entries, "cuts": self.cuts, "_books": []}

    def parts(self, v: np.ndarray):
        if not self._books:
            self._books = [Book(e) for e in self.entries]
        for p, book in enumerate(self._books):
            yield p, v[:, self.cuts[p] : self.cuts[p + 1]], book

    def digest(self) -> str:
        text = ",".join(str(x) for e in self.entries for x in e.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def whole_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``label`` and ``v`` (integers) of the rows that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    kept = vectors.filter(x.isNotNull() & ~bad)
    return kept.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` numbers, and where they stand in the batch."""
    flat, size = flat_list(batch.column("v"), np.int64)
    same = size == dim
    if not same.all():
        flat = flat[np.repeat(same, size)]
    return flat.reshape(int(same.sum()), dim), np.flatnonzero(same)


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round: assign every part, then take the means."""
    dim, n = books.cuts[-1], len(books.entries[0])

    def run(batches):
        sums = [np.zeros((n, e.shape[1] + 1), object) for e in books.entries]
        any_row = False
        for batch in batches:
            v, _ = _matrix(batch, dim)
            for a in range(0, len(v), CHUNK):
                any_row = True
                for p, x, book in books.parts(v[a : a + CHUNK]):
                    entry, _ = book.nearest(x)
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    whole = np.column_stack([x, np.ones(len(x), np.int64)])
                    sums[p][used] += np.add.reduceat(whole[order], first, axis=0)
        if any_row:
            for p, total in enumerate(sums):
                entry, position = np.nonzero(total)
                yield pa.record_batch(
                    {
                        "part": pa.array(np.full(len(entry), p, np.int32)),
                        "entry": pa.array(entry.astype(np.int32)),
                        "position": pa.array(position.astype(np.int32)),
                        "total": pa.array([Decimal(x) for x in total[entry, position]], pa.decimal128(38, 0)),
                    }
                )

    schema = "part int, entry int, position int, total decimal(38,0)"
    found = vectors.select("v").mapInArrow(run, schema).groupBy("part", "entry", "position").agg(F.sum("total").alias("total"))
    # as many rows as the codebooks have numbers
    totals = [np.zeros((n, e.shape[1] + 1), object) for e in books.entries]
    for r in found.collect():
        totals[r.part][r.entry, r.position] = int(r.total)
    entries = []
    for total, old in zip(totals, books.entries, strict=True):
        used = total[:, -1] > 0
        new = old.copy()
        new[used] = (total[used, :-1] // total[used, -1:]).astype(np.int64)
        entries.append(new)
    return Codebooks(entries)


def fit_codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of :func:`whole_vectors` after ``rounds`` rounds; None without vectors."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    if not first:
        return None
    dim = len(first[0].v)
    start = np.array([r.v for r in first if len(r.v) == dim], np.int64).reshape(-1, dim)
    cuts = _cuts(dim)
    books = Codebooks([start[:, cuts[p] : cuts[p + 1]] for p in range(PARTS)])
    for _ in range(rounds):
        books = moved(vectors, books)
    return books


def encoded_vectors(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (hexadecimal) and ``error`` of :func:`whole_vectors`."""
    dim = books.cuts[-1]

    def run(batches):
        for batch in batches:
            v, at = _matrix(batch, dim)
            codes, errors = np.empty((len(v), PARTS), np.uint8), np.zeros(len(v), np.int64)
            for p, x, book in books.parts(v):
                codes[:, p], far = book.nearest(x)
                errors += far
            code = np.full(batch.num_rows, None, object)
            code[at] = [c.tobytes().hex() for c in codes]
            error = np.zeros(batch.num_rows, np.int64)
            error[at] = errors
            none = np.ones(batch.num_rows, bool)
            none[at] = False
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "code": pa.array(code, pa.string()),
                    "error": pa.array(error, pa.int64(), mask=none),
                }
            )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decoded_vectors(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """``codes`` with ``approximate``: the entries of each code, side by side."""

    @F.arrow_udf("array<long>")
    def approximate(column: pa.Array) -> pa.Array:
        rows = []
        for text in column.to_pylist():
            numbers = None if text is None else bytes.fromhex(text)
            rows.append(numbers and np.concatenate([e[i] for e, i in zip(books.entries, numbers, strict=True)]).tolist())
        return pa.array(rows, pa.list_(pa.int64()))

    return codes.withColumn("approximate", approximate(F.col(code)))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows of one label (nulls together)."""
    totals = materialise(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    totals = totals.withColumnRenamed("label", "_label")
    same = codes["label"].eqNullSafe(totals["_label"])
    if totals.count() <= LABELS:
        return codes.join(F.broadcast(totals), same, "left").drop("_label")
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = codes.withColumn("_part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = dealt["label"].eqNullSafe(salted["_label"]) & (dealt["_part"] == salted["_salt"])
    return dealt.join(salted, same, "left").drop("_label", "_salt", "_part")


def compression_report(rows: DataFrame) -> DataFrame:
    """Code, error and label error of every vector that takes part, with the codebooks' hash."""
    vectors = materialise(whole_vectors(rows), "codes-vectors")
    books = fit_codebooks(vectors)
    if books is None:
        schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], schema)
    codes = materialise(encoded_vectors(vectors, books), "codes-codes")
    return with_label_error(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def _oracle() -> str:
    steps = [
        f"""kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""parts as materialized (select vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as x
  from kept, range({PARTS}) t(p))""",
        f"""book0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c
  from parts qualify e < {ENTRIES})""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} as materialized (select vec_id, p, any_value(x) as x, min(d) as d, arg_min(e, d * 1000 + e) as e from (
  select vec_id, parts.p, x, e,
    list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) as d
  from parts join book{k} b on parts.p = b.p) y group by vec_id, p)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from book{k} b left join (
  select p, e, list(s order by i) as c from (select p, e, i, floor(sum(v) / count(*)) as s from (
    select p, e, unnest(x) as v, generate_subscripts(x, 1) as i from near{k}) a group by p, e, i) g group by p, e) m
  on b.p = m.p and b.e = m.e)""")
    return f"""with {', '.join(steps)},
codes as (select vec_id, string_agg(lower(printf('%02x', e)), '' order by p) as code, cast(sum(d) as bigint) as error
  from near{ROUNDS} group by vec_id),
book as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' order by p, e)) as h
  from book{ROUNDS})
select c.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, h as codebooks_sha256
from codes c join kept k on c.vec_id = k.vec_id, book"""


@query("op13_vector_codes", _oracle())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return compression_report(table(spark, sf_dir, "embeddings"))
