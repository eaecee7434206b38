"""Global order without a global window: dense ordinals, random order, exact cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentspark.functions.draws import draw_key
from sentspark.storage import materialise

_ROW_BITS = 33
_BUCKETS = 4096
_PREFIX = 4
# The cut is finished by a top-k of at most this many rows.
_FINISH_ROWS = 10_000
# Buckets of consecutive rows for each shuffle partition.
_BUCKETS_A_TASK = 4


def with_ordinals(
    df: DataFrame, by: list[str], name: str = "pos", start: int = 0, stored: bool = False
) -> DataFrame:
    """Number the rows densely in the order of ``by``, whose values must be unique.

    Range partitions are sorted side by side and stamped with (partition, row). The
    stamped table is written once, so that the row counts per partition and the rows
    themselves come from the same partitioning. A row's number is then its row stamp
    plus the rows of the partitions before it; that table of offsets has one row per
    partition.

    Finding the ranges reads the rows a second time, so ``df`` is written first, unless
    ``stored`` says that it is a plain scan of a table.
    """
    stamp = F.monotonically_increasing_id()
    stamped = (
        (df if stored else materialise(df, "rows"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.shiftright(stamp, _ROW_BITS))
        .withColumn("_row", stamp.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    table = materialise(stamped, "ordinals")
    counts = table.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    numbered = table.join(F.broadcast(offsets), "_part")
    return numbered.select(
        *df.columns, (F.col("_offset") + F.col("_row") + F.lit(start)).cast("bigint").alias(name)
    )


def _borders(df: DataFrame, by: list[str], per: int) -> tuple[list, int]:
    """Every ``size``-th key of the rows in the order of ``by``, but the first, and ``size``.

    Only the key columns are moved. ``size`` is the multiple of ``per`` that gives about
    ``_BUCKETS_A_TASK`` buckets for each shuffle partition, so as many keys come to the driver.
    """
    numbered = with_ordinals(df.select(*by), by, "pos", stored=True)
    n = numbered.count()
    wanted = _BUCKETS_A_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(-(-n // (wanted * per)), 1) * per
    found = numbered.filter(F.pmod("pos", F.lit(size)) == 0).filter("pos > 0").orderBy("pos")
    return [tuple(r) for r in found.select(*by).collect()], size


def deal_in_order(
    df: DataFrame, by: list[str], per: int, stored: bool = False, first: int | None = None
) -> DataFrame:
    """Number the rows densely in the order of ``by`` while they move once.

    Adds ``pos`` and ``bucket``: a bucket holds consecutive positions, a multiple of ``per``
    of them, and lies in one task, so that windows over ``bucket`` and parts of it need no
    further shuffle. The keys that begin the buckets are found from the key columns alone;
    a row finds its bucket among them by bisection. ``by`` must be unique. With ``first``
    only the rows before that position are kept, and those of later buckets are not moved.

    ``df`` is read twice and is written first, unless ``stored`` says that it is a scan.
    """
    df = df if stored else materialise(df, "rows")
    borders, size = _borders(df, by, per)
    bucket = _place(df, by, borders).cast("bigint")
    if first is not None:
        df = df.filter(bucket <= (first - 1) // size)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*by))
    out = df.withColumn("bucket", bucket).withColumn("pos", F.col("bucket") * size + rank - 1)
    return out if first is None else out.filter(F.col("pos") < first)


def _place(df: DataFrame, by: list[str], borders: list) -> Column:
    """How many of the sorted ``borders`` are not above the row's key."""
    if not borders:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in by]
    key = F.struct(*by)
    keys = F.array(*(F.struct(*(F.lit(x).cast(t).alias(c) for x, t, c in zip(b, kinds, by))) for b in borders))
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    # a place beyond the last border gives null and is not taken
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(keys, at + step - 1) <= key, at + step).otherwise(at),
    )


def shuffle_full(
    df: DataFrame, id: str = "sent_id", seed: int = 42, epoch: int = 0, name: str = "pos"
) -> DataFrame:
    """A random permutation: ``pos`` is the place of the row in it."""
    keyed = df.withColumn("_key", draw_key(seed, f"shuffle:{epoch}", id))
    return with_ordinals(keyed, ["_key", id], name).drop("_key")


def shuffle_buffered(
    df: DataFrame,
    pos: str = "pos",
    seed: int = 42,
    epoch: int = 0,
    buffer: int = 2048,
    name: str = "shuffled",
    within: tuple[str, ...] = (),
) -> DataFrame:
    """A permutation that moves no row out of its block of ``buffer`` positions.

    ``pos`` must be dense. Every block has at most ``buffer`` rows, so the window has
    no large group. If the rows are already dealt by columns whose groups hold whole blocks,
    name these as ``within``: no further shuffle is needed then.
    """
    block = F.floor(F.col(pos) / F.lit(buffer)).cast("bigint")
    w = Window.partitionBy(*within, "block").orderBy(draw_key(seed, f"buffer:{epoch}", pos), pos)
    return df.withColumn("block", block).withColumn(
        name, F.col("block") * F.lit(buffer) + F.row_number().over(w) - F.lit(1)
    )


def cut_key(
    df: DataFrame, key: str, id: str, take: Callable[[int], int]
) -> tuple[int, int, tuple[str, int] | None]:
    """Find the row that ends the first ``take(n)`` of the n rows ordered by (key, id).

    ``key`` holds lower-case hex digits. Each pass counts rows per 4-digit prefix, at
    most 65,536 numbers, and descends into the prefix in which the cut falls, until few
    rows are left to sort. No row moves. Returns (n, take(n), (key, id) of the last row
    taken).
    """
    n = k = None
    prefix, rest = "", df.select(key, id)
    while True:
        width = len(prefix) + _PREFIX
        counted = rest.groupBy(F.substring(key, 1, width).alias("p")).agg(F.count("*").alias("n"))
        counts = sorted((r.p, r.n) for r in counted.collect())
        if n is None:
            n = sum(c for _, c in counts)
            k = left = take(n)
            if k <= 0:
                return n, 0, None
        for prefix, count in counts:
            if left <= count:
                break
            left -= count
        rest = rest.filter(F.col(key).startswith(prefix))
        if count <= _FINISH_ROWS or len(prefix) >= 32:
            break
    last = rest.orderBy(key, id).limit(left).orderBy(F.desc(key), F.desc(id)).first()
    return n, k, (last[0], last[1])


def weighted_median(hist: DataFrame, value: str, weight: str) -> float | None:
    """Exact median of integers given as (value, how many). Reads ``hist`` a few times."""
    r = hist.agg(F.sum(weight).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if r.n is None:
        return None
    middle = {(r.n + 1) // 2, r.n // 2 + 1}
    found = [_kth_value(hist, value, weight, k, r.lo, r.hi) for k in middle]
    return sum(found) / len(found)


def _kth_value(hist: DataFrame, value: str, weight: str, k: int, lo: int, hi: int) -> int:
    """Narrow [lo, hi] to one value; each pass counts in at most ``_BUCKETS`` intervals."""
    while lo < hi:
        width = -(-(hi - lo + 1) // _BUCKETS)
        bucket = F.floor((F.col(value) - F.lit(lo)) / F.lit(width))
        inside = hist.filter(F.col(value).between(lo, hi))
        counts = inside.groupBy(bucket.alias("b")).agg(F.sum(weight).alias("n")).collect()
        for b, n in sorted((c.b, c.n) for c in counts):
            if k <= n:
                break
            k -= n
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
    return lo
