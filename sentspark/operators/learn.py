"""Learning jobs on Spark: token vectors, trials over settings."""

from __future__ import annotations

import hashlib
import math
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentspark.functions import ragged as R
from sentspark.functions.draws import draw_key, uniform
from sentspark.operators.losses import contrastive_eval
from sentspark.operators.pooling import encode
from sentspark.operators.vocab import BROADCAST_TOKENS
from sentspark.storage import materialise

#: Length of a token vector in whole numbers.
UNIT = 4096
#: Tokens of a task whose pairs are counted at once.
GATHERED = 1 << 20
#: Most numbers of the token vectors that go to every executor; 8 bytes each.
BROADCAST_NUMBERS = 4_000_000
# Stands for a null among the tokens of a row.
_NO_TOKEN = 1 << 40

TRIALS = (
    "trial_number int, value double, state string, params map<string,string>, "
    "intermediate_values map<int,double>"
)


def cooccurrences(df: DataFrame, window: int = 5, ids: str = "ids") -> DataFrame:
    """token, context, n: how often two tokens stand within ``window`` places of each other
    in a row, a pair ``d`` places apart weighing ``window + 1 - d``. Both directions are listed.

    Pairs are counted inside the tasks first, so a token that is a third of the corpus moves no
    more rows than another one. A null array has no tokens.
    """
    return cooccurrences_by_window(df, [window], ids).withColumnRenamed(f"n_{window}", "n")


def cooccurrences_by_window(df: DataFrame, windows: list[int], ids: str = "ids") -> DataFrame:
    """token, context and n_<window> for each window, from one pass over the rows: see
    :func:`cooccurrences`. A pair that only wider windows hold has 0.

    Both orders of a pair are counted as one, ``GATHERED`` tokens of a task at a time.
    """
    names = [f"n_{w}" for w in windows]
    # by window and distance, the distance 0 unused
    weights = np.array([[max(w + 1 - d, 0) * (d > 0) for d in range(max(windows) + 1)] for w in windows], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, lengths in _gathered(batches):
            for left, right, sums in _near(flat, lengths, weights):
                ends = [pa.array(x, pa.int64(), mask=x == _NO_TOKEN).cast(pa.int32()) for x in (left, right)]
                yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, sums)], names=["a", "b", *names])

    rows = df.select(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    schema = ", ".join(["a int", "b int", *(f"{n} bigint" for n in names)])
    pairs = rows.mapInArrow(count, schema).groupBy("a", "b").agg(*(F.sum(n).alias(n) for n in names))

    def listed(a: str, b: str, times: int) -> Column:
        return F.struct(F.col(a).alias("token"), F.col(b).alias("context"), *((F.col(n) * times).alias(n) for n in names))

    alike = F.col("a").eqNullSafe(F.col("b"))
    both = F.when(alike, F.array(listed("a", "b", 2))).otherwise(F.array(listed("a", "b", 1), listed("b", "a", 1)))
    return pairs.select(F.inline(both))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens of all rows in a row, length of each row), across the borders of Arrow batches."""
    tokens, sizes, held = [], [], 0
    for b in batches:
        flat = b.column(0).flatten().cast(pa.int64()).fill_null(_NO_TOKEN).to_numpy()
        tokens.append(flat)
        sizes.append(b.column(0).value_lengths().to_numpy())
        held += len(flat)
        if held >= GATHERED:
            yield np.concatenate(tokens), np.concatenate(sizes)
            tokens, sizes, held = [], [], 0
    if held:
        yield np.concatenate(tokens), np.concatenate(sizes)


def _near(flat: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> Iterator[tuple]:
    """The pairs of tokens of a row that are near each other, smaller token first, each once:
    (token, token, one weighted count for each row of ``weights``)."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    known, place = np.unique(flat, return_inverse=True)
    far = weights.shape[1] - 1
    bits = far.bit_length()
    for lo in range(0, len(flat), GATHERED):
        # pairs that begin in this part of the tokens
        at, n = place[lo : lo + GATHERED + far], row[lo : lo + GATHERED + far]
        codes = []
        for d in range(1, min(far, len(at) - 1) + 1):
            begin = min(GATHERED, len(at) - d)
            same = n[:begin] == n[d : begin + d]
            a, b = at[:begin][same], at[d : begin + d][same]
            codes.append((np.minimum(a, b) * len(known) + np.maximum(a, b)) << bits | d)
        code = np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        if len(code) == 0:
            continue
        pair, distance = code >> bits, code & ((1 << bits) - 1)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        sums = [np.add.reduceat(w[distance], first) for w in weights]
        yield known[pair[first] // len(known)], known[pair[first] % len(known)], sums


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def association(pairs: DataFrame) -> DataFrame:
    """token, context, q: positive pointwise mutual information, in 1/1024, of :func:`cooccurrences`."""
    total = materialise(pairs.groupBy("token").agg(F.sum("n").alias("n_token")), "token-counts")
    every = total.agg(F.sum("n_token").alias("n_all"))
    contexts = total.select(F.col("token").alias("context"), F.col("n_token").alias("n_context"))
    known = pairs.join(_small(total, BROADCAST_TOKENS), "token").join(_small(contexts, BROADCAST_TOKENS), "context")
    both, alone = (
        F.col(a).cast("double") * F.col(b).cast("double") for a, b in (("n", "n_all"), ("n_token", "n_context"))
    )
    q = F.round(F.lit(1024) * F.ln(both / alone)).cast("bigint")
    return known.crossJoin(F.broadcast(every)).select("token", "context", q.alias("q")).filter("q > 0")


def _signs(token: Column, dim: int, seed: int) -> Column:
    """``dim`` signs of a token, one for each bit of its digits: 1 or -1."""
    digits = F.concat(*(draw_key(seed, f"project:{k}", token) for k in range(-(-dim // 128))))
    return F.array(*(_bit_sign(digits, d) for d in range(dim)))


def _bit_sign(digits: Column, place: int) -> Column:
    digit = F.conv(F.substring(digits, place // 4 + 1, 1), 16, 10).cast("int")
    return (F.shiftright(digit, place % 4).bitwiseAND(F.lit(1)) * 2 - 1).cast("bigint")


def _projected(weights: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """token, u: weighted sums of the contexts' vectors, scaled to whole numbers of length UNIT."""
    contexts = vectors.select(F.col("token").alias("context"), "u")
    joined = weights.join(_small(contexts, BROADCAST_NUMBERS // dim), "context")
    sums = joined.groupBy("token").agg(*(F.sum(F.col("q") * F.col("u")[d]).alias(f"x{d}") for d in range(dim)))
    row = sums.select("token", F.array(*(f"x{d}" for d in range(dim))).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double")))
    scaled = F.transform("x", lambda e: F.round(e.cast("double") * UNIT / F.col("length")).cast("bigint"))
    zero = F.transform("x", lambda e: F.lit(0).cast("bigint"))
    return row.withColumn("length", length).select("token", F.when(F.col("length") > 0, scaled).otherwise(zero).alias("u"))


def _without_rare(df: DataFrame, ids: str, min_count: int) -> DataFrame:
    """The arrays without tokens that occur less than ``min_count`` times: rows are numbered,
    their tokens meet the counts in a join and are put together again."""
    numbered = df.select(ids, F.monotonically_increasing_id().alias("row"))
    tokens = materialise(numbered.select("row", F.posexplode(ids).alias("pos", "token")), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("token")
    kept = tokens.join(often, "token", "left_semi").groupBy("row").agg(F.collect_list(F.struct("pos", "token")).alias("t"))
    return kept.select(F.transform(F.array_sort("t"), lambda x: x["token"]).alias(ids))


def encoder_epochs(
    df: DataFrame, dim: int = 64, min_count: int = 1, epochs: int = 1, window: int = 5, seed: int = 42, ids: str = "ids"
) -> Iterator[DataFrame]:
    """Token vectors after every epoch: token, vector (see :func:`fit_encoder`)."""
    if min_count > 1:
        df = _without_rare(df, ids, min_count)
    pairs = materialise(cooccurrences(df, window, ids), "cooccurrences")
    yield from projections(materialise(association(pairs), "association"), dim, epochs, seed)


def projections(weights: DataFrame, dim: int = 64, epochs: int = 1, seed: int = 42) -> Iterator[DataFrame]:
    """Token vectors after every epoch, from the :func:`association` of a corpus (stored)."""
    tokens = weights.select("token").distinct()
    vectors = tokens.withColumn("u", _signs(F.col("token"), dim, seed))
    for _ in range(epochs):
        vectors = materialise(_projected(weights, vectors, dim), "token-vectors")
        yield vectors.select("token", F.transform("u", lambda e: (e / F.lit(float(UNIT))).cast("float")).alias("vector"))


def fit_encoder(
    df: DataFrame, dim: int = 64, min_count: int = 1, epochs: int = 1, window: int = 5, seed: int = 42, ids: str = "ids"
) -> DataFrame:
    """Token vectors from id arrays: token, vector.

    Tokens that stand near each other are counted, the counts become positive pointwise
    mutual information, and the first epoch projects every token's row of it to ``dim``
    numbers by random signs of the contexts. A further epoch replaces a token's vector by the
    weighted sum of its contexts' vectors, which reaches contexts of contexts. Vectors have
    length 1 in steps of 1/4096.

    Counts, weights and sums are whole numbers, so the vectors do not depend on the
    partitioning. Nothing comes to the driver. Tokens that occur less than ``min_count``
    times are left out (their neighbours close up); a token that never stands near
    another has no vector. It is a bag-of-tokens model, not of a Transformer's quality.
    """
    for vectors in encoder_epochs(df, dim, min_count, epochs, window, seed, ids):
        pass
    return vectors


def token_dropout(
    df: DataFrame, rate: float, view: int, seed: int = 42, ids: str = "ids", id: str = "sent_id"
) -> DataFrame:
    """A view of each row with a random share of its tokens left out."""
    return df.withColumn(ids, _kept(ids, _draws(ids, id, view, seed), rate))


def _draws(ids: str, id: str, view: int, seed: int) -> Column:
    """A number below 2**32 for each token of an array: it stays where this share is at least the rate."""

    def draw(_: Column, i: Column) -> Column:
        key = F.md5(F.concat_ws(":", F.lit(f"{seed}:view{view}"), F.col(id).cast("string"), i.cast("string")))
        return (uniform(key) * F.lit(2.0**32)).cast("bigint")

    return F.transform(ids, draw)


def _kept(ids: str, draws: Column, rate: float) -> Column:
    @F.arrow_udf("array<int>")
    def keep(ids: pa.Array, draws: pa.Array) -> pa.Array:
        # a null array comes back as an empty one, which when() puts right
        lengths = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        stays = draws.flatten().to_numpy() / 2.0**32 >= rate
        return R.list_array(ids.flatten().filter(pa.array(stays)), R.sum_rows(stays.astype(np.int64), lengths), pa.int32())

    return F.when(F.col(ids).isNotNull(), keep(ids, draws))


def with_draws(batches: DataFrame, seed: int = 42) -> DataFrame:
    """``batches`` with the draws of the two token dropouts of :func:`evaluate_encoder`, which are
    the same at every rate: to be stored where many settings are evaluated."""
    return batches.select(
        "sent_id", "batch_id", "ids", *(_draws("ids", "sent_id", v, seed).alias(f"draws_{v}") for v in (1, 2))
    )


def evaluate_encoder(
    batches: DataFrame,
    token_vectors: DataFrame,
    dropout: float = 0.1,
    batches_per_group: int = 8,
    kind: str = "debiased_contrastive",
    seed: int = 42,
) -> DataFrame:
    """Contrastive loss of an encoder on batches (sent_id, batch_id, ids): n_groups, loss.

    The two views of a sentence are two token dropouts, since the encoder itself draws
    nothing.
    """
    return evaluate_drawn(with_draws(batches, seed), token_vectors, dropout, batches_per_group, kind)


def evaluate_drawn(
    drawn: DataFrame,
    token_vectors: DataFrame,
    dropout: float = 0.1,
    batches_per_group: int = 8,
    kind: str = "debiased_contrastive",
) -> DataFrame:
    """:func:`evaluate_encoder` on batches :func:`with_draws`."""
    views = drawn.select(
        F.col("sent_id").alias("pair_id"),
        "batch_id",
        _kept("ids", F.col("draws_1"), dropout).alias("ids"),
        _kept("ids", F.col("draws_2"), dropout).alias("ids_j"),
    )
    z_i = encode(views, token_vectors, "ids", "pair_id").withColumnRenamed("embedding", "z_i")
    z_j = encode(z_i, token_vectors, "ids_j", "pair_id").withColumnRenamed("embedding", "z_j")
    return contrastive_eval(z_j, kind, batches_per_group)


def draw_params(space: dict[str, list | tuple], trial: int, seed: int = 42) -> dict[str, Any]:
    """One setting: a choice from each list, a number from each range.

    A range is (low, high); (low, high, "log") draws the logarithm evenly; (low, high, step)
    draws one of low, low + step, ... up to high.
    """
    out = {}
    for name, values in space.items():
        digits = hashlib.md5(f"{seed}:{name}:{trial}".encode()).hexdigest()[:8]
        u = int(digits, 16) / 2**32
        if isinstance(values, list):
            out[name] = values[int(u * len(values))]
            continue
        low, high, *how = values
        if not how:
            out[name] = low + u * (high - low)
        elif how[0] == "log":
            out[name] = math.exp(math.log(low) + u * (math.log(high) - math.log(low)))
        else:
            out[name] = low + how[0] * int(u * (int((high - low) / how[0] + 1e-9) + 1))
    return out


def sweep(
    spark: SparkSession,
    space: dict[str, list | tuple],
    objective: Callable[[dict[str, Any]], dict[int, float | None]],
    n_trials: int,
    seed: int = 42,
    report: str | None = None,
    side_by_side: int = 4,
) -> DataFrame:
    """Try ``n_trials`` random settings: one row per trial.

    ``objective`` runs the Spark jobs of one setting and returns the loss per epoch; the
    value of a trial is its best loss. ``side_by_side`` trials run at a time, each in a
    scheduler pool of its own, so that small jobs of one fill the gaps of another. ``report``
    names a folder that gets all trials so far as JSON after each one.
    """
    rows: dict[int, tuple] = {}
    writing = threading.Lock()

    def run(number: int) -> None:
        params = draw_params(space, number, seed)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{number % side_by_side}")
        losses = objective(params)
        known = [v for v in losses.values() if v is not None]
        state = "COMPLETE" if known else "FAIL"
        with writing:
            named = {k: str(v) for k, v in params.items()}
            rows[number] = (number, min(known) if known else None, state, named, losses)
            if report:
                _trials(spark, rows).coalesce(1).write.mode("overwrite").json(report)

    with ThreadPoolExecutor(side_by_side) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(run), n) for n in range(n_trials)]:
            done.result()
    return _trials(spark, rows)


def _trials(spark: SparkSession, rows: dict[int, tuple]) -> DataFrame:
    return spark.createDataFrame([rows[n] for n in sorted(rows)], TRIALS)


def read_report(spark: SparkSession, report: str) -> DataFrame:
    """The trials of a report, as :func:`sweep` returns them; JSON has no numbers as keys."""
    stored = spark.read.schema(TRIALS.replace("map<int,double>", "map<string,double>")).json(report)
    epochs = F.transform_keys("intermediate_values", lambda k, v: k.cast("int"))
    return stored.withColumn("intermediate_values", epochs)


def trial_epochs(trials: DataFrame) -> DataFrame:
    """trial_number, epoch, loss: one row per trial and epoch."""
    return trials.select("trial_number", F.explode("intermediate_values").alias("epoch", "loss"))


def best_trial(trials: DataFrame, value: str = "value", number: str = "trial_number") -> DataFrame:
    """The row with the smallest value; ties go to the lower number."""
    row = F.struct(*trials.columns)
    best = F.min_by(row, F.struct(value, number)).alias("best")
    return trials.filter(F.col(value).isNotNull()).agg(best).filter("best is not null").select("best.*")


def running_best(df: DataFrame, value: str, order: str, by: str) -> DataFrame:
    """Add ``best``, the smallest value of each series so far. A series has one row per
    epoch, so it is short."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("best", F.min(value).over(w))
