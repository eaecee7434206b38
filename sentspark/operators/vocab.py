"""Word counts, subword vocabulary, corpus encoding."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentspark.functions import ragged as R
from sentspark.functions import text as T
from sentspark.storage import materialise, new_path

N_SPECIAL = len(T.SPECIAL_TOKENS)
# Largest vocabulary and merge list sent to every executor; a few MB each.
BROADCAST_TOKENS = 200_000
# Salt for joins on words: one word may be a third of all occurrences.
WORD_SALT = 32
# Words with more symbols are encoded one by one.
LONG_WORD = 64
# Fixed lengths of the lists a round of vocabulary learning brings to the driver.
TOP_PAIRS = 2_000
COUNTED_PAIRS = 300
# Merges that a round decides from words on the driver: at least so many pairs, whose words
# hold at most so many symbols (a bound, since a word counts once for every such pair).
GATHERED_PAIRS = 32
GATHERED_SYMBOLS = 1 << 20
# Groups of merges between two rewrites of the word table.
GROUPS_PER_TABLE = 16
# Symbols of words that a task works on at once.
TASK_SYMBOLS = 1 << 20

WORDS_SCHEMA = "ids array<int>, freq bigint"


# -- counts -----------------------------------------------------------------------


def word_frequency(df: DataFrame, words: Column) -> DataFrame:
    """word, freq. Partial counts before the shuffle, so a hot word moves little."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent character pairs of the distinct words, weighted by word frequency."""
    symbols = F.split("word", "")
    pairs = F.zip_with(
        F.slice(symbols, 1, F.size(symbols) - 1),
        F.slice(symbols, 2, F.size(symbols) - 1),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")),
    )
    return (
        words.filter(F.char_length("word") > 1)
        .select(F.explode(pairs).alias("p"), "freq")
        .groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right"))
        .agg(F.sum("freq").alias("freq"))
    )


def top_words(words: DataFrame, size: int) -> DataFrame:
    """Word-level vocabulary: token, id. The ``size`` most frequent words, ties by word;
    ids follow the reserved tokens."""
    best = words.orderBy(F.desc("freq"), "word").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), "word"))
    return best.select(F.col("word").alias("token"), (rank + F.lit(N_SPECIAL - 1)).cast("int").alias("id"))


# -- vocabulary learning ------------------------------------------------------------

_PAIR = np.int64(32)
_NO_PAIR = np.iinfo(np.int64).max


def _pair_keys(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """left << 32 | right for every adjacent pair, -1 where two words meet."""
    keys = (flat[:-1].astype(np.int64) << _PAIR) | flat[1:].astype(np.int64)
    keys[np.cumsum(lengths)[:-1] - 1] = -1
    return keys


def _listed(keys: np.ndarray, sorted_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in the list, whether it is there)."""
    at = np.searchsorted(sorted_pairs, keys)
    at[at == len(sorted_pairs)] = 0
    return at, sorted_pairs[at] == keys


def _hits(flat: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the listed pairs, place of each in the list); of a run of one symbol every other.

    Most symbols begin or end none of the pairs, so two look-ups leave few positions to search.
    """
    n = int(max(flat.max(), (pairs & 0xFFFFFFFF).max(), (pairs >> _PAIR).max())) + 1
    begins, ends = np.zeros(n, bool), np.zeros(n, bool)
    begins[pairs >> _PAIR], ends[pairs & 0xFFFFFFFF] = True, True
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(lengths) - 1] = False
    pos = np.flatnonzero(begins[flat[:-1]] & ends[flat[1:]] & inside[:-1])
    keys = (flat[pos].astype(np.int64) << _PAIR) | flat[pos + 1]
    at, hit = _listed(keys, pairs)
    same = hit & ((keys >> _PAIR) == (keys & 0xFFFFFFFF))
    if same.any():
        goes_on = same[:-1] & (keys[1:] == keys[:-1]) & (np.diff(pos) == 1)
        opens = same & ~np.concatenate([[False], goes_on])
        run_start = np.maximum.accumulate(np.where(opens, pos, 0))
        hit &= ~same | ((pos - run_start) % 2 == 0)
    return pos[hit], at[hit]


def _apply_batch(flat, lengths, batch):
    """Merge the listed pairs everywhere; no symbol both ends one pair and starts another."""
    pairs, new_ids = batch
    if len(flat) < 2:
        return flat, lengths
    pos, at = _hits(flat, lengths, pairs)
    if len(pos) == 0:
        return flat, lengths
    flat = flat.copy()
    flat[pos] = new_ids[at]
    keep = np.ones(len(flat), bool)
    keep[pos + 1] = False
    return flat[keep], R.sum_rows(keep.astype(np.int64), lengths)


def _sum_by_key(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, and for each of the ``weights`` its sum by key."""
    if len(keys) == 0:
        return keys, *weights
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(w[order], first) for w in weights)


def _sum_by_pair(keys: np.ndarray, n_tokens: int, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for keys of pairs of the first ``n_tokens`` ids; by counting, if these pairs are few."""
    if n_tokens * n_tokens > max(len(keys), 1 << 16):
        return _sum_by_key(keys, *weights)
    place = (keys >> _PAIR) * n_tokens + (keys & 0xFFFFFFFF)
    found = np.flatnonzero(np.bincount(place, minlength=1))
    # bincount adds doubles, so the halves of the weights are added apart to stay exact
    sums = []
    for w in weights:
        low, high = (np.bincount(place, x)[found].astype(np.int64) for x in (w & 0xFFFFFF, w >> 24))
        sums.append((high << 24) + low)
    return (found // n_tokens << _PAIR) | (found % n_tokens), *sums


def _gathered_words(batches: Iterator[pa.RecordBatch]):
    """(symbols of all words, length of each, frequency of each), ``TASK_SYMBOLS`` or more at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    total = 0
    for b in batches:
        flat, lengths = R.flat_list(b.column("ids"), np.int32)
        held.append((flat, lengths.astype(np.int64), b.column("freq").to_numpy()))
        total += len(flat)
        if total >= TASK_SYMBOLS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, total = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _merged_words(batches: Iterator[pa.RecordBatch], pending):
    for flat, lengths, freq in _gathered_words(batches):
        for batch in pending:
            flat, lengths = _apply_batch(flat, lengths, batch)
        yield flat, lengths, freq


def _as_arrays(merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array([(l << 32) | r for l, r, _ in merges], np.int64)
    order = np.argsort(pairs)
    return pairs[order], np.array([n for _, _, n in merges], np.int32)[order]


def _count_pairs(words: DataFrame, pending: list) -> DataFrame:
    """pair, freq, and symbols: at least the length of all words that hold the pair."""

    def count(batches):
        for flat, lengths, freq in _merged_words(batches, pending):
            if len(flat) < 2:
                continue
            keys = _pair_keys(flat, lengths)
            inside = keys >= 0
            n, size = (np.repeat(x, lengths)[:-1][inside] for x in (freq, lengths))
            keys, n, size = _sum_by_pair(keys[inside], int(flat.max()) + 1, n, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(n), pa.array(size)], names=["pair", "freq", "symbols"]
            )

    return (
        words.mapInArrow(count, "pair bigint, freq bigint, symbols bigint")
        .groupBy("pair")
        .agg(F.sum("freq").alias("freq"), F.sum("symbols").alias("symbols"))
    )


def _count_neighbours(
    words: DataFrame, pending: list, ranked: np.ndarray, n_counted: int
) -> DataFrame:
    """What stands next to the first ``n_counted`` ranked pairs, where that neighbour and
    the nearer symbol are a ranked pair too: pair_no, after (1 behind, 0 before), symbol,
    freq."""

    def count(batches):
        order = np.argsort(ranked)
        listed = ranked[order]
        for flat, lengths, freq in _merged_words(batches, pending):
            if len(flat) < 2:
                continue
            at, known = _listed(_pair_keys(flat, lengths), listed)
            number = np.where(known, order[at], len(ranked))
            pos = np.flatnonzero(number < n_counted)
            before = pos[pos > 0]
            before = before[known[before - 1]]
            after = pos[pos + 1 < len(number)]
            after = after[known[after + 1]]
            # pair number, side and neighbour packed into one bigint
            code = np.concatenate(
                [
                    (number[before] << 33) | flat[before - 1],
                    (number[after] << 33) | (1 << 32) | flat[after + 2],
                ]
            )
            weight = np.repeat(freq, lengths)
            code, n = _sum_by_key(code, np.concatenate([weight[before], weight[after]]))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "freq"])

    code = F.col("code")
    return (
        words.mapInArrow(count, "code bigint, freq bigint")
        .groupBy("code")
        .agg(F.sum("freq").alias("freq"))
        .select(
            F.shiftright(code, 33).alias("pair_no"),
            F.shiftright(code, 32).bitwiseAND(F.lit(1)).alias("after"),
            code.bitwiseAND(F.lit(0xFFFFFFFF)).alias("symbol"),
            "freq",
        )
    )


def _next_merges(
    ranking: list[tuple[int, int, int]], n_counted: int, neighbours: list, more: int, room: int
) -> list[list[tuple[int, int]]]:
    """The merges that one-by-one merging would do next, as far as they are certain.

    ``ranking`` lists (left, right, freq) in merge order, ``neighbours`` what stands next
    to its first ``n_counted`` pairs, and no unranked pair is more frequent than ``more``.
    Merging a pair creates pairs with its neighbours, none more frequent than the
    neighbour count, and takes occurrences from the ranked pairs that overlap it, exactly
    the neighbour count as long as one merge overlaps them. So the pair with the highest
    remaining count is next while that count is exact and above every created pair.
    Returned in groups: within one, no occurrences overlap.
    """
    near = {(r.pair_no, r.after, r.symbol): r.freq for r in neighbours}
    strongest: dict[int, int] = {}
    for (c, _, _), freq in near.items():
        strongest[c] = max(strongest.get(c, 0), freq)
    starts, ends = defaultdict(list), defaultdict(list)
    for i, (l, r, _) in enumerate(ranking):
        starts[l].append(i)
        ends[r].append(i)

    count = [freq for _, _, freq in ranking]
    exact, lost = [True] * len(ranking), [False] * len(ranking)
    heap = [(-freq, l, r, i) for i, (l, r, freq) in enumerate(ranking)]
    groups: list[list[tuple[int, int]]] = []
    taken, created = set(), more
    while heap and len(taken) < room:
        freq, l, r, i = heapq.heappop(heap)
        if i in taken or -freq != count[i]:
            continue
        if taken and (not exact[i] or i >= n_counted or count[i] <= created):
            break
        if not groups or lost[i]:
            groups.append([])
        groups[-1].append((l, r))
        taken.add(i)
        if i >= n_counted:
            break
        created = max(created, strongest.get(i, 0))
        for j in {*starts[r], *ends[l]} - taken:
            jl, jr, _ = ranking[j]
            after = near.get((i, 1, jr), 0) if jl == r else 0
            before = near.get((i, 0, jl), 0) if jr == l else 0
            loss = max(after, before)
            if loss == 0:
                continue
            known = not lost[i] and l != r and jl != jr
            if known:
                count[j] = min(count[j], ranking[j][2] - loss)
                heapq.heappush(heap, (-count[j], jl, jr, j))
            exact[j] &= known and not lost[j] and not (after and before)
            lost[j] = True
    return groups


def _with_pairs(words: DataFrame, pending: list, pairs: np.ndarray, inside: bool) -> DataFrame:
    """The words that hold one of the sorted ``pairs`` (or none of them), after the pending merges."""

    def pick(batches):
        for flat, lengths, freq in _merged_words(batches, pending):
            if len(flat) < 2:
                continue
            _, known = _listed(_pair_keys(flat, lengths), pairs)
            holds = R.sum_rows(np.append(known, False).astype(np.int64), lengths) > 0
            keep = np.flatnonzero((holds == inside) & (lengths > 1))
            values, n = R.take_rows(flat, lengths, keep)
            yield pa.RecordBatch.from_arrays(
                [R.list_array(values, n, pa.int32()), pa.array(freq[keep])], names=["ids", "freq"]
            )

    return words.mapInArrow(pick, WORDS_SCHEMA)


def _gathered(ranking: list[tuple[int, int, int, int]]) -> int:
    """How many of the first pairs have words that fit on the driver."""
    sizes = np.cumsum([symbols for _, _, _, symbols in ranking])
    return int(np.searchsorted(sizes, GATHERED_SYMBOLS, "right"))


class _Neighbourhood:
    """The first ranked pairs with all words that hold one of them: one-by-one merging, exactly.

    The counts of ranked pairs are those of the corpus, and every word in which one of them
    can change is here; a pair with a token made here occurs in these words only. So merging
    goes on as long as the next pair comes before ``horizon``, the last ranked pair, which
    no pair outside can do: its count only falls. A token that existed before ends it, since
    its pairs occur elsewhere too.
    """

    def __init__(self, ranking: list[tuple[int, int, int]], complete: bool, words: list[list[int]], freq: list[int]):
        self.words, self.freq = words, freq
        self.count = {(l, r): n for l, r, n in ranking}
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k, w in enumerate(words):
            for p in zip(w, w[1:]):
                if p in self.count:
                    self.where[p].add(k)
        self.heap = [(-n, l, r) for l, r, n in ranking]
        heapq.heapify(self.heap)
        self.horizon = None if complete else max(self.heap)

    def merges(self, tokens: list[str], ids: dict[str, int], vocab_size: int, least: int):
        """The merges in order, as (left, right, id); extends ``tokens`` and ``ids``."""
        out, made = [], set()
        while self.heap and len(tokens) < vocab_size:
            key = heapq.heappop(self.heap)
            n, pair = -key[0], key[1:]
            if n != self.count[pair]:
                continue
            if n < least or (self.horizon is not None and key > self.horizon):
                break
            token = tokens[pair[0]] + tokens[pair[1]]
            known = token in ids
            if not known:
                ids[token] = len(tokens)
                tokens.append(token)
                made.add(ids[token])
            out.append((*pair, ids[token]))
            self._merge(pair, ids[token], made)
            if known:
                break
        return out

    def _merge(self, pair: tuple[int, int], new: int, made: set[int]) -> None:
        changed = set()
        for k in list(self.where[pair]):
            word, n = self.words[k], self.freq[k]
            for p in zip(word, word[1:]):
                if p in self.count:
                    self.count[p] -= n
                    changed.add(p)
            merged, i = [], 0
            while i < len(word):
                hit = i + 1 < len(word) and word[i] == pair[0] and word[i + 1] == pair[1]
                merged.append(new if hit else word[i])
                i += 2 if hit else 1
            self.words[k] = merged
            for p in zip(merged, merged[1:]):
                if p in self.count or p[0] in made or p[1] in made:
                    self.count[p] = self.count.get(p, 0) + n
                    self.where[p].add(k)
                    changed.add(p)
        for p in changed:
            if self.count[p] > 0:
                heapq.heappush(self.heap, (-self.count[p], *p))


def learn_bpe(
    words: DataFrame, vocab_size: int, min_frequency: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Byte-pair vocabulary of a (word, freq) table: vocab(token, id), merges(rank, left,
    right, left_id, right_id, id).

    Ids: reserved tokens, then the characters by code point, then one token per merge.
    Each step merges the most frequent adjacent pair, ties by the smaller ids.

    The words stay on the executors as id arrays. A round ranks the pairs, and merges at once
    as many as one-by-one merging would have merged in the same order. Frequent pairs are
    decided from a second ranking, of the symbols next to them. Once the words of the next
    pairs are few (``GATHERED_SYMBOLS``), these words come to the driver, where the exact
    order is followed as far as they determine it, ties included. What comes to the driver
    has a fixed size in either case.
    """
    spark = words.sparkSession
    chars = words.select(F.explode(F.split("word", "")).alias("c")).distinct()
    tokens = list(T.SPECIAL_TOKENS) + sorted(r.c for r in chars.collect())
    ids = {t: i for i, t in enumerate(tokens)}
    alphabet = np.array([ord(t) for t in tokens[N_SPECIAL:]], np.uint32)

    slots = [new_path(spark, "bpe-words") for _ in range(2)]
    table = materialise(_character_words(words, alphabet), "bpe-words", slots[0])
    n_tables, pending, merges = 1, [], []

    while len(tokens) < vocab_size:
        sized = [
            (r.pair >> 32, r.pair & 0xFFFFFFFF, r.freq, r.symbols)
            for r in _count_pairs(table, pending)
            .filter(F.col("freq") >= max(1, min_frequency))
            .orderBy(F.desc("freq"), "pair")
            .limit(TOP_PAIRS)
            .collect()
        ]
        if not sized:
            break
        ranking = [row[:3] for row in sized]
        near = _gathered(sized)
        if near >= min(GATHERED_PAIRS, len(sized)):
            pairs = np.sort(np.array([(l << 32) | r for l, r, _ in ranking[:near]], np.int64))
            found = _with_pairs(table, pending, pairs, True).toArrow()
            complete = near == len(sized) < TOP_PAIRS
            local = _Neighbourhood(ranking[:near], complete, found["ids"].to_pylist(), found["freq"].to_pylist())
            merges += local.merges(tokens, ids, vocab_size, max(1, min_frequency))
            longer = [(w, n) for w, n in zip(local.words, local.freq, strict=True) if len(w) > 1]
            again = pa.table(
                {
                    "ids": pa.array([w for w, _ in longer], pa.list_(pa.int32())),
                    "freq": pa.array([n for _, n in longer], pa.int64()),
                }
            )
            rest = _with_pairs(table, pending, pairs, False).union(spark.createDataFrame(again))
            table = materialise(rest, "bpe-words", slots[n_tables % 2])
            n_tables, pending = n_tables + 1, []
            continue
        ranked = np.array([(l << 32) | r for l, r, _ in ranking], np.int64)
        n_counted = min(COUNTED_PAIRS, len(ranking))
        neighbours = _count_neighbours(table, pending, ranked, n_counted).collect()
        more = ranking[-1][2] if len(ranking) == TOP_PAIRS else 0
        room = vocab_size - len(tokens)
        for group in _next_merges(ranking, n_counted, neighbours, more, room):
            batch = []
            for left, right in group:
                token = tokens[left] + tokens[right]
                known = token in ids
                if not known:
                    ids[token] = len(tokens)
                    tokens.append(token)
                batch.append((left, right, ids[token]))
                if known:
                    break
            merges += batch
            pending.append(_as_arrays(batch))
            # A merge into a token that other merges made adds to the counts of its
            # pairs, so what comes next needs a new count.
            if known:
                break
        if len(pending) >= GROUPS_PER_TABLE:
            table = materialise(_rewritten(table, pending), "bpe-words", slots[n_tables % 2])
            n_tables, pending = n_tables + 1, []

    vocab = spark.createDataFrame(list(enumerate(tokens)), "id int, token string").select("token", "id")
    rows = [(i, tokens[l], tokens[r], l, r, n) for i, (l, r, n) in enumerate(merges)]
    schema = "rank int, left string, right string, left_id int, right_id int, id int"
    return vocab, spark.createDataFrame(rows, schema)


def _character_words(words: DataFrame, alphabet: np.ndarray) -> DataFrame:
    def to_ids(batches):
        for b in batches:
            w = b.column("word")
            points = np.frombuffer("".join(w.to_pylist()).encode("utf-32-le"), np.uint32)
            ids = np.searchsorted(alphabet, points) + N_SPECIAL
            lengths = pc.utf8_length(w).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [R.list_array(ids, lengths, pa.int32()), b.column("freq")], names=["ids", "freq"]
            )

    # every round reads this table, which may be too small to be dealt to all cores by its size
    spark = words.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    longer = words.filter(F.char_length("word") > 1).select("word", "freq")
    return longer.repartition(tasks, "word").mapInArrow(to_ids, WORDS_SCHEMA)


def _rewritten(words: DataFrame, pending: list) -> DataFrame:
    """The words after the pending merges; words of one symbol have no pairs and go."""

    def rewrite(batches):
        for flat, lengths, freq in _merged_words(batches, pending):
            keep = np.flatnonzero(lengths > 1)
            values, n = R.take_rows(flat, lengths, keep)
            yield pa.RecordBatch.from_arrays(
                [R.list_array(values, n, pa.int32()), pa.array(freq[keep])], names=["ids", "freq"]
            )

    return words.mapInArrow(rewrite, WORDS_SCHEMA)


# -- encoding -----------------------------------------------------------------------


def _bounded(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


class _Encoder:
    """Subword ids of words. It is built once, as sorted arrays, and broadcast."""

    def __init__(self, vocab: list, merges: list):
        self.special = {t: i for i, t in enumerate(T.SPECIAL_TOKENS)}
        chars = sorted((ord(r.token), r.id) for r in vocab if len(r.token) == 1)
        self.points = np.array([c for c, _ in chars] or [0], np.uint32)
        self.point_ids = np.array([i for _, i in chars] or [T.UNK], np.int32)
        rows = sorted(((r.left_id << 32) | r.right_id, r.rank, r.id) for r in merges)
        self.pairs = np.array([p for p, _, _ in rows] or [-2], np.int64)
        self.ranks = np.array([k for _, k, _ in rows] or [0], np.int64)
        self.merged = np.array([i for _, _, i in rows] or [0], np.int32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        if not words:
            return self._in_order([])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        flat = np.where(self.points[at] == points, self.point_ids[at], T.UNK).astype(np.int32)
        for i, w in enumerate(words):
            if w in self.special:
                first = int(lengths[:i].sum())
                flat[first] = self.special[w]
                flat[first + 1 : first + lengths[i]] = -1
        lengths = R.sum_rows((flat >= 0).astype(np.int64), lengths)
        flat = flat[flat >= 0]

        done = []
        open_ = np.arange(len(words))
        while len(open_):
            short = lengths <= LONG_WORD
            flat, lengths, open_ = self._set_aside(flat, lengths, open_, ~short, done, self._long)
            if len(flat) == 0:
                break
            best, at = self._best_pairs(flat, lengths)
            merge = best < _NO_PAIR
            pos = best[merge] & 0xFFFFFFFF
            flat[pos] = self.merged[at[pos]]
            keep = np.ones(len(flat), bool)
            keep[pos + 1] = False
            flat, lengths = flat[keep], lengths - merge
            flat, lengths, open_ = self._set_aside(flat, lengths, open_, ~merge, done)
        return self._in_order(done)

    def _best_pairs(self, flat: np.ndarray, lengths: np.ndarray):
        """Per word, rank << 32 | position of its first pair of lowest rank."""
        keys = np.append(_pair_keys(flat, lengths), -1)
        at, known = _listed(keys, self.pairs)
        code = np.where(known, (self.ranks[at] << 32) | np.arange(len(flat)), _NO_PAIR)
        return np.minimum.reduceat(code, R.starts_of(lengths)), at

    @staticmethod
    def _set_aside(flat, lengths, words, finished, done, finish=None):
        if not finished.any():
            return flat, lengths, words
        values, n = R.take_rows(flat, lengths, np.flatnonzero(finished))
        if finish:
            rows = [finish(row.tolist()) for row in np.split(values, np.cumsum(n)[:-1])]
            values = np.array([i for row in rows for i in row], np.int32)
            n = np.array([len(row) for row in rows], np.int64)
        done.append((words[finished], values, n))
        rest = np.flatnonzero(~finished)
        return *R.take_rows(flat, lengths, rest), words[rest]

    @staticmethod
    def _in_order(done):
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words, values, n = (np.concatenate(x) for x in zip(*done))
        return R.take_rows(values, n, np.argsort(words))

    def _pair(self, left: int, right: int) -> tuple[int, int] | None:
        key = (left << 32) | right
        at = int(np.searchsorted(self.pairs, key))
        if at == len(self.pairs) or self.pairs[at] != key:
            return None
        return int(self.ranks[at]), int(self.merged[at])

    def _long(self, ids: list[int]) -> list[int]:
        """The same for one long word, in time n log n: a heap of pairs and a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (pair := self._pair(ids[i], ids[after[i]])):
                heapq.heappush(heap, (pair[0], i, ids[i], ids[after[i]], pair[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


def encode_corpus(
    df: DataFrame,
    vocab: DataFrame,
    merges: DataFrame,
    words: str = "words",
    out: str = "ids",
    id: str = "sent_id",
    limit: int = BROADCAST_TOKENS,
) -> DataFrame:
    """Replace the word arrays by subword id arrays.

    With a vocabulary and merge list of at most ``limit`` rows there is no shuffle: they go
    to the executors, and every Arrow batch encodes each of its distinct words once. Larger
    ones are joined: the distinct words of the corpus are merged in rounds, and their
    occurrences, salted, are collected again by ``id``. NULL has no ids.
    """
    spark = df.sparkSession
    every = F.coalesce(F.col(words), F.array().cast("array<string>"))
    vocab_rows = _bounded(vocab.select("token", "id"), limit)
    merge_rows = _bounded(merges.select("rank", "left_id", "right_id", "id"), limit)
    if vocab_rows is None or merge_rows is None:
        df = df.withColumn(words, every)
        coded = _coded_words(df.select(F.explode(words).alias("token")).distinct(), vocab, merges)
        unknown = F.array().cast("array<int>")
        return _by_join(df, coded, unknown, words, out, id).withColumn(out, F.flatten(out))
    shared = spark.sparkContext.broadcast(_Encoder(vocab_rows, merge_rows))

    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = shared.value
        for column in columns:
            lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = column.flatten().dictionary_encode()
            values, sizes = encoder.words(coded.dictionary.to_pylist())
            flat, picked = R.take_rows(values, sizes, coded.indices.to_numpy(zero_copy_only=False))
            yield R.list_array(flat, R.sum_rows(picked, lengths), pa.int32())

    return df.withColumn(out, encode(every)).drop(words)


def _coded_words(tokens: DataFrame, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """token, code (its subword ids) of distinct words, by joins with the merge list.

    A round applies to every word its first merge of lowest rank. It writes the words that
    change and those that are finished apart, and the next one reads the former only.
    """
    spark = tokens.sparkSession
    special = tokens["token"].isin(T.SPECIAL_TOKENS)
    place = F.array_position(F.array(*map(F.lit, T.SPECIAL_TOKENS)), F.col("token")) - 1
    fixed = tokens.filter(special).select("token", F.array(place.cast("int")).alias("ids"))
    single = vocab.filter(F.length("token") == 1).select("token", F.col("id").alias("code"))
    chars = tokens.filter(~special).select("token", F.split("token", "").alias("chars"))
    state = _by_join(chars, single, F.lit(T.UNK), "chars", "ids", "token").unionByName(fixed)

    n = F.size("ids")
    salted = _salted(merges.select("left_id", "right_id", "rank", F.col("id").alias("new_id")))
    root, schema = new_path(spark, "coded-words"), "token string, ids array<int>, round int, open int"
    round_, changed = 0, True
    state = materialise(state.select("token", "ids"), "words")
    while changed:
        both = F.arrays_zip(
            F.slice("ids", 1, n - 1).alias("left_id"), F.slice("ids", 2, n - 1).alias("right_id")
        )
        pairs = state.filter(n > 1).select("token", F.posexplode(both).alias("pos", "pair"))
        best = (
            pairs.select("token", "pos", "pair.*", _salt("token", "pos"))
            .join(salted, ["left_id", "right_id", "salt"])
            .groupBy("token")
            .agg(F.min(F.struct("rank", "pos", "new_id")).alias("best"))
        )
        at = F.col("best.pos")
        merged = F.concat(
            F.slice("ids", 1, at), F.array(F.col("best.new_id").cast("int")), F.slice("ids", at + 3, n)
        )
        stepped = state.join(best, "token", "left").select(
            "token",
            F.when(F.col("best").isNull(), F.col("ids")).otherwise(merged).alias("ids"),
            F.col("best").isNotNull().cast("int").alias("open"),
        )
        path = f"{root}/round={round_}"
        stepped.write.mode("overwrite").partitionBy("open").parquet(path)
        state = spark.read.schema(schema).option("basePath", root).parquet(path).filter("open = 1")
        state = state.select("token", "ids")
        round_, changed = round_ + 1, not state.isEmpty()
    done = spark.read.schema(schema).parquet(root).filter("open = 0")
    return done.select("token", F.col("ids").alias("code"))


def encode_words(
    df: DataFrame,
    vocab: DataFrame,
    words: str = "words",
    out: str = "ids",
    id: str = "sent_id",
    limit: int = BROADCAST_TOKENS,
) -> DataFrame:
    """Replace the word arrays by word-level ids, unknown words by the unknown id.

    A vocabulary of at most ``limit`` tokens is looked up in place, without a shuffle.
    A larger one is joined: occurrences are salted, so that a hot word spreads over
    several tasks, and collected again by ``id``.
    """
    known = _bounded(vocab.select("token", "id"), limit)
    if known is None:
        codes = vocab.select("token", F.col("id").alias("code"))
        return _by_join(df, codes, F.lit(T.UNK), words, out, id)
    shared = df.sparkSession.sparkContext.broadcast(
        ([r.token for r in known], np.array([r.id for r in known] + [T.UNK], np.int32))
    )

    @F.arrow_udf("array<int>")
    def look_up(column: pa.Array) -> pa.Array:
        tokens, ids = shared.value
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten()
        at = pc.index_in(flat, value_set=pa.array(tokens, flat.type))
        return R.list_array(ids[pc.fill_null(at, len(tokens)).to_numpy()], lengths, pa.int32())

    return df.withColumn(out, look_up(words)).drop(words)


def _salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(WORD_SALT)).cast("int").alias("salt")


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD_SALT - 1))))


def _by_join(df: DataFrame, codes: DataFrame, unknown: Column, words: str, out: str, id: str) -> DataFrame:
    """Replace the word arrays by arrays of the words' codes; ``codes`` has token and code."""
    occurrences = df.select(F.col(id).alias("_id"), F.posexplode(words).alias("pos", "token"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("code", unknown).alias("code"))))
    coded = (
        occurrences.withColumn("salt", _salt("_id", "pos"))
        .join(_salted(codes), ["token", "salt"], "left")
        .groupBy("_id")
        .agg(in_order.alias("coded"))
        .select(F.col("_id").alias(id), F.col("coded.code").alias(out))
    )
    empty = F.array().cast(coded.schema[out].dataType)
    return df.drop(words).join(coded, id, "left").withColumn(out, F.coalesce(out, empty))


def write_vocabulary(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")


def vocabulary_size(vocab: DataFrame) -> int:
    return vocab.count()
