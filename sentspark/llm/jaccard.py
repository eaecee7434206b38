"""Jaccard join of documents on word shingles, through a metric-space join.

The Jaccard distance is a metric, so a pivot's distances to two documents differ by at
most the distance of the two. In the space of all shingles that alone splits nothing:
unrelated documents lie at distance 1 from every pivot and from each other, and every
window would hold all of them. The join therefore has two levels.

1. *Slices.* Shingles are dealt by hash into more slices than two linked documents can
   differ in shingles, so linked documents agree on a slice that is not empty
   (:func:`slice_keys`). Documents that agree on a slice and whose sketches allow a link
   (:func:`sketch`, a lower bound of their difference, finer for larger sets) are chained, and the connected
   components of the chains are clusters: no link leaves a cluster.
2. *Pivots.* Within a cluster some documents are pivots. Their distances to all others are
   exact and give links; the others fall into the Voronoi region of their nearest pivot,
   and are replicated to each region whose pivot is at most two thresholds farther, so
   linked documents meet in one region. Regions are joined recursively, and a region whose
   documents are all connected already needs no further comparison.

A cluster is handled in one task while its shingles number at most ``CLUSTER``. Larger
ones are dealt over many tasks, and documents outside their largest component are compared
as pivots with the whole cluster, round after round, until none is left.

Documents with equal sets are one node. Sets, nodes and slices are compared by 64-bit
hashes; links are counted exactly on shingle hashes.

Null or empty text has no shingle and is linked with nothing. Rows that repeat a document
belong to its component. Null ids are no component's smallest id unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.frames import buckets, free, hot_rows, join_hot, keyed, same_row
from sentspark.llm.links import components
from sentspark.llm.rolling import LOWER_CODES, Sums, buffers, mix, numbers, planes, ramp, row_blocks, word_codes, word_spans
from sentspark.session import ship_package
from sentspark.storage import materialise

#: Words of a shingle.
SHINGLE = 4
#: Two documents link when LINK_A * intersection >= LINK_B * union.
LINK_A, LINK_B = 100, 85
#: Shingles of a cluster that one task joins, each document counting for FINE more.
CLUSTER = 1 << 24
#: Pivots of a region, and of a large cluster's round; parts of the sketches in a cluster.
PIVOTS, ROUND_PIVOTS, FINE = 8, 2048, 512
#: Keys gathered before they are dealt out; least parts of a sketch, and most shingles for each of them.
FLUSH, PARTS, FULL = 1 << 20, 32, 16
#: Parts of sketches compared at once.
_CELLS = 1 << 20

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_EPS = 1 - LINK_B / LINK_A
#: Size classes of slices: each starts at 1.5 times the start before it.
_CLASSES = [1, 7]
while _CLASSES[-1] < 1 << 40:
    _CLASSES.append(_CLASSES[-1] * 3 // 2 + 1)
_CLASSES = np.array(_CLASSES)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a binary column."""
    data, offsets = buffers(column)
    for a, b in row_blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, first = word_spans(part, at)
        sums = Sums(word_codes(part, start, end, LOWER_CODES))
        windows = sums.windows(SHINGLE)
        for d in range(b - a):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= SHINGLE:
                yield np.unique(windows[lo : hi - SHINGLE + 1])
            elif hi > lo:
                yield sums.spans(np.array([lo]), np.array([hi]))
            else:
                yield windows[:0]


def set_id(values: np.ndarray) -> np.uint64:
    return Sums(values).spans(np.array([0]), np.array([len(values)]))[0]


def _classes(n: int) -> set[int]:
    """Size classes in which a set of ``n`` may meet a linked set: that of the larger one."""
    return {int(np.searchsorted(_CLASSES, x, "right")) for x in (n, n * LINK_A // LINK_B)}


def slice_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the slices of one set; two linked sets have a key in common.

    Linked sets of up to ``hi`` shingles differ in at most ``d`` of them, so of ``m``
    slices at least ``m - d`` agree. If one of the two sets has fewer empty slices than
    that, a slice that is not empty agrees. A set with too many empty slices adds the
    slices of another dealing, until one has few enough; as both sets go on to the first
    dealing that suits them, both have the first that suits either.
    """
    out = []
    for c in _classes(len(values)):
        hi = int(_CLASSES[c]) - 1
        d = 2 * hi * (LINK_A - LINK_B) // (LINK_A + LINK_B)
        m = d + 1 + (max(1, d // 16) if d else 0)
        attempt = 0
        while True:
            seed = _U((attempt + 1) * _GOLD % (1 << 64))
            mixed = mix(values ^ seed)
            slot = ((mixed >> _U(32)) * _U(m)) >> _U(32)
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            sums = np.add.reduceat(mix(mixed[order] + _U(1)), starts)
            out.append(mix(sums + mix(slot[starts] * _U(1 << 20) + _U(c * 4096 + attempt) + seed)))
            if m - len(starts) < m - d:
                break
            attempt += 1
    return np.concatenate(out)


def parts_of(n: int) -> int:
    """Parts of the sketch of a set of ``n`` shingles: a power of two that grows with the set.

    With ``FULL`` shingles a part or fewer, unrelated sets of any size differ, part by part and
    modulo 16, in a larger share of their shingles than linked ones can.
    """
    return max(PARTS, 1 << (-(-n // FULL) - 1).bit_length())


def sketch(values: np.ndarray) -> np.ndarray:
    """Sizes, modulo 16, of the parts into which a hash deals the set, two to a byte.

    Two sets differ in at least as many shingles as their sizes differ part by part, also
    when only the sizes' remainders are known.
    """
    n = parts_of(len(values))
    part = (mix(values + _U(_GOLD)) >> _U(65 - n.bit_length())).astype(np.int64)
    parts = np.bincount(part, minlength=n) & 15
    return (parts[::2] | parts[1::2] << 4).astype(np.uint8)


class Sketches:
    """Sketches one after the other in ``packed``, of sets of the sizes ``size``."""

    def __init__(self, size: np.ndarray, packed: np.ndarray):
        self.size = size.astype(np.int64)
        sizes, which = np.unique(self.size, return_inverse=True)
        self.parts = np.array([parts_of(int(n)) for n in sizes], np.int64)[which]
        first = np.cumsum(self.parts // 2) - self.parts // 2
        self.row, self.of = np.zeros(len(size), np.int64), {}
        for n in np.unique(self.parts).tolist():
            some = np.flatnonzero(self.parts == n)
            self.row[some] = np.arange(len(some))
            both = packed[first[some][:, None] + np.arange(n // 2)]
            self.of[n] = np.empty((len(some), n), np.uint8)
            self.of[n][:, ::2], self.of[n][:, 1::2] = both & 15, both >> 4

    def get(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Sketches in ``n`` parts, of sets with as many or twice as many."""
        own = self.parts[rows] == n
        if own.all():
            return self.of[n][self.row[rows]]
        out = np.empty((len(rows), n), np.uint8)
        if own.any():
            out[own] = self.of[n][self.row[rows[own]]]
        fine = self.of[2 * n][self.row[rows[~own]]]
        out[~own] = fine[:, ::2] + fine[:, 1::2]
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sets may be linked."""
        both = self.size[a] + self.size[b]
        # sets that pass have sketches of the same number of parts, or one has twice as many
        near = may_link(np.abs(self.size[a] - self.size[b]), both, 0)
        least = np.minimum(self.parts[a], self.parts[b])
        for n in np.unique(least[near]).tolist():
            some = np.flatnonzero(near & (least == n))
            for at in np.split(some, range(_CELLS // n or 1, len(some), _CELLS // n or 1)):
                apart = (self.get(a[at], n) - self.get(b[at], n)) & 15
                near[at] = may_link(np.minimum(apart, 16 - apart).sum(1, dtype=np.int64), both[at], 0)
        return near


def _dealt(
    keys: list[np.ndarray], nodes: list[np.uint64], sizes: list[int], sketches: list[np.ndarray], n: int
) -> pa.RecordBatch:
    """One row a slot: the low bytes of the keys, their nodes by number, the nodes, the sets' sizes and sketches."""
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key, node, size, drawn = np.concatenate(keys), np.array(nodes), np.array(sizes, "<u4"), np.concatenate(sketches)
    length = np.array([len(x) for x in sketches])
    first = np.cumsum(length) - length
    slot = (key >> _U(40)) % _U(n)
    order = np.argsort(slot, kind="stable")
    slot, key, owner = slot[order], key[order], owner[order]
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(starts, np.r_[starts[1:], len(slot)], strict=True):
        own, number = np.unique(owner[a:b], return_inverse=True)
        row = (
            int(slot[a]),
            planes(key[a:b], 5),
            planes(np.diff(number, prepend=0), 3),
            node[own].tobytes(),
            size[own].tobytes() + drawn[np.repeat(first[own], length[own]) + ramp(length[own])].tobytes(),
        )
        for column, x in zip(out, row, strict=True):
            column.append(x)
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.record_batch({c: pa.array(x, t) for c, x, t in zip(("slot", *"abcd"), out, kinds, strict=True)})


def _chains(docs: DataFrame) -> DataFrame:
    """Links ``a``-``b`` that connect the nodes which agree on a slice and may be linked."""
    n = buckets(docs.sparkSession)

    def emit(batches):
        keys, nodes, sizes, sketches, seen, total = [], [], [], [], set(), 0
        for batch in batches:
            for values in shingle_sets(batch.column("data")):
                if not len(values) or (node := set_id(values)) in seen:
                    continue
                seen.add(node)
                keys.append(slice_keys(values))
                nodes.append(node)
                sizes.append(len(values))
                sketches.append(sketch(values))
                total += len(keys[-1])
                if total >= FLUSH:
                    yield _dealt(keys, nodes, sizes, sketches, n)
                    keys, nodes, sizes, sketches, seen, total = [], [], [], [], set(), 0
        if total:
            yield _dealt(keys, nodes, sizes, sketches, n)

    def chain(batches):
        keys, nodes, places, sizes, drawn, known = [], [], [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                at = np.cumsum(numbers(row["b"], 3)).astype(np.int64)
                named = np.frombuffer(row["c"], np.int64)
                keys.append(numbers(row["a"], 5) + (_U(row["slot"]) << _U(40)))
                nodes.append(named[at])
                places.append(at + known)
                sizes.append(np.frombuffer(row["d"], "<u4", len(named)))
                drawn.append(np.frombuffer(row["d"], np.uint8, offset=4 * len(named)))
                known += len(named)
        if not keys:
            return
        sketches = Sketches(np.concatenate(sizes), np.concatenate(drawn))
        k, v, place = np.concatenate(keys), np.concatenate(nodes), np.concatenate(places)
        del keys, nodes, places, sizes, drawn
        order = np.lexsort((v, k))
        k, v, place = k[order], v[order], place[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]
        k, v, place = k[new], v[new], place[new]
        same = k[1:] == k[:-1]
        starts = np.flatnonzero(np.r_[True, ~same])
        count = np.diff(np.r_[starts, len(k)])
        # two members: each pair once, all side by side
        two = starts[count == 2]
        two = two[np.lexsort((v[two + 1], v[two]))]
        two = two[np.r_[True, (v[two[1:]] != v[two[:-1]]) | (v[two[1:] + 1] != v[two[:-1] + 1])][: len(two)]]
        two = two[sketches.near(place[two], place[two + 1])]
        found, seen = [np.stack([v[two], v[two + 1]], 1)], set()
        for a, n in zip(starts[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            if (members := v[a : a + n].tobytes()) not in seen:
                seen.add(members)
                found += [np.stack([v[x], v[y]], 1) for x, y in _spanned(sketches, place[a : a + n], a)]
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield pa.record_batch({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})

    packed = docs.select("data").mapInArrow(emit, "slot int, a binary, b binary, c binary, d binary")
    return packed.repartition(n, "slot").mapInArrow(chain, "a long, b long")


def _spanned(sketches: Sketches, place: np.ndarray, base: int):
    """Pairs (by position) that connect the members of a group wherever sketches allow a link."""
    rest, frontier = np.arange(1, len(place)), [0]
    while len(rest):
        one = frontier.pop() if frontier else int(rest[0])
        rest = rest[rest != one]
        near = sketches.near(np.full(len(rest), place[one]), place[rest])
        hit = rest[near]
        if len(hit):
            yield np.full(len(hit), one + base), hit + base
            rest = rest[~near]
            frontier += hit.tolist()


class Sets:
    """Sorted sets side by side, with the links found among them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.first = np.r_[0, np.cumsum(self.size)]
        self.values = np.concatenate(sets)
        self.parent = np.arange(len(sets))

        owner = np.repeat(np.arange(len(sets)), self.size)
        at = owner * FINE + (mix(self.values + _U(_GOLD)) >> _U(64 - FINE.bit_length() + 1)).astype(np.int64)
        self.drawn = np.bincount(at, minlength=len(sets) * FINE).astype(np.uint8).reshape(-1, FINE)

    def apart(self, members: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Least difference of the members and a set with the fine sketch ``drawn``."""
        steps = self.drawn[members] - drawn
        return np.minimum(steps, -steps).sum(1, dtype=np.int64)

    def get(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in members])

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def common(self, members: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        """Shingles that each member shares with ``pivot``."""
        size = self.size[members]
        starts = np.cumsum(size) - size
        at = np.repeat(self.first[members] - starts, size) + np.arange(size.sum())
        values = self.values[at]
        place = np.searchsorted(pivot, values)
        place[place == len(pivot)] = 0
        return np.add.reduceat((pivot[place] == values).astype(np.int64), starts)


def may_link(apart: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return apart * (LINK_A + LINK_B) <= (LINK_A - LINK_B) * (n + m)


def linked(common: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return LINK_A * common >= LINK_B * (n + m - common)


def _join(sets: Sets, members: np.ndarray) -> None:
    """Connect the linked sets among ``members``: pivots, regions, recursion."""
    stack = [members]
    while stack:
        members = stack.pop()
        if len(members) < 2:
            continue
        root = sets.roots(members)
        labels, count = np.unique(root, return_counts=True)
        if len(labels) == 1:
            continue
        outside = np.flatnonzero(root != labels[np.argmax(count)])
        pivots = outside[np.unique(np.linspace(0, len(outside) - 1, PIVOTS).astype(int))]
        # bounds of the distances: equal where a link is possible, from the sketches elsewhere
        least, most = np.empty((len(pivots), len(members))), np.ones((len(pivots), len(members)))
        for k, p in enumerate(pivots):
            pivot, size = sets.get(members[p]), sets.size[members]
            apart = sets.apart(members, sets.drawn[members[p]])
            least[k] = 2 * apart / (size + len(pivot) + apart)
            some = np.flatnonzero(may_link(apart, size, len(pivot)))
            common = sets.common(members[some], pivot)
            least[k, some] = most[k, some] = 1 - common / (size[some] + len(pivot) - common)
            for i in some[linked(common, size[some], len(pivot))]:
                sets.union(members[p], members[i])
        rest = np.ones(len(members), bool)
        rest[pivots] = False
        window = least[:, rest] <= most[:, rest].min(0) + 2 * _EPS + 1e-9
        rest = members[rest]
        if window.sum() > len(rest):
            stack.append(rest)
        else:
            stack += [rest[w] for w in window]


def _cluster_links(docs: DataFrame) -> DataFrame:
    """``node`` and ``label`` of the documents ``(cluster, node, data)``, joined per cluster."""

    def solve(nodes: list[int], column: list[bytes]):
        known = {}
        for node, values in zip(nodes, shingle_sets(pa.array(column, pa.binary())), strict=True):
            known.setdefault(node, values)
        names = np.array(sorted(known))
        sets = Sets([known[x] for x in names])
        _join(sets, np.arange(len(names)))
        return names, names[sets.roots(np.arange(len(names)))]

    def run(batches):
        now, nodes, data = None, [], []
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for c, node, text in zip(
                batch.column("cluster").to_pylist(), batch.column("node").to_pylist(), batch.column("data").to_pylist(), strict=True
            ):
                if c != now and nodes:
                    out.append(solve(nodes, data))
                    nodes, data = [], []
                now = c
                nodes.append(node)
                data.append(text)
            if out:
                yield _labels(out)
                out = []
        if nodes:
            yield _labels([solve(nodes, data)])

    ordered = docs.repartition(buckets(docs.sparkSession), "cluster").sortWithinPartitions("cluster")
    return ordered.mapInArrow(run, "node long, label long")


def _labels(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    node, label = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.record_batch({"node": pa.array(node), "label": pa.array(label)})


def _large_links(docs: DataFrame) -> DataFrame:
    """As :func:`_cluster_links` for clusters over ``CLUSTER``; ``docs`` is a written table.

    A round compares up to ``ROUND_PIVOTS`` documents outside a cluster's largest
    component with the whole cluster, dealt into parts of at most ``CLUSTER`` shingles.
    """
    dealt = docs.withColumn("parts", F.ceil(F.col("weight") / CLUSTER).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    labels = materialise(docs.select("cluster", "node", F.col("node").alias("label")).distinct(), "jaccard-labels")
    done = None
    while True:
        size = labels.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        top = size.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
        outside = labels.join(top, "cluster").filter("label <> top").select("cluster", "node")
        if done is not None:
            outside = outside.join(done, ["cluster", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("node")))
        pivots = outside.withColumn("r", rank).filter(F.col("r") <= ROUND_PIVOTS).drop("r")
        pivots = materialise(pivots, "jaccard-pivots")
        if pivots.isEmpty():
            return labels.select("node", "label")
        done = pivots if done is None else materialise(done.union(pivots), "jaccard-done")
        chosen = dealt.join(pivots, ["cluster", "node"]).select(
            F.col("cluster").alias("cluster"),
            F.col("node").alias("node"),
            F.col("data").alias("data"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        )
        found = (
            dealt.select("cluster", "part", "node", "data")
            .groupBy("cluster", "part")
            .cogroup(chosen.groupBy("cluster", "part"))
            .applyInArrow(_compare, "a long, b long")
        )
        edges = found.union(labels.filter("node <> label").select("node", "label"))
        named = components(edges).select("node", F.col("component").alias("new"))
        labels = materialise(
            labels.join(named, "node", "left").select("cluster", "node", F.coalesce("new", "node").alias("label")),
            "jaccard-labels",
        )


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if left.num_rows and right.num_rows:
        sets = Sets(list(shingle_sets(left.column("data"))))
        nodes, every = left.column("node").to_numpy(), np.arange(left.num_rows)
        for node, pivot in zip(right.column("node").to_pylist(), shingle_sets(right.column("data")), strict=True):
            some = np.flatnonzero(may_link(sets.apart(every, Sets([pivot]).drawn[0]), sets.size, len(pivot)))
            if not len(some):
                continue
            hit = nodes[some[linked(sets.common(some, pivot), sets.size[some], len(pivot))]]
            a.append(np.full(len(hit), node))
            b.append(hit)
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _nodes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tk``, set size and node of every row; the node of an empty set is null."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("data")))
            ids = [int(set_id(s).view(np.int64)) if len(s) else None for s in sets]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "tk": batch.column("tk"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array(ids, pa.int64()),
                }
            )

    return docs.mapInArrow(run, "doc_id long, tk long, n_shingles long, node long")


def similar_groups(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``tk``, ``n_shingles`` and ``label`` (equal within a component, or null)."""
    rows = keyed(docs, text, id)
    nodes = materialise(_nodes(rows), "jaccard-nodes")
    clusters = components(_chains(rows)).select("node", F.col("component").alias("cluster"))
    known = nodes.filter("node is not null")
    first = known.groupBy("node").agg(
        F.min(F.struct("doc_id", "tk")).alias("row"), F.max("n_shingles").alias("n")
    )
    picked = materialise(
        first.join(clusters, "node").select("cluster", "node", "n", "row.doc_id", "row.tk"), "jaccard-clusters"
    )
    weights = picked.groupBy("cluster").agg(F.sum(F.col("n") + FINE).alias("weight"), F.count("*").alias("nodes"))
    weights = materialise(weights, "jaccard-weights")
    picked = join_hot(picked, weights, "cluster", hot_rows(weights, picked.count(), "nodes"))
    texts = rows.join(picked, same_row(rows, picked)).select("cluster", "node", "data", "weight")
    texts = materialise(texts, "jaccard-texts")
    labels = _cluster_links(texts.filter(F.col("weight") <= CLUSTER).drop("weight"))
    if not weights.filter(F.col("weight") > CLUSTER).isEmpty():
        labels = labels.union(_large_links(texts.filter(F.col("weight") > CLUSTER)))
    labels = materialise(labels, "jaccard-links")
    counted = known.groupBy("node").agg(F.count("*").alias("rows"))
    hot = hot_rows(counted, nodes.count(), "rows").join(labels, "node", "left").select("node", "label")
    named = join_hot(known, labels, "node", hot, "left").union(
        nodes.filter("node is null").withColumn("label", F.lit(None).cast("long")).select("node", "doc_id", "tk", "n_shingles", "label")
    )
    return named.select("doc_id", "tk", "n_shingles", F.coalesce("label", "node").alias("label"))


def components_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    groups = materialise(similar_groups(docs), "jaccard-groups")
    linked = groups.filter("label is not null")
    low = linked.groupBy("label").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    low = materialise(low, "jaccard-low")
    named = join_hot(linked, low, "label", hot_rows(low, groups.count(), "rows"))
    alone = groups.filter("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.select("doc_id", "n_shingles", F.col("low").alias("component_id")).union(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest id of every component, in the same columns,
    which may have any further names."""
    id, tk, once, i, t, r = free(docs, "_id", "_tk", "_once", "_i", "_t", "_r")
    groups = materialise(similar_groups(docs), "jaccard-groups")
    first = groups.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "tk")).alias("row"))
    keep = first.select(F.col("row.doc_id").alias(id), F.col("row.tk").alias(tk), F.lit(True).alias(once))
    lone = groups.filter("label is null").select(F.col("doc_id").alias(id), F.col("tk").alias(tk)).distinct()
    keep = keep.union(lone.withColumn(once, F.lit(False)))
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64("text")})
    kept = rows.join(keep, F.col(i).eqNullSafe(F.col(id)) & (F.col(t) == F.col(tk)))
    order = Window.partitionBy(i, t).orderBy(once)
    kept = kept.withColumn(r, F.row_number().over(order)).filter(~F.col(once) | (F.col(r) == 1))
    return kept.select(*docs.columns)


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return components_of(table(spark, sf_dir, "documents"))
