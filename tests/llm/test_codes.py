"""Vector codes against plain distances to all entries, on rows with every edge case."""

import hashlib
import math

import numpy as np


def _brute(rows):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    dim = len(kept[0][1])
    cuts = [dim * p // 4 for p in range(5)]
    same = [r for r in kept if len(r[1]) == dim]
    whole = np.array([r[1] for r in same], object).reshape(len(same), dim)
    start = np.array([r[1] for r in kept[:256] if len(r[1]) == dim], object)
    books = [start[:, cuts[p] : cuts[p + 1]] for p in range(4)]

    def assigned():
        far = [((whole[:, None, cuts[p] : cuts[p + 1]] - b[None]) ** 2).sum(2) for p, b in enumerate(books)]
        return [f.astype(np.int64).argmin(1) for f in far], [f.min(1) for f in far]

    for _ in range(4):
        entry, _ = assigned()
        for p in range(4):
            new = books[p].copy()
            for e in range(len(new)):
                mine = whole[entry[p] == e][:, cuts[p] : cuts[p + 1]]
                if len(mine):
                    new[e] = mine.sum(0) // len(mine)
            books[p] = new
    entry, far = assigned()
    code = {}
    for k, r in enumerate(same):
        code[id(r)] = ("".join(f"{entry[p][k]:02x}" for p in range(4)), int(sum(f[k] for f in far)))
    out = [(r[0], *code.get(id(r), (None, None)), r[2]) for r in kept]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    total = {}
    for _, _, e, label in out:
        if e is not None:
            total[label] = total.get(label, 0) + e
    return [(i, c, e, total.get(label), digest) for i, c, e, label in out]


def _rows(n, dim=10):
    rng = np.random.default_rng(n)
    v = rng.integers(-6, 7, (n, dim)) / 8 + rng.choice([0.0, 0.0004], (n, dim))
    rows = [(int(i) * 3, [float(x) for x in v[i]], int(i) % 3 if i % 4 else None) for i in range(n)]
    rows += [(1, None, 0), (2, [1.0] * (dim - 1) + [None], 0), (4, [float("nan")] * dim, 1), (5, [float("inf")] * dim, 1)]
    rows += [(900001, [0.5] * dim, 7), (900001, [0.5] * dim, 7), (900002, [0.5] * 3, 9), (900003, [], 9), (None, [0.25] * dim, None)]
    return rows


def test_codes_equal_brute_force(spark):
    from sentspark.llm import codes

    for n, parts in ((1, 1), (40, 1), (700, 7)):
        rows = _rows(n)
        table = spark.createDataFrame(
            [(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, error int, _label string"
        )
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
        got = [tuple(r) for r in codes.compression_report(table.repartition(parts)).collect()]
        assert sorted(got, key=str) == sorted(_brute(rows), key=str)


def test_labels_above_the_broadcast_limit(spark, monkeypatch):
    from sentspark.llm import codes

    table = spark.createDataFrame(_rows(90), "vec_id long, embedding array<float>, label int")
    want = sorted((tuple(r) for r in codes.compression_report(table).collect()), key=str)
    monkeypatch.setattr(codes, "LABELS", 0)
    assert sorted((tuple(r) for r in codes.compression_report(table).collect()), key=str) == want


def test_masks_hold_every_entry_inside_the_radius():
    from sentspark.llm import codes

    rng = np.random.default_rng(2)
    entries, x = rng.integers(-50, 50, (200, 5)), rng.integers(-60, 60, (300, 5))
    book = codes.Book(entries)
    radius = book.radius(x)
    mask = book.candidates(x, radius)
    bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, : len(entries)].astype(bool)
    inside = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(2)
    assert (bits == inside).all()
    assert inside.any(1).all() and not inside.all()


def test_empty_table_and_decoding(spark):
    from sentspark.llm import codes

    table = spark.createDataFrame(_rows(30), "vec_id long, embedding array<float>, label int")
    assert codes.compression_report(table.limit(0)).count() == 0
    vectors = codes.whole_vectors(table)
    books = codes.fit_codebooks(vectors)
    decoded = codes.decoded_vectors(codes.encoded_vectors(vectors, books), books).collect()
    whole = {r.vec_id: r.v for r in vectors.collect()}
    for r in decoded:
        if r.code is not None:
            assert sum((a - b) ** 2 for a, b in zip(whole[r.vec_id], r.approximate, strict=True)) == r.error
