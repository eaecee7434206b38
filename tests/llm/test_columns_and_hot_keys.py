"""Stages on tables whose further columns are named as theirs, and joins on hot keys."""

import random

import pytest
from pyspark.sql import functions as F

NAMES = ["_id", "_ranges", "_tk", "_score", "_r", "_i", "_t", "_once", "_counts", "_ID2", "row", "counts", "p", "v", "kept"]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(150))
    rows = []
    for i in range(60):
        own = " ".join(rng.choice(words) for _ in range(80))
        rows.append((i, f"{own} {long}" if i % 6 == 0 else own if i % 5 else rows[-1][1] if rows else own, "en", "s", 1))
    rows += [rows[7], rows[7], (60, None, None, None, None), (61, "", "en", "s", 0)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(50)], "doc_id long, toxic int")
    return plain, plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in NAMES}), labels


def _rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("stage", ["quality", "toxicity", "near_duplicates", "repeated_strings"])
def test_stages_take_columns_of_any_name(clashing, stage):
    from sentspark.llm.jaccard import one_of_each
    from sentspark.llm.quality import quality_filter
    from sentspark.llm.suffix import remove_repeats
    from sentspark.llm.toxicity import toxicity_filter

    plain, wide, labels = clashing
    run = {
        "quality": quality_filter,
        "toxicity": lambda d: toxicity_filter(d, labels),
        "near_duplicates": one_of_each,
        "repeated_strings": remove_repeats,
    }[stage]
    got = run(wide)
    assert got.columns == wide.columns
    assert _rows(got, plain.columns) == _rows(run(plain), plain.columns)
    # what the further columns held goes on unchanged
    for r in got.collect():
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in NAMES)


def test_join_with_hot_keys_equals_a_plain_join(spark):
    from sentspark.llm import frames

    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(6000)], "k long, x long").repartition(7)
    counted = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("most"))
    hot = frames.hot_rows(counted, 6000)
    assert [r.k for r in hot.collect()] == [0]
    for how, right in (("inner", counted), ("left", counted.filter("k % 2 = 0"))):
        want = left.join(right, "k", how)
        assert _rows(frames.join_hot(left, right, "k", hot, how), want.columns) == _rows(want, want.columns)


def test_components_of_a_star_and_a_chain(spark):
    from sentspark.llm.links import components

    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5060)] + [(9, 9), (1, 0)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5061)}


def test_groups_in_which_half_of_all_rows_are_copies(spark):
    from sentspark.llm.jaccard import components_of

    rng = random.Random(4)
    text = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(700)]
    near = text[0].rsplit(" ", 1)[0]
    rows = [(i, text[0] if i % 2 else near if i % 50 == 0 else None if i % 50 == 2 else text[i % 700]) for i in range(1400)]
    got = {r.doc_id: r.component_id for r in components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first: dict = {}
    for i, t in rows:
        t = text[0] if t == near else t
        first.setdefault(t if t is not None else i, i)
    assert got == {i: first[i if t is None else text[0] if t == near else t] for i, t in rows}
