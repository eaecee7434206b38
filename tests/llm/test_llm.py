"""The operators for training data against brute force, on a small fixture with edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, common string, ranges string, row long"


def _texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(120)]
    out: list[str | None] = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(1, 250))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(base))
            base[at:at] = passage[: rng.randint(20, 120)]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n"]).join(copy))
    out += [None, "", " \t\n", "one", "é" * 500, "ab" * 700, "É É É " * 100, " ".join(words * 12)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [
        (i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", "y", 7) for i, t in enumerate(texts)
    ]
    rows += [rows[3], rows[3], (None, "a lone text without an id", None, None, 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def _pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_suffix_removal_equals_brute_force(docs):
    from sentspark.llm import suffix

    rows, n = [(d, t.encode()) for d, t in _pairs(docs)], suffix.LENGTH
    seen = Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    want = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix.removal_report(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_anchors_equal_brute_force(docs):
    from sentspark.llm import anchors

    rows, n = [(d, WORD.findall(t)) for d, t in _pairs(docs)], anchors.LENGTH
    seen = Counter(tuple(w[i : i + n]) for _, w in rows for i in range(len(w) - n + 1))
    want = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in anchors.removal_report(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [1 << 24, 3000])
def test_jaccard_join_equals_brute_force(docs, monkeypatch, limit):
    from sentspark.llm import jaccard

    monkeypatch.setattr(jaccard, "CLUSTER", limit)
    sets = []
    for d, t in _pairs(docs):
        w = WORD.findall(t.lower())
        grams = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
        sets.append((d, grams))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for i, (d, a) in enumerate(sets):
        ids = [e for k, (e, _) in enumerate(sets) if group[k] == group[i] and e is not None]
        want.append((d, len(a), (min(ids) if ids else None) if a else d))
    got = [tuple(r) for r in jaccard.components_of(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.filter("text is not null").count() < docs.count()


def test_encodings_equal_the_public_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sentspark.llm import bpe, packing

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(str(path))
    want = []
    for d, t in _pairs(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        code = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((d, len(ids), code, hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encoding_report(docs, str(path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    rng = random.Random(5)
    letters = [*"aeiostrn'.,! \n\tΣİßÉ日한\U0001f600x19́\x1c\x85​", "'s", "<|endoftext|>", "</w>", " the"]
    byte_path = packing.byte_vocabulary()
    bytes_library = Tokenizer.from_file(byte_path)
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 15)))
        ids = next(bpe.vocabulary(str(path)).encode([text])).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        ids = next(packing.document_ids([text], byte_path)).tolist()
        assert ids == [*bytes_library.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    from sentspark.llm import packing

    library = Tokenizer.from_file(packing.byte_vocabulary())
    rows = [r for r in packing.packed(docs.filter("doc_id is not null").distinct(), packing.byte_vocabulary()).collect()]
    for d, t in set(_pairs(docs)):
        if d is None:
            continue
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for sequence in {r.sequence_id for r in rows}:
        parts = sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in parts])
        assert [p.offset for p in parts] == [0, *ends[:-1]]
        assert ends[-1] <= packing.LENGTH and (int(ends[-1]) & int(ends[-1] - 1)) == 0


def test_toxicity_on_planted_words(spark):
    from sentspark.llm import toxicity

    rng = random.Random(2)
    words = [f"n{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 8 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vile", "awful", "nasty"])
        rows.append((i, " ".join(text), "extra"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(None, None, None), (9999, "", None)]
    labels += [(None, 1), (5, None), (77777, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_report(docs, marks).collect()}
    assert len(out) == len(rows)
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in set(held)) for i in range(1500))
    assert np.mean([out[i].predicted == (i % 8 == 0) for i in held]) > 0.97
    none = toxicity.toxicity_report(docs, marks.limit(0)).collect()
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in none)


def test_preference_prefix_and_edges(spark):
    from sentspark.llm import preference

    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "bye"),
        (2, 0, "user", "other"), (2, 1, "assistant", None), (None, 0, "user", "lost"), (3, 0, None, "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = preference.preference_examples(preference.replaced_replies(preference.conversations(turns))).collect()
    assert len(out) == 1
    r = out[0]
    assert r.prompt == "<|user|>\nhi<|end|>\n" and r.chosen == "<|assistant|>\nyes<|end|>\n"
    assert r.rejected == "<|assistant|>\n<|end|>\n" and len(r.chosen_mask) == len(r.chosen)
    assert r.chosen[r.chosen_mask.index("1") :] == "yes<|end|>\n"


def test_licenses_edges(spark):
    from sentspark.llm import licenses

    notice = licenses.TEMPLATES["GPL-3.0"]
    rows = [(1, f"some words before it\n{notice}"), (2, None), (3, ""), (4, notice), (4, notice), (5, "no notice at all here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(tuple(r) for r in licenses.license_matches(docs).collect())
    assert [(d, x) for d, x, _, _ in out] == [(1, "GPL-3.0"), (4, "GPL-3.0")]
    assert all(c == 1.0 for _, _, c, _ in out)


def test_topk_edges(spark):
    from sentspark.llm import topk

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    rows += [(400, None, 0), (401, [float("nan")] * 8, 0), (402, [None] * 8, 0), (None, [1.0] * 8, 0), (500, [1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = topk.integer_vectors(vectors)
    got = topk.top_k(usable, usable.filter(F.col("id") % topk.EVERY == 0)).collect()
    whole = {r.id: np.array(r.v) for r in usable.collect() if len(r.v) == 8}
    for q in (0, 100, 200):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[: topk.K]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == best


def test_empty_tables(spark):
    from sentspark.llm import anchors, bpe, jaccard, licenses, packing, quality, suffix

    none = spark.createDataFrame([], SCHEMA)
    assert quality.quality_report(none).count() == 0
    assert jaccard.components_of(none).count() == 0
    assert suffix.removal_report(none).count() == 0
    assert anchors.removal_report(none).count() == 0
    assert licenses.license_matches(none).count() == 0
    assert packing.packed(none, packing.byte_vocabulary()).count() == 0
    assert bpe.encoding_report(none, bpe.word_vocabulary()).count() == 0


def test_quality_keeps_clean_and_drops_symbols(spark, docs):
    from sentspark.llm import quality

    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(100)), "en", "s", 0) for i in range(120)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "###" for _ in range(100)), "en", "s", 0) for i in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _score int")
    kept = {r.doc_id for r in quality.quality_filter(table).collect()}
    assert kept == set(range(120))
    assert quality.quality_report(docs).count() == docs.count()
