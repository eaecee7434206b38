import json
import random

import numpy as np
import pytest

from sentspark.functions import text as T
from sentspark.operators import vocab as V
from sentspark.plans.embed import encode_lines, learn_vocabulary

tk = pytest.importorskip("tokenizers")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sent_id bigint, text string")


def library(texts, size):
    tok = tk.Tokenizer(tk.models.BPE(unk_token="<unk>"))
    n = tk.normalizers
    tok.normalizer = n.Sequence([n.Replace(tk.Regex(r"\p{P}"), ""), n.Lowercase()])
    tok.pre_tokenizer = tk.pre_tokenizers.Whitespace()
    trainer = tk.trainers.BpeTrainer(vocab_size=size, special_tokens=T.SPECIAL_TOKENS, show_progress=False)
    tok.train_from_iterator(texts, trainer)
    return tok


def learnt(spark, texts, size):
    vocab, merges = learn_vocabulary(frame(spark, texts), size)
    return (
        {r.token: r.id for r in vocab.collect()},
        [(r.left, r.right) for r in merges.orderBy("rank").collect()],
        vocab,
        merges,
    )


def test_golden_case(spark):
    ids, merges, vocab, table = learnt(spark, ["aa ab ab ba ba cab cd cd"], 12)
    assert merges == [("a", "b"), ("b", "a"), ("c", "d")]
    assert [ids[c] for c in "abcd"] == [5, 6, 7, 8]
    rows = encode_lines(frame(spark, ["zab zz ab", "<mask> ab", ""]), vocab, table).orderBy("sent_id").collect()
    ab = ids["ab"]
    assert [r.ids for r in rows] == [[2, ab, 2, 2, ab], [0, ab], []]


def random_texts(seed, alphabet, n):
    rng = random.Random(seed)
    return [
        " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12)))
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    "seed, alphabet, n, size",
    [(1, "ab", 40, 60), (2, "abc", 60, 90), (3, "aaab", 60, 80), (4, "abcdefgh", 80, 150), (5, "a", 20, 20), (6, "ab", 150, 130)],
)
def test_merges_and_ids_agree_with_library(spark, seed, alphabet, n, size):
    texts = random_texts(seed, alphabet, n)
    tok = library(texts, size)
    model = json.loads(tok.to_str())["model"]
    ids, merges, vocab, table = learnt(spark, texts, size)
    assert merges == [tuple(m) for m in model["merges"]]
    assert ids == model["vocab"]
    unseen = random_texts(seed + 100, alphabet + "z", 50) + ["a<mask>b", "x </s>y", "<S> <unk>", "", " "]
    unseen += ["".join(random.Random(seed).choices(alphabet, k=n)) for n in (63, 64, 65, 66, 3000)]
    rows = encode_lines(frame(spark, unseen), vocab, table).orderBy("sent_id").collect()
    assert [r.ids for r in rows] == [tok.encode(t).ids for t in unseen]


@pytest.mark.parametrize("symbols, top", [(0, 1000), (300, 20), (3000, 40)])
def test_merges_agree_whatever_the_driver_may_hold(spark, monkeypatch, symbols, top):
    monkeypatch.setattr(V, "GATHERED_SYMBOLS", symbols)
    monkeypatch.setattr(V, "GATHERED_PAIRS", 2)
    monkeypatch.setattr(V, "TOP_PAIRS", top)
    texts = random_texts(8, "abcde", 40)
    model = json.loads(library(texts, 90).to_str())["model"]
    ids, merges, _, _ = learnt(spark, texts, 90)
    assert merges == [tuple(m) for m in model["merges"]]
    assert ids == model["vocab"]


def test_thousands_of_merges_agree_with_library(spark, monkeypatch):
    rounds = []
    count = V._count_pairs
    monkeypatch.setattr(V, "_count_pairs", lambda *a: rounds.append(1) or count(*a))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.filter("text is not null").collect()]
    model = json.loads(library(texts, 5300).to_str())["model"]
    ids, merges, _, _ = learnt(spark, texts, 5300)
    assert len(merges) >= 5000 and merges == [tuple(m) for m in model["merges"]]
    assert ids == model["vocab"]
    assert len(rounds) < 150


def test_real_words_agree_with_library(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUPS_PER_TABLE", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [r.text for r in docs.collect()]
    model = json.loads(library(texts, 150).to_str())["model"]
    ids, merges, _, _ = learnt(spark, texts, 150)
    assert merges == [tuple(m) for m in model["merges"]]
    assert ids == model["vocab"]


def test_short_rankings_give_the_same_merges(spark, monkeypatch):
    texts = random_texts(9, "abcdef", 80)
    want = learnt(spark, texts, 80)[1]
    monkeypatch.setattr(V, "TOP_PAIRS", 5)
    monkeypatch.setattr(V, "COUNTED_PAIRS", 3)
    assert learnt(spark, texts, 80)[1] == want


def test_alphabet_may_fill_the_vocabulary(spark):
    ids, merges, _, _ = learnt(spark, ["abc"], 6)
    assert merges == [] and len(ids) == 8


def test_word_lookup_and_join_agree(spark):
    words = [["a", "b", "zz"], [], ["a"] * 50, ["c"]]
    df = spark.createDataFrame(list(enumerate(words)), "sent_id bigint, words array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id int")
    a = sorted(V.encode_words(df, vocab).collect())
    b = sorted(V.encode_words(df, vocab, limit=1).select("sent_id", "ids").collect())
    assert [r.ids for r in a] == [r.ids for r in b] == [[5, 6, 2], [], [5] * 50, [2]]


def test_word_counts_with_a_hot_word(spark):
    texts = ["hot " * 20 + f"w{i % 7}" for i in range(300)]
    counts = {r.word: r.freq for r in V.word_frequency(frame(spark, texts), T.words("text")).collect()}
    assert counts["hot"] == 6000 and sum(counts.values()) == 6300
    assert V.top_words(V.word_frequency(frame(spark, texts), T.words("text")), 2).orderBy("id").collect()[0].token == "hot"


def test_subwords_by_join_when_the_vocabulary_is_large(spark):
    _, _, vocab, merges = learnt(spark, ["aa ab ab ba ba cab cd cd \U0001d51e\U0001d51e " + "ab" * 20], 30)
    rows = [
        (1, ["zab", "<mask>", "ab", "ab"]), (2, []), (3, None), (4, ["a" * 9, "ab" * 30 + "z"]),
        (5, ["<unk>", "\U0001d51e\U0001d51ea", "z"]),
    ]
    df = spark.createDataFrame(rows, "sent_id int, words array<string>")
    a = sorted(V.encode_corpus(df, vocab, merges).collect())
    b = sorted(V.encode_corpus(df, vocab, merges, limit=1).select("sent_id", "ids").collect())
    assert a == b and len(a) == 5
    assert V.encode_corpus(df.limit(0), vocab, merges, limit=1).collect() == []


def test_vocabulary_round_trip(spark, tmp_path):
    _, merges, vocab, table = learnt(spark, ["ab ab abc"], 12)
    V.write_vocabulary(vocab, table, str(tmp_path / "v"))
    vocab2, table2 = V.read_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(vocab.collect()) == sorted(vocab2.collect())
    assert V.vocabulary_size(vocab2) == vocab.count()
    assert sorted(table.collect()) == sorted(table2.collect())


def test_merging_equals_a_loop_over_the_symbols():
    rng = np.random.default_rng(8)
    for listed in ([(1, 1, 9)], [(0, 1, 9), (2, 3, 8), (0, 3, 7)]):
        words = [list(map(int, rng.integers(0, 4, n))) for n in rng.integers(1, 12, 200)]
        flat, lengths = np.array(sum(words, []), np.int32), np.array(list(map(len, words)))
        got, sizes = V._apply_batch(flat, lengths, V._as_arrays(listed))
        made, want = {(l, r): n for l, r, n in listed}, []
        for w in words:
            out, i = [], 0
            while i < len(w):
                new = made.get(tuple(w[i : i + 2]))
                out.append(w[i] if new is None else new)
                i += 1 if new is None else 2
            want.append(out)
        assert [x.tolist() for x in np.split(got, np.cumsum(sizes)[:-1])] == want


def test_sums_by_pair_are_exact_either_way():
    rng = np.random.default_rng(9)
    left, right = rng.integers(0, 50, (2, 70_000))
    keys, n = (left << 32) | right, rng.integers(1, 1 << 50, 70_000)
    few, many = V._sum_by_pair(keys, 50, n), V._sum_by_pair(keys, 50_000, n)
    want = {}
    for k, w in zip(keys.tolist(), n.tolist()):
        want[k] = want.get(k, 0) + w
    assert dict(zip(few[0].tolist(), few[1].tolist())) == dict(zip(many[0].tolist(), many[1].tolist())) == want


def test_a_small_word_table_is_dealt_to_all_cores(spark):
    words = spark.createDataFrame([(f"word{k}", 1) for k in range(400)], "word string, freq long").coalesce(1)
    alphabet = np.array(sorted({ord(c) for c in "word0123456789"}), np.uint32)
    assert V._character_words(words, alphabet).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
