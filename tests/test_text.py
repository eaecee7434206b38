import re
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from sentspark.functions import text as T
from sentspark.sources import lines as L


def apply(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


ODD = ["", " ", "a", " a ", " a　b\u001c", "\t\na  b\r\n", "\x85x y ", "​a​", "\x0b\x0cz"]


def test_trim_and_word_count_agree_with_python(spark):
    every_space = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    texts = ODD + [f"{s}a{s}b{s}" for s in every_space]
    assert apply(spark, texts, T.trim) == [t.strip() for t in texts]
    assert apply(spark, texts, T.word_count) == [len(t.split()) for t in texts]


def test_word_limit_is_inclusive(spark):
    texts = [" ".join(["w"] * n) for n in (127, 128, 129)] + ["x" * 1000, "  ".join(["w"] * 128)]
    assert apply(spark, texts, T.within_word_limit) == [True, True, False, True, True]


def test_lines_follow_universal_newlines(spark):
    texts = ["a b\r\nc\rd\n\ne", "", "a", "a\n", "a\n\n", "\n", "a\r\n", "a\r", "\r\r\n", "a\r\nb\r\n"]
    want = [t.replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    want = [(t[:-1] if t.endswith("\n") else t).split("\n") if t else [] for t in want]
    assert apply(spark, texts, T.lines) == want


def test_lines_from_documents_ids(spark):
    docs = spark.createDataFrame([(7, "x\ny"), (8, "z"), (-1, "n")], "doc_id bigint, text string")
    rows = L.lines_from_documents(docs).orderBy("sent_id").collect()
    assert [tuple(r) for r in rows] == [
        (-(1 << 27), -1, 0, "n"), (7 << 27, 7, 0, "x"), ((7 << 27) + 1, 7, 1, "y"), (8 << 27, 8, 0, "z"),
    ]


def test_a_document_of_many_lines(spark):
    n = 117_324
    docs = spark.createDataFrame([(1, "a\n" * n), (2, "b")], "doc_id bigint, text string")
    for dense in (False, True):
        got = L.lines_from_documents(docs, dense=dense).agg(
            F.count("*"), F.countDistinct("sent_id"), F.max("line_no"), F.max("sent_id")
        ).first()
        assert tuple(got) == (n + 1, n + 1, n - 1, n if dense else 2 << 27)


def test_documents_with_64_bit_ids(spark):
    ids = [-(1 << 63), -5, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, "x\ny") for i in ids], "doc_id bigint, text string")
    rows = L.lines_from_documents(docs, dense=True).orderBy("sent_id").collect()
    assert [(r.sent_id, r.doc_id, r.line_no) for r in rows] == [
        (2 * k + j, i, j) for k, i in enumerate(ids) for j in range(2)
    ]
    with pytest.raises(Exception, match="number its lines densely"):
        L.lines_from_documents(docs).agg(F.max("sent_id")).collect()


def test_training_keeps_blank_lines_and_search_drops_them(spark):
    df = spark.createDataFrame([(1, " a "), (2, "　"), (3, " ".join(["w"] * 129))], "sent_id int, text string")
    assert [tuple(r) for r in L.training_lines(df).orderBy("sent_id").collect()] == [(1, "a"), (2, "")]
    assert [r.sent_id for r in L.search_lines(df).orderBy("sent_id").collect()] == [1, 3]


def test_sentences(spark):
    texts = ["A b.  C d!\n\nE: f. ", "no end", "a.b c", "x。　y", ""]
    pattern = re.compile("(?<=[。！？.!?…؟।:;])\\s+")
    assert apply(spark, texts, T.sentences) == [pattern.split(t) for t in texts]


WILD = ["hi_there a‿b $$x++ «q»,,", "Hi,,you... $$ ok", "éöñç İ ẞ ø", "ΟΔΟΣ ΣΑΣ Σ", "한글 a-b", "², ½ áb", "x y", "__a__", "a‍b"]


@pytest.mark.parametrize("keep_punctuation", [False, True])
def test_words_agree_with_tokenizers(spark, keep_punctuation):
    tk = pytest.importorskip("tokenizers")
    n, p = tk.normalizers, tk.pre_tokenizers
    norm = [] if keep_punctuation else [n.Replace(tk.Regex(r"\p{P}"), "")]
    norm = n.Sequence(norm + [n.Lowercase()])
    split = p.Sequence([p.Whitespace(), p.Punctuation()]) if keep_punctuation else p.Whitespace()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = WILD + [r.text for r in docs.collect()]
    want = [[w for w, _ in split.pre_tokenize_str(norm.normalize_str(t))] for t in texts]
    assert apply(spark, texts, lambda c: T.words(c, keep_punctuation)) == want


def test_strip_accents_over_all_of_unicode(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(map(chr, points[i : i + 256])) for i in range(0, len(points), 256)]
    want = [
        "".join(x for x in unicodedata.normalize("NFD", b) if unicodedata.category(x)[0] != "M") for b in blocks
    ]
    assert apply(spark, blocks, T.strip_accents) == want


def test_invalid_bytes(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"ok\xff\xfe bad\nfine \xef\xbf\xbd\n")
    read = lambda how: [r.text for r in L.read_lines(spark, str(tmp_path), how).orderBy("row").collect()]
    assert read("drop") == ["ok bad", "fine �"]
    assert read("replace")[0].startswith("ok�")
    with pytest.raises(ValueError):
        read("ignore")


def test_files_keep_their_line_order(spark, tmp_path):
    from sentspark.operators.order import with_ordinals

    for name, n in (("a.txt", 500), ("b.txt", 300)):
        (tmp_path / name).write_text("".join(f"{name} {i}\r\n" for i in range(n)), newline="")
    lines = with_ordinals(L.read_lines(spark, str(tmp_path)), ["file", "block", "row"], "line_no")
    got = [r.text for r in lines.orderBy("line_no").collect()]
    assert got == [f"a.txt {i}" for i in range(500)] + [f"b.txt {i}" for i in range(300)]


def test_empty_file(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    assert L.read_lines(spark, str(tmp_path)).count() == 0


def test_line_and_split_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "sent_id int, text string, split string")
    L.write_lines(df, str(tmp_path / "t"))
    assert sorted(r.text for r in L.read_lines(spark, str(tmp_path / "t")).collect()) == ["a", "b"]
    L.write_split(df, str(tmp_path / "s"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "s/split=test")).collect()] == ["b"]


def test_bad_bytes_are_dropped_as_python_drops_them(spark, tmp_path):
    rng = random.Random(9)
    parts = [b"a", b"\xc3", b"\xe2\x82", b"\xe2\x82\xac", b"\xff", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\xef\xbf\xbd", b"\xc3\xa9", b" "]
    lines = [b"".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    (tmp_path / "in.txt").write_bytes(b"\n".join(lines) + b"\n")
    got = [r.text for r in L.read_in_order(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [x.decode("utf-8", "ignore") for x in lines]


def test_ordered_sinks_give_the_order_back(spark, tmp_path):
    rows = [(i, f"line {i}", "train" if i % 4 else "test") for i in range(2000)] + [(5000, None, "train"), (4000, "", "test")]
    df = spark.createDataFrame(rows, "sent_id bigint, text string, split string").repartition(7)
    L.write_lines(df, str(tmp_path / "all"), order="sent_id")
    got = [r.text for r in L.read_in_order(spark, str(tmp_path / "all")).orderBy("line_no").collect()]
    assert got == [t for _, t, _ in sorted(rows, key=lambda r: r[0]) if t is not None]
    files = sorted((tmp_path / "all").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "".join(t + "\n" for t in got)
    L.write_split_lines(df, str(tmp_path / "parts"), "sent_id")
    for split in ("train", "test"):
        got = [r.text for r in L.read_in_order(spark, str(tmp_path / f"parts/split={split}")).orderBy("line_no").collect()]
        assert got == [t for _, t, s in sorted(rows, key=lambda r: r[0]) if s == split and t is not None]


def test_encoder_artifact_refuses_what_does_not_match(spark, tmp_path):
    from sentspark.sources.encoder import load_encoder, save_encoder

    path = str(tmp_path / "encoder")
    vectors = spark.createDataFrame([(5, [0.5, 1.0]), (6, [0.25, 0.0])], "token int, vector array<float>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id int")
    save_encoder(path, vectors, vocab, dim=2, seed=1)
    got, words, settings = load_encoder(spark, path, dim=2)
    assert sorted(map(tuple, words.collect())) == [("a", 5), ("b", 6)] and settings == {"dim": 2, "seed": 1}
    assert sorted((r.token, tuple(r.vector)) for r in got.collect()) == [(5, (0.5, 1.0)), (6, (0.25, 0.0))]
    with pytest.raises(ValueError, match="made with"):
        load_encoder(spark, path, dim=3)
    vectors.limit(1).write.mode("overwrite").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="not the table"):
        load_encoder(spark, path)
    spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError, match="incomplete"):
        load_encoder(spark, path)


def test_small_inputs_are_spread_and_large_ones_left(spark):
    cores = spark.sparkContext.defaultParallelism
    assert L.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    assert L.spread(spark.range(0, 100, 1, 40)).rdd.getNumPartitions() == 40
    assert L.spread(spark.range(0, 100, 1, 1), most=100).rdd.getNumPartitions() == 1
