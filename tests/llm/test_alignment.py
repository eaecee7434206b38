"""Alignment against the public libraries and a plain comparison of all token pairs."""

import hashlib
import random
from collections import Counter

import pytest


def _texts():
    rng = random.Random(11)
    parts = [
        "the", "internationalization", " ", "  ", "\n", "\t", "Übergröße", "日本語", "\U0001f600", "é", "'s", "1234",
        "▁", "<|endoftext|>", "<s>", "<0x41>", "\x00", " ", "...", "a", "\r\n", "مرحبا", "ﬁ",
    ]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    long = " ".join(rng.choice(["alignment", "tokens", "über", "日本"]) for _ in range(3000))
    return [None, "", " ", "  lead", "trail  ", "x" * 3000, "é" * 2000, long, long, "a▁b", *some]


def _brute(texts):
    import public_tokenizers as tokenizers_of
    import sentencepiece
    from tokenizers import Tokenizer

    from sentspark.llm.packing import byte_alphabet

    a_model = Tokenizer.from_file(str(tokenizers_of.path("byte_bpe_50k.json")))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=str(tokenizers_of.path("piece_bpe_32k.model")))
    letters = byte_alphabet()

    def piece(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        text = text or ""
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        size_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        size_b = [piece(i) for i in b]
        whole = (" " + text).encode()
        if not text or b"".join(size_a) != whole or b"".join(size_b) != whole:
            a, b, size_a, size_b = [], [], [], []
        spans = []
        for sizes in (size_a, size_b):
            at, out = 0, []
            for s in sizes:
                out.append((at, at + len(s)))
                at += len(s)
            spans.append(out)
        first = 0
        links = []
        for i, (x, y) in enumerate(spans[0]):
            while first < len(b) and spans[1][first][1] <= x:
                first += 1
            j = first
            while j < len(b) and spans[1][j][0] < y:
                links.append((i, j))
                j += 1
        counts.update((a[i], b[j]) for i, j in links)
        common = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        groups, i, j = [], 0, 0
        for c in common:
            ga, gb = [], []
            while i < len(a) and spans[0][i][1] <= c:
                ga.append(a[i])
                i += 1
            while j < len(b) and spans[1][j][1] <= c:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        rows.append((a, b, groups, links))
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for a, b, groups, links in rows:
        seen = [(counts[a[i], b[j]], b[j]) for i, j in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(n == highest[y] for n, y in seen), sum(n for n, _ in seen), sha))
    return out, rows


@pytest.mark.parametrize("block", [8 << 20, 5000])
def test_report_equals_brute_force(spark, monkeypatch, block):
    from sentspark.llm import alignment

    texts = _texts()
    want, _ = _brute(texts)
    ids = [None if i == 7 else i for i in range(len(texts))]
    rows = [(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair string").repartition(4)
    monkeypatch.setattr(alignment, "BLOCK", block)
    got = [tuple(r) for r in alignment.alignment_report(docs, alignment.byte_vocabulary(), alignment.piece_model()).collect()]
    assert sorted(got, key=str) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=str)
    assert sum(w[2] > 0 for w in want) > 100 and any(w[0] == 0 for w in want[9:])


def test_aligned_tokens_and_empty_table(spark):
    from sentspark.llm import alignment

    texts = _texts()[:60]
    _, rows = _brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.aligned_tokens(docs, alignment.byte_vocabulary(), alignment.piece_model()).collect():
        a, b, groups, links = rows[r.doc_id]
        assert (r.a_ids, r.b_ids) == (a, b)
        assert list(zip(r.links_a, r.links_b, strict=True)) == links
        assert len(r.a_ends) == len(r.b_ends) == len(groups)
        assert not a or (r.a_ends[-1], r.b_ends[-1]) == (len(a), len(b))
    none = alignment.alignment_report(docs.limit(0), alignment.byte_vocabulary(), alignment.piece_model())
    assert none.count() == 0


def test_pieces_of_words_equal_the_library():
    from sentspark.llm import alignment

    known = alignment.pieces(alignment.piece_model())
    for text in _texts():
        text = text or ""
        if text and "▁" not in text:  # written like a space, which no result depends on
            assert next(known.encode([" " + text])).tolist() == known.model.encode(text), text
