"""Personal data against plain regular expressions over random texts, and on its edge cases."""

import hashlib
import random
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(x):
    return re.sub("[^0-9]", "", x)


def _luhn(x):
    d = [int(c) for c in x][::-1]
    return sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(d)) % 10 == 0


def base_spans(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [
        ("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p or 0) <= 255 for p in m.group().split("."))
    ]
    out += [
        ("card", m.start(), m.end())
        for m in CARD.finditer(text)
        if 14 <= len(_digits(m.group())) <= 19 and _luhn(_digits(m.group()))
    ]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def _texts():
    rng = random.Random(7)
    pieces = [
        "a", "Zé", "1", "12", "255", "256", "0004", ".", ".", "..", "@", "@", "-", " ", "+", "+1", "(", ")", "%", "_",
        "b.c", "x@y.de", "10.0.0.1", "4111111111111111", "4111 1111-1111 1111", "378282246310005", "+49 (30) 555-1234567",
        "日", "\U0001f600", "\n", "://", "http", "token = ", "IBAN ", "account", "9" * 20,
    ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(6000)]


def test_base_kinds_equal_the_plain_patterns():
    from sentspark.llm import personal

    seen = set()
    for text in _texts():
        got = [(personal.KINDS[k], a, b) for a, k, b in personal.spans(text) if k < 4]
        assert got == base_spans(text), text
        seen |= {k for k, _, _ in got}
    assert seen == {"email", "ip", "card", "phone"}


def test_added_kinds():
    from sentspark.llm import personal

    text = 'see https://me@host.example/a?b=1. then IBAN: DE89 3704 0044 0532 0130 00, token = "ab12cd34" tokens 77'
    found = [(personal.KINDS[k], text[a:b]) for a, k, b in personal.spans(text)]
    assert ("url", "https://me@host.example/a?b=1") in found
    assert ("account", "DE89 3704 0044 0532 0130 00") in found
    assert ("account", "ab12cd34") in found
    assert ("email", "me@host.example") in found
    assert personal.spans("IBAN DE88370400440532013000 account opened today, a token of thanks") == []
    assert personal.redacted("to a@b.co or token: zz99zz99!") == "to [EMAIL] or token: [ACCOUNT]!"


def test_long_texts_take_linear_time():
    from sentspark.llm import personal

    for text in ("1" * 2_000_000, "a" * 1_000_000 + "@", "a@" * 300_000, "+1(" * 300_000, "1 " * 500_000):
        assert [x for x in personal.spans(text) if x[1] < 4] == []
    dotted = "1.2" * 500_000
    assert [(a, b) for a, _, b in personal.spans(dotted)] == [m.span() for m in IP.finditer(dotted)]


def test_report_and_redaction_of_edge_rows(spark):
    from sentspark.llm import personal

    texts = [None, "", " ", "mail a.b@c.de now", "mail a.b@c.de now", "日本 10.1.2.3 +1 (017) 555-7713", "x" * 100_000 + " u@v.w"]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "c@d.ef", None, None), (3, "mail a.b@c.de now", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int").repartition(3)
    got = sorted((tuple(r) for r in personal.personal_report(docs).collect()), key=str)
    want = []
    for d, t, _, _ in rows:
        base = base_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(s[0] == k for s in base) for k in personal.BASE]
        want.append((d, *counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert got == sorted(want, key=str)
    clean = personal.redact(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()}[5] == "日本 [IP] [PHONE]"
    assert {r.doc_id: r.text for r in clean.collect()}[0] is None
    assert personal.personal_report(docs.limit(0)).count() == 0
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in personal.personal_spans(docs).collect()}
    assert kinds[5] == ["ip", "phone"] and kinds[1] == []
