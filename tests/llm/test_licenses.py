"""License scan: whole texts, against plain windows over plain shingles."""

import random

import pytest

from sentspark.llm import licenses as L

MARKS = str.maketrans("", "", L._MARKS)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text.translate(MARKS)).split()
    return [tuple(words[i : i + L.SHINGLE]) for i in range(len(words) - L.SHINGLE + 1)]


def plain(rows, templates):
    best = {}
    for doc_id, text in rows:
        own = shingles(text or "")
        for name, body in templates.items():
            wanted = set(shingles(body))
            s = len(wanted)
            if not s:
                continue
            step = max(1, s // 4)
            for p in range(0, len(own), step):
                share = len(wanted & set(own[p : p + s + step - 1])) / s
                if share >= L.CONTAINMENT:
                    key = (doc_id, name)
                    best[key] = max(best.get(key, (0, 0)), (share, -p))
    return sorted((d, n, c, -p) for (d, n), (c, p) in best.items())


def found(spark, rows, templates):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # other columns, of names that the scan uses itself, do not matter
    docs = docs.selectExpr("*", "1 as row", "2 as shingles", "'x' as license", "0 as p")
    return sorted(tuple(r) for r in L.license_matches(docs, templates).collect())


def test_every_known_text_is_found_whole_and_worn(spark):
    rng = random.Random(7)
    noise = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(0, None), (1, ""), (2, "the software"), (3, noise(3000))]
    for k, body in enumerate(L.TEMPLATES.values()):
        rows.append((10 + k, f"{noise(k)}\n{body}\n{noise(50)}"))
        worn = body.split()
        worn[len(worn) // 2] = "changed"
        rows.append((100 + k, f"{noise(3 * k)} {' '.join(worn)}"))
        # half of it is no match of the whole text
        rows.append((200 + k, " ".join(body.split()[: len(worn) // 2])))
    # twice in a very long text, and rows of one id
    body = L.TEMPLATES["MIT text"]
    rows += [(300, f"{noise(20_000)} {body} {noise(400)} {body}"), (301, body), (301, body)]
    got = found(spark, rows, None)
    assert got == plain(rows, L.TEMPLATES)
    whole = {(d, n) for d, n, c, _ in got if c == 1.0}
    assert {(10 + k, n) for k, n in enumerate(L.TEMPLATES)} <= whole


def test_templates_of_one_length_long_ones_and_ties(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(40)]
    templates = {f"long {k}": " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(3000)) for k in range(2)}
    templates |= {"a": "one two three four five six", "b": "one two three four five seven", "same": "one two three four five six", "short": "one two"}
    rows = [(1, templates["long 0"]), (2, "x y z " + " ".join(templates["long 1"].split()[:2700])), (3, "one two three four five six one two three four five seven")]
    got = found(spark, rows, templates)
    assert got == plain(rows, templates)
    assert [(d, n) for d, n, _, _ in got] == [(1, "long 0"), (2, "long 1"), (3, "a"), (3, "b"), (3, "same")]


def test_bounds_of_the_template_table(spark, monkeypatch):
    assert found(spark, [(1, "one two three four five")], {}) == []
    monkeypatch.setattr(L, "SHINGLES_MOST", 5)
    with pytest.raises(ValueError):
        L.template_table(spark, {"a": "one two three four five six"})
