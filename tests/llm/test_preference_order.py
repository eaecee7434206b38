"""Pairs by the order of conversations, and pairs that diverge early."""


def test_every_conversation_with_a_reply_makes_a_pair(spark):
    from sentspark.llm import preference

    ids = [3, 10, 11, 500, 1 << 40]
    rows = [(c, 0, "user", f"q{c}") for c in [*ids, 12]] + [(c, 1, "assistant", f"a{c}") for c in ids]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    talks = preference.conversations(turns)
    out = {r.conv_id: r for r in preference.preference_examples(preference.next_replies(talks)).collect()}
    assert sorted(out) == ids
    for c, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        assert out[c].n_prompt_turns == 1 and out[c].prompt == f"<|user|>\nq{c}<|end|>\n"
        assert out[c].chosen == f"<|assistant|>\na{c}<|end|>\n" and out[c].rejected == f"<|assistant|>\na{after}<|end|>\n"
    assert preference.next_replies(talks.filter("conv_id = 3")).count() == 0


def test_pairs_that_diverge_in_an_early_turn(spark):
    from sentspark.llm import preference

    pairs = spark.createDataFrame(
        [(1, [("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "x"), ("user", "c"), ("assistant", "d")])],
        "conv_id long, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>",
    )
    r = preference.preference_examples(pairs).first()
    assert r.n_prompt_turns == 1 and r.prompt == "<|user|>\na<|end|>\n"
    assert r.chosen == "<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert r.rejected == "<|assistant|>\nx<|end|>\n<|user|>\nc<|end|>\n<|assistant|>\nd<|end|>\n"
    assert r.chosen_mask.count("1") == len("b<|end|>\n") and r.rejected_mask.count("1") == len("xd<|end|>\n<|end|>\n")


def test_replaced_turns_part_early_and_late_and_lose_no_conversation(spark):
    from sentspark.llm import preference

    rows = []
    for c in (-3, 4, 9, 20):
        for k in range(3):
            rows += [(c, 2 * k, "user", f"q{c}.{k}", 1), (c, 2 * k + 1, "assistant", f"a{c}.{k}", 1)]
        rows.append((c, 6, "user", "last", 1))
    rows += [(7, 0, "user", "no reply", 1), (None, 0, "assistant", "lost", 1), (4, 0, "user", "q4.0", 1), (30, 0, "assistant", "x" * 50_000, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen int")
    out = {r.conv_id: r for r in preference.preference_examples(preference.replaced_turns(preference.conversations(turns))).collect()}
    assert sorted(out) == [-3, 4, 9, 20, 30]
    assert {c: r.n_prompt_turns for c, r in out.items()} == {-3: 1, 4: 3, 9: 1, 20: 5, 30: 0}
    assert "a9.2" in out[4].rejected and "a4.1" in out[4].chosen and out[4].chosen.endswith("last<|end|>\n")
    assert "a-3.2" in out[30].rejected and len(out[20].rejected) > 50_000
    assert preference.replaced_turns(preference.conversations(turns.limit(0))).count() == 0
    only = preference.replaced_turns(preference.conversations(turns.filter("conv_id = 9")))
    assert only.count() == 0
