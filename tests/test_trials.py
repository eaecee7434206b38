"""The entries on the trials of a sweep, against plain Python over the same trials."""

from sentspark.catalog import QUERIES, load

SF = "/root/testdata/sf0.001"


def test_best_trial_and_running_best_on_trials(spark):
    load()
    trials = QUERIES["sweep_trials"](spark, SF).collect()
    assert len(trials) == 8 and all(len(t.intermediate_values) >= 2 for t in trials)
    complete = [t for t in trials if t.value is not None]
    assert all(t.value == min(v for v in t.intermediate_values.values() if v is not None) for t in complete)
    best = QUERIES["sweep_best_trial"](spark, SF).collect()
    want = min(complete, key=lambda t: (t.value, t.trial_number), default=None)
    assert [b.trial_number for b in best] == ([] if want is None else [want.trial_number])
    got = {(r.trial_number, r.epoch): r.best for r in QUERIES["sweep_running_best"](spark, SF).collect()}
    for t in trials:
        so_far = []
        for epoch in sorted(t.intermediate_values):
            if t.intermediate_values[epoch] is not None:
                so_far.append(t.intermediate_values[epoch])
            assert got.pop((t.trial_number, epoch)) == min(so_far, default=None)
    assert not got
