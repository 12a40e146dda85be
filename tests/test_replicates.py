from cadenza.plans.registry import QUERIES


def test_registered_replicates(spark, data, monkeypatch):
    from cadenza.operators import models

    seen = {}
    for name, place in (("permutation_p", 5), ("bootstrap_ci", 5), ("split_half_stability", 6)):
        monkeypatch.setattr(models, name, lambda *a, name=name, place=place: seen.setdefault(name, a[place]))
    for query in ("l6_permutation_p", "l7_bootstrap_ci", "l17_split_half"):
        QUERIES[query].make(spark, data)
    assert seen == {"permutation_p": 1000, "bootstrap_ci": 500, "split_half_stability": 50}
