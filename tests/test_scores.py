"""Scores that only have to pass a bound, or that repeat, are not worked out in full each time."""

from __future__ import annotations

import pandas as pd

from tallyloom.operators import channels, recurring, similarity

NOTES = ["", "a", "ab", "swiggy order", "order swiggy", "swigy ordr", "xx swiggy order no 7 yy", "rent of flat", "rent flat of b", "instalment of the yearly premium", "yearly premium of the instalment x", "acme traders and sons"]


def test_fuzzy_at_least_is_fuzzy_with_a_bound():
    for a in NOTES:
        for b in NOTES:
            for least in (0, 50, 75, 90, 100):
                assert similarity.fuzzy_at_least(a, b, least) == (similarity.fuzzy(a, b) >= least)


def test_alike_tries_no_runs_where_none_can_do(monkeypatch):
    def none(a, b):
        raise AssertionError((a, b))

    monkeypatch.setattr(similarity, "partial", none)
    assert not recurring.alike(90.0)(("upi", "rent of flat", ""), ("upi", "acme traders and sons", ""))


def test_a_pair_of_names_is_scored_once_a_batch(monkeypatch):
    seen, whole = [], similarity.weighted
    monkeypatch.setattr(similarity, "weighted", lambda a, b: seen.append((a, b)) or whole(a, b))
    got = channels._near.func(pd.Series(["ann lee", "acme", None, ""] * 500), pd.Series(["anne lee", "pay bob", "x", "y"] * 500))
    assert sorted(seen) == [("acme", "pay bob"), ("ann lee", "anne lee")] and got.tolist() == [True, False, False, False] * 500
