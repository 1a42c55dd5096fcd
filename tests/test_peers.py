"""Peers of hits stay in one task: pairs are neither written nor shuffled."""

from skyquilt import catalog
from skyquilt.plans import search


def test_pairs_of_peers_are_not_dealt_again(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("pairs are written")

    monkeypatch.setattr(search, "cut", refused)
    rows = catalog.QUERIES["change_evidence"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # tiles by number and by cell, hits by cell, results by customer and by number
    assert plan.count("Exchange hashpartitioning") <= 5 and rows.count() == 1500


def test_landmarks_are_sent_in_small_tables():
    from skyquilt.operators import nearest

    sizes = [len(part) for part in nearest.sent(((i, [0.0]) for i in range(100)), ["block", "lon"])]
    assert sum(sizes) == 100 and max(sizes) == nearest.SENT
