"""Pairs are formed and judged for units of equal rows, and no pair of rows is shuffled or stored."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import entity
from orrery.operators.graph import connected_components
from orrery.plans import catalogue

from .conftest import SF

KEYS = ["licence", "address", "geo"]


@pytest.mark.parametrize("name", ["block_pairs", "pair_signals", "pair_verdicts"])
def test_no_pair_of_rows_is_shuffled(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Generate" in above


def crowd(spark, monkeypatch, n=300):
    monkeypatch.setattr(entity, "MOST_IDS", 64)
    monkeypatch.setattr(entity, "TILE", 3)
    p = catalogue._places(spark, SF)
    one = p.where("id = 7").drop("id").crossJoin(spark.range(10_000, 10_000 + n))
    return p.unionByName(one.select(p.columns))


def test_links_of_equal_rows_stay_few(spark, monkeypatch):
    rows = crowd(spark, monkeypatch).cache()
    pairs = entity.block_pairs(rows, KEYS, None)[0].cache()
    assert pairs.count() == pairs.distinct().count() >= 300 * 299 // 2
    plain = entity.verdicts(pairs, rows).cache()
    assert plain.exceptAll(entity.block_verdicts(rows, KEYS)).isEmpty() and plain.count() == pairs.count()
    links = entity.block_links(rows, KEYS).cache()
    assert links.count() < 3 * rows.count()
    for kind in ("linked", "strong"):
        parts = lambda e: sorted(map(tuple, connected_components(e.where(kind), "a", "b").collect()))  # noqa: B023, E731
        assert parts(links) == parts(plain)
    probable = lambda e: {r[0] for r in e.where("linked and not strong").select(F.explode(F.array("a", "b"))).collect()}
    assert probable(links) == probable(plain)
