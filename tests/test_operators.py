"""Hand-computed cases, leakage and shuffle tests, and sources."""

import datetime as dt
import urllib.error

import pytest
from pyspark.sql import functions as F

from orrery.operators import asof, policy, scheduling
from orrery.operators.graph import connected_components
from orrery.sources import paged
from orrery.sources.tables import append_staged, inspections, pending

from .conftest import SF


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 140)) and got[200] == 200 and len(got) == 101
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_future_rows_change_nothing(spark):
    i = inspections(spark, SF)
    t = i.where("d < '1998-01-01'").select(F.col("inspection_id").alias("target_id"), "establishment_id", F.col("d").alias("t"), F.col("name").alias("current_name"))
    now = asof.features(t, i.where("d < '1998-01-01'"), "1996-07-01")
    later = asof.features(t, i.orderBy(F.rand(1)), "1996-07-01")
    assert now.exceptAll(later).count() == 0 and later.exceptAll(now).count() == 0


def test_reserve_by_hand(spark):
    rows = [("a", i, 1.0 - i / 10, 0, i in (5, 6), 4) for i in range(8)]
    df = spark.createDataFrame(rows, "cell string, id int, score double, label int, eligible boolean, k int")
    got = {r.id: r.reason for r in policy.allocate(df, ["cell"], F.lit(0.5), F.lit(False)).collect()}
    assert sorted(i for i, r in got.items() if r == "selected_by_coverage_reserve") == [5, 6]
    assert sorted(i for i, r in got.items() if r == "not_selected_capacity_exhausted") == [2, 3, 4, 7]


def test_fill_and_backlog(spark):
    q = spark.createDataFrame([("a", i, i) for i in range(1, 8)], "cell string, id int, final_rank int")
    days = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1, 0, 2), ("a", dt.date(2024, 1, 2), 2, 2, 3)], "cell string, slot_date date, day_index int, slots_before int, n_slots int")
    got = {r.id: (r.day_index, r.slot_index, r.status) for r in scheduling.fill(q, days, ["cell"]).collect()}
    assert got[2] == (1, 2, "scheduled") and got[5] == (2, 3, "scheduled") and got[6] == (None, None, "backlog")


def test_paging_retries():
    calls, slept = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        return b"[]"

    assert paged.fetch("u", get=get, sleep=slept.append) == b"[]" and slept == [1.0, 2.0]
    with pytest.raises(ValueError):
        paged.page_params(10, 0, "")


def test_staged_log_refuses_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, what string")
    path = f"file://{tmp_path}/staged"
    append_staged(rows, path, "id")
    with pytest.raises(ValueError):
        append_staged(rows.limit(1), path, "id")
    assert pending(spark.read.schema(rows.schema).json(path), rows.where("id = 'a'"), "id").count() == 1
