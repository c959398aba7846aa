"""Interpolation in runs: right across runs and at odd values, without a frame that shrinks."""

import math

import numpy as np

from orrery.functions import numbers


def test_interpolation_across_runs(spark):
    rng = np.random.default_rng(4)
    px = sorted(set(np.round(rng.random(12), 2).tolist()))
    py = np.cumsum(rng.random(len(px))).tolist()
    xs = [*np.round(rng.random(400) * 1.4 - 0.2, 3).tolist(), *px, float("inf"), float("-inf"), float("nan"), None]
    rows = spark.createDataFrame([("c", x) for x in xs] + [("none", 0.5)], "cell string, x double")
    points = spark.createDataFrame([("c", a, b) for a, b in zip(px, py)], "cell string, px double, py double")
    got = numbers.interpolate(rows, points, "x").collect()
    assert len(got) == len(xs) + 1
    for r in got:
        if r.cell == "none" or r.x is None:
            assert r.value is None
        else:
            want = py[-1] if math.isnan(r.x) else float(np.interp(r.x, px, py))
            assert abs(r.value - want) < 1e-9, r


def test_interpolation_reads_no_frame_anew(spark):
    rows = spark.createDataFrame([("c", 0.5)], "cell string, x double")
    points = spark.createDataFrame([("c", 0.0, 1.0)], "cell string, px double, py double")
    plan = numbers.interpolate(rows, points, "x")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
