"""Attributions, encodings, spans, dominance and tuning against brute force and hand-made cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from orrery.operators import calibrate, encode, explain, geo, policy, scheduling


def shapley(value, m):
    """Shapley values by all orders of the players."""
    out = np.zeros(m)
    for order in itertools.permutations(range(m)):
        known = frozenset()
        for j in order:
            out[j] += value(known | {j}) - value(known)
            known |= {j}
    return out / math.factorial(m)


def test_walks_match_all_orders_and_add_up():
    draw = np.random.default_rng(3)
    f = lambda x: np.tanh(x[:, 0] * x[:, 1] * x[:, 2]) + x[:, 2] * x[:, 0]
    rows, ground = draw.normal(size=(4, 3)), draw.normal(size=(5, 3))
    orders = [np.array(o) for o in itertools.permutations(range(3))]
    got = explain.walk_values(f, rows, ground, orders)
    for x, v in zip(rows, got):
        want = shapley(lambda known: f(np.where([j in known for j in range(3)], x, ground)).mean(), 3)
        assert np.allclose(v, want)
    once = explain.walk_values(f, rows, ground, orders[:1])
    assert np.allclose(once.sum(axis=1), f(rows) - f(ground).mean()) and not np.allclose(once, got)
    pairs = lambda x: np.tanh(x[:, 0] * x[:, 1]) + x[:, 2] * x[:, 0]
    # An order and its reverse settle whatever only two columns do together.
    assert np.allclose(explain.walk_values(pairs, rows, ground, orders[:1]), explain.walk_values(pairs, rows, ground, orders))


def test_tree_values_match_brute_force(spark):
    draw = np.random.default_rng(7)
    x = draw.integers(0, 6, size=(300, 4)).astype(float)
    y = ((x[:, 0] * x[:, 1] > 6) ^ (x[:, 2] > 3)).astype(int)
    df = spark.createDataFrame([("f", i, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], "fold_id string, id long, label int, a double, b double, c double, d double")
    used = ["a", "b", "c", "d"]
    model = calibrate.boosted_model(df, used, rounds=4)
    got = {(r["id"], r["feature"]): r for r in explain.tree_attributions(model, df, "fold_id", used).collect()}
    raw = {r["id"]: r["rawPrediction"][1] for r in model.transform(VectorAssembler(inputCols=used, outputCol="_x").transform(df)).collect()}
    assert len(got) == 1200

    def expected(node, row, known):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        left, right = node.leftChild(), node.rightChild()
        if split.featureIndex() in known:
            return expected(left if row[split.featureIndex()] <= split.threshold() else right, row, known)
        a, b = left.impurityStats().count(), right.impurityStats().count()
        return (a * expected(left, row, known) + b * expected(right, row, known)) / (a + b)

    roots = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]
    for i in (0, 17, 101):
        want = shapley(lambda known: sum(w * expected(n, x[i], known) for w, n in roots), 4)
        assert np.allclose([got[i, f]["value"] for f in used], want)
    for i, margin in raw.items():
        assert math.isclose(got[i, "a"]["base"] + sum(got[i, f]["value"] for f in used), margin, abs_tol=1e-9)


def test_sample_does_not_depend_on_order_or_other_columns(spark):
    df = spark.range(500).select(F.lit("f").alias("cell"), "id", F.rand(1).alias("label"))
    draw = lambda d, n=20, seed=5: {r["id"] for r in explain.seeded_sample(d, ["cell"], n, seed).collect()}
    one = draw(df)
    assert len(one) == 20 and one == draw(df.repartition(7).withColumn("label", F.lit(0.0))) and one != draw(df, seed=6)
    assert len(draw(df, 900)) == 500 and not draw(df.limit(0))
    with pytest.raises(ValueError):
        explain.seeded_sample(df, ["cell"], 0, 1)


def test_codes_of_unseen_and_null_categories(spark):
    train = spark.createDataFrame([("f", "b", None), ("f", "a", "x"), ("f", "b", "x"), ("g", "z", None)], "cell string, p string, q string")
    vocab = encode.vocabulary(train, ["cell"], ["p", "q"])
    assert {tuple(r) for r in vocab.collect()} == {("f", "p", "a", 1), ("f", "p", "b", 2), ("f", "q", "x", 1), ("g", "p", "z", 1)}
    rows = spark.createDataFrame([(1, "f", "b", "x"), (2, "f", "new", None), (3, "g", "z", "x"), (4, "h", "a", "x")], "id int, cell string, p string, q string")
    coded = encode.codes(rows, ["cell"], ["p", "q"], vocab)
    hot = {r["id"]: (r["code_p"], r["code_q"], r["ones"], r["width"]) for r in encode.one_hot(coded, ["cell"], ["p", "q"], vocab).collect()}
    assert hot == {1: (2, 1, [2, 4], 5), 2: (0, 0, [0, 3], 5), 3: (1, 0, [1, 2], 3), 4: (0, 0, [0, 1], 2)}
    rates = {(r["cell"], r["column"]): r["rate"] for r in encode.unseen_rate(coded, ["cell"], ["p", "q"]).collect()}
    assert rates == {("f", "p"): 0.5, ("f", "q"): 0.5, ("g", "p"): 0.0, ("g", "q"): 1.0, ("h", "p"): 1.0, ("h", "q"): 1.0}
    donor = spark.createDataFrame([("f", 0, [9.0, 9.0]), ("f", 2, [1.0, 2.0])], "cell string, code int, vector array<double>")
    found = {r["id"]: (r["p_emb_00"], r["p_emb_01"]) for r in encode.looked_up(coded, ["cell"], "p", donor, 2).collect()}
    assert found == {1: (1.0, 2.0), 2: (9.0, 9.0), 3: (None, None), 4: (None, None)}
    assert encode.codes(rows.limit(0), ["cell"], ["p"], vocab).count() == 0


def test_spans_over_tiles_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(geo, "TILE", 16)
    draw = np.random.default_rng(1)
    places = [("big", 41 + float(a), -87 - float(b)) for a, b in draw.random((120, 2))]
    places += places[:30] + [("one", 41.0, -87.0)] + [("same", 40.0, -80.0)] * 3
    got = {r["g"]: r for r in geo.group_spans(spark.createDataFrame(places, "g string, lat double, lon double"), "g").collect()}

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))

    pairs = [km(a, b) for a, b in itertools.combinations([p for p in places if p[0] == "big"], 2)]
    assert got["big"]["n"] == 150 and math.isclose(got["big"]["max_km"], max(pairs)) and math.isclose(got["big"]["avg_km"], sum(pairs) / len(pairs))
    assert [got[g][c] for g in ("one", "same") for c in ("max_km", "avg_km")] == [0.0] * 4


def test_dominance_names_who_beats_whom(spark):
    points = spark.createDataFrame([("k", "a", 5, 1), ("k", "b", 4, 1), ("k", "c", 3, 3), ("k", "d", 3, 1), ("l", "a", 2, 2), ("l", "b", 1, 1), ("m", "a", 1, 1), ("m", "b", 1, 1)], "k string, p string, x int, y int")
    got = {(r["k"], r["p"]): (r["dominated_by"], r["winner"]) for r in policy.dominance(points, ["k"], "p", ["x", "y"]).collect()}
    assert got == {("k", "a"): ("", None), ("k", "b"): ("a", None), ("k", "c"): ("", None), ("k", "d"): ("a, b, c", None), ("l", "a"): ("", "a"), ("l", "b"): ("a", "a"), ("m", "a"): ("", None), ("m", "b"): ("", None)}


def test_tied_rates_go_to_the_baseline(spark):
    best = lambda rows: [tuple(r) for r in calibrate.choose_rate(spark.createDataFrame(rows, "rate double, fold string, score double"), 0.5).collect()]
    assert best([(4.0, "a", 0.5), (1.0, "a", 0.5), (0.5, "a", 0.4)]) == [(1.0, 0.5, 2)]
    # 0.25 and 0.75 are exact in binary, so both are equally far from the baseline.
    assert best([(0.75, "a", 0.5), (0.25, "a", 0.5)])[0][0] == 0.25 and best([]) == []


def test_service_of_a_plan(spark):
    plan = spark.createDataFrame([("a", 1, 1, 1, "scheduled"), ("a", 2, 2, 3, "scheduled"), ("a", 3, 3, None, "backlog"), ("b", 4, 1, None, "backlog")], "cell string, id int, final_rank int, day_index int, status string")
    queue = spark.createDataFrame([("a", 1, "risk_priority"), ("a", 2, "coverage_reserve"), ("a", 3, "coverage_reserve"), ("b", 4, "risk_priority")], "cell string, id int, mechanism string")
    a, b = scheduling.service(plan, queue, ["cell"]).orderBy("cell").collect()
    assert (a["mean_wait"], a["max_wait"], a["worst_scheduled_rank"], a["best_backlogged_rank"], a["reserve_slots_lost"]) == (1.0, 2, 2, 3, 1)
    assert math.isclose(a["reserve_share_delta"], 1 / 2 - 2 / 3) and (b["mean_wait"], b["queue_coverage"], b["reserve_share_delta"]) == (None, 0.0, 0.0)
