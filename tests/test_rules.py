"""Contracts, order-dependent rules, models and sources against hand-made or plain cases."""

import datetime as dt
import http.server
import json
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import numbers, text
from orrery.operators import calibrate, contracts, entity, governance, operational, policy, scheduling
from orrery.operators.running import by_risk, running, score_run
from orrery.sources import paged, tables


def test_refusals(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.4, 0)], "id int, score double, label int")
    for bad in (lambda: contracts.refuse_outcomes(df), lambda: contracts.refuse_duplicates(df, ["id"]), lambda: contracts.scoped(df, {"id": None}, ["id"]), lambda: contracts.refuse_nulls(df.withColumn("x", F.lit(None)), ["x"])):
        with pytest.raises(contracts.ContractError):
            bad()
    assert contracts.refuse_outcomes(df.drop("label")).count() == 2 and contracts.scoped(df, {"id": 1, "score": None}, ["id"]).count() == 2
    with pytest.raises(KeyError):
        import __spark_entry__ as e

        e.run_named_query(spark, "no such query", "")


def decided(spark, rows):
    return spark.createDataFrame(rows, "cell string, id int, eligible boolean, k int, g int, model_rank int, mechanism string, reason string, is_selected boolean, final_rank int")


GOOD = [("a", 1, False, 2, 1, 1, "risk_priority", "selected_by_risk_rank", True, 1), ("a", 2, False, 2, 1, 2, "not_selected", "not_selected_capacity_exhausted", False, None), ("a", 3, True, 2, 1, 3, "coverage_reserve", "selected_by_coverage_reserve", True, 2), ("a", 4, True, 2, 1, 4, "not_selected", "not_selected_reserve_exhausted", False, None)]


def test_every_policy_check_finds_its_violation(spark):
    universe = spark.createDataFrame([("a", 4)], "cell string, n_universe long")
    found = lambda rows, n=4: {r[0] for r in contracts.violations(contracts.policy_violations(decided(spark, rows), universe.withColumn("n_universe", F.lit(n).cast("long")), ["cell"])).collect() if r[1]}
    assert not found(GOOD)
    change = lambda i, **c: [tuple(c.get(n, v) for n, v in zip(("cell", "id", "eligible", "k", "g", "model_rank", "mechanism", "reason", "is_selected", "final_rank"), r)) if j == i else r for j, r in enumerate(GOOD)]
    assert "cell_covers_universe" in found(GOOD, 5)
    assert "selected_is_capacity" in found(change(0, is_selected=False, final_rank=None))
    assert "mechanisms_add_up" in found(change(0, mechanism="not_selected"))
    assert "reserve_within_target_and_supply" in found(change(2, g=0) and [tuple(0 if n == 4 else v for n, v in enumerate(r)) for r in GOOD])
    assert "risk_is_the_best_ranks" in found(change(0, model_rank=9))
    assert "reserve_is_eligible" in found(change(2, eligible=False))
    assert "mechanism_fits_reason" in found(change(0, reason="selected_by_coverage_reserve"))
    assert "selected_by_a_selected_reason" in found(change(0, reason="not_selected_capacity_exhausted"))
    assert "ranks_unique_and_contiguous" in found(change(2, final_rank=3)) and "unselected_have_no_rank" in found(change(1, final_rank=7))
    assert "id_selected_once" in found(change(2, id=1))


def test_every_schedule_check_finds_its_violation(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 5)]
    plan = [("a", 1, "scheduled", d[0], 1), ("a", 2, "scheduled", d[0], 2), ("a", 3, "backlog", None, None)]
    days = [("a", d[0], 1, 2), ("a", d[1], 2, 1)]
    def found(p=plan, h=days, q=(1, 2, 3)):
        frame = spark.createDataFrame(p, "cell string, id int, status string, slot_date date, slot_index int")
        horizon = spark.createDataFrame(h, "cell string, slot_date date, day_index int, n_slots int")
        queue = spark.createDataFrame([("a", i) for i in q], "cell string, id int")
        return {r[0] for r in contracts.violations(contracts.schedule_violations(frame, horizon, queue, ["cell"])).collect() if r[1]}
    assert not found()
    assert "slot_taken_once" in found([*plan, ("a", 4, "scheduled", d[0], 1)]) and "id_in_one_slot" in found([*plan, ("a", 1, "scheduled", d[1], 1)])
    assert "day_within_capacity" in found([*plan, ("a", 4, "scheduled", d[3], 1)]) and "queue_is_accounted_for" in found(q=(1, 2, 3, 9))
    assert "days_contiguous" in found(h=[days[0], ("a", d[1], 3, 1)]) and "backlog_has_no_slot" in found([*plan, ("a", 4, "backlog", d[1], 1)]) and "status_is_known" in found([*plan, ("a", 4, "lost", None, None)])


def test_predictions_against_the_contract(spark):
    day = dt.date(2024, 1, 1)
    universe = spark.createDataFrame([("a", i, day) for i in range(1, 6)] + [("b", 1, day)], "cell string, id int, calibration_end date")
    p = spark.createDataFrame([("a", 1, 0.5, day), ("a", 2, float("nan"), day), ("a", 2, 0.1, day), ("a", 3, 1.5, day), ("a", 4, 0.2, dt.date(2024, 2, 1)), ("a", 9, 0.2, day), ("b", 1, None, day)], "cell string, id int, score double, trained_through date")
    got = {r.cell: tuple(r)[1:] for r in contracts.prediction_violations(p, universe, ["cell"]).collect()}
    # NaN sorts above every number, so it counts as no probability too
    assert got == {"a": (1, 1, 1, 1, 2, 1), "b": (0, 0, 0, 1, 0, 0)}


def test_running_positions_in_two_levels(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", i, float(round(s, 2)), int(y)) for i, (s, y) in enumerate(zip(rng.random(600), rng.integers(0, 2, 600)))]
    df = spark.createDataFrame(rows, "cell string, id int, score double, label int")
    got = {r.id: (r.pos, r.cum) for r in by_risk(df, ["cell"], {"cum": F.col("label")}).collect()}
    for cell in "ab":
        total = 0
        for n, (_, i, _, y) in enumerate(sorted((r for r in rows if r[0] == cell), key=lambda r: (-r[2], r[1])), 1):
            total += y
            assert got[i] == (n, total)
    assert running(df.limit(0), ["cell"], score_run("score"), [F.asc("id")], {}).count() == 0


def test_overrides_by_hand(spark):
    queue = [("a", 1, True, "risk_priority", 1), ("a", 2, True, "risk_priority", 2), ("a", 3, True, "coverage_reserve", 5), ("a", 4, False, "not_selected", 3), ("a", 5, False, "not_selected", 4), ("a", 6, False, "not_selected", 6)]
    said = [("a", "OV-3", "9", "force_include"), ("a", "OV-1", "4", "force_include"), ("a", "OV-2", "1", "force_exclude"), ("a", "OV-4", "5", "force_include"), ("a", "OV-5", "4", "force_include"), ("a", "OV-6", "2", "force_exclude")]
    out = governance.apply_overrides(spark.createDataFrame(queue, "cell string, id int, is_selected boolean, mechanism string, model_rank int"), spark.createDataFrame(said, "cell string, override_id string, target_id string, action string"), ["cell"])
    got = {r.override_id: (r.outcome, r.displaced_id) for r in out.collect()}
    # 4 displaces 2, the lowest risk row; 1 leaves a hole; then no risk row stands for 5.
    assert got == {"OV-1": ("applied", "2"), "OV-2": ("applied", None), "OV-3": ("not_in_queue", None), "OV-4": ("applied", None), "OV-5": ("already_selected", None), "OV-6": ("not_selected", None)}


def test_adjustments_by_hand(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    plan = [("a", 1, "scheduled", d[0], 1, 1, "risk_priority"), ("a", 2, "scheduled", d[0], 2, 2, "risk_priority"), ("a", 3, "scheduled", d[1], 1, 3, "risk_priority"), ("a", 4, "scheduled", d[1], 2, 4, "coverage_reserve"), ("a", 5, "backlog", None, None, 5, "risk_priority")]
    days = [("a", d[0], 2), ("a", d[1], 2), ("a", d[2], 1)]
    said = [("A1", 1, "defer_to_date", d[1]), ("A2", 3, "cancel", None), ("A3", 4, "defer_to_date", d[2]), ("A4", 2, "advance_to_date", d[2]), ("A5", 5, "defer_to_date", d[1]), ("A6", 9, "cancel", None), ("A7", 2, "defer_to_date", dt.date(2024, 2, 1)), ("A8", 2, "defer_to_date", d[2]), ("A9", 1, "defer_to_date", d[1])]
    out = governance.adjust(spark.createDataFrame(plan, "cell string, id int, status string, slot_date date, slot_index int, final_rank int, mechanism string"), spark.createDataFrame(days, "cell string, slot_date date, n_slots int"), spark.createDataFrame([("a", *s) for s in said], "cell string, adjustment_id string, id int, action string, target_date date"), ["cell"])
    got = {r.adjustment_id: (r.outcome, r.final_status, r.final_date, r.displaced_id) for r in out.collect()}
    assert got == {
        "A1": ("applied", "deferred", d[1], 3), "A2": ("applied", "cancelled", None, None), "A3": ("applied", "deferred", d[2], None), "A4": ("refused_direction", None, None, None), "A5": ("no_op_not_scheduled", "backlog", None, None),
        "A6": ("row_not_in_plan", None, None, None), "A7": ("refused_day", None, None, None), "A8": ("refused_full", None, None, None), "A9": ("no_op_already_on_date", "deferred", d[1], None),
    }


def test_nearest_order_by_hand(spark):
    rows = [("g", i, 41.0 + y, -87.0, r) for i, y, r in ((1, 0.0, 2), (2, 0.3, 1), (3, 0.31, 3), (4, -0.1, 4))]
    got = {r.id: r.visit for r in governance.nearest_order(spark.createDataFrame(rows, "area string, id int, lat double, lon double, final_rank int"), "area").collect()}
    assert got == {2: 1, 3: 2, 1: 3, 4: 4}


def test_backlog_and_versions(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 5)]
    plan = spark.createDataFrame([("a", i, i, None, "backlog") for i in (5, 6, 7, 8)], "cell string, id int, final_rank int, slot_date date, status string")
    days = spark.createDataFrame([("a", d[0], 4)], "cell string, slot_date date, n_slots int")
    cal = spark.createDataFrame([("a", d[0], 4), ("a", d[2], 1), ("a", d[3], 2)], "cell string, slot_date date, n_slots int")
    got = {r.id: (r.backlog_position, r.slots_short, r.would_fit_on_day_index, r.first_available_date) for r in scheduling.project_backlog(plan, days, cal, ["cell"], 8).collect()}
    assert got == {5: (1, 4, 2, d[2]), 6: (2, 4, 3, d[3]), 7: (3, 4, 3, d[3]), 8: (4, 4, None, None)}
    v = scheduling.versioned([plan, plan.where("id < 7")], ["original", "adjusted"])
    assert {r.id: (r.version, r.replan_index) for r in scheduling.latest(v, ["cell", "id"]).collect()} == {5: ("adjusted", 1), 6: ("adjusted", 1), 7: ("original", 0), 8: ("original", 0)}


def test_operational_selection_marks_and_refuses(spark):
    rows = spark.createDataFrame([(i, None if i == 4 else 1.0 - i / 10, i in (5, 6)) for i in range(8)], "k1 int, score double, eligible boolean")
    ranked = operational.ranked(rows, "k1")
    assert {r.k1: r.operational_rank for r in ranked.collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: None, 5: 5, 6: 6, 7: 7}
    got = {r.k1: (r.mechanism, r.policy_rank) for r in operational.select(ranked, "k1", 4, 0.5, False).collect()}
    assert got[4] == ("not_selected", None) and got[5] == ("coverage_reserve", 3) and got[6] == ("coverage_reserve", 4) and got[2] == ("not_selected", None)
    assert all(r.mechanism == "not_selected" for r in operational.select(ranked, "k1", 0, 0.5, False).collect())
    with pytest.raises(contracts.ContractError):
        operational.select(ranked.withColumn("label", F.lit(1)), "k1", 4, 0.5, False)


def test_names_units_and_addresses(spark):
    df = spark.createDataFrame([("The The Joe's DBA", "12 N Flower St Bsmt APT 4B", "60601"), ("LIMITED EDITIONS LTD", "1st Ave", "1")], "n string, a string, z string")
    got = df.select(text.name_key(F.col("n")).alias("n"), text.units(F.col("a")).alias("u"), text.address_key(F.col("a"), F.col("z")).alias("k")).collect()
    assert [r.n for r in got] == ["JOES", "LIMITED EDITIONS"] and got[0].u == "APT" and got[1].k is None  # a marker's next word is its value, whatever it is


def test_clusters_climb_the_whole_ladder(spark):
    base = {"name": "A", "aka": None, "licence": None, "house": 1, "street": "M", "unit": None, "direction": None, "facility": None, "geo": None, "lat": None, "lon": None}
    rows = [(i, addr, z, unit, lat) for i, addr, z, unit, lat in [(1, "a", "z", None, None), (2, "a", "z", None, None), (3, "b", "z", None, None), (4, "c", "y", None, None), (5, "d", "x", "1", None), (6, "d", "x", "2", None), (7, "e", "x", None, None), (8, "f", "w", None, 41.0), (9, "f", "w", None, 41.5), (10, None, "v", None, None), (11, "g", "v", None, None)]]
    df = spark.createDataFrame([{**base, "id": i, "address": a, "zip": z, "unit": u, "lat": lat, "lon": -87.0 if lat else None} for i, a, z, u, lat in rows], "id int, name string, aka string, licence string, house int, street string, unit string, direction string, facility string, geo string, lat double, lon double, address string, zip string")
    edges = [(1, 2, True), (2, 3, False), (3, 4, False), (5, 6, True), (6, 7, True), (8, 9, True), (10, 11, False)]
    e = spark.createDataFrame([(a, b, s, True) for a, b, s in edges], "a int, b int, strong boolean, linked boolean")
    got = {r.id: (r.cluster, r.confidence, r.split_reason) for r in entity.clusters(df, e).collect()}
    assert got[1] == got[2] == (1, "reduced", "probable_edges_dropped") and got[3] == (3, "reduced", "probable_edges_dropped") and got[4][0] == 4  # ZIPs z and y
    assert got[5] == (5, "reduced", "atomised") and got[6] == (6, "reduced", "atomised") and got[7] == (7, "reduced", "address_split")  # units 1 and 2
    assert got[8] == (8, "reduced", "atomised") and got[9] == (9, "reduced", "atomised")  # 55 km apart
    assert got[10] == got[11] == (10, "medium", None)


def fold_rows(spark, change=0):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        split = ("train", "calibration", "test")[i % 3]
        x = rng.normal(size=3)
        y = int(rng.random() < 1 / (1 + np.exp(-(x[0] - 0.5 * x[1]))))
        rows.append(("f1" if i % 2 else "f2", i, split, y if split != "test" else (y + change) % 2, float(x[0]), None if i % 11 == 0 else float(x[1]), bool(x[2] > 0), float(1 / (1 + np.exp(-x[0])))))
    return spark.createDataFrame(rows, "fold_id string, id int, split string, label int, a double, b double, c boolean, score double")


def test_test_labels_change_no_score(spark):
    one, two = fold_rows(spark), fold_rows(spark, 1)
    fit = lambda d: sorted((r.id, round(r.score, 9)) for r in calibrate.logistic(d, "fold_id", ["a", "b"], {"b": "b"}, ["c"]).collect())
    assert fit(one) == fit(two)
    for method in (calibrate.platt, calibrate.isotonic):
        scored = lambda d: sorted((r.id, round(r.calibrated, 9)) for r in method(d.where("split = 'calibration'"), d.where("split = 'test'").drop("label"), "fold_id").collect())
        assert scored(one) == scored(two)
    moved = one.withColumn("label", F.when(F.col("split") == "train", 1 - F.col("label")).otherwise(F.col("label")))
    assert fit(one) != fit(moved)


def test_logistic_is_the_penalised_optimum(spark):
    d = fold_rows(spark)
    data, used = calibrate.preprocessed(d, "fold_id", ["a", "b"], {"b": "b"}, ["c"])
    beta = calibrate.newton(data.where("split = 'train'"), "fold_id", used, 1.0)
    for fold, b in beta.items():
        p = data.where((F.col("split") == "train") & (F.col("fold_id") == fold)).select("label", *used).toPandas()
        x, y = np.column_stack([np.ones(len(p)), p[used].to_numpy()]), p["label"].to_numpy()
        price = np.array([0.0] + [1.0] * len(used))
        gradient = x.T @ (y - 1 / (1 + np.exp(-x @ b))) - price * b
        assert np.abs(gradient).max() < 1e-6
        assert abs(p["a"].mean()) < 1e-9 and abs(p["a"].std(ddof=0) - 1) < 1e-9


def test_isotonic_runs_pool_like_one(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.random(500), 3)
    y = (rng.random(500) < x).astype(int)
    fit = calibrate.isotonic_fit(spark.createDataFrame([("c", float(a), int(b)) for a, b in zip(x, y)], "cell string, score double, label int"), "cell").collect()
    xs = np.unique(x)
    mean, n = np.array([y[x == v].mean() for v in xs]), np.array([(x == v).sum() for v in xs])
    want = [max(min((mean[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    got = {round(r.px, 3): r.py for r in fit}
    assert all(abs(got[round(float(v), 3)] - want[i]) < 1e-9 for i, v in enumerate(xs) if round(float(v), 3) in got)
    assert np.allclose(np.interp(xs, sorted(got), [got[k] for k in sorted(got)]), want, atol=1e-9)


def test_interpolation_is_clamped(spark):
    rows = spark.createDataFrame([("c", v) for v in (-1.0, 0.0, 0.5, 1.0, 9.0)], "cell string, x double")
    points = spark.createDataFrame([("c", 0.0, 1.0), ("c", 1.0, 3.0)], "cell string, px double, py double")
    assert sorted((r.x, r.value) for r in numbers.interpolate(rows, points, "x").collect()) == [(-1.0, 1.0), (0.0, 1.0), (0.5, 2.0), (1.0, 3.0), (9.0, 3.0)]


def test_sources_and_manifest(spark, tmp_path):
    raw = spark.createDataFrame([(1, (2, "x"), None)], "a int, b struct<c: int, d: string>, e string")
    assert tuple(tables.records_as_text(raw, ["a", "b", "e", "zz"]).first()) == ("1", '{"c":2,"d":"x"}', None, None)
    assert tables.fields([{"a": 1}, {"b": 2, "a": 3}]) == ["a", "b"]
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, s string")
    path = f"file://{tmp_path}/t_1.parquet"
    tables.write_table(df, path, ["id"])
    assert [r.id for r in spark.read.parquet(path).coalesce(1).collect()] == [1, 2] and tables.latest(spark, f"file://{tmp_path}", "t_").endswith("t_1.parquet")
    assert tables.manifest(df) == tables.manifest(df.orderBy("id")) != tables.manifest(df.withColumn("s", F.lit("x")))
    assert json.loads(tables.write_manifest(df, path))["row_count"] == 2 and spark.read.text(path + ".manifest").count() == 1
    (tmp_path / "d.json").write_text('[{"id": 1, "why": "x"}, {"id": "2"}]')
    assert [tuple(r) for r in tables.decisions(spark, f"file://{tmp_path}/d.json", ["id", "why"]).collect()] == [("1", "x"), ("2", None)]


@pytest.fixture
def served():
    rows = [{"id": str(i), "place": {"b": 1, "a": i}} if i % 2 else {"id": str(i), "note": None} for i in range(7)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            body = [{"n": str(len(rows))}] if "count" in q.get("$select", "") else rows[int(q["$offset"]) : int(q["$offset"]) + int(q["$limit"])]
            self.send_response(200), self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_paged_source_reads_all_or_fails(spark, served):
    spark.dataSource.register(paged.PagedSource)
    read = lambda **o: spark.read.format("orrery_pages").options(url=served, order="id", limit="3", **o).load()
    got = read().collect()
    assert len(got) == 7 and got[0].asDict().keys() == {"id", "note", "place"} and json.loads(got[1].place) == {"a": 1, "b": 1}
    with pytest.raises(Exception, match="after page"):
        read(pages="2", schema="id string").collect()
    with pytest.raises(Exception, match="short"):
        read(pages="5", schema="id string").collect()


def test_allocation_against_a_plain_walk(spark):
    rng = np.random.default_rng(13)
    rows = [(f"c{c}", i, float(rng.random()), 0, bool(rng.random() < 0.3), int(k)) for c, k in enumerate((1, 5, 17, 40)) for i in range(40)]
    df = spark.createDataFrame(rows, "cell string, id int, score double, label int, eligible boolean, k int")
    for share, forced in ((0.0, False), (0.2, False), (0.5, True), (1.0, True)):
        got = {(r.cell, r.id): (r.mechanism, r.final_rank) for r in policy.allocate(df, ["cell"], F.lit(share), F.lit(forced)).collect()}
        for c in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1]))
            k = min(own[0][5], len(own))
            want = min(int(share * k), k) if forced else max(0, int(share * k) - sum(r[4] for r in own[:k]))
            g = max(x for x in range(want + 1) if sum(r[4] for r in own[k - x :]) >= x)
            queue = [(r, "risk_priority") for r in own[: k - g]] + [(r, "coverage_reserve") for r in [r for r in own[k - g :] if r[4]][:g]]
            place = {r[1]: (m, n) for n, (r, m) in enumerate(queue, 1)}
            assert all(got[c, r[1]] == place.get(r[1], ("not_selected", None)) for r in own)
