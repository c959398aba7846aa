"""Queries on contracts, checks, operational selection, adjustments and redraws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, contracts, governance, operational, policy, ranking, scheduling, uncertainty
from ..shared import stored
from ..sources.tables import inspections, records, table
from .catalogue import _CELLS, _FOLDS, _HORIZON, _INSP, _PLAN, CELL, ERA, K, PLANNING, POLICIES, _alloc_sql, _calendar, _plan, cells, decided, fold_table_of, query, targets

# --- contracts ------------------------------------------------------------------------

_PRED = """pred AS MATERIALIZED (SELECT fold_id, id, CASE WHEN id % 41 = 0 THEN NULL WHEN id % 43 = 0 THEN score + 2 ELSE score END AS score, CASE WHEN id % 47 = 0 THEN DATE '2009-01-01' ELSE DATE '1990-01-01' END AS trained_through FROM cells WHERE id % 37 <> 0
  UNION ALL SELECT fold_id, id, score, DATE '1990-01-01' FROM cells WHERE id % 53 = 0 UNION ALL SELECT fold_id, -id, score, DATE '1990-01-01' FROM cells WHERE id % 59 = 0)"""


def _predictions(c):
    """Scores with every kind of violation, by id."""
    score = F.when(F.col("id") % 41 == 0, None).when(F.col("id") % 43 == 0, F.col("score") + 2).otherwise(F.col("score"))
    late, early = F.lit("2009-01-01").cast("date"), F.lit("1990-01-01").cast("date")
    most = c.where("id % 37 <> 0").select("fold_id", "id", score.alias("score"), F.when(F.col("id") % 47 == 0, late).otherwise(early).alias("trained_through"))
    again = c.where("id % 53 = 0").select("fold_id", "id", "score", early.alias("trained_through"))
    strange = c.where("id % 59 = 0").select("fold_id", (-F.col("id")).alias("id"), "score", early.alias("trained_through"))
    return most.unionByName(again).unionByName(strange)


@query(f"""WITH {_CELLS}, {_PRED}, p AS (SELECT fold_id, id, count(*) AS n, count(*) FILTER (WHERE score IS NULL) AS bad, count(*) FILTER (WHERE score < 0 OR score > 1) AS outside, max(trained_through) AS t FROM pred GROUP BY ALL),
 u AS (SELECT c.fold_id, c.id, f.calibration_end FROM cells c JOIN folds f USING (fold_id)), b AS (SELECT coalesce(u.fold_id, p.fold_id) AS fold_id, u.id AS uid, calibration_end, n, bad, outside, t FROM u FULL JOIN p ON u.fold_id = p.fold_id AND u.id = p.id)
 SELECT fold_id, count(*) FILTER (WHERE n IS NULL) AS n_missing, count(*) FILTER (WHERE uid IS NULL) AS n_unexpected, count(*) FILTER (WHERE n > 1) AS n_repeated, CAST(coalesce(sum(bad), 0) AS BIGINT) AS n_not_finite, CAST(coalesce(sum(outside), 0) AS BIGINT) AS n_no_probability, count(*) FILTER (WHERE t > calibration_end) AS n_trained_late FROM b GROUP BY fold_id""")
def prediction_contract(spark, sf_dir):
    c = cells(spark, sf_dir)
    universe = c.select("fold_id", "id").join(F.broadcast(fold_table_of(spark).select("fold_id", "calibration_end")), "fold_id")
    return contracts.prediction_violations(_predictions(c), universe, CELL)


@query(f"WITH {_CELLS}, {_PRED}, one AS (SELECT fold_id, id, max(score) AS score FROM pred GROUP BY ALL) SELECT c.fold_id, c.id, o.score FROM cells c LEFT JOIN one o ON o.fold_id = c.fold_id AND o.id = c.id")
def score_alignment(spark, sf_dir):
    c = cells(spark, sf_dir)
    return contracts.aligned(c.select("fold_id", "id"), _predictions(c).groupBy("fold_id", "id").agg(F.max("score").alias("score")), CELL)


@query("""WITH r AS (SELECT event_id AS id, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id FROM events UNION ALL SELECT event_id, value, user_id FROM events WHERE event_id % 100 = 0)
 SELECT CASE WHEN n > 1 THEN 'repeated' WHEN value IS NULL OR isnan(value) THEN 'missing_value' WHEN user_id IS NULL THEN 'missing_user_id' ELSE 'scored' END AS scoring_status, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r) GROUP BY 1""")
def scorable_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value", "user_id")
    rows = e.withColumn("user_id", F.when(F.col("id") % 7 != 0, F.col("user_id"))).unionByName(e.where("id % 100 = 0"))
    return contracts.scorable(rows, ["value", "user_id"], "id").groupBy("scoring_status").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return contracts.duplicates(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d")), ["o_custkey", "d"])


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL ORDER BY 1")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").where("event_type is not null").distinct().orderBy("event_type")


@query(f"WITH {_CELLS}, {_alloc_sql(POLICIES)} SELECT policy_id, mechanism, CASE WHEN mechanism = 'risk_priority' THEN 'selected_by_risk_rank' WHEN mechanism = 'coverage_reserve' THEN 'selected_by_coverage_reserve' WHEN eligible THEN 'not_selected_reserve_exhausted' ELSE 'not_selected_capacity_exhausted' END AS reason, count(*) AS n FROM dec GROUP BY ALL")
def decision_reasons(spark, sf_dir):
    return decided(spark, sf_dir, POLICIES).groupBy("policy_id", "mechanism", "reason").agg(F.count("*").alias("n"))


# --- checks ---------------------------------------------------------------------------


@query(f"""WITH {_CELLS}, {_alloc_sql(POLICIES)}, d AS MATERIALIZED (SELECT policy_id, fold_id, id, eligible, model_rank, mechanism, kk, g, mechanism <> 'not_selected' AS sel,
  CASE WHEN mechanism = 'risk_priority' THEN 'selected_by_risk_rank' WHEN mechanism = 'coverage_reserve' THEN 'selected_by_coverage_reserve' WHEN eligible THEN 'not_selected_reserve_exhausted' ELSE 'not_selected_capacity_exhausted' END AS reason,
  CASE WHEN mechanism <> 'not_selected' THEN row_number() OVER (PARTITION BY policy_id, fold_id ORDER BY (mechanism = 'risk_priority') DESC, (mechanism = 'coverage_reserve') DESC, model_rank) END AS fr FROM dec),
 per AS (SELECT policy_id, fold_id, count(*) AS n, max(kk) AS k, count(*) FILTER (WHERE sel) AS s, count(*) FILTER (WHERE mechanism = 'risk_priority') AS r, count(*) FILTER (WHERE mechanism = 'coverage_reserve') AS v, count(*) FILTER (WHERE eligible) AS e, max(g) AS g FROM d GROUP BY ALL),
 u AS (SELECT policy_id, fold_id, count(*) AS nu FROM pc GROUP BY ALL)
 SELECT 'cell_covers_universe' AS check_name, count(*) AS violations FROM per FULL JOIN u USING (policy_id, fold_id) WHERE n IS DISTINCT FROM nu
 UNION ALL SELECT 'selected_is_capacity', count(*) FROM per WHERE s <> least(k, n) UNION ALL SELECT 'mechanisms_add_up', count(*) FROM per WHERE r + v <> s UNION ALL SELECT 'reserve_within_target_and_supply', count(*) FROM per WHERE v > g OR v > e
 UNION ALL SELECT 'risk_is_the_best_ranks', count(*) FROM d JOIN per USING (policy_id, fold_id) WHERE (mechanism = 'risk_priority') <> (model_rank <= r) UNION ALL SELECT 'reserve_is_eligible', count(*) FROM d WHERE mechanism = 'coverage_reserve' AND NOT eligible
 UNION ALL SELECT 'mechanism_fits_reason', count(*) FROM d WHERE (mechanism, reason) NOT IN (('risk_priority', 'selected_by_risk_rank'), ('coverage_reserve', 'selected_by_coverage_reserve'), ('not_selected', 'not_selected_capacity_exhausted'), ('not_selected', 'not_selected_reserve_exhausted')) UNION ALL SELECT 'selected_by_a_selected_reason', count(*) FROM d WHERE sel <> starts_with(reason, 'selected_') UNION ALL SELECT 'ranks_unique_and_contiguous', count(*) FROM (SELECT 1 FROM d WHERE sel GROUP BY policy_id, fold_id HAVING min(fr) <> 1 OR max(fr) <> count(*) OR count(DISTINCT fr) <> count(*)) UNION ALL SELECT 'unselected_have_no_rank', count(*) FROM d WHERE NOT sel AND fr IS NOT NULL
 UNION ALL SELECT 'id_selected_once', count(*) FROM (SELECT 1 FROM d WHERE sel GROUP BY policy_id, fold_id, id HAVING count(*) > 1)""")
def policy_checks(spark, sf_dir):
    d = stored(decided(spark, sf_dir, POLICIES), "decided")
    n = cells(spark, sf_dir).groupBy("fold_id").agg(F.count("*").alias("n_universe"))
    names = F.explode(F.array(*(F.lit(p[0]) for p in POLICIES)))
    return contracts.violations(contracts.policy_violations(d, n.withColumn("policy_id", names), ["policy_id", *CELL]))


@query(f"""WITH {_CELLS}, {_PLAN}, sch AS (SELECT * FROM plan WHERE status = 'scheduled'), us AS (SELECT fold_id, slot_date, count(*) AS used, max(slot_index) AS top FROM sch GROUP BY ALL)
 SELECT 'slot_taken_once' AS check_name, count(*) AS violations FROM (SELECT 1 FROM sch GROUP BY fold_id, slot_date, slot_index HAVING count(*) > 1) UNION ALL SELECT 'id_in_one_slot', count(*) FROM (SELECT 1 FROM sch GROUP BY fold_id, id HAVING count(*) > 1)
 UNION ALL SELECT 'day_within_capacity', count(*) FROM us LEFT JOIN hor USING (fold_id, slot_date) WHERE n_slots IS NULL OR used > n_slots OR top > n_slots
 UNION ALL SELECT 'queue_is_accounted_for', count(*) FROM dec LEFT JOIN plan USING (fold_id, id) WHERE mechanism <> 'not_selected' AND plan.status IS NULL
 UNION ALL SELECT 'days_contiguous', count(*) FROM (SELECT fold_id FROM hor GROUP BY 1 HAVING min(day_index) <> 1 OR max(day_index) <> count(*)) UNION ALL SELECT 'backlog_has_no_slot', count(*) FROM plan WHERE (status = 'backlog') <> (slot_date IS NULL) UNION ALL SELECT 'status_is_known', count(*) FROM plan WHERE status NOT IN ('scheduled', 'backlog')""")
def schedule_checks(spark, sf_dir):
    days, plan = _plan(spark, sf_dir)
    queue = decided(spark, sf_dir).where("is_selected").select("fold_id", "id")
    return contracts.violations(contracts.schedule_violations(plan, days, queue, CELL))


@query(f"""WITH {_INSP}, {_FOLDS}, s AS (SELECT fold_id, inspection_id, CASE WHEN d <= train_end THEN 'train' WHEN d <= calibration_end THEN 'calibration' ELSE 'test' END AS split FROM insp JOIN folds ON d BETWEEN train_start AND test_end),
 same AS (SELECT establishment_id, d, max(label) AS label, count(*) AS n FROM insp GROUP BY ALL)
 SELECT 'boundaries_are_strict' AS check_name, count(*) AS violations FROM folds WHERE NOT (train_end < calibration_start AND calibration_end < test_start AND test_start <= test_end) UNION ALL SELECT 'calibration_follows_training', count(*) FROM folds WHERE calibration_start <> train_end + 1
 UNION ALL SELECT 'no_id_in_two_splits', count(*) FROM (SELECT 1 FROM s GROUP BY fold_id, inspection_id HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'one_row_an_entity_and_day', count(*) FROM (SELECT 1 FROM same GROUP BY establishment_id, d HAVING count(*) > 1) UNION ALL SELECT 'every_record_accounted_for', (SELECT count(*) FROM insp) - (SELECT CAST(sum(n) AS BIGINT) FROM same)
 UNION ALL SELECT 'label_is_binary', count(*) FROM same WHERE label NOT IN (0, 1)""")
def fold_and_target_checks(spark, sf_dir):
    from ..functions import numbers
    from ..operators import entity

    f = fold_table_of(spark)
    i = inspections(spark, sf_dir)
    s = numbers.split_of(i, f)
    same = entity.collapse_same_day(i)
    return contracts.violations({
        "boundaries_are_strict": f.where("not (train_end < calibration_start and calibration_end < test_start and test_start <= test_end)"), "calibration_follows_training": f.where("calibration_start <> date_add(train_end, 1)"),
        "no_id_in_two_splits": s.groupBy("fold_id", "inspection_id").agg(F.countDistinct("split").alias("n")).where("n > 1"), "one_row_an_entity_and_day": same.groupBy("establishment_id", "d").count().where("count > 1"),
        "every_record_accounted_for": i.select("inspection_id").exceptAll(same.select(F.explode(F.split("ids", " ").cast("array<bigint>")).alias("inspection_id"))), "label_is_binary": same.where("label not in (0, 1)"),
    })


# --- folds, rankers and capacities ----------------------------------------------------


@query(f"WITH {_INSP} SELECT 'covid_shift' AS fold_id, CASE WHEN d <= DATE '1997-12-31' THEN 'train' WHEN d <= DATE '1998-06-30' THEN 'calibration' ELSE 'test' END AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM insp WHERE d BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' GROUP BY ALL")
def shift_fold(spark, sf_dir):
    """A fold of fixed dates, tested after a break in the data."""
    s = asof.fixed_fold(inspections(spark, sf_dir), "covid_shift", "1995-01-01", "1997-12-31", "1998-06-30", "1999-12-31")
    return s.groupBy("fold_id", "split").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


_U = uncertainty.MODULUS


@query(f"""WITH {_CELLS}, u AS (SELECT fold_id, id, label, seed, ((h * h + 7) % {_U} * 16807) % {_U} AS u FROM (SELECT fold_id, id, label, seed, (id % {_U} * 48271 + seed * 69621 + 11) % {_U} AS h FROM cells, range(1, 21) AS r(seed))),
 r AS (SELECT *, row_number() OVER (PARTITION BY fold_id, seed ORDER BY u, id) AS pos FROM u), x AS (SELECT *, sum(label) OVER (PARTITION BY fold_id, seed ORDER BY pos) AS cum FROM r), g AS (SELECT fold_id, seed, count(*) AS n, sum(label) AS p, sum(2 * cum - label) AS t FROM x GROUP BY ALL)
 SELECT fold_id, count(*) AS n_seeds, round(avg((t / nullif(2.0 * n * p, 0) - 0.5) / nullif(0.5 - p / (2.0 * n), 0)), 6) AS mean_nde FROM g GROUP BY fold_id""")
def random_ranker(spark, sf_dir):
    """Discovery of twenty seeded random orders: a repeatable hash of the id is the score."""
    seeds = F.explode(F.sequence(F.lit(1), F.lit(20)))
    c = cells(spark, sf_dir).select("fold_id", "id", "label", seeds.alias("seed"))
    c = c.withColumn("score", -uncertainty.uniform(F.col("id"), F.col("seed")))
    g = ranking.discovery_summary(c, ["fold_id", "seed"])
    return g.groupBy("fold_id").agg(F.count("*").alias("n_seeds"), F.round(F.avg("nde"), 6).alias("mean_nde"))


@query(f"""WITH {_CELLS}, s AS (SELECT fold_id, id, label, unnest(['business_as_usual', 'optimal', 'worst', 'model']) AS producer, unnest([-CAST(date_diff('day', DATE '1970-01-01', d) AS DOUBLE), CAST(label AS DOUBLE), -CAST(label AS DOUBLE), score]) AS score FROM cells),
 x AS (SELECT *, sum(label) OVER (PARTITION BY producer, fold_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cum FROM s), g AS (SELECT producer, fold_id, count(*) AS n, sum(label) AS p, sum(2 * cum - label) AS t FROM x GROUP BY ALL)
 SELECT producer, fold_id, round((t / nullif(2.0 * n * p, 0) - 0.5) / nullif(0.5 - p / (2.0 * n), 0), 6) AS nde FROM g""")
def fold_program(spark, sf_dir):
    """One union of score producers, each evaluated on every fold."""
    parts = {"business_as_usual": -F.unix_date("d").cast("double"), "optimal": F.col("label").cast("double"), "worst": -F.col("label").cast("double"), "model": F.col("score")}
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("producer"), s.alias("score")) for n, s in parts.items())))
    c = cells(spark, sf_dir).select("fold_id", "id", "label", long.alias("x")).select("fold_id", "id", "label", "x.*")
    g = ranking.discovery_summary(c, ["producer", "fold_id"])
    return g.select("producer", "fold_id", F.round("nde", 6).alias("nde"))


@query(f"""WITH {_INSP}, {_FOLDS}, t AS (SELECT fold_id, year(d) AS y, month(d) AS m, label FROM insp JOIN folds ON d BETWEEN train_start AND train_end), a AS (SELECT fold_id, y, m, count(*) AS n, least(greatest(avg(label), 1e-6), 1 - 1e-6) AS p FROM t GROUP BY ALL), b AS (SELECT fold_id, y, least(greatest(avg(label), 1e-6), 1 - 1e-6) AS p FROM t GROUP BY ALL)
 SELECT a.fold_id, a.m AS month, round(sum(n * (ln(a.p / (1 - a.p)) - ln(b.p / (1 - b.p)))) / sum(n), 6) AS effect FROM a JOIN b ON a.fold_id = b.fold_id AND a.y = b.y GROUP BY ALL""")
def fold_month_effects(spark, sf_dir):
    """Month effects from the training rows of every fold alone."""
    return uncertainty.month_effects(_training(spark, sf_dir), CELL).withColumn("effect", F.round("effect", 6))


def _training(spark, sf_dir):
    f = F.broadcast(fold_table_of(spark).select("fold_id", "train_start", "train_end"))
    i = inspections(spark, sf_dir).select("d", "label")
    return i.join(f, F.col("d").between(F.col("train_start"), F.col("train_end"))).select("fold_id", "d", "label")


@query(f"""WITH {_CELLS}, t AS (SELECT fold_id, year(d) AS y, month(d) AS m, label FROM insp JOIN folds ON d BETWEEN train_start AND train_end), a AS (SELECT fold_id, y, m, count(*) AS n, least(greatest(avg(label), 1e-6), 1 - 1e-6) AS p FROM t GROUP BY ALL), b AS (SELECT fold_id, y, least(greatest(avg(label), 1e-6), 1 - 1e-6) AS p FROM t GROUP BY ALL),
 e AS MATERIALIZED (SELECT a.fold_id, a.m, round(sum(n * (ln(a.p / (1 - a.p)) - ln(b.p / (1 - b.p)))) / sum(n), 9) AS effect FROM a JOIN b ON a.fold_id = b.fold_id AND a.y = b.y GROUP BY ALL),
 base AS (SELECT fold_id, ln(q / (1 - q)) AS z FROM (SELECT fold_id, least(greatest(avg(label), 1e-6), 1 - 1e-6) AS q FROM cells GROUP BY 1)),
 r AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY score DESC, id) AS pos, row_number() OVER (PARTITION BY fold_id ORDER BY d, id) AS dpos FROM cells), sl AS (SELECT fold_id, dpos AS pos, d AS slot FROM r),
 pr AS MATERIALIZED (SELECT r.fold_id, id, label, r.pos, 1 / (1 + exp(-(z + coalesce(e1.effect, 0)))) AS p_real, 1 / (1 + exp(-(z + coalesce(e2.effect, 0)))) AS p_sim FROM r JOIN sl ON sl.fold_id = r.fold_id AND sl.pos = r.pos JOIN base ON base.fold_id = r.fold_id LEFT JOIN e e1 ON e1.fold_id = r.fold_id AND e1.m = month(r.d) LEFT JOIN e e2 ON e2.fold_id = r.fold_id AND e2.m = month(slot)),
 u AS (SELECT pr.*, rep, ((h * h + 7) % {_U} * 16807) % {_U} / {_U}::DOUBLE AS u FROM (SELECT *, (id % {_U} * 48271 + rep * 69621 + 11) % {_U} AS h FROM pr, range(1, 51) AS q(rep)) AS pr),
 dr AS (SELECT fold_id, rep, pos, label, CAST(CASE WHEN label = 1 THEN u * p_real ELSE p_real + u * (1 - p_real) END < p_sim AS INTEGER) AS drawn FROM u), cu AS (SELECT *, sum(drawn) OVER (PARTITION BY fold_id, rep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM dr),
 g AS (SELECT fold_id, rep, count(*) AS n, sum(drawn) AS p, sum(2 * cum - drawn) AS t, count(*) FILTER (WHERE drawn <> label) AS flips FROM cu GROUP BY ALL), nd AS (SELECT *, CASE WHEN p > 0 AND p < n THEN (t / (2.0 * n * p) - 0.5) / (0.5 - p / (2.0 * n)) END AS nde FROM g)
 SELECT fold_id, round(quantile_cont(nde, 0.05), 5) AS p05, round(quantile_cont(nde, 0.5), 5) AS p50, round(quantile_cont(nde, 0.95), 5) AS p95, round(sum(flips) / sum(n), 6) AS flip_rate FROM nd GROUP BY fold_id""")
def label_redraw(spark, sf_dir):
    """Discovery when labels are drawn anew for the dates that the model's order gives, 50 times."""
    effects = uncertainty.month_effects(_training(spark, sf_dir), CELL).withColumn("effect", F.round("effect", 9))
    g = uncertainty.label_redraw(cells(spark, sf_dir), effects, CELL, 50)
    return g.withColumns({**{c: F.round(c, 5) for c in ("p05", "p50", "p95")}, "flip_rate": F.round("flip_rate", 6)})


_LEVELS = ["day_1", "week_1", "month_1", "pct_10", "pct_25"]


_LEVEL_SQL = f"""per AS (SELECT fold_id, d, count(*) AS n FROM cells GROUP BY ALL), c AS (SELECT fold_id, CAST(sum(n) AS INTEGER) AS n, CAST(round(median(n)) AS INTEGER) AS day FROM per GROUP BY 1),
 lv AS (SELECT fold_id, unnest(['day_1', 'week_1', 'month_1', 'pct_10', 'pct_25']) AS k_name, unnest(list_transform([day, day * 5, day * 21, CAST(round_even(n * 0.1, 0) AS INTEGER), CAST(round_even(n * 0.25, 0) AS INTEGER)], lambda k: greatest(1, least(k, n)))) AS k FROM c),
 r AS MATERIALIZED (SELECT *, row_number() OVER w AS model_rank, sum(CAST(eligible AS INTEGER)) OVER w AS cum FROM cells WINDOW w AS (PARTITION BY fold_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
 tot AS (SELECT fold_id, sum(CAST(eligible AS INTEGER)) AS total FROM cells GROUP BY 1), pl AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {s}::DOUBLE, {f})" for n, s, f in POLICIES)}) AS p(policy_id, share, forced)),
 w AS MATERIALIZED (SELECT policy_id, lv.fold_id, k_name, k, total, CASE WHEN forced THEN least(floor(k * share), k) ELSE greatest(0, floor(k * share) - coalesce((SELECT cum FROM r WHERE r.fold_id = lv.fold_id AND r.model_rank = lv.k), 0)) END AS wanted FROM lv JOIN tot USING (fold_id), pl),
 g AS MATERIALIZED (SELECT policy_id, w.fold_id, k_name, k, coalesce(max(CASE WHEN total - cum >= k - model_rank THEN k - model_rank END), 0) AS g, any_value(total) AS total, any_value(wanted) AS wanted FROM w JOIN r ON r.fold_id = w.fold_id AND model_rank <= k AND k - model_rank <= wanted GROUP BY ALL),
 h AS MATERIALIZED (SELECT policy_id, fold_id, k_name, k, CASE WHEN wanted >= k AND total >= k THEN k ELSE g END AS g FROM g),
 z AS (SELECT h.policy_id, h.k_name, h.k, h.g, r.*, model_rank <= h.k - h.g AS risk, sum(CASE WHEN model_rank > h.k - h.g AND eligible THEN 1 ELSE 0 END) OVER (PARTITION BY h.policy_id, h.k_name, h.fold_id ORDER BY model_rank ROWS UNBOUNDED PRECEDING) AS below FROM h JOIN r USING (fold_id))"""


def _levels(spark, sf_dir):
    """Every row under seven policies and five capacities; rows are ranked once."""
    from ..functions import numbers

    c = cells(spark, sf_dir)
    per = c.groupBy("fold_id", "d").agg(F.count("*").alias("n")).groupBy("fold_id").agg(F.sum("n").alias("n"), F.round(F.median("n")).cast("int").alias("day"))
    levels = per.select("fold_id", F.explode(numbers.capacity_levels(F.col("n"), F.col("day"))).alias("k")).select("fold_id", "k.*").where(F.col("k_name").isin(_LEVELS))
    grid = F.explode(F.array(*(F.struct(F.lit(n).alias("policy_id"), F.lit(s).alias("share"), F.lit(f).alias("forced")) for n, s, f in POLICIES)))
    # A fold's levels and policies are a few dozen rows.
    rows = stored(policy.ranked(c, CELL), "ranked-cells").join(F.broadcast(levels), "fold_id").withColumn("p", grid).select("*", "p.*").drop("p")
    return policy.allocate(rows, ["policy_id", "fold_id", "k_name"], F.col("share"), F.col("forced"))


@query(f"""WITH {_CELLS}, {_LEVEL_SQL}
 SELECT policy_id, fold_id, k_name, k, count(*) FILTER (WHERE risk OR eligible AND below <= g) AS n_selected, count(*) FILTER (WHERE NOT risk AND eligible AND below <= g) AS n_reserve, CAST(sum(CASE WHEN risk OR eligible AND below <= g THEN label ELSE 0 END) AS BIGINT) AS hits FROM z GROUP BY ALL""")
def policy_levels(spark, sf_dir):
    """The grid of seven policies and five capacities on every fold."""
    return policy.cell_metrics(_levels(spark, sf_dir), ["policy_id", "fold_id", "k_name", "k"]).select("policy_id", "fold_id", "k_name", "k", "n_selected", "n_reserve", "hits")


@query(f"""WITH {_CELLS}, {_LEVEL_SQL}, pool AS MATERIALIZED (SELECT policy_id, k_name, CAST(sum(CASE WHEN risk OR eligible AND below <= g THEN label ELSE 0 END) AS BIGINT) AS positives_selected, count(*) FILTER (WHERE eligible AND (risk OR below <= g)) AS eligible_selected FROM z GROUP BY ALL),
 dom AS (SELECT p.policy_id, p.k_name, string_agg(q.policy_id, ', ' ORDER BY q.policy_id) AS by FROM pool p JOIN pool q ON q.k_name = p.k_name AND q.positives_selected >= p.positives_selected AND q.eligible_selected >= p.eligible_selected AND (q.positives_selected > p.positives_selected OR q.eligible_selected > p.eligible_selected) GROUP BY ALL),
 o AS (SELECT pool.*, dom.by IS NOT NULL AS is_dominated, coalesce(dom.by, '') AS dominated_by FROM pool LEFT JOIN dom USING (policy_id, k_name)), win AS (SELECT k_name, CASE WHEN count(*) = 1 THEN min(policy_id) END AS winner FROM o WHERE NOT is_dominated GROUP BY 1)
 SELECT o.*, winner FROM o LEFT JOIN win USING (k_name)""")
def policy_dominance(spark, sf_dir):
    """Which policies are beaten at each capacity over all folds, by whom, and the one left if any."""
    s = F.col("is_selected")
    pooled = _levels(spark, sf_dir).groupBy("policy_id", "k_name").agg(F.sum(F.when(s, F.col("label")).otherwise(0)).cast("long").alias("positives_selected"), F.count_if(s & F.col("eligible")).alias("eligible_selected"))
    return policy.dominance(stored(pooled, "policy-points"), ["k_name"], "policy_id", ["positives_selected", "eligible_selected"])


# --- schedule -------------------------------------------------------------------------


@query(f"""WITH {_CELLS}, {_PLAN}, rest AS (SELECT fold_id, d AS slot_date, n, coalesce(sum(n) OVER (PARTITION BY fold_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY fold_id ORDER BY d) AS i FROM (SELECT fold_id, d, count(*) AS n FROM cells GROUP BY ALL) WHERE NOT EXISTS (SELECT 1 FROM hor WHERE hor.fold_id = cells.fold_id AND hor.slot_date >= cells.d) ),
 b AS (SELECT fold_id, id, final_rank, row_number() OVER (PARTITION BY fold_id ORDER BY final_rank, id) AS place FROM plan WHERE status = 'backlog'), hz AS (SELECT fold_id, CAST(sum(n_slots) AS BIGINT) AS slots, count(*) AS n_days FROM hor GROUP BY 1)
 SELECT b.fold_id, id, CAST(place AS INTEGER) AS backlog_position, slots AS horizon_slots, greatest(0, {K} - slots) AS slots_short, CAST(n_days + i AS INTEGER) AS would_fit_on_day_index, rest.slot_date AS first_available_date FROM b JOIN hz USING (fold_id) LEFT JOIN rest ON rest.fold_id = b.fold_id AND place > before AND place <= before + n""".replace("WHERE NOT EXISTS (SELECT 1 FROM hor WHERE hor.fold_id = cells.fold_id AND hor.slot_date >= cells.d) )", "AS q WHERE d > (SELECT max(slot_date) FROM hor WHERE hor.fold_id = q.fold_id))"))
def backlog_projection(spark, sf_dir):
    """Where the backlog would land on the days after the horizon."""
    days, plan = _plan(spark, sf_dir)
    return scheduling.project_backlog(plan, days, _calendar(spark, sf_dir), CELL, K)


@query()
def schedule_adjustments(spark, sf_dir):
    """Supervisors' adjustments applied to every plan in id order (see ``governance.adjust``)."""
    days, plan = _plan(spark, sf_dir)
    ends = days.groupBy("fold_id").agg(F.min("slot_date").alias("first"), F.max("slot_date").alias("last"))
    a = plan.where("id % 9 = 0").join(ends, "fold_id").select("fold_id", F.concat(F.lit("AD-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("adjustment_id"), "id",
        F.when(F.col("id") % 27 == 0, "cancel").when(F.col("id") % 2 == 0, "defer_to_date").otherwise("advance_to_date").alias("action"), F.when(F.col("id") % 2 == 0, F.col("last")).otherwise(F.col("first")).alias("target_date"))
    return governance.adjust(plan, days, stored(a, "adjustments"), CELL)


@query(f"""WITH {_CELLS}, {_PLAN}, v AS (SELECT fold_id, id, unnest([0, 1, 2]) AS replan_index, unnest(['original', 'adjusted', 'replanned']) AS version, status FROM plan WHERE id % 3 <> 1 UNION ALL SELECT fold_id, id, 0, 'original', status FROM plan WHERE id % 3 = 1)
 SELECT fold_id, id, version, replan_index FROM (SELECT *, row_number() OVER (PARTITION BY fold_id, id ORDER BY replan_index DESC) AS n FROM v) WHERE n = 1""")
def latest_version(spark, sf_dir):
    """The last version of every planned row: original, adjusted, replanned."""
    plan = _plan(spark, sf_dir)[1].select("fold_id", "id", "status")
    versions = [plan, plan.where("id % 3 <> 1"), plan.where("id % 3 <> 1")]
    return scheduling.latest(scheduling.versioned(versions, ["original", "adjusted", "replanned"]), ["fold_id", "id"]).select("fold_id", "id", "version", "replan_index")


@query(f"""WITH {_CELLS}, {_alloc_sql()} SELECT fold_id, area, id, CAST(row_number() OVER (PARTITION BY fold_id, area ORDER BY model_rank, id) AS INTEGER) AS visit FROM dec WHERE mechanism <> 'not_selected'""")
def risk_first_order(spark, sf_dir):
    return scheduling.risk_first(decided(spark, sf_dir).where("is_selected"), ["fold_id", "area"]).select("fold_id", "area", "id", "visit")


@query(f"""WITH {_CELLS}, {_PLAN}, p AS (SELECT plan.*, area FROM plan JOIN cells USING (fold_id, id)) SELECT fold_id, area, count(*) AS n, count(*) FILTER (WHERE p.status = 'scheduled') AS n_scheduled, min(final_rank)::INTEGER AS best_rank, min(slot_date) AS first_date, max(slot_date) AS last_date FROM p GROUP BY ALL""")
def block_summary(spark, sf_dir):
    plan = _plan(spark, sf_dir)[1]
    return plan.groupBy("fold_id", "area").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "scheduled").alias("n_scheduled"), F.min("final_rank").alias("best_rank"), F.min("slot_date").alias("first_date"), F.max("slot_date").alias("last_date"))


@query(f"""WITH {_INSP}, g AS (SELECT t.inspection_id, t.d, max(h.d) AS s FROM insp t LEFT JOIN insp h ON h.establishment_id = t.establishment_id AND h.d < t.d AND h.results IS NOT NULL GROUP BY ALL)
 SELECT count(*) AS n, count(s) AS n_with_source, count(*) FILTER (WHERE s >= d) AS n_violations FROM g""")
def group_source_validity(spark, sf_dir):
    """Group sources must predate the row: counts of those that do not."""
    t = asof.last_attribute(targets(spark, sf_dir), records(spark, sf_dir), "results")
    return t.agg(F.count("*").alias("n"), F.count("days_since_source").alias("n_with_source"), F.count_if(F.col("days_since_source") <= 0).alias("n_violations"))


# --- operational path -----------------------------------------------------------------

_OPS = f"""cand AS (SELECT establishment_id, count(*) FILTER (WHERE kind = 'CANVASS') AS nc, count(*) FILTER (WHERE kind = 'CANVASS' AND d >= DATE '{ERA}') AS ne, date_diff('day', max(d), DATE '{PLANNING}') AS days, count(*) FILTER (WHERE kind LIKE '%COMPLAINT%') AS complaints FROM insp WHERE d < DATE '{PLANNING}' GROUP BY 1),
 sc AS (SELECT *, CASE WHEN establishment_id % 31 <> 0 THEN round(1 / (1 + exp(-(0.3 * complaints + days / 1000.0 - 1))), 9) END AS score FROM cand),
 rk AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY score IS NULL ORDER BY score DESC, establishment_id) END AS operational_rank FROM sc)"""


def _operational(spark, sf_dir):
    h = inspections(spark, sf_dir)
    u = asof.universe(records(spark, sf_dir), PLANNING).select(F.col("candidate_id").alias("target_id"), "establishment_id", F.lit(PLANNING).cast("date").alias("t"), F.col("last_name").alias("current_name"))
    f = asof.features(u, h, ERA)
    z = 0.3 * F.col("prior_complaint_count") + F.col("days_since_any_inspection") / 1000.0 - 1
    score = F.when(F.col("establishment_id") % 31 != 0, F.round(1 / (1 + F.exp(-z)), 9))
    return operational.ranked(f.withColumn("score", score), "establishment_id")


@query(f"WITH {_INSP}, {_OPS} SELECT establishment_id, score, CASE WHEN score IS NULL THEN 'missing_score' ELSE 'scored' END AS scoring_status, operational_rank FROM rk")
def operational_scores(spark, sf_dir):
    """Candidates at the planning date with a score, their rank, or why they have none."""
    return _operational(spark, sf_dir).select("establishment_id", "score", "scoring_status", "operational_rank")


@query(f"""WITH {_INSP}, {_OPS}, s AS (SELECT *, ne = 0 AS eligible, operational_rank <= 50 - 10 AS risk FROM rk WHERE score IS NOT NULL), z AS (SELECT *, sum(CASE WHEN NOT risk AND eligible THEN 1 ELSE 0 END) OVER (ORDER BY operational_rank ROWS UNBOUNDED PRECEDING) AS below, sum(CAST(eligible AS INTEGER)) OVER (ORDER BY operational_rank ROWS UNBOUNDED PRECEDING) AS cum FROM s),
 tot AS (SELECT count(*) AS n, sum(CAST(eligible AS INTEGER)) AS total FROM s), g AS (SELECT coalesce(max(50 - operational_rank), 0) AS g FROM z, tot WHERE operational_rank <= least(50, n) AND 50 - operational_rank <= 10 AND total - cum >= 50 - operational_rank),
 y AS (SELECT s.*, g, operational_rank <= 50 - g AS r2 FROM s, g), w AS (SELECT *, sum(CASE WHEN NOT r2 AND eligible THEN 1 ELSE 0 END) OVER (ORDER BY operational_rank ROWS UNBOUNDED PRECEDING) AS b2 FROM y)
 SELECT establishment_id, CASE WHEN r2 THEN 'risk_priority' WHEN eligible AND b2 <= g THEN 'coverage_reserve' ELSE 'not_selected' END AS mechanism, CASE WHEN r2 THEN 'selected_by_risk_rank' WHEN eligible AND b2 <= g THEN 'selected_by_coverage_reserve' WHEN eligible THEN 'not_selected_reserve_exhausted' ELSE 'not_selected_capacity_exhausted' END AS reason,
  CASE WHEN r2 THEN operational_rank::INTEGER WHEN eligible AND b2 <= g THEN (50 - g + b2)::INTEGER END AS policy_rank FROM w UNION ALL SELECT establishment_id, 'not_selected', 'excluded_unscorable', NULL FROM rk WHERE score IS NULL""")
def operational_selection(spark, sf_dir):
    """Fifty candidates under a forced reserve of a fifth; those without a score are marked."""
    rows = _operational(spark, sf_dir).withColumn("eligible", F.col("prior_canvass_count_code_era") == 0)
    return operational.select(rows, "establishment_id", 50, 0.2, True).select("establishment_id", "mechanism", "reason", "policy_rank")
