"""Queries on explanations, encodings, tuning, broken decisions, group spans and service."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import calibrate, contracts, encode, explain, geo, scheduling
from ..shared import stored
from ..sources.tables import inspections
from .catalogue import _BOOLEANS, _CELLS, _COLUMNS, _FAMILIES, _FOLDS, _INSP, _KM, _PLAN, _XY, CELL, FIRST, POLICIES, ORACLES, _alloc_sql, _coordinates, _plan, _xy, cells, decided, fold_table_of, query
from .operations import _U

# --- explanations ---------------------------------------------------------------------

#: Explained rows and background rows a fold; the sampling operators' own parameters.
SAMPLE, BACKGROUND, SEED = 25, 8, 42

_DRAW = f"((((id % {_U} * 48271 + {SEED} * 69621 + 11) % {_U}) * ((id % {_U} * 48271 + {SEED} * 69621 + 11) % {_U}) + 7) % {_U} * 16807) % {_U}"
_TRAIN = "tr AS (SELECT f.fold_id, inspection_id AS id, score, entries FROM insp JOIN folds f ON d BETWEEN f.train_start AND f.train_end)"
_BG = f"{_TRAIN}, bg AS MATERIALIZED (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY {_DRAW}, id) <= {BACKGROUND})"


def _training(spark, sf_dir):
    f = F.broadcast(fold_table_of(spark).select("fold_id", "train_start", "train_end"))
    i = inspections(spark, sf_dir).select(F.col("inspection_id").alias("id"), "d", "score", "entries", "establishment_id", "area", "label")
    return i.join(f, F.col("d").between(F.col("train_start"), F.col("train_end"))).drop("train_start", "train_end")


@query(f"WITH {_CELLS} SELECT fold_id, id FROM cells QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY {_DRAW}, id) <= {SAMPLE}")
def explanation_sample(spark, sf_dir):
    """A seeded sample of every test window; label and score take no part in the draw."""
    return explain.seeded_sample(cells(spark, sf_dir).select("fold_id", "id"), CELL, SAMPLE, SEED)


@query(f"WITH {_INSP}, {_FOLDS}, {_BG} SELECT bg.fold_id, count(*) AS n, count(*) FILTER (WHERE i.d > f.train_end) AS n_unsafe FROM bg JOIN insp i ON i.inspection_id = bg.id JOIN folds f USING (fold_id) GROUP BY 1")
def background_safety(spark, sf_dir):
    """Reference rows of every fold, and how many of them lie past its training window."""
    b = explain.seeded_sample(_training(spark, sf_dir), CELL, BACKGROUND, SEED)
    ends = F.broadcast(fold_table_of(spark).select("fold_id", "train_end"))
    return b.join(ends, "fold_id").groupBy("fold_id").agg(F.count("*").alias("n"), F.count_if(F.col("d") > F.col("train_end")).alias("n_unsafe"))


def _bent(x: np.ndarray) -> np.ndarray:
    """A model that is no sum of its columns: score and entries."""
    return 1 / (1 + np.exp(-(2 * x[:, 0] * x[:, 1] - x[:, 1] + x[:, 0])))


def _bent_sql(s: str, e: str) -> str:
    return f"1 / (1 + exp(-(2 * {s} * {e} - {e} + {s})))"


@query(f"""WITH {_CELLS}, {_BG}, x AS (SELECT c.fold_id, c.id, c.score AS s, i.entries::DOUBLE AS e, b.score AS bs, b.entries::DOUBLE AS be FROM cells c JOIN insp i ON i.inspection_id = c.id JOIN bg b ON b.fold_id = c.fold_id),
 v AS (SELECT fold_id, id, {_bent_sql("s", "e")} AS joint, {_bent_sql("s", "be")} AS only_s, {_bent_sql("bs", "e")} AS only_e, {_bent_sql("bs", "be")} AS neither FROM x),
 a AS (SELECT fold_id, id, avg((only_s - neither + joint - only_e) / 2) AS vs, avg((only_e - neither + joint - only_s) / 2) AS ve FROM v GROUP BY ALL)
 SELECT fold_id, id, unnest(['score', 'entries']) AS feature, round(unnest([vs, ve]), 6) + 0.0 AS value FROM a""")
def permutation_attributions(spark, sf_dir):
    """Antithetic walks of a model of two columns over all test rows; two columns make them exact."""
    rows = cells(spark, sf_dir).select("fold_id", "id", "score").join(inspections(spark, sf_dir).select(F.col("inspection_id").alias("id"), "entries"), "id")
    b = explain.seeded_sample(_training(spark, sf_dir), CELL, BACKGROUND, SEED)
    out = explain.permutation_attributions(rows, "fold_id", ["score", "entries"], b, _bent)
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query()
def tree_attributions(spark, sf_dir):
    """Exact tree values of the last fold's boosted model for its test rows."""
    last = fold_table_of(spark).orderBy(F.desc("fold_id")).limit(1)
    data, used = calibrate.preprocessed(_xy(spark, sf_dir, last), "fold_id", _COLUMNS, _FAMILIES, _BOOLEANS)
    data = stored(data.select("fold_id", "id", "label", "split", *used), "preprocessed")
    model = calibrate.boosted_model(data.where("split = 'train'"), used)
    return explain.tree_attributions(model, data.where("split = 'test'"), "fold_id", used)


# --- tuning ---------------------------------------------------------------------------

#: Inverse penalties that are tried, and the one that ties fall to.
RATES, BASE_RATE = [0.01, 0.1, 1.0], 0.1
#: First days of the inner held-out quarters; all end before the first test window.
INNER = ["1997-07-01", "1998-01-01", "1998-07-01"]


@query()
def tuned_penalty(spark, sf_dir):
    """The strength of the logistic model, chosen on inner quarters before the first test window."""
    s = F.col("s").cast("date")
    inner = spark.createDataFrame([(f"inner_{d}", d) for d in INNER], "fold_id string, s string").select("fold_id", F.lit(FIRST).cast("date").alias("train_start"), F.date_sub(s, 1).alias("train_end"), s.alias("calibration_start"), F.date_sub(s, 1).alias("calibration_end"), s.alias("test_start"), F.date_sub(F.add_months(s, 3), 1).alias("test_end"))
    rows = stored(_xy(spark, sf_dir, inner).drop("calibration_start", "calibration_end"), "inner-rows")
    return calibrate.choose_rate(calibrate.penalty_sweep(rows, _COLUMNS, _FAMILIES, _BOOLEANS, RATES), BASE_RATE)


_SCORES = [(0.001, "a", 0.5), (0.001, "b", 0.7), (0.01, "a", 0.6), (0.01, "b", 0.5000004), (0.003, "a", 0.59999995), (0.003, "b", 0.6), (0.03, "a", 0.1), (0.03, "b", None)]


@query(f"""WITH s AS (SELECT * FROM (VALUES {", ".join(f"({r}::DOUBLE, '{f}', {'NULL' if v is None else v}::DOUBLE)" for r, f, v in _SCORES)}) AS t(rate, fold, score)), m AS (SELECT rate, avg(score) AS mean_score FROM s GROUP BY 1),
 t AS (SELECT *, abs(rate - 0.003) AS off FROM m WHERE (SELECT max(mean_score) FROM m) - mean_score <= 1e-6) SELECT rate, round(mean_score, 9) AS mean_score, (SELECT count(*) FROM t) AS n_tied FROM t ORDER BY off, rate LIMIT 1""")
def rate_choice(spark, sf_dir):
    """The best rate of a sweep; near ties go to the baseline."""
    out = calibrate.choose_rate(spark.createDataFrame(_SCORES, "rate double, fold string, score double"), 0.003)
    return out.withColumn("mean_score", F.round("mean_score", 9))


# --- encodings ------------------------------------------------------------------------

_KINDS = ["chain", "area"]
_CATS = """cat AS MATERIALIZED (SELECT f.fold_id, inspection_id AS id, CASE WHEN d <= f.train_end THEN 'train' ELSE 'test' END AS split, 'E' || CAST(establishment_id AS VARCHAR) AS chain, CASE WHEN inspection_id % 29 <> 0 THEN CAST(area AS VARCHAR) END AS area, label
   FROM insp JOIN folds f ON d BETWEEN f.train_start AND f.train_end OR d BETWEEN f.test_start AND f.test_end),
 voc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fold_id, "column" ORDER BY category) AS code FROM (SELECT DISTINCT fold_id, unnest(['chain', 'area']) AS "column", unnest([chain, area]) AS category FROM cat WHERE split = 'train') WHERE category IS NOT NULL),
 cod AS MATERIALIZED (SELECT c.*, coalesce(v.code, 0) AS code_chain, coalesce(w.code, 0) AS code_area FROM cat c LEFT JOIN voc v ON v.fold_id = c.fold_id AND v."column" = 'chain' AND v.category = c.chain LEFT JOIN voc w ON w.fold_id = c.fold_id AND w."column" = 'area' AND w.category = c.area WHERE split = 'test')"""


def _categories(spark, sf_dir):
    s = numbers.split_of(inspections(spark, sf_dir), fold_table_of(spark)).where("split <> 'calibration'")
    area = F.when(F.col("inspection_id") % 29 != 0, F.col("area").cast("string"))
    return s.select("fold_id", F.col("inspection_id").alias("id"), "split", F.concat(F.lit("E"), F.col("establishment_id").cast("string")).alias("chain"), area.alias("area"), "label")


def _coded(spark, sf_dir):
    c = stored(_categories(spark, sf_dir), "categories")
    vocab = stored(encode.vocabulary(c.where("split = 'train'"), CELL, _KINDS), "vocabulary")
    return c, vocab, encode.codes(c.where("split = 'test'"), CELL, _KINDS, vocab)


@query(f"""WITH {_INSP}, {_FOLDS}, {_CATS}, n AS (SELECT fold_id, count(*) FILTER (WHERE "column" = 'chain') + 1 AS nc, count(*) FILTER (WHERE "column" = 'area') + 1 AS na FROM voc GROUP BY 1)
 SELECT fold_id, id, CAST(code_chain AS INTEGER) AS code_chain, CAST(code_area AS INTEGER) AS code_area, CAST(code_chain AS VARCHAR) || ' ' || CAST(nc + code_area AS VARCHAR) AS ones, CAST(nc + na AS INTEGER) AS width FROM cod JOIN n USING (fold_id)""")
def category_codes(spark, sf_dir):
    """Test rows with the codes that training gave their categories, and where their ones are."""
    _, vocab, coded = _coded(spark, sf_dir)
    out = encode.one_hot(coded, CELL, _KINDS, vocab)
    return out.select("fold_id", "id", "code_chain", "code_area", F.array_join("ones", " ").alias("ones"), "width")


@query(f"""WITH {_INSP}, {_FOLDS}, {_CATS} SELECT fold_id, unnest(['chain', 'area']) AS "column", round(unnest([c, a]), 6) AS rate FROM (SELECT fold_id, avg(CAST(code_chain = 0 AS INTEGER)) AS c, avg(CAST(code_area = 0 AS INTEGER)) AS a FROM cod GROUP BY 1)""")
def unseen_rates(spark, sf_dir):
    """The share of test rows whose category training did not see."""
    return encode.unseen_rate(_coded(spark, sf_dir)[2], CELL, _KINDS).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_INSP}, {_FOLDS}, {_CATS}, dn AS (SELECT c.fold_id, v.code, avg(label) AS x, count(*)::DOUBLE AS y FROM cat c JOIN voc v ON v.fold_id = c.fold_id AND v."column" = 'area' AND v.category = c.area WHERE split = 'train' AND v.code % 5 <> 0 GROUP BY ALL),
 sp AS (SELECT fold_id, avg(label) AS x, count(*)::DOUBLE AS y FROM cat WHERE split = 'train' GROUP BY 1)
 SELECT c.fold_id, c.id, round(coalesce(dn.x, sp.x), 6) AS area_emb_00, coalesce(dn.y, sp.y) AS area_emb_01 FROM cod c JOIN sp USING (fold_id) LEFT JOIN dn ON dn.fold_id = c.fold_id AND dn.code = c.code_area""")
def embedding_lookup(spark, sf_dir):
    """Donor vectors by code; unseen categories take the donor's vector for unknown ones.

    The donor here is a table of label means and counts in place of a network's embedding.
    """
    c, vocab, coded = _coded(spark, sf_dir)
    train = c.where("split = 'train'")
    vector = F.array(F.avg("label"), F.count("*").cast("double")).alias("vector")
    known = encode.codes(train, CELL, ["area"], vocab).where("code_area > 0 and code_area % 5 <> 0").groupBy("fold_id", F.col("code_area").alias("code")).agg(vector)
    spare = train.groupBy("fold_id").agg(vector).select("fold_id", F.lit(encode.UNKNOWN).alias("code"), "vector")
    out = encode.looked_up(coded, CELL, "area", known.unionByName(spare), 2)
    return out.select("fold_id", "id", F.round("area_emb_00", 6).alias("area_emb_00"), "area_emb_01")


# --- checks on broken decisions -------------------------------------------------------

_BROKEN = f"""d AS MATERIALIZED (SELECT policy_id, fold_id, id, mechanism, sel, CASE WHEN id % 83 = 0 THEN 'selected_by_risk_rank' ELSE reason END AS reason, CASE WHEN sel AND id % 97 = 0 THEN fr + 1 WHEN NOT sel AND id % 89 = 0 THEN 1 ELSE fr END AS fr FROM (
   SELECT policy_id, fold_id, id, mechanism, mechanism <> 'not_selected' AS sel, CASE WHEN mechanism = 'risk_priority' THEN 'selected_by_risk_rank' WHEN mechanism = 'coverage_reserve' THEN 'selected_by_coverage_reserve' WHEN eligible THEN 'not_selected_reserve_exhausted' ELSE 'not_selected_capacity_exhausted' END AS reason,
    CASE WHEN mechanism <> 'not_selected' THEN row_number() OVER (PARTITION BY policy_id, fold_id ORDER BY (mechanism = 'risk_priority') DESC, (mechanism = 'coverage_reserve') DESC, model_rank) END AS fr FROM dec))"""


@query(f"""WITH {_CELLS}, {_alloc_sql(POLICIES)}, {_BROKEN}
 SELECT 'mechanism_fits_reason' AS check_name, count(*) AS violations FROM d WHERE CASE mechanism WHEN 'risk_priority' THEN reason <> 'selected_by_risk_rank' WHEN 'coverage_reserve' THEN reason <> 'selected_by_coverage_reserve' ELSE reason NOT LIKE 'not_selected_%' END
 UNION ALL SELECT 'selected_by_a_selected_reason', count(*) FROM d WHERE sel <> (reason LIKE 'selected_%') UNION ALL SELECT 'unselected_have_no_rank', count(*) FROM d WHERE NOT sel AND fr IS NOT NULL
 UNION ALL SELECT 'ranks_unique_and_contiguous', count(*) FROM (SELECT 1 FROM d WHERE sel GROUP BY policy_id, fold_id HAVING list_sort(list(fr)) <> generate_series(1, count(*)))""")
def policy_checks_on_broken(spark, sf_dir):
    """The checks of a decided queue, on decisions broken by id: they must count what was broken."""
    s, i = F.col("is_selected"), F.col("id")
    d = decided(spark, sf_dir, POLICIES)
    d = d.withColumn("reason", F.when(i % 83 == 0, "selected_by_risk_rank").otherwise(F.col("reason"))).withColumn("final_rank", F.when(s & (i % 97 == 0), F.col("final_rank") + 1).when(~s & (i % 89 == 0), F.lit(1)).otherwise(F.col("final_rank")))
    d = stored(d, "broken")
    n = d.groupBy("policy_id", "fold_id").agg(F.count("*").alias("n_universe"))
    found = contracts.policy_violations(d, n, ["policy_id", *CELL])
    return contracts.violations({k: found[k] for k in ("mechanism_fits_reason", "selected_by_a_selected_reason", "unselected_have_no_rank", "ranks_unique_and_contiguous")})


# --- geography and service ------------------------------------------------------------


@query(f"""WITH g AS MATERIALIZED ({ORACLES["geo_groups"]}), {_XY} m AS MATERIALIZED (SELECT g.area, xy.* FROM g JOIN xy USING (id)),
 p AS (SELECT a.area, {_KM} AS km FROM m a JOIN m b ON a.area = b.area AND a.id < b.id), s AS (SELECT area, max(km) AS x, avg(km) AS y FROM p GROUP BY 1)
 SELECT area, n, round(coalesce(x, 0), 5) AS max_km, round(coalesce(y, 0), 5) AS avg_km FROM (SELECT area, count(*) AS n FROM m GROUP BY 1) LEFT JOIN s USING (area)""")
def group_spans(spark, sf_dir):
    """The widest and the mean distance inside every group of near places."""
    xy = _coordinates(spark, sf_dir)
    m = geo.groups(xy, 1.5).select("id", "area").join(xy, "id")
    return geo.group_spans(stored(m, "members"), "area").withColumns({c: F.round(c, 5) for c in ("max_km", "avg_km")})


@query(f"""WITH {_CELLS}, {_PLAN}, qp AS (SELECT que.fold_id, que.id, mechanism = 'coverage_reserve' AS res, plan.status = 'scheduled' AS sch, plan.final_rank AS r, day_index - 1 AS wt FROM que LEFT JOIN plan USING (fold_id, id)),
 sv AS (SELECT fold_id, count(*) AS n_queued, count(*) FILTER (WHERE sch) AS n_scheduled, round(avg(wt), 6) AS mean_wait, median(wt) AS median_wait, CAST(max(wt) AS INTEGER) AS max_wait, CAST(max(r) FILTER (WHERE sch) AS INTEGER) AS worst_scheduled_rank, CAST(min(r) FILTER (WHERE NOT sch) AS INTEGER) AS best_backlogged_rank, count(*) FILTER (WHERE res) AS n_reserve_recommended, count(*) FILTER (WHERE res AND sch) AS n_reserve_scheduled FROM qp GROUP BY 1)
 SELECT *, round(n_scheduled / n_queued, 6) AS queue_coverage, round(coalesce(n_reserve_scheduled / nullif(n_scheduled, 0), 0) - n_reserve_recommended / n_queued, 6) AS reserve_share_delta, n_reserve_recommended - n_reserve_scheduled AS reserve_slots_lost FROM sv""")
def plan_service(spark, sf_dir):
    """Waits, reach and reserve of every fold's plan."""
    plan = _plan(spark, sf_dir)[1]
    out = scheduling.service(plan, plan.select("fold_id", "id", "mechanism"), CELL)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_wait", "queue_coverage", "reserve_share_delta")})
