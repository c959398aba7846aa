"""All queries of the engine by name, and the SQL that gives the same rows.

Every query runs over its whole tables.  Domain roles are played by the star schema (see
``sources.tables``); ``cells`` are the test windows of the rolling-origin folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import asof, audit, calibrate, entity, geo, governance, policy, ranking, scheduling, stability, uncertainty
from ..operators.graph import connected_components
from ..shared import stored
from ..sources.tables import inspections, manifest, records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ERA, FIRST, LAST = "1996-07-01", "1995-01-01", "2001-07-31"
PLANNING = "2000-01-01"
CELL = ["fold_id"]
K = 40
POLICIES = [("pure_risk", 0.0, False), ("floor_05", 0.05, False), ("floor_10", 0.10, False), ("floor_20", 0.20, False), ("forced_05", 0.05, True), ("forced_10", 0.10, True), ("forced_20", 0.20, True)]

_INSP = """flags AS MATERIALIZED (
  SELECT l_orderkey, bool_or(l_returnflag = 'R') AS priority, bool_or(l_returnflag = 'A') AS foundation, count(*) AS entries FROM lineitem GROUP BY 1
), insp AS MATERIALIZED (
  SELECT o_orderkey AS inspection_id, o_custkey AS establishment_id, CAST(o_orderdate AS DATE) AS d,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'COMPLAINT' WHEN '2-HIGH' THEN 'CANVASS RE-INSPECTION' WHEN '3-MEDIUM' THEN 'CANVASS' WHEN '4-NOT SPECIFIED' THEN 'OTHER' WHEN '5-LOW' THEN 'LICENSE' END AS kind,
    CASE o_orderstatus WHEN 'F' THEN 'Fail' WHEN 'O' THEN 'No Entry' WHEN 'P' THEN 'Pass w/ Conditions' END AS results,
    'NAME ' || CAST(o_orderkey % 3 AS VARCHAR) AS name, o_totalprice / 500000 AS score, c_nationkey AS area,
    coalesce(priority, false) AS priority, coalesce(foundation, false) AS foundation, coalesce(entries, 0) AS entries, CAST(coalesce(priority, false) AS INTEGER) AS label
  FROM orders LEFT JOIN flags ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
)"""
_FOLDS = f"""folds AS (
  SELECT CAST(year(ts) AS VARCHAR) || 'Q' || CAST(quarter(ts) AS VARCHAR) AS fold_id, DATE '{FIRST}' AS train_start, CAST(cs - INTERVAL 1 DAY AS DATE) AS train_end,
    cs AS calibration_start, CAST(ts - INTERVAL 1 DAY AS DATE) AS calibration_end, ts AS test_start, te AS test_end
  FROM (SELECT cs, CAST(cs + INTERVAL 3 MONTH AS DATE) AS ts, CAST(cs + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS te
        FROM (SELECT CAST(s + INTERVAL 42 MONTH AS DATE) AS cs FROM (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 3 MONTH)) AS s)))
  WHERE te <= DATE '{LAST}'
)"""
_CELLS = f"""{_INSP}, {_FOLDS}, hist AS (
  SELECT t.inspection_id, count(h.inspection_id) FILTER (WHERE h.kind = 'CANVASS' AND h.d >= DATE '{ERA}') AS nc FROM insp t LEFT JOIN insp h ON h.establishment_id = t.establishment_id AND h.d < t.d GROUP BY 1
), cells AS MATERIALIZED (
  SELECT f.fold_id, i.inspection_id AS id, i.establishment_id, i.d, i.score, i.label, i.area, i.name, (nc = 0) AS eligible
  FROM insp i JOIN folds f ON i.d BETWEEN f.test_start AND f.test_end JOIN hist USING (inspection_id)
)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def fold_table_of(spark: SparkSession) -> DataFrame:
    return numbers.folds(spark, FIRST, LAST)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every test window; eligible means no earlier canvass of the place in the code era."""
    f = F.broadcast(fold_table_of(spark).select("fold_id", "test_start", "test_end"))
    t = inspections(spark, sf_dir).join(f, F.col("d").between(F.col("test_start"), F.col("test_end")))
    h = records(spark, sf_dir).where((F.col("kind") == "CANVASS") & (F.col("d") >= F.lit(ERA).cast("date"))).groupBy("establishment_id").agg(F.min("d").alias("first_canvass"))
    t = t.join(h, "establishment_id", "left")
    return t.select("fold_id", F.col("inspection_id").alias("id"), "establishment_id", "d", "score", "label", "area", "name", (F.col("first_canvass").isNull() | (F.col("first_canvass") >= F.col("d"))).alias("eligible"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("inspection_id").alias("target_id"), "establishment_id", F.col("d").alias("t"), F.col("name").alias("current_name"))


# --- named descriptive queries --------------------------------------------------------


@query("SELECT count(*) AS n FROM orders")
def q_row_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey IS NOT NULL")
def q_unique_licenses(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("n"))


@query("SELECT min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders")
def q_date_range(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"))


@query(f"WITH {_INSP} SELECT kind, count(*) AS n, count(*) FILTER (WHERE priority) AS n_priority FROM insp GROUP BY kind")
def q_type_counts(spark, sf_dir):
    return inspections(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("priority").alias("n_priority"))


@query(f"WITH {_INSP} SELECT results, count(*) AS n FROM insp GROUP BY results")
def q_result_counts(spark, sf_dir):
    return inspections(spark, sf_dir).groupBy("results").agg(F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20")
def q_top_facilities(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(20)


@query("SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS column_type FROM (DESCRIBE orders)")
def q_schema(spark, sf_dir):
    return spark.createDataFrame(table(spark, sf_dir, "orders").dtypes, "column_name string, column_type string")


@query()
def table_manifest(spark, sf_dir):
    return spark.createDataFrame([(t, manifest(table(spark, sf_dir, t))) for t in ("nation", "orders")], "name string, manifest string")


# --- scalars --------------------------------------------------------------------------

_RAW = "(VALUES (1, 'The O''Brien''s Café, Inc.', '1234-36 W. 51st St. Apt 2', '60601-1234', '0', '41.88', '-87.63'), (2, 'Joe & Sons LLC', '77 N State Ave', '6060', ' 12 ', '40.0', '-87.63'), (3, 'LLC', 'corner of 5th', '00000', '', 'x', '-87.6'), (4, NULL, '9 1/2 E Lake Dr Suite 4 unit 7', NULL, '77', NULL, '-87.7')) AS t(id, nm, addr, zip, lic, lat, lon)"


def _raw(spark: SparkSession) -> DataFrame:
    rows = [(1, "The O'Brien's Café, Inc.", "1234-36 W. 51st St. Apt 2", "60601-1234", "0", "41.88", "-87.63"), (2, "Joe & Sons LLC", "77 N State Ave", "6060", " 12 ", "40.0", "-87.63"), (3, "LLC", "corner of 5th", "00000", "", "x", "-87.6"), (4, None, "9 1/2 E Lake Dr Suite 4 unit 7", None, "77", None, "-87.7")]
    return spark.createDataFrame(rows, "id int, nm string, addr string, zip string, lic string, lat string, lon string")


# The SQL has lists of its own, so that a slip in the functions' lists shows.
_LEGAL = "LLC|L L C|INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LP|LLP|PC|PLLC|DBA"
_UNITS = "SUITE|STE|APARTMENT|APT|UNIT|ROOM|RM|FLOOR|FL|BUILDING|BLDG|BASEMENT|BSMT|SPACE|SPC|REAR|LL"


@query(rf"""WITH a AS (SELECT id, zip, lic, lat, lon, addr, trim(regexp_replace(regexp_replace(replace(regexp_replace(upper(strip_accents(nm)), '''S\b', 'S', 'g'), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS s FROM {_RAW}),
 b AS (SELECT *, regexp_replace(regexp_replace(s, '( ({_LEGAL}))+$', ''), '^(THE )+', '') AS c, substr(regexp_replace(zip, '[^0-9]', '', 'g'), 1, 5) AS z FROM a)
 SELECT id, CASE WHEN c = '' THEN s ELSE c END AS name_key, CASE WHEN length(z) = 5 AND z <> '00000' THEN z END AS zip_key, nullif(nullif(trim(lic), ''), '0') AS licence_key,
  list_aggregate(list_sort(list_distinct(regexp_extract_all(upper(addr), '\b(?:{_UNITS})\b\.?\s*([A-Z0-9][A-Z0-9\-]*)', 1))), 'string_agg', ' ') AS units0,
  CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing' WHEN TRY_CAST(lat AS DOUBLE) IS NULL OR TRY_CAST(lon AS DOUBLE) IS NULL THEN 'unreadable' WHEN NOT (TRY_CAST(lat AS DOUBLE) BETWEEN 41.6 AND 42.1 AND TRY_CAST(lon AS DOUBLE) BETWEEN -87.95 AND -87.5) THEN 'outside' ELSE lat || ',' || lon END AS geo_key FROM b""")
def name_keys(spark, sf_dir):
    return _raw(spark).select("id", text.name_key(F.col("nm")).alias("name_key"), text.zip_key(F.col("zip")).alias("zip_key"), text.licence_key(F.col("lic")).alias("licence_key"), F.nullif(text.units(F.col("addr")), F.lit("")).alias("units0"), text.geo_key(F.col("lat"), F.col("lon")).alias("geo_key"))


_SUFF = "ST|STREET|AVE|AVENUE|BLVD|BOULEVARD|RD|ROAD|DR|DRIVE|PL|PLACE|CT|COURT|PKWY|LN|LANE"


@query(rf"""WITH a AS (SELECT id, substr(regexp_replace(zip, '[^0-9]', '', 'g'), 1, 5) AS z, trim(regexp_replace(trim(regexp_replace(upper(addr), '\s+', ' ', 'g')), ' (?:{_UNITS})\b\.?\s*(?:[A-Z0-9][A-Z0-9\-]*)?', '', 'g')) AS s FROM {_RAW}),
 b AS (SELECT *, regexp_extract(s, '^([0-9]+)(?:-[0-9]+)?(?: 1/2)? ', 1) AS house, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^[0-9]+(?:-[0-9]+)?(?: 1/2)? +', ''), '^(N|S|E|W)(?:ORTH|OUTH|AST|EST)?\.? ', '\1 '), '\b([0-9]+)(?:ST|ND|RD|TH)\b', '\1', 'g'), ' (?:{_SUFF})\.?$', '') AS street FROM a)
 SELECT id, CASE WHEN house <> '' THEN house || '|' || trim(street) || '|' || CASE WHEN length(z) = 5 AND z <> '00000' THEN z ELSE '' END END AS address_key FROM b""")
def address_parts(spark, sf_dir):
    return _raw(spark).select("id", text.address_key(F.col("addr"), F.col("zip")).alias("address_key"))


@query("""SELECT c_custkey, sha256(coalesce(c_name, '') || chr(31) || coalesce(c_mktsegment, '') || chr(31) || CAST(c_nationkey AS VARCHAR)) AS signature FROM customer""")
def node_signature(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.signature(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("signature"))


@query("""WITH e AS (SELECT doc_id, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> '') AS e FROM documents)
 SELECT doc_id, CAST(len(e) AS BIGINT) AS n_entries, coalesce(list_sum(list_transform(e, lambda x: length(x))), 0)::BIGINT AS entry_chars FROM e""")
def text_entries(spark, sf_dir):
    e = F.transform(F.filter(F.transform(F.split("text", r"\|"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.length(x).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(e).cast("long").alias("n_entries"), F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x).alias("entry_chars"))


@query(r"""WITH c AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[.;|]'), lambda x: NOT regexp_matches(x, 'with|avec')) AS c FROM documents)
 SELECT doc_id, CASE WHEN len(list_filter(c, lambda x: regexp_matches(x, 'ing the'))) > 0 THEN 'foundation' WHEN len(list_filter(c, lambda x: regexp_matches(x, 'tion'))) > 0 THEN 'priority' ELSE 'none' END AS severity,
  regexp_extract(text, '(?s)(.{0,30}tion.{0,60})', 1) AS evidence FROM c""")
def text_severity(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.severity(t, "ing the", "tion", "with|avec").alias("severity"), text.evidence(t, "tion").alias("evidence"))


@query(f"""WITH {_INSP} SELECT inspection_id, kind = 'CANVASS' AS is_canvass, kind LIKE '%COMPLAINT%' AS is_complaint, kind LIKE '%RE-INSPECTION%' AS is_reinspection, kind LIKE 'LICENSE%' AS is_license,
 CASE WHEN d < DATE '{ERA}' THEN 'pre_code' WHEN d < DATE '1997-01-01' THEN 'adoption' ELSE 'stable' END AS phase, CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS quarter,
 CASE WHEN d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN d BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'calibration' WHEN d BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'test' ELSE 'outside' END AS split FROM insp""")
def type_predicates(spark, sf_dir):
    k, d = F.col("kind"), F.col("d")
    split = F.when(d.between("1995-01-01", "1998-12-31"), "train").when(d.between("1999-01-01", "1999-12-31"), "calibration").when(d.between("2000-01-01", "2000-12-31"), "test").otherwise("outside")
    return inspections(spark, sf_dir).select("inspection_id", (k == "CANVASS").alias("is_canvass"), k.like("%COMPLAINT%").alias("is_complaint"), k.like("%RE-INSPECTION%").alias("is_reinspection"), k.like("LICENSE%").alias("is_license"), numbers.era_phase(d, ERA, "1997-01-01").alias("phase"), numbers.quarter_key(d).alias("quarter"), split.alias("split"))


@query("SELECT event_id, TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS d, TRY_CAST(substr(event_type, 1, 10) AS DATE) AS bad FROM events")
def date_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.read_date(F.col("ts").cast("string")).alias("d"), numbers.read_date(F.col("event_type")).alias("bad"))


@query(f"WITH {_INSP} SELECT a.inspection_id, a.name IS DISTINCT FROM b.name AS name_changed FROM insp a LEFT JOIN insp b ON b.inspection_id = a.inspection_id + 1")
def null_safe_name_change(spark, sf_dir):
    i = inspections(spark, sf_dir).select("inspection_id", "name")
    nxt = i.select((F.col("inspection_id") - 1).alias("inspection_id"), F.col("name").alias("next"))
    return i.join(nxt, "inspection_id", "left").select("inspection_id", (~F.col("name").eqNullSafe(F.col("next"))).alias("name_changed"))


@query(f"""WITH {_INSP}, p AS (SELECT inspection_id, least(greatest(score, 1e-6), 1 - 1e-6) AS q FROM insp)
 SELECT inspection_id, round(ln(q / (1 - q)), 5) AS logit, abs(1 / (1 + exp(-ln(q / (1 - q)))) - q) < 1e-9 AS back FROM p""")
def logit_round_trip(spark, sf_dir):
    z, q = numbers.logit(F.col("score")), numbers.clamped(F.col("score"))  # what comes back is the clamped score
    return inspections(spark, sf_dir).select("inspection_id", numbers.round_away(z, 5).alias("logit"), (F.abs(numbers.sigmoid(z) - q) < 1e-9).alias("back"))


# --- as-of ----------------------------------------------------------------------------

_LB = ", ".join(f"count(*) FILTER (WHERE c AND h.d >= t.d - INTERVAL {n} DAY) AS canvasses_last_{n}d, count(*) FILTER (WHERE e AND h.priority AND h.d >= t.d - INTERVAL {n} DAY) AS canvass_priority_events_last_{n}d" for n in asof.LOOK_BACKS)


@query(f"""WITH {_INSP}, p AS (
  SELECT t.inspection_id AS target_id, t.establishment_id, t.d AS t, t.name AS current_name, t.d, h.inspection_id AS hid, h.d AS hd, h.kind, h.results, h.name AS hname, h.priority, h.foundation,
    coalesce(h.kind = 'CANVASS', false) AS c, coalesce(h.kind = 'CANVASS' AND h.d >= DATE '{ERA}', false) AS e, coalesce(h.kind = 'CANVASS' AND h.results IN ('Fail', 'Pass', 'Pass w/ Conditions'), false) AS i
  FROM insp t LEFT JOIN insp h ON h.establishment_id = t.establishment_id AND h.d < t.d
), g AS (SELECT target_id, establishment_id, t, current_name, count(*) FILTER (WHERE c) AS prior_canvass_count, count(*) FILTER (WHERE e) AS prior_canvass_count_code_era, count(*) FILTER (WHERE i) AS prior_canvass_inspected_count,
  max(hd) FILTER (WHERE c) AS lc, count(*) FILTER (WHERE i AND results = 'Fail') AS prior_canvass_fail_count, count(*) FILTER (WHERE i AND results = 'Pass w/ Conditions') AS prior_canvass_pass_w_conditions_count,
  arg_max(results, (hd, hid)) FILTER (WHERE c AND results IS NOT NULL) AS lr, count(*) FILTER (WHERE e AND priority) AS pr, count(*) FILTER (WHERE e AND foundation) AS fo, arg_max(priority, (hd, hid)) FILTER (WHERE e) AS priority_at_last_canvass,
  count(hid) AS prior_inspection_count_any_type, max(hd) AS la, count(*) FILTER (WHERE kind LIKE '%COMPLAINT%') AS prior_complaint_count, count(*) FILTER (WHERE kind LIKE '%RE-INSPECTION%') AS prior_reinspection_count,
  count(*) FILTER (WHERE kind LIKE 'LICENSE%') AS prior_license_inspection_count, arg_max(hname, (hd, hid)) FILTER (WHERE c AND hname IS NOT NULL) AS ln_, count(*) FILTER (WHERE c AND hname IS NOT DISTINCT FROM current_name) AS prior_canvass_count_current_name, min(hd) AS fi,
  {_LB.replace('h.d', 'hd').replace('h.priority', 'priority').replace('t.d', 't')}
  FROM p GROUP BY ALL)
 SELECT * EXCLUDE (current_name, lc, lr, pr, fo, la, ln_, fi), date_diff('day', lc, t) AS days_since_last_canvass, CASE WHEN prior_canvass_inspected_count > 0 THEN prior_canvass_fail_count / prior_canvass_inspected_count END AS prior_canvass_fail_rate,
  CASE WHEN prior_canvass_count > 0 THEN lr = 'Fail' END AS fail_at_last_canvass, CASE WHEN prior_canvass_count_code_era > 0 THEN pr END AS prior_canvass_priority_count, CASE WHEN prior_canvass_count_code_era > 0 THEN fo END AS prior_canvass_priority_foundation_count,
  CASE WHEN prior_canvass_count_code_era > 0 THEN pr / prior_canvass_count_code_era END AS prior_canvass_priority_rate, date_diff('day', la, t) AS days_since_any_inspection,
  CASE WHEN prior_canvass_count > 0 THEN ln_ IS DISTINCT FROM current_name END AS name_changed_since_last_canvass, date_diff('day', fi, t) AS days_since_first_inspection FROM g""")
def asof_features(spark, sf_dir):
    return asof.features(targets(spark, sf_dir), inspections(spark, sf_dir), ERA)


@query(f"""WITH {_INSP}, g AS (SELECT t.inspection_id AS target_id, t.establishment_id, t.d AS t, arg_max((CAST(h.inspection_id AS VARCHAR), h.results, h.d), (h.d, CAST(h.inspection_id AS VARCHAR))) FILTER (WHERE h.results IS NOT NULL) AS l
  FROM insp t LEFT JOIN insp h ON h.establishment_id = t.establishment_id AND h.d < t.d GROUP BY 1, 2, 3)
 SELECT target_id, establishment_id, coalesce(l[2], '__UNKNOWN__') AS results, l[1] AS source_id, date_diff('day', l[3], t) AS days_since_source FROM g""")
def asof_last_attribute(spark, sf_dir):
    return asof.last_attribute(targets(spark, sf_dir), records(spark, sf_dir), "results")


@query("""SELECT t.event_id, count(h.event_id) AS n_before, round(coalesce(sum(h.value), 0), 4) AS value_before, count(h.event_id) FILTER (WHERE h.event_type = 'error') AS errors_before
 FROM events t LEFT JOIN events h ON h.user_id = t.user_id AND h.ts < t.ts GROUP BY t.event_id""")
def asof_events(spark, sf_dir):
    """History of a user strictly before an event: equal times are not history, so a range frame, not a row frame."""
    e = table(spark, sf_dir, "events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.count("event_id").over(w).alias("n_before"), F.round(F.coalesce(F.sum("value").over(w), F.lit(0.0)), 4).alias("value_before"), F.count(F.when(F.col("event_type") == "error", 1)).over(w).alias("errors_before"))


@query(f"""WITH {_INSP} SELECT 'CANDIDATE::{PLANNING}::' || CAST(establishment_id AS VARCHAR) AS candidate_id, establishment_id, count(*) AS prior_count, min(d) AS first_date, max(d) AS last_date,
 arg_max(name, (d, inspection_id)) AS last_name, arg_max(kind, (d, inspection_id)) AS last_kind FROM insp WHERE d < DATE '{PLANNING}' GROUP BY establishment_id""")
def candidate_universe(spark, sf_dir):
    return asof.universe(inspections(spark, sf_dir), PLANNING)


@query(f"""WITH {_INSP} SELECT establishment_id, count(*) FILTER (WHERE kind = 'CANVASS') AS prior_canvass_count, count(*) AS prior_inspection_count_any_type, date_diff('day', max(d), DATE '{PLANNING}') AS days_since_any_inspection
 FROM insp WHERE d < DATE '{PLANNING}' GROUP BY 1""")
def candidate_features(spark, sf_dir):
    h = inspections(spark, sf_dir)
    u = asof.universe(h, PLANNING).select(F.col("candidate_id").alias("target_id"), "establishment_id", F.lit(PLANNING).cast("date").alias("t"), F.col("last_name").alias("current_name"))
    return asof.features(u, h, ERA).select("establishment_id", "prior_canvass_count", "prior_inspection_count_any_type", "days_since_any_inspection")


@query(f"""WITH {_INSP} SELECT establishment_id, d, max(label) AS label, CAST(sum(entries) AS BIGINT) AS entries, count(*) AS n_records, coalesce(min(inspection_id) FILTER (WHERE label = 1), min(inspection_id)) AS target_id,
 string_agg(CAST(inspection_id AS VARCHAR), ' ' ORDER BY inspection_id) AS ids FROM insp GROUP BY 1, 2""")
def label_same_day(spark, sf_dir):
    return entity.collapse_same_day(inspections(spark, sf_dir))


# --- joins and set contracts ----------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def coverage_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS n_orders, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a
 FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def full_diff(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full")


@query(f"WITH {_INSP} SELECT establishment_id, d, count(*) AS n FROM insp GROUP BY 1, 2 HAVING count(*) > 1")
def dup_check(spark, sf_dir):
    return inspections(spark, sf_dir).groupBy("establishment_id", "d").agg(F.count("*").alias("n")).where("n > 1")


@query("""(SELECT 'missing' AS side, o_orderkey AS k FROM orders EXCEPT ALL SELECT 'missing', l_orderkey FROM lineitem WHERE l_linenumber = 1)
 UNION ALL (SELECT 'extra', l_orderkey FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT 'extra', o_orderkey FROM orders)""")
def set_difference(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "k").unionByName(b.exceptAll(a).select(F.lit("extra").alias("side"), "k"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_read(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND contains(o_orderpriority, 'URG')")
def scope_filter(spark, sf_dir):
    scope = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "absent": None}
    rows = table(spark, sf_dir, "orders")
    for column, value in scope.items():
        if value is not None and column in rows.columns:
            rows = rows.where(F.col(column) == value)
    return rows.where(F.contains("o_orderpriority", F.lit("URG"))).select("o_orderkey")


# --- entity resolution and graphs -----------------------------------------------------


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n % 20 + 1).cast("int"), F.lit(1))
    name = F.concat(F.lit("SHOP "), letter(k), F.when(k % 9 == 0, F.concat(F.lit(" "), (k % 3).cast("string"))).otherwise(""))
    aka = F.when(k % 11 == 0, F.concat(F.lit("SHOP "), letter(k + 1))).when(k % 13 == 0, F.concat(F.lit("SHOP "), letter(k), F.lit(" EXPRESS")))
    direction = F.when(k % 17 == 0, "N").when(k % 19 == 0, "S")
    zip_ = F.col("c_nationkey").cast("string")
    house = (k % 60).cast("int")
    lat, lon = 41.60 + (k % 30) / 1000, -87.90 + F.col("c_nationkey") / 1000
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), name.alias("name"), aka.alias("aka"), F.concat_ws("|", house.cast("string"), F.concat(F.coalesce(F.concat(direction, F.lit(" ")), F.lit("")), F.lit("MAIN")), zip_).alias("address"),
        (k % 75).cast("string").alias("licence"), house.alias("house"), F.lit("MAIN").alias("street"), zip_.alias("zip"), F.when(k % 7 == 0, k % 5).cast("string").alias("unit"), direction.alias("direction"),
        F.when(k % 6 != 0, F.concat(F.lit("F"), (k % 3).cast("string"))).alias("facility"), F.when(k % 4 != 0, lat).alias("lat"), F.when(k % 4 != 0, lon).alias("lon"))
    return rows.withColumn("geo", F.when(F.col("lat").isNotNull(), F.concat_ws("|", (F.col("id") % 30).cast("string"), "zip")))


_PLACES = """places AS MATERIALIZED (SELECT *, CASE WHEN lat IS NOT NULL THEN CAST(id % 30 AS VARCHAR) || '|' || zip END AS geo, CAST(house AS VARCHAR) || '|' || coalesce(direction || ' ', '') || 'MAIN' || '|' || zip AS address FROM (
  SELECT c_custkey AS id, 'SHOP ' || chr(CAST(65 + c_custkey % 20 AS INTEGER)) || CASE WHEN c_custkey % 9 = 0 THEN ' ' || CAST(c_custkey % 3 AS VARCHAR) ELSE '' END AS name,
    CASE WHEN c_custkey % 11 = 0 THEN 'SHOP ' || chr(CAST(65 + (c_custkey + 1) % 20 AS INTEGER)) WHEN c_custkey % 13 = 0 THEN 'SHOP ' || chr(CAST(65 + c_custkey % 20 AS INTEGER)) || ' EXPRESS' END AS aka,
    CAST(c_custkey % 75 AS VARCHAR) AS licence, CAST(c_custkey % 60 AS INTEGER) AS house, 'MAIN' AS street, CAST(c_nationkey AS VARCHAR) AS zip, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 5 AS VARCHAR) END AS unit,
    CASE WHEN c_custkey % 17 = 0 THEN 'N' WHEN c_custkey % 19 = 0 THEN 'S' END AS direction, CASE WHEN c_custkey % 6 <> 0 THEN 'F' || CAST(c_custkey % 3 AS VARCHAR) END AS facility,
    CASE WHEN c_custkey % 4 <> 0 THEN 41.60 + (c_custkey % 30) / 1000 END AS lat, CASE WHEN c_custkey % 4 <> 0 THEN -87.90 + c_nationkey / 1000 END AS lon FROM customer)),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON a.id < b.id AND a.licence = b.licence UNION SELECT a.id, b.id FROM places a JOIN places b ON a.id < b.id AND a.address = b.address
  UNION SELECT a.id, b.id FROM places a JOIN places b ON a.id < b.id AND a.geo = b.geo)"""

_SUB = lambda x, y: f"(len({x}) > 0 AND len({x}) < len({y}) AND list_has_all({y}, {x}))"
_SIGNALS = f"""crowded AS (SELECT geo FROM places WHERE geo IS NOT NULL AND address IS NOT NULL GROUP BY geo HAVING count(DISTINCT address) > 4),
tok AS (SELECT *, geo IN (SELECT geo FROM crowded) AS packed, list_filter([name, aka], lambda x: x IS NOT NULL) AS keys, list_distinct(string_split(name, ' ')) AS nt, coalesce(list_distinct(string_split(aka, ' ')), []) AS kt FROM places),
tk AS (SELECT *, list_filter(list_distinct(list_concat(nt, kt)), lambda x: regexp_full_match(x, '[0-9]+')) AS dg FROM tok),
sig AS MATERIALIZED (SELECT p.a, p.b, coalesce(x.licence = y.licence, false) AS same_license, coalesce(x.address = y.address, false) AS same_addr_key, coalesce(x.geo = y.geo AND NOT x.packed AND x.zip = y.zip, false) AS same_coord,
  coalesce(x.street = y.street AND x.zip = y.zip AND abs(x.house - y.house) BETWEEN 1 AND 2, false) AS near_addr, coalesce(x.zip = y.zip, false) AS same_zip, list_has_any(x.keys, y.keys) AS name_exact,
  {_SUB('x.nt', 'y.nt')} OR {_SUB('y.nt', 'x.nt')} OR {_SUB('x.nt', 'y.kt')} OR {_SUB('y.kt', 'x.nt')} OR {_SUB('x.kt', 'y.nt')} OR {_SUB('y.nt', 'x.kt')} OR {_SUB('x.kt', 'y.kt')} OR {_SUB('y.kt', 'x.kt')} AS name_containment,
  coalesce(x.aka IS NOT NULL AND y.aka IS NOT NULL AND NOT (list_contains(y.keys, x.aka) OR list_contains(x.keys, y.aka) OR {_SUB('x.kt', 'y.kt')} OR {_SUB('y.kt', 'x.kt')}), false) AS aka_conflict,
  len(x.dg) > 0 AND len(y.dg) > 0 AND NOT list_has_any(x.dg, y.dg) AS digit_conflict, coalesce(x.unit <> y.unit, false) AS unit_conflict, coalesce(x.direction <> y.direction, false) AS dir_conflict, x.facility = y.facility AS facility_agree
  FROM pairs p JOIN tk x ON x.id = p.a JOIN tk y ON y.id = p.b)"""
_VERDICTS = """ver AS MATERIALIZED (SELECT a, b, rule, rule IN ('S1', 'S2', 'S3') AS strong, rule IN ('S1', 'S2', 'S3', 'P1', 'P2') AS linked FROM (SELECT a, b, CASE WHEN dir_conflict THEN 'V1' WHEN unit_conflict AND NOT same_license THEN 'V2' WHEN digit_conflict AND NOT same_license THEN 'V3'
  WHEN (name_exact OR name_containment) AND aka_conflict AND NOT same_license THEN 'V4' WHEN same_license AND pl THEN 'S1' WHEN pl AND name_exact THEN 'S2' WHEN same_license AND near_addr AND name_exact THEN 'S3' WHEN same_license AND near_addr THEN 'P1'
  WHEN pl AND name_containment AND facility_agree IS DISTINCT FROM false THEN 'P2' WHEN same_license AND NOT pl AND NOT near_addr THEN 'A1' WHEN pl AND name_containment THEN 'A2' WHEN pl AND facility_agree THEN 'N2' WHEN pl THEN 'N1' ELSE 'N0' END AS rule
  FROM (SELECT *, same_addr_key OR same_coord AS pl FROM sig)))"""


_BLOCKS = ["licence", "address", "geo"]


@query(f"WITH {_PLACES} SELECT a, b FROM pairs")
def block_pairs(spark, sf_dir):
    # As in SQL, without a limit: a pair in a large block is a pair.
    return entity.block_pairs(_places(spark, sf_dir), _BLOCKS, None)[0]


@query(f"""WITH {_PLACES}, l AS (SELECT unnest(['licence', 'address', 'geo']) AS kind, unnest([licence, address, geo]) AS value FROM places), s AS (SELECT kind, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)
 SELECT kind, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS n_alone, count(*) FILTER (WHERE n > 5000) AS n_over FROM s GROUP BY kind""")
def block_sizes(spark, sf_dir):
    """Blocks by kind, with the number above the reference's limit of 5,000 rows."""
    return entity.block_summary(_places(spark, sf_dir), _BLOCKS)


@query(f"WITH {_PLACES} SELECT geo, count(DISTINCT address) AS n_addresses FROM places WHERE geo IS NOT NULL GROUP BY geo HAVING count(DISTINCT address) > 4")
def crowded_coordinates(spark, sf_dir):
    return entity.crowded_coordinates(_places(spark, sf_dir))


@query(f"WITH {_PLACES}, {_SIGNALS} SELECT * FROM sig")
def pair_signals(spark, sf_dir):
    return entity.block_signals(_places(spark, sf_dir), _BLOCKS)


@query(f"WITH {_PLACES}, {_SIGNALS}, {_VERDICTS} SELECT * FROM ver")
def pair_verdicts(spark, sf_dir):
    return entity.block_verdicts(_places(spark, sf_dir), _BLOCKS)


def _invariant_sql(name: str, members: str) -> str:
    """Violations of every cluster of a table of ``id, cluster``."""
    return f"""{name}_m AS MATERIALIZED (SELECT m.cluster, p.* FROM {members} m JOIN places p USING (id)),
 {name}_s AS (SELECT DISTINCT cluster, lat, lon FROM {name}_m WHERE lat IS NOT NULL),
 {name}_w AS (SELECT DISTINCT a.cluster FROM {name}_s a JOIN {name}_s b USING (cluster) WHERE {_KM} * 1000 > 2000),
 {name} AS MATERIALIZED (SELECT cluster, concat_ws('+', CASE WHEN na > 4 THEN 'too_many_addresses' END, CASE WHEN nz > 1 THEN 'too_many_zips' END, CASE WHEN nu > 1 THEN 'conflicting_units' END, CASE WHEN nd > 1 THEN 'conflicting_directionals' END,
   CASE WHEN na <= 4 AND cluster IN (SELECT cluster FROM {name}_w) THEN 'geographic_spread' END) AS violations
   FROM (SELECT cluster, count(DISTINCT address) AS na, count(DISTINCT zip) AS nz, count(DISTINCT unit) AS nu, count(DISTINCT direction) AS nd FROM {name}_m GROUP BY 1))"""


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_FIRST = f"""{_PLACES}, {_SIGNALS}, {_VERDICTS}, e1 AS MATERIALIZED (SELECT a, b FROM ver WHERE linked UNION ALL SELECT b, a FROM ver WHERE linked), e2 AS MATERIALIZED (SELECT a, b FROM ver WHERE strong UNION ALL SELECT b, a FROM ver WHERE strong),
 r1 AS (SELECT id AS node, id AS label FROM places UNION SELECT e1.b, r1.label FROM r1 JOIN e1 ON e1.a = r1.node), l1 AS MATERIALIZED (SELECT node AS id, min(label) AS cluster FROM r1 GROUP BY node)"""


@query(f"WITH RECURSIVE {_FIRST}, {_invariant_sql('v1', 'l1')} SELECT cluster, violations FROM v1 WHERE violations <> ''")
def cluster_invariants(spark, sf_dir):
    """What the components of all links violate, before any is rebuilt."""
    p = _places(spark, sf_dir)
    parts = connected_components(entity.block_links(p, _BLOCKS), "a", "b")
    return entity.check_invariants(p.join(parts, p["id"] == parts["node"], "left").select("id", F.coalesce("label", "id").alias("cluster")), p)


@query(f"""WITH RECURSIVE {_FIRST}, {_invariant_sql('v1', 'l1')}, r2 AS (SELECT id AS node, id AS label FROM places UNION SELECT e2.b, r2.label FROM r2 JOIN e2 ON e2.a = r2.node),
 l2 AS MATERIALIZED (SELECT node AS id, min(label) AS cluster FROM r2 WHERE node IN (SELECT id FROM l1 JOIN v1 USING (cluster) WHERE violations <> '') GROUP BY node), {_invariant_sql('v2', 'l2')},
 f2 AS (SELECT l2.id, l2.cluster, address FROM l2 JOIN v2 USING (cluster) JOIN places USING (id) WHERE violations <> ''), l3 AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY cluster, coalesce(address, '#' || CAST(id AS VARCHAR))) AS cluster FROM f2), {_invariant_sql('v3', 'l3')},
 sure AS (SELECT cluster, bool_or(id IN (SELECT a FROM ver WHERE linked AND NOT strong UNION SELECT b FROM ver WHERE linked AND NOT strong)) AS unsure FROM l1 GROUP BY 1),
 done AS (SELECT l1.id, l1.cluster, CASE WHEN unsure THEN 'medium' ELSE 'high' END AS confidence, NULL AS split_reason FROM l1 JOIN v1 USING (cluster) JOIN sure USING (cluster) WHERE violations = ''
  UNION ALL SELECT id, cluster, 'reduced', 'probable_edges_dropped' FROM l2 JOIN v2 USING (cluster) WHERE violations = '' UNION ALL SELECT id, cluster, 'reduced', 'address_split' FROM l3 JOIN v3 USING (cluster) WHERE violations = ''
  UNION ALL SELECT id, id, 'reduced', 'atomised' FROM l3 JOIN v3 USING (cluster) WHERE violations <> '')
 SELECT *, printf('EST-%011d', cluster) AS establishment_id FROM done""")
def entity_clusters(spark, sf_dir):
    p = _places(spark, sf_dir)
    return entity.clusters(p, stored(entity.block_links(p, _BLOCKS), "links"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT a AS x FROM e UNION SELECT b FROM e),
 both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT x AS node, x AS label FROM n UNION SELECT b.b, r.label FROM r JOIN both_ b ON b.a = r.node)
 SELECT node, min(label) AS label FROM r GROUP BY node""")
def components(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 7).alias("dst"))
    return connected_components(e).select("node", "label")


# --- geography ------------------------------------------------------------------------


def _coordinates(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (41.60 + (k * 37 % 500) / 1000).alias("lat"), (-87.95 + (k * 91 % 450) / 1000).alias("lon"))


_XY = "xy AS (SELECT s_suppkey AS id, 41.60 + (s_suppkey * 37 % 500) / 1000 AS lat, -87.95 + (s_suppkey * 91 % 450) / 1000 AS lon FROM supplier), "
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH {_XY} p AS (SELECT a.id AS a, b.id AS b, {_KM} AS km FROM xy a JOIN xy b ON a.id < b.id) SELECT a, b, round(km, 6) AS km FROM p WHERE km <= 1.5")
def distance_pairs(spark, sf_dir):
    return geo.near_pairs(_coordinates(spark, sf_dir), 1.5).select("a", "b", F.round("km", 6).alias("km"))


@query(f"""WITH RECURSIVE {_XY} e AS (SELECT a.id AS a, b.id AS b FROM xy a JOIN xy b ON a.id <> b.id WHERE {_KM} <= 1.5), r AS (SELECT id AS node, id AS label FROM xy UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
 c AS (SELECT node, min(label) AS root FROM r GROUP BY node), m AS (SELECT root, avg(lat) AS c_lat, avg(lon) AS c_lon, count(*) AS n_members FROM c JOIN xy ON xy.id = c.node GROUP BY root),
 n AS (SELECT *, 'area_' || CAST(row_number() OVER (ORDER BY round(c_lat, 9) DESC, root) AS VARCHAR) AS area FROM m)
 SELECT node AS id, area, n_members, round(c_lat, 6) AS c_lat, round(c_lon, 6) AS c_lon FROM c JOIN n USING (root)""")
def geo_groups(spark, sf_dir):
    g = geo.groups(_coordinates(spark, sf_dir), 1.5)
    return g.withColumn("c_lat", F.round("c_lat", 6)).withColumn("c_lon", F.round("c_lon", 6))


@query()
def nearest_order(spark, sf_dir):
    p = geo.groups(_coordinates(spark, sf_dir), 1.5).join(_coordinates(spark, sf_dir), "id").withColumn("final_rank", F.col("id"))
    return governance.nearest_order(p, "area")


# --- folds, ranks and metrics ---------------------------------------------------------


@query(f"WITH {_FOLDS} SELECT * FROM folds")
def fold_table(spark, sf_dir):
    return fold_table_of(spark)


@query(f"""WITH {_INSP}, {_FOLDS}, s AS (SELECT fold_id, CASE WHEN d <= train_end THEN 'train' WHEN d <= calibration_end THEN 'calibration' ELSE 'test' END AS split, d, establishment_id, label FROM insp JOIN folds ON d BETWEEN train_start AND test_end),
 per AS (SELECT fold_id, split, d, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT fold_id, split, median(n) AS median_daily FROM per GROUP BY ALL)
 SELECT fold_id, split, count(*) AS n, round(avg(label), 6) AS positive_rate, count(DISTINCT establishment_id) AS n_places, max(median_daily) AS median_daily FROM s JOIN m USING (fold_id, split) GROUP BY fold_id, split""")
def fold_stats(spark, sf_dir):
    s = numbers.split_of(inspections(spark, sf_dir), fold_table_of(spark))
    per = s.groupBy("fold_id", "split", "d").agg(F.count("*").alias("n")).groupBy("fold_id", "split").agg(F.median("n").alias("median_daily"))
    g = s.groupBy("fold_id", "split").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("positive_rate"), F.countDistinct("establishment_id").alias("n_places"))
    return g.join(per, ["fold_id", "split"])


@query(f"WITH {_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY score DESC, id) AS rank FROM cells) SELECT fold_id, id, rank FROM r WHERE rank <= {K}")
def topk(spark, sf_dir):
    return ranking.top_k(cells(spark, sf_dir), CELL, K).select("fold_id", "id", "rank")


@query(f"""WITH {_CELLS} SELECT fold_id, id, rank() OVER w + (count(*) OVER (PARTITION BY fold_id, area) - 1) / 2.0 AS avg_rank, CAST(((row_number() OVER (PARTITION BY fold_id ORDER BY score, id)) * least(15, count(*) OVER (PARTITION BY fold_id)) - 1) // count(*) OVER (PARTITION BY fold_id) AS BIGINT) AS bin
 FROM cells WINDOW w AS (PARTITION BY fold_id ORDER BY area)""")
def rank_avg_and_bins(spark, sf_dir):
    c = ranking.equal_mass_bins(cells(spark, sf_dir), CELL)
    return ranking.average_rank(c, "area", CELL, "avg_rank", F.col("area").cast("long")).select("fold_id", "id", "avg_rank", "bin")


_AUC = "a AS (SELECT fold_id, label, rank() OVER (PARTITION BY fold_id ORDER BY score) + (count(*) OVER (PARTITION BY fold_id, score) - 1) / 2.0 AS r FROM cells)"


@query(f"""WITH {_CELLS}, {_AUC} SELECT fold_id, round(CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) END, 6) AS roc_auc FROM a GROUP BY fold_id""")
def roc_auc(spark, sf_dir):
    return ranking.roc_auc(cells(spark, sf_dir), CELL).select("fold_id", F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {_CELLS}, s AS (SELECT fold_id, score, sum(label) AS tp, count(*) AS m FROM cells GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(m) OVER w AS cm FROM s WINDOW w AS (PARTITION BY fold_id ORDER BY score DESC))
 SELECT fold_id, round(sum(tp * ctp / cm) / nullif(sum(tp), 0), 6) AS pr_auc FROM c GROUP BY fold_id""")
def pr_auc(spark, sf_dir):
    return ranking.pr_auc(cells(spark, sf_dir), CELL).select("fold_id", F.round("pr_auc", 6).alias("pr_auc"))


@query(f"""WITH {_CELLS}, p AS (SELECT *, least(greatest(score, 1e-15), 1 - 1e-15) AS q FROM cells) SELECT fold_id, round(avg(pow(score - label, 2)), 6) AS brier, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 6) AS log_loss FROM p GROUP BY fold_id""")
def brier_logloss(spark, sf_dir):
    return ranking.probability_metrics(cells(spark, sf_dir), CELL).select("fold_id", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query(f"""WITH {_CELLS}, n AS (SELECT *, ((row_number() OVER (PARTITION BY fold_id ORDER BY score, id)) * least(15, count(*) OVER (PARTITION BY fold_id)) - 1) // count(*) OVER (PARTITION BY fold_id) AS bin FROM cells),
 b AS (SELECT fold_id, bin, count(*) AS m, avg(score) AS s, avg(label) AS y FROM n GROUP BY ALL), t AS (SELECT fold_id, count(*) AS n, avg(label) AS base FROM cells GROUP BY 1)
 SELECT fold_id, round(sum(m / n * abs(s - y)), 6) AS ece, round(max(abs(s - y)), 6) AS mce, round(sum(m / n * pow(s - y, 2)), 6) AS reliability, round(sum(m / n * pow(y - base, 2)), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM b JOIN t USING (fold_id) GROUP BY fold_id""")
def ece_mce(spark, sf_dir):
    g = ranking.calibration_error(cells(spark, sf_dir), CELL)
    return g.select("fold_id", *(F.round(c, 6).alias(c) for c in ("ece", "mce", "reliability", "resolution", "uncertainty")))


@query(f"""WITH {_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY score DESC, id) AS k FROM cells)
 SELECT fold_id, round(sum(label) FILTER (WHERE k <= {K}) / least({K}, count(*)), 6) AS precision_at_k, round(sum(label) FILTER (WHERE k <= {K}) / nullif(sum(label), 0), 6) AS recall_at_k,
  round(sum(label) FILTER (WHERE k <= {K}) / least({K}, count(*)) / nullif(sum(label) / count(*), 0), 6) AS lift_at_k FROM r GROUP BY fold_id""")
def at_k(spark, sf_dir):
    g = ranking.at_k(cells(spark, sf_dir), CELL, K)
    return g.select("fold_id", *(F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "lift_at_k")))


@query(f"""WITH {_CELLS}, c AS (SELECT fold_id, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn FROM cells GROUP BY 1)
 SELECT fold_id, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def prf(spark, sf_dir):
    g = ranking.at_threshold(cells(spark, sf_dir), CELL, 0.5)
    return g.select("fold_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_DISC = "disc AS (SELECT *, row_number() OVER w AS pos, CAST(sum(label) OVER w AS BIGINT) AS cum FROM cells WINDOW w AS (PARTITION BY fold_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {_CELLS}, {_DISC} SELECT fold_id, pos, cum FROM disc UNION ALL SELECT DISTINCT fold_id, 0, 0 FROM cells")
def discovery_curve(spark, sf_dir):
    d = ranking.discovery(cells(spark, sf_dir), CELL).select("fold_id", F.col("pos").cast("long").alias("pos"), "cum")
    return d.unionByName(d.select("fold_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("cum")).distinct())


@query(f"""WITH {_CELLS}, {_DISC}, g AS (SELECT fold_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS p, sum(2 * cum - label) AS t FROM disc GROUP BY 1), h AS (SELECT d.fold_id, max(cum) AS half FROM disc d JOIN g USING (fold_id) WHERE pos <= n // 2 GROUP BY 1)
 SELECT fold_id, n, p, round(t / nullif(2.0 * n * p, 0), 6) AS area, round((t / nullif(2.0 * n * p, 0) - 0.5) / nullif(0.5 - p / (2.0 * n), 0), 6) AS nde, round(coalesce(half, 0) / nullif(p, 0), 6) AS first_half FROM g LEFT JOIN h USING (fold_id)""")
def nde(spark, sf_dir):
    g = ranking.discovery_summary(cells(spark, sf_dir), CELL)
    return g.select("fold_id", "n", "p", *(F.round(c, 6).alias(c) for c in ("area", "nde", "first_half")))


@query(f"""WITH {_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY score DESC, id) AS pos FROM cells), s AS (SELECT fold_id, d AS slot, row_number() OVER (PARTITION BY fold_id ORDER BY d, id) AS pos FROM cells),
 g AS (SELECT fold_id, date_diff('day', slot, d) AS g FROM r JOIN s USING (fold_id, pos) WHERE label = 1)
 SELECT fold_id, round(avg(g), 6) AS mean_gain, CAST(median(g) AS DOUBLE) AS median_gain, round(coalesce(stddev_samp(g), 0), 6) AS sd_gain, quantile_cont(g, 0.25) AS p25, quantile_cont(g, 0.75) AS p75, min(g) AS min_gain, max(g) AS max_gain, round(avg(CAST(g > 0 AS INTEGER)), 6) AS share_earlier FROM g GROUP BY fold_id""")
def days_earlier(spark, sf_dir):
    g = ranking.days_earlier(cells(spark, sf_dir), CELL)
    return g.withColumns({c: F.round(c, 6) for c in ("mean_gain", "sd_gain", "share_earlier")})


@query(f"""WITH {_CELLS}, per AS (SELECT fold_id, d, count(*) AS n FROM cells GROUP BY ALL), c AS (SELECT fold_id, CAST(sum(n) AS INTEGER) AS n, CAST(round(median(n)) AS INTEGER) AS day FROM per GROUP BY 1)
 SELECT fold_id, unnest(['day_1', 'week_1', 'month_1', 'pct_1', 'pct_5', 'pct_10', 'pct_25', 'pct_50']) AS k_name,
  unnest(list_transform([day, day * 5, day * 21, CAST(round_even(n * 0.01, 0) AS INTEGER), CAST(round_even(n * 0.05, 0) AS INTEGER), CAST(round_even(n * 0.1, 0) AS INTEGER), CAST(round_even(n * 0.25, 0) AS INTEGER), CAST(round_even(n * 0.5, 0) AS INTEGER)], lambda k: greatest(1, least(k, n)))) AS k FROM c""")
def capacity_levels(spark, sf_dir):
    per = cells(spark, sf_dir).groupBy("fold_id", "d").agg(F.count("*").alias("n"))
    c = per.groupBy("fold_id").agg(F.sum("n").alias("n"), F.round(F.median("n")).cast("int").alias("day"))
    return c.select("fold_id", F.explode(numbers.capacity_levels(F.col("n"), F.col("day"))).alias("k")).select("fold_id", "k.*")


@query(f"""WITH {_INSP}, m AS (SELECT year(d) AS y, month(d) AS m, count(*) AS n, least(greatest(avg(label), 1e-6), 1 - 1e-6) AS p FROM insp GROUP BY ALL), y AS (SELECT year(d) AS y, least(greatest(avg(label), 1e-6), 1 - 1e-6) AS p FROM insp GROUP BY 1)
 SELECT m.m AS month, round(sum(n * (ln(m.p / (1 - m.p)) - ln(y.p / (1 - y.p)))) / sum(n), 6) AS effect FROM m JOIN y ON m.y = y.y GROUP BY m.m""")
def month_effects(spark, sf_dir):
    i = inspections(spark, sf_dir).withColumn("y", F.year("d")).withColumn("month", F.month("d"))
    m = i.groupBy("y", "month").agg(F.count("*").alias("n"), numbers.logit(F.avg("label")).alias("lm"))
    y = i.groupBy("y").agg(numbers.logit(F.avg("label")).alias("ly"))
    return m.join(y, "y").groupBy("month").agg(F.round(F.sum(F.col("n") * (F.col("lm") - F.col("ly"))) / F.sum("n"), 6).alias("effect"))


@query(f"""WITH {_INSP}, h AS (SELECT t.inspection_id, date_diff('day', max(h.d) FILTER (WHERE h.kind = 'CANVASS'), t.d) AS days, arg_max(h.priority, (h.d, h.inspection_id)) FILTER (WHERE h.kind = 'CANVASS') AS last_p,
  (count(*) FILTER (WHERE h.kind = 'CANVASS' AND h.priority)) / nullif(count(*) FILTER (WHERE h.kind = 'CANVASS'), 0) AS rate FROM insp t LEFT JOIN insp h ON h.establishment_id = t.establishment_id AND h.d < t.d GROUP BY t.inspection_id, t.d)
 SELECT inspection_id AS id, CAST(coalesce(days, max(days) OVER () + 1) AS DOUBLE) AS days_since, coalesce(CAST(last_p AS DOUBLE), 0.5) AS priority_at_last, coalesce(rate, 0.5) AS priority_rate, 0.5::DOUBLE AS constant FROM h""")
def ranker_scores(spark, sf_dir):
    f = asof.features(targets(spark, sf_dir), inspections(spark, sf_dir), "1900-01-01")
    most = f.agg((F.max("days_since_last_canvass") + 1).alias("most"))
    f = f.join(F.broadcast(most), F.lit(True))  # one row
    return f.select(F.col("target_id").alias("id"), F.coalesce("days_since_last_canvass", "most").cast("double").alias("days_since"), F.coalesce(F.col("priority_at_last_canvass").cast("double"), F.lit(0.5)).alias("priority_at_last"), F.coalesce("prior_canvass_priority_rate", F.lit(0.5)).alias("priority_rate"), F.lit(0.5).alias("constant"))


# --- policy ---------------------------------------------------------------------------


def decided(spark, sf_dir, policies=POLICIES[2:3]):
    """Every cell under every policy: the policies are a literal of a few rows."""
    grid = F.explode(F.array(*(F.struct(F.lit(n).alias("policy_id"), F.lit(s).alias("share"), F.lit(f).alias("forced")) for n, s, f in policies)))
    rows = stored(policy.ranked(cells(spark, sf_dir), CELL), "ranked-cells").withColumn("k", F.lit(K)).withColumn("p", grid).select("*", "p.*").drop("p")
    return policy.allocate(rows, ["policy_id", *CELL], F.col("share"), F.col("forced"))


def _alloc_sql(policies=POLICIES[2:3]) -> str:
    values = ", ".join(f"('{n}', {s}::DOUBLE, {f})" for n, s, f in policies)
    return f"""pc AS MATERIALIZED (SELECT cells.*, p.* FROM cells CROSS JOIN (VALUES {values}) AS p(policy_id, share, forced)),
 r AS MATERIALIZED (SELECT *, row_number() OVER w AS model_rank, count(*) OVER (PARTITION BY policy_id, fold_id) AS n, sum(CAST(eligible AS INTEGER)) OVER w AS cum, sum(CAST(eligible AS INTEGER)) OVER (PARTITION BY policy_id, fold_id) AS total FROM pc WINDOW w AS (PARTITION BY policy_id, fold_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
 c AS MATERIALIZED (SELECT policy_id, fold_id, max(share) AS share, bool_or(forced) AS forced, least({K}, max(n)) AS kk, max(total) AS total, max(cum) FILTER (WHERE model_rank = least({K}, n)) AS at_k FROM r GROUP BY 1, 2),
 x AS MATERIALIZED (SELECT policy_id, fold_id, unnest(generate_series(0, CAST(CASE WHEN forced THEN least(floor(kk * share), kk) ELSE greatest(0, floor(kk * share) - coalesce(at_k, 0)) END AS BIGINT))) AS x, kk, total FROM c),
 g AS MATERIALIZED (SELECT x.policy_id, x.fold_id, max(x.kk) AS kk, CAST(max(x) AS BIGINT) AS g FROM x LEFT JOIN r ON r.policy_id = x.policy_id AND r.fold_id = x.fold_id AND r.model_rank = x.kk - x.x WHERE x.total - coalesce(r.cum, 0) >= x.x GROUP BY 1, 2),
 q AS MATERIALIZED (SELECT r.*, g.g, g.kk, r.model_rank <= g.kk - g.g AS risk FROM r JOIN g USING (policy_id, fold_id)),
 z AS MATERIALIZED (SELECT *, sum(CASE WHEN NOT risk AND eligible THEN 1 ELSE 0 END) OVER (PARTITION BY policy_id, fold_id ORDER BY model_rank ROWS UNBOUNDED PRECEDING) AS below FROM q),
 dec AS MATERIALIZED (SELECT *, CASE WHEN risk THEN 'risk_priority' WHEN eligible AND below <= g THEN 'coverage_reserve' ELSE 'not_selected' END AS mechanism FROM z)"""


@query(f"""WITH {_CELLS}, {_alloc_sql()}, s AS (SELECT *, mechanism <> 'not_selected' AS is_selected FROM dec)
 SELECT fold_id, id, CAST(model_rank AS INTEGER) AS model_rank, g, mechanism, is_selected, CASE WHEN risk THEN 'selected_by_risk_rank' WHEN mechanism = 'coverage_reserve' THEN 'selected_by_coverage_reserve' WHEN eligible THEN 'not_selected_reserve_exhausted' ELSE 'not_selected_capacity_exhausted' END AS reason,
  CASE WHEN is_selected THEN CAST(row_number() OVER (PARTITION BY fold_id ORDER BY is_selected DESC, (mechanism = 'risk_priority') DESC, model_rank) AS INTEGER) END AS final_rank FROM s""")
def decide(spark, sf_dir):
    return decided(spark, sf_dir).select("fold_id", "id", "model_rank", F.col("g").cast("long").alias("g"), "mechanism", "is_selected", "reason", "final_rank")


@query(f"WITH {_CELLS} SELECT fold_id, count(*) AS n, count(*) FILTER (WHERE eligible) AS n_eligible, round(avg(CAST(eligible AS INTEGER)), 6) AS share FROM cells GROUP BY GROUPING SETS ((fold_id), ())")
def eligibility(spark, sf_dir):
    return cells(spark, sf_dir).rollup("fold_id").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.round(F.avg(F.col("eligible").cast("int")), 6).alias("share"))


def _grid(spark, sf_dir):
    return policy.cell_metrics(decided(spark, sf_dir, POLICIES), ["policy_id", *CELL])


def _grid_sql() -> str:
    return f"""{_alloc_sql(POLICIES)}, grid AS MATERIALIZED (SELECT policy_id, fold_id, count(*) FILTER (WHERE mechanism <> 'not_selected') AS n_selected, count(*) FILTER (WHERE mechanism = 'risk_priority') AS n_risk, count(*) FILTER (WHERE mechanism = 'coverage_reserve') AS n_reserve,
 CAST(sum(CASE WHEN mechanism <> 'not_selected' THEN label ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN mechanism <> 'not_selected' THEN label ELSE 0 END) / nullif(sum(label), 0), 6) AS capture, round(count(*) FILTER (WHERE mechanism <> 'not_selected' AND eligible) / nullif(count(*) FILTER (WHERE eligible), 0), 6) AS coverage FROM dec GROUP BY policy_id, fold_id)"""


@query(f"WITH {_CELLS}, {_grid_sql()} SELECT * FROM grid")
def policy_grid(spark, sf_dir):
    return _grid(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("capture", "coverage")})


@query(f"WITH {_CELLS}, {_grid_sql()} SELECT g.policy_id, g.fold_id, g.hits, b.hits - g.hits AS cost FROM grid g JOIN grid b ON b.fold_id = g.fold_id AND b.policy_id = 'pure_risk'")
def opportunity_cost(spark, sf_dir):
    return policy.opportunity_cost(_grid(spark, sf_dir), CELL).select("policy_id", "fold_id", "hits", "cost")


@query(f"""WITH {_CELLS}, {_grid_sql()}, p AS (SELECT policy_id, round(avg(capture), 6) AS capture, round(avg(coverage), 6) AS coverage FROM grid GROUP BY 1)
 SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.capture >= p.capture AND q.coverage >= p.coverage AND (q.capture > p.capture OR q.coverage > p.coverage))""")
def frontier(spark, sf_dir):
    rounded = _grid(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("capture", "coverage")})
    p = rounded.groupBy("policy_id").agg(F.round(F.avg("capture"), 6).alias("capture"), F.round(F.avg("coverage"), 6).alias("coverage"))
    return policy.frontier(p, "policy_id", "capture", "coverage")


# --- audit ----------------------------------------------------------------------------


@query(f"""WITH {_CELLS}, g AS (SELECT fold_id, area, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM cells GROUP BY ALL)
 SELECT fold_id, area, n, pos, n - pos AS neg, round(pos / n, 6) AS base_rate, round(n / sum(n) OVER (PARTITION BY fold_id), 6) AS share, CASE WHEN n < 20 THEN 'rows' WHEN pos < 5 THEN 'positives' WHEN n - pos < 5 THEN 'negatives' ELSE 'supported' END AS support FROM g""")
def group_support(spark, sf_dir):
    return audit.support(cells(spark, sf_dir), CELL, "area", (20, 5, 5)).withColumns({c: F.round(c, 6) for c in ("base_rate", "share")})


@query(f"""WITH {_CELLS}, {_alloc_sql()}, ga AS (SELECT area, count(*) AS population, count(*) FILTER (WHERE mechanism <> 'not_selected') AS selected FROM dec GROUP BY 1), t AS (SELECT *, population / sum(population) OVER () AS p, selected / sum(selected) OVER () AS s FROM ga)
 SELECT area, population, selected, round(p, 6) AS population_share, round(s, 6) AS selected_share, round(s / p, 6) AS selection_ratio FROM t""")
def priority_audit(spark, sf_dir):
    return audit.priority(decided(spark, sf_dir), "area").withColumns({c: F.round(c, 6) for c in ("population_share", "selected_share", "selection_ratio")})


@query(f"""WITH {_INSP}, h AS (SELECT t.inspection_id, t.area, count(h.inspection_id) AS a, count(h.inspection_id) FILTER (WHERE h.kind = 'CANVASS') AS c FROM insp t LEFT JOIN insp h ON h.establishment_id = t.establishment_id AND h.d < t.d GROUP BY ALL)
 SELECT area, 'days_since_any_inspection' AS feature, count(*) AS n, round(avg(CAST(a = 0 AS INTEGER)), 6) AS null_rate FROM h GROUP BY 1 UNION ALL SELECT area, 'days_since_last_canvass', count(*), round(avg(CAST(c = 0 AS INTEGER)), 6) FROM h GROUP BY 1""")
def missingness(spark, sf_dir):
    i = inspections(spark, sf_dir)
    f = asof.features(targets(spark, sf_dir), i, ERA).join(i.select(F.col("inspection_id").alias("target_id"), "area"), "target_id")
    return audit.missingness(f, "area", ["days_since_any_inspection", "days_since_last_canvass"]).withColumn("null_rate", F.round("null_rate", 6))


@query(f"""WITH {_CELLS}, m AS (SELECT fold_id, area, count(*) AS n, round(avg(label), 6) AS v FROM cells GROUP BY ALL), p AS (SELECT fold_id, round(avg(label), 6) AS pv FROM cells GROUP BY 1), w AS (SELECT m.*, pv, sum(n * v) OVER (PARTITION BY fold_id) / sum(n) OVER (PARTITION BY fold_id) AS mu FROM m JOIN p USING (fold_id))
 SELECT fold_id, round(max(v) - min(v), 6) AS spread, round(CASE WHEN min(v) > 0 THEN max(v) / min(v) END, 6) AS ratio, round(max(abs(v - pv)), 6) AS max_deviation, round(sqrt(sum(n * pow(v - mu, 2)) / sum(n)), 6) AS weighted_sd, arg_min(area, (v, area)) AS lowest, arg_min(area, (-v, area)) AS highest FROM w GROUP BY fold_id""")
def disparity(spark, sf_dir):
    c = cells(spark, sf_dir)
    m = c.groupBy("fold_id", "area").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("v"))
    g = audit.disparity(m, CELL, "area", "v", c.groupBy("fold_id").agg(F.round(F.avg("label"), 6).alias("v")))
    return g.withColumns({x: F.round(x, 6) for x in ("spread", "ratio", "max_deviation", "weighted_sd")})


@query(f"""WITH {_CELLS}, m AS (SELECT fold_id, area, avg(label) AS v FROM cells GROUP BY ALL), g AS (SELECT area, count(*) AS n_folds, arg_min(v, fold_id) AS f, arg_max(v, fold_id) AS l FROM m GROUP BY 1)
 SELECT area, n_folds, round(f, 6) AS first_value, round(l, 6) AS last_value, round((l - f) / nullif(abs(f), 0), 6) AS change, CASE WHEN n_folds < 3 THEN 'too_few' WHEN (l - f) / nullif(abs(f), 0) > 0.25 THEN 'rising' WHEN (l - f) / nullif(abs(f), 0) < -0.25 THEN 'falling' ELSE 'stable' END AS trend FROM g""")
def drift(spark, sf_dir):
    m = cells(spark, sf_dir).groupBy("fold_id", "area").agg(F.avg("label").alias("v"))
    return audit.drift(m, ["area"], "fold_id", "v").withColumns({x: F.round(x, 6) for x in ("first_value", "last_value", "change")})


# --- scheduling -----------------------------------------------------------------------


def _calendar(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("fold_id", F.col("d").alias("slot_date")).agg(F.count("*").alias("n_slots"))


def _plan(spark, sf_dir):
    q = decided(spark, sf_dir).where("is_selected").select("fold_id", "id", "final_rank", "mechanism", "area")
    days = scheduling.horizon(_calendar(spark, sf_dir), CELL, K)
    return days, stored(scheduling.fill(q, days, CELL), "plan")


_HORIZON = f"""cal AS (SELECT fold_id, d AS slot_date, count(*) AS n_slots FROM cells GROUP BY ALL), med AS (SELECT fold_id, median(n_slots) AS m FROM cal GROUP BY 1),
 hor AS MATERIALIZED (SELECT *, coalesce(sum(n_slots) OVER (PARTITION BY fold_id ORDER BY slot_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS slots_before FROM (SELECT cal.*, row_number() OVER (PARTITION BY fold_id ORDER BY slot_date) AS day_index, m FROM cal JOIN med USING (fold_id)) WHERE day_index <= ceil({K} / m))"""
_PLAN = f"""{_alloc_sql()}, {_HORIZON}, que AS (SELECT fold_id, id, mechanism, row_number() OVER (PARTITION BY fold_id ORDER BY (mechanism = 'risk_priority') DESC, model_rank) AS final_rank FROM dec WHERE mechanism <> 'not_selected'),
 plan AS MATERIALIZED (SELECT que.fold_id, que.id, final_rank, slot_date, day_index, final_rank - slots_before AS slot_index, CASE WHEN slot_date IS NULL THEN 'backlog' ELSE 'scheduled' END AS status FROM que LEFT JOIN hor ON hor.fold_id = que.fold_id AND final_rank > slots_before AND final_rank <= slots_before + n_slots)"""


@query(f"WITH {_CELLS}, {_HORIZON} SELECT fold_id, slot_date, n_slots, CAST(day_index AS INTEGER) AS day_index, slots_before FROM hor")
def horizon(spark, sf_dir):
    return scheduling.horizon(_calendar(spark, sf_dir), CELL, K).select("fold_id", "slot_date", "n_slots", "day_index", "slots_before")


@query(f"WITH {_CELLS}, {_PLAN} SELECT fold_id, id, CAST(final_rank AS INTEGER) AS final_rank, slot_date, CAST(slot_index AS BIGINT) AS slot_index, status FROM plan")
def slot_fill(spark, sf_dir):
    return _plan(spark, sf_dir)[1].select("fold_id", "id", "final_rank", "slot_date", F.col("slot_index").cast("long").alias("slot_index"), "status")


@query(f"WITH {_CELLS}, {_PLAN} SELECT fold_id, count(*) AS n_backlog FROM plan WHERE status = 'backlog' GROUP BY 1")
def backlog(spark, sf_dir):
    return _plan(spark, sf_dir)[1].where("status = 'backlog'").groupBy("fold_id").agg(F.count("*").alias("n_backlog"))


@query(f"""WITH {_CELLS}, {_PLAN}, u AS (SELECT fold_id, slot_date, count(*) AS used FROM plan WHERE status = 'scheduled' GROUP BY ALL)
 SELECT h.fold_id, h.slot_date, n_slots, coalesce(used, 0) AS used, round(coalesce(used, 0) / n_slots, 6) AS utilization FROM hor h LEFT JOIN u ON u.fold_id = h.fold_id AND u.slot_date = h.slot_date""")
def utilization(spark, sf_dir):
    days, plan = _plan(spark, sf_dir)
    return scheduling.utilization(days, plan, CELL).withColumn("utilization", F.round("utilization", 6))


_EVENTS = "ev AS (SELECT fold_id, id, CASE WHEN id % 3 = 0 THEN 'completed' WHEN id % 3 = 1 THEN 'cancelled_in_field' ELSE 'not_performed' END AS execution_status FROM plan WHERE id % 5 = 0)"


def _field_events(plan):
    status = F.when(F.col("id") % 3 == 0, "completed").when(F.col("id") % 3 == 1, "cancelled_in_field").otherwise("not_performed")
    return plan.where("id % 5 = 0").select("fold_id", "id", status.alias("execution_status"))


@query(f"""WITH {_CELLS}, {_PLAN}, {_EVENTS}, k AS (SELECT plan.*, execution_status, coalesce(execution_status = 'cancelled_in_field', false) AS gone, coalesce(execution_status = 'completed' OR status = 'scheduled' AND slot_date < DATE '2000-02-15', false) AS past FROM plan LEFT JOIN ev USING (fold_id, id)),
 fr AS (SELECT fold_id, id, final_rank, slot_date, slot_index, status FROM k WHERE past AND NOT gone), wa AS (SELECT fold_id, id, final_rank, row_number() OVER (PARTITION BY fold_id ORDER BY final_rank) AS n FROM k WHERE NOT past AND NOT gone),
 sl AS (SELECT fold_id, slot_date, unnest(generate_series(1, n_slots)) AS slot_index FROM hor WHERE slot_date >= DATE '2000-02-15'), op AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY slot_date, slot_index) AS n FROM sl WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.fold_id = sl.fold_id AND fr.slot_date = sl.slot_date AND fr.slot_index = sl.slot_index))
 SELECT fold_id, id, CAST(final_rank AS INTEGER) AS final_rank, slot_date, CAST(slot_index AS BIGINT) AS slot_index, status, true AS frozen FROM fr
 UNION ALL SELECT wa.fold_id, id, CAST(final_rank AS INTEGER), slot_date, CAST(slot_index AS BIGINT), CASE WHEN slot_date IS NULL THEN 'backlog' ELSE 'scheduled' END, false FROM wa LEFT JOIN op ON op.fold_id = wa.fold_id AND op.n = wa.n""")
def replan(spark, sf_dir):
    days, plan = _plan(spark, sf_dir)
    out = scheduling.replan(plan, days, _field_events(plan), CELL, "2000-02-15")
    return out.withColumn("slot_index", F.col("slot_index").cast("long"))


@query(f"""WITH {_CELLS}, {_PLAN}, o AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY slot_date, slot_index) AS pos, coalesce(max(final_rank) OVER (PARTITION BY fold_id ORDER BY slot_date, slot_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM plan WHERE status = 'scheduled')
 SELECT fold_id, count(*) AS n, CAST(max(greatest(0, m - final_rank)) AS INTEGER) AS max_depth, count(*) FILTER (WHERE m > final_rank) AS n_inverted, round(corr(pos, final_rank), 6) AS spearman FROM o GROUP BY 1""")
def preservation(spark, sf_dir):
    return scheduling.preservation(_plan(spark, sf_dir)[1], CELL).withColumn("spearman", F.round("spearman", 6))


# --- governance -----------------------------------------------------------------------


@query(f"""WITH {_CELLS}, {_PLAN}, {_EVENTS} SELECT ev.fold_id, CASE WHEN plan.status = 'scheduled' THEN 'recorded' ELSE 'no_op' END AS outcome, execution_status, count(*) AS n FROM ev JOIN plan USING (fold_id, id) GROUP BY ALL""")
def exec_summary(spark, sf_dir):
    plan = _plan(spark, sf_dir)[1]
    return governance.execution_summary(plan, _field_events(plan), CELL)


@query(f"""WITH {_CELLS}, {_PLAN}, {_EVENTS}, t AS (SELECT fold_id, id, 'warning' AS r FROM plan WHERE id % 4 = 0 UNION SELECT fold_id, id, 'no_execution_record' FROM plan WHERE status = 'scheduled' AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.fold_id = plan.fold_id AND ev.id = plan.id))
 SELECT fold_id, id, string_agg(r, '|' ORDER BY r) AS reasons, CASE WHEN id % 6 = 0 THEN 'accept' ELSE 'open' END AS status FROM t GROUP BY fold_id, id""")
def review_cases(spark, sf_dir):
    plan = _plan(spark, sf_dir)[1]
    cases = governance.review_cases(plan.where("id % 4 = 0"), plan.where("status = 'scheduled'").join(_field_events(plan), ["fold_id", "id"], "left_anti"), ["fold_id", "id"])
    said = plan.where("id % 6 = 0").select("fold_id", "id", F.explode(F.array(F.struct(F.lit("D1").alias("decision_id"), F.lit("accept").alias("decision")), F.struct(F.lit("D2").alias("decision_id"), F.lit("reject").alias("decision")))).alias("x")).select("fold_id", "id", "x.*")
    return governance.resolve(cases, said, ["fold_id", "id"])


@query()
def overrides(spark, sf_dir):
    d = decided(spark, sf_dir)
    o = d.where("id % 50 = 0").select("fold_id", F.concat(F.lit("OV-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("override_id"), F.col("id").cast("string").alias("target_id"), F.when(F.col("is_selected"), "force_exclude").otherwise("force_include").alias("action"))
    o = o.toDF("o_fold", "override_id", "target_id", "action").withColumnRenamed("o_fold", "fold_id")
    queue = decided(spark, sf_dir).select("fold_id", "id", "is_selected", "mechanism", "model_rank")
    return governance.apply_overrides(queue, o, CELL)


# --- models and calibration -----------------------------------------------------------


def _calibration_and_test(spark, sf_dir):
    """The rows of every fold's calibration quarter, and those of its test quarter.

    Stored once for both, as each reads all lines of all orders.
    """
    i = stored(inspections(spark, sf_dir).select(F.col("inspection_id").alias("id"), "d", "score", "label"), "scored")
    within = lambda part: i.join(F.broadcast(fold_table_of(spark).select("fold_id", f"{part}_start", f"{part}_end")), F.col("d").between(F.col(f"{part}_start"), F.col(f"{part}_end"))).select("fold_id", "id", "d", "score", "label")
    return within("calibration"), within("test")


def _xy(spark, sf_dir, folds=None):
    """Features and label of every row in every fold that uses it, with its split."""
    f = asof.features(targets(spark, sf_dir), inspections(spark, sf_dir), ERA)
    i = inspections(spark, sf_dir).select(F.col("inspection_id").alias("target_id"), "d", "label")
    rows = stored(f.join(i, "target_id").withColumnRenamed("target_id", "id"), "model-rows")
    return numbers.split_of(rows, folds if folds is not None else fold_table_of(spark)).where("split <> 'calibration'")


_COLUMNS = ["prior_canvass_count", "days_since_last_canvass", "prior_canvass_priority_rate", "prior_complaint_count", "days_since_first_inspection"]
_FAMILIES = {"canvass": "days_since_last_canvass", "code_era": "prior_canvass_priority_rate", "history": "days_since_first_inspection"}
_BOOLEANS = ["fail_at_last_canvass", "name_changed_since_last_canvass"]


@query()
def logistic_scores(spark, sf_dir):
    """Every fold's test rows, scored by a model of its training rows."""
    return calibrate.logistic(_xy(spark, sf_dir), "fold_id", _COLUMNS, _FAMILIES, _BOOLEANS)


@query()
def boosted_scores(spark, sf_dir):
    """The last fold's test rows, scored by trees fitted on its training rows."""
    last = fold_table_of(spark).orderBy(F.desc("fold_id")).limit(1)
    return calibrate.boosted(_xy(spark, sf_dir, last), "fold_id", _COLUMNS, _FAMILIES, _BOOLEANS)


_CAL = f"""cal AS MATERIALIZED (SELECT f.fold_id, inspection_id AS id, score, label FROM insp JOIN folds f ON d BETWEEN f.calibration_start AND f.calibration_end)"""
_NEWTON_CAL = "m0 AS (SELECT DISTINCT fold_id, 0::DOUBLE AS i, 0::DOUBLE AS s FROM cal), zc AS MATERIALIZED (SELECT fold_id, label::DOUBLE AS y, ln(q / (1 - q)) AS z FROM (SELECT fold_id, label, least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM cal))" + "".join(
    f""", mc{k} AS (SELECT zc.fold_id, i, s, z, y, 1 / (1 + exp(-(i + s * z))) AS p FROM zc JOIN m{k} USING (fold_id)),
 mt{k} AS (SELECT fold_id, any_value(i) AS i, any_value(s) AS s, sum(p * (1 - p)) AS a, sum(p * (1 - p) * z) AS b, sum(p * (1 - p) * z * z) AS c, sum(y - p) AS g, sum((y - p) * z) AS h FROM mc{k} GROUP BY 1),
 m{k + 1} AS MATERIALIZED (SELECT fold_id, i + (c * g - b * h) / (a * c - b * b) AS i, s + (a * h - b * g) / (a * c - b * b) AS s FROM mt{k})"""
    for k in range(9)
)
_PLATT = f"""{_CAL}, {_NEWTON_CAL}, pla AS MATERIALIZED (SELECT c.fold_id, id, label, score, 1 / (1 + exp(-(i + s * ln(q / (1 - q))))) AS calibrated FROM (SELECT *, least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM cells) c JOIN m9 USING (fold_id))"""
# The monotone fit at a point is the largest over starts of the smallest over ends of the mean between.
_ISO = f"""{_CAL}, pt AS MATERIALIZED (SELECT fold_id, score AS x, avg(label) AS y, count(*) AS w, sum(label) AS sy, row_number() OVER (PARTITION BY fold_id ORDER BY score) AS i FROM cal GROUP BY fold_id, score),
 pf AS MATERIALIZED (SELECT *, sum(w) OVER v AS cw, sum(sy) OVER v AS cy FROM pt WINDOW v AS (PARTITION BY fold_id ORDER BY i)),
 seg AS (SELECT a.fold_id, a.i AS s, b.i AS e, (b.cy - a.cy + a.sy) / (b.cw - a.cw + a.w) AS m FROM pf a JOIN pf b ON a.fold_id = b.fold_id AND a.i <= b.i), low AS MATERIALIZED (SELECT fold_id, s, e AS at, min(m) OVER (PARTITION BY fold_id, s ORDER BY e DESC) AS v FROM seg),
 fit AS MATERIALIZED (SELECT low.fold_id, x, max(v) AS y FROM low JOIN pf ON pf.fold_id = low.fold_id AND pf.i = low.at GROUP BY low.fold_id, x),
 iso AS MATERIALIZED (SELECT c.fold_id, c.id, c.label, c.score, CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (c.score - lo.x) / (hi.x - lo.x) END AS calibrated
   FROM cells c ASOF LEFT JOIN fit lo ON c.fold_id = lo.fold_id AND c.score >= lo.x ASOF LEFT JOIN fit hi ON c.fold_id = hi.fold_id AND c.score <= hi.x)"""


@query(f"WITH {_CELLS}, {_PLATT} SELECT fold_id, id, label, round(calibrated, 6) AS calibrated FROM pla")
def platt(spark, sf_dir):
    """Test rows under Platt's calibration, fitted on the calibration quarter of their fold."""
    out = calibrate.platt(*_calibration_and_test(spark, sf_dir), "fold_id")
    return out.select("fold_id", "id", "label", F.round("calibrated", 6).alias("calibrated"))


@query(f"WITH {_CELLS}, {_ISO} SELECT fold_id, id, label, round(calibrated, 6) AS calibrated FROM iso")
def isotonic(spark, sf_dir):
    """Test rows under monotone calibration, fitted on the calibration quarter of their fold."""
    out = calibrate.isotonic(*_calibration_and_test(spark, sf_dir), "fold_id")
    return out.select("fold_id", "id", "label", F.round("calibrated", 6).alias("calibrated"))


def _loss_sql(table: str) -> str:
    q = "least(greatest(calibrated, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
    return f"SELECT fold_id, avg(-(label * ln({q}) + (1 - label) * ln(1 - {q}))) AS loss FROM {table} GROUP BY 1"


@query(f"""WITH {_CELLS}, {_PLATT}, {_ISO.replace(_CAL + ", ", "")}, l AS (SELECT p.fold_id, p.loss AS a, i.loss AS b FROM ({_loss_sql("pla")}) p JOIN ({_loss_sql("iso")}) i USING (fold_id)),
 m AS (SELECT fold_id, avg(a) OVER w AS mp, avg(b) OVER w AS mi FROM l WINDOW w AS (ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT fold_id, CASE WHEN mp - mi > 0.005 THEN 'isotonic' ELSE 'platt' END AS method FROM m""")
def calib_select(spark, sf_dir):
    """The method of every fold, by the log losses of both calibrators on earlier test quarters."""
    cal, test = _calibration_and_test(spark, sf_dir)
    a = calibrate.log_loss(calibrate.platt(cal, test, "fold_id"), "fold_id", "calibrated", "platt_loss")
    b = calibrate.log_loss(calibrate.isotonic(cal, test, "fold_id"), "fold_id", "calibrated", "isotonic_loss")
    return calibrate.method_choice(a.join(b, "fold_id"))


@query(f"""WITH {_CELLS}, r AS (SELECT fold_id, rank() OVER (PARTITION BY fold_id ORDER BY score) + (count(*) OVER (PARTITION BY fold_id, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY fold_id ORDER BY area) + (count(*) OVER (PARTITION BY fold_id, area) - 1) / 2.0 AS b FROM cells) SELECT fold_id, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    c = ranking.average_rank(ranking.average_rank(cells(spark, sf_dir), "score", CELL, "a"), "area", CELL, "b", F.col("area").cast("long"))
    return c.groupBy("fold_id").agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query(f"""WITH {_INSP}, f AS (SELECT inspection_id, area, unnest(['entries', 'score']) AS feature, unnest([2.0 * (entries - avg(entries) OVER ()), -1.5 * (score - avg(score) OVER ())]) AS v FROM insp)
 SELECT area, feature, round(avg(v), 6) AS mean_value, round(avg(abs(v)), 6) AS mean_abs FROM f GROUP BY ALL""")
def attribution_linear(spark, sf_dir):
    i = inspections(spark, sf_dir)
    mean = i.agg(F.avg("entries").alias("me"), F.avg("score").alias("ms"))
    v = i.join(F.broadcast(mean), F.lit(True)).select("area", F.explode(F.array(F.struct(F.lit("entries").alias("feature"), (2.0 * (F.col("entries") - F.col("me"))).alias("v")), F.struct(F.lit("score").alias("feature"), (-1.5 * (F.col("score") - F.col("ms"))).alias("v")))).alias("x")).select("area", "x.*")
    return v.groupBy("area", "feature").agg(F.round(F.avg("v"), 6).alias("mean_value"), F.round(F.avg(F.abs("v")), 6).alias("mean_abs"))


# --- runtime checks -------------------------------------------------------------------


@query(f"""WITH {_CELLS}, {_PLAN} SELECT 'selected_is_k' AS check_name, count(*) AS violations FROM (SELECT fold_id FROM dec GROUP BY 1 HAVING count(*) FILTER (WHERE mechanism <> 'not_selected') <> max(kk))
 UNION ALL SELECT 'reserve_is_eligible', count(*) FROM dec WHERE mechanism = 'coverage_reserve' AND NOT eligible UNION ALL SELECT 'slot_taken_twice', count(*) FROM (SELECT 1 FROM plan WHERE status = 'scheduled' GROUP BY fold_id, slot_date, slot_index HAVING count(*) > 1)""")
def null_rule_checks(spark, sf_dir):
    d = decided(spark, sf_dir)
    one = lambda name, bad: bad.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
    plan = _plan(spark, sf_dir)[1]
    return (
        one("selected_is_k", d.groupBy("fold_id").agg(F.count_if("is_selected").alias("s"), F.max("k").alias("k")).where("s <> k"))
        .unionByName(one("reserve_is_eligible", d.where("mechanism = 'coverage_reserve' and not eligible")))
        .unionByName(one("slot_taken_twice", plan.where("status = 'scheduled'").groupBy("fold_id", "slot_date", "slot_index").count().where("count > 1")))
    )


# --- stability and choice -------------------------------------------------------------

_VALUES = """v AS (SELECT fold_id, unnest(['score', 'area', 'label']) AS feature, unnest([-1.5::DOUBLE * (score - 0.5), 0.1::DOUBLE * (area - 12), 0.3::DOUBLE * label]) AS v FROM cells),
 fr AS (SELECT *, rank() OVER (PARTITION BY fold_id ORDER BY a DESC) AS k FROM (SELECT fold_id, feature, round(avg(abs(v)), 9) AS a FROM v GROUP BY ALL))"""


def _values(spark, sf_dir):
    parts = {"score": -1.5 * (F.col("score") - 0.5), "area": 0.1 * (F.col("area") - 12), "label": 0.3 * F.col("label")}
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), v.alias("v")) for n, v in parts.items())))
    return cells(spark, sf_dir).select("fold_id", long.alias("x")).select("fold_id", "x.*")


@query(f"""WITH {_CELLS}, {_VALUES} SELECT feature, round(avg(a), 6) AS mean_abs, round(stddev_pop(a), 6) AS sd, min(k) AS best_rank, max(k) AS worst_rank, count(*) AS n_folds FROM fr GROUP BY 1""")
def importance(spark, sf_dir):
    return stability.importance(_values(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_abs", "sd")})


@query(f"""WITH {_CELLS}, {_VALUES}, t AS (SELECT fold_id, list(feature) AS top FROM fr WHERE k <= 2 GROUP BY 1), l AS (SELECT *, lag(top) OVER (ORDER BY fold_id) AS prev FROM t)
 SELECT fold_id, round(len(list_intersect(top, prev)) / len(list_distinct(list_concat(top, prev))), 6) AS jaccard FROM l WHERE prev IS NOT NULL""")
def importance_overlap(spark, sf_dir):
    return stability.top_overlap(_values(spark, sf_dir), 2).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY score, id) AS rn, count(*) OVER (PARTITION BY fold_id) AS n FROM cells)
 SELECT fold_id, percent, id, score FROM r, (VALUES (10), (50), (90)) AS p(percent) WHERE rn = (percent * n + 99) // 100""")
def representative_cases(spark, sf_dir):
    return stability.representative(cells(spark, sf_dir), CELL)


_TWO = [POLICIES[0], POLICIES[2]]


@query(f"""WITH {_CELLS}, {_alloc_sql(_TWO)}, s AS (SELECT fold_id, id, bool_or(policy_id = 'pure_risk') AS a, bool_or(policy_id = 'floor_10') AS b FROM dec WHERE mechanism <> 'not_selected' GROUP BY ALL)
 SELECT fold_id, count(*) FILTER (WHERE a AND NOT b) AS only_left, count(*) FILTER (WHERE b AND NOT a) AS only_right, bool_and(a AND b) AS same FROM s GROUP BY 1""")
def queue_difference(spark, sf_dir):
    return stability.queue_difference(decided(spark, sf_dir, _TWO).where("is_selected"), CELL, "pure_risk", "floor_10")


@query(f"WITH {_CELLS} SELECT CAST(sum(least({K}, n)) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT fold_id, count(*) AS n FROM cells GROUP BY 1)")
def pooled_capacity(spark, sf_dir):
    return stability.pooled_capacity(cells(spark, sf_dir), CELL, K)


@query(f"""WITH {_CELLS}, g AS (SELECT fold_id, d, count(*) AS n FROM cells GROUP BY ALL)
 SELECT fold_id, d, n, coalesce(sum(n) OVER (PARTITION BY fold_id ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100 < sum(n) OVER (PARTITION BY fold_id) * 20 AS held FROM g""")
def inner_split(spark, sf_dir):
    return stability.inner_split(cells(spark, sf_dir), CELL, 20)


@query(f"""WITH x AS ({ORACLES["calib_select"]}) SELECT count(*) FILTER (WHERE prev <> method) AS n_switches, count(*) AS n_folds FROM (SELECT method, lag(method) OVER (ORDER BY fold_id) AS prev FROM x)""")
def method_switches(spark, sf_dir):
    return stability.method_switches(calib_select(spark, sf_dir))


@query(f"WITH {_INSP} SELECT name, count(DISTINCT establishment_id) AS n_places FROM insp WHERE d < DATE '{PLANNING}' GROUP BY 1 HAVING count(DISTINCT establishment_id) > 1")
def chain_names(spark, sf_dir):
    return stability.chain_names(inspections(spark, sf_dir), PLANNING)


_MODELS = "VALUES ('a', 0.21D, 0.19D, 0.23D, 0.05D, 0.50D), ('b', 0.24D, 0.22D, 0.26D, 0.06D, 0.52D), ('c', 0.23D, 0.20D, 0.25D, 0.04D, 0.51D), ('d', 0.18D, 0.16D, 0.20D, 0.01D, 0.40D)"


@query(f"""WITH m AS (SELECT * FROM ({_MODELS.replace("D", "::DOUBLE")}) AS t(model, nde, lo, hi, ece, prec)), c AS (SELECT *, hi >= (SELECT arg_max(lo, (nde, lo)) FROM m) AS is_contender FROM m)
 SELECT model, is_contender, row_number() OVER (ORDER BY is_contender DESC, ece, prec DESC, model) = 1 AS is_chosen FROM c""")
def model_choice(spark, sf_dir):
    return stability.model_choice(spark.sql(f"SELECT * FROM {_MODELS} AS t(model, nde, lo, hi, ece, prec)"))


@query(f"""WITH x AS ({ORACLES["month_effects"]}) SELECT round(max(effect) - min(effect), 6) AS amplitude FROM x""")
def seasonal_amplitude(spark, sf_dir):
    return month_effects(spark, sf_dir).agg(F.round(F.max("effect") - F.min("effect"), 6).alias("amplitude"))


# --- uncertainty and approval ---------------------------------------------------------


@query(f"""WITH {_CELLS}, p AS (SELECT x.fold_id, sum(sign(x.score - y.score) * sign(x.area - y.area)) AS s, count(*) FILTER (WHERE sign(x.score - y.score) * sign(x.area - y.area) < 0) AS inversions, count(*) FILTER (WHERE x.score <> y.score)::DOUBLE AS da, count(*) FILTER (WHERE x.area <> y.area)::DOUBLE AS db FROM cells x JOIN cells y ON x.fold_id = y.fold_id AND x.id < y.id GROUP BY 1),
 t AS (SELECT fold_id, greatest(0, count(DISTINCT score) - count(DISTINCT area)) AS new_ties FROM cells GROUP BY 1) SELECT fold_id, round(s / sqrt(nullif(da * db, 0)), 6) AS tau_b, inversions, new_ties FROM t JOIN p USING (fold_id)""")
def rank_agreement(spark, sf_dir):
    return uncertainty.rank_agreement(cells(spark, sf_dir), CELL, "score", "area").withColumn("tau_b", F.round("tau_b", 6))


_NEWTON = "n0 AS (SELECT DISTINCT fold_id, 0::DOUBLE AS i, 0::DOUBLE AS s FROM cells)" + "".join(
    f""", s{k} AS (SELECT z.fold_id, i, s, z, y, 1 / (1 + exp(-(i + s * z))) AS p FROM z JOIN n{k} USING (fold_id)),
 t{k} AS (SELECT fold_id, any_value(i) AS i, any_value(s) AS s, sum(p * (1 - p)) AS a, sum(p * (1 - p) * z) AS b, sum(p * (1 - p) * z * z) AS c, sum(y - p) AS g, sum((y - p) * z) AS h FROM s{k} GROUP BY 1),
 n{k + 1} AS MATERIALIZED (SELECT fold_id, i + (c * g - b * h) / nullif(a * c - b * b, 0) AS i, s + (a * h - b * g) / nullif(a * c - b * b, 0) AS s FROM t{k})"""
    for k in range(8)
)


@query(f"""WITH {_CELLS}, z AS MATERIALIZED (SELECT fold_id, label::DOUBLE AS y, ln(q / (1 - q)) AS z FROM (SELECT fold_id, label, least(greatest(score, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM cells)), {_NEWTON} SELECT fold_id, round(i, 6) AS intercept, round(s, 6) AS slope FROM n8""")
def calibration_slope(spark, sf_dir):
    return uncertainty.calibration_slope(cells(spark, sf_dir), CELL).withColumns({c: F.round(c, 6) for c in ("intercept", "slope")})


_M = uncertainty.MODULUS
_WEIGHT = " + ".join(f"(u >= {t!r}::DOUBLE)::BIGINT" for t in uncertainty.POISSON)


@query(f"""WITH {_CELLS}, h AS (SELECT fold_id, scheme, rep, label, pow(score - label, 2) AS loss, (key % {_M} * 48271 + rep * 69621 + 11) % {_M} AS h FROM (SELECT *, unnest(['row', 'block']) AS scheme, unnest([id, establishment_id]) AS key FROM cells), range(1, 1001) AS r(rep)),
 w AS (SELECT fold_id, scheme, rep, label, loss, {_WEIGHT} AS w FROM (SELECT *, ((h * h + 7) % {_M} * 16807) % {_M} / {_M}::DOUBLE AS u FROM h)),
 d AS (SELECT fold_id, scheme, rep, CASE WHEN sum(w * label) > 0 AND sum(w * label) < sum(w) THEN sum(w * loss) / sum(w) END AS brier FROM w GROUP BY ALL)
 SELECT fold_id, scheme, count(*) FILTER (WHERE brier IS NULL) AS degenerate, CASE WHEN count(brier) >= 950 THEN round(quantile_cont(brier, 0.025), 6) END AS low, CASE WHEN count(brier) >= 950 THEN round(quantile_cont(brier, 0.975), 6) END AS high FROM d GROUP BY ALL""")
def bootstrap_brier(spark, sf_dir):
    b = uncertainty.bootstrap_brier(cells(spark, sf_dir), CELL, {"row": "id", "block": "establishment_id"})
    return b.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query(f"""WITH {_CELLS}, {_alloc_sql()}, said AS (SELECT fold_id, id, area, CASE WHEN id % 6 = 0 THEN 'accept' END AS decision, CASE WHEN id % 12 = 0 THEN 'local_knowledge' END AS reason FROM dec WHERE mechanism <> 'not_selected'),
 chk AS (SELECT fold_id, count(*) AS n_rows, count(decision) AS n_decided, count(*) - count(DISTINCT id) AS n_repeated, CAST(0 AS BIGINT) AS n_unranked, count(*) FILTER (WHERE area IS NULL) AS n_unplaced, count(*) FILTER (WHERE decision IS NOT NULL AND coalesce(reason, '') = '') AS n_unexplained FROM said GROUP BY 1)
 SELECT *, n_repeated + n_unplaced + n_unexplained = 0 AS ready, CASE WHEN n_decided = 0 THEN 'draft' WHEN n_decided >= n_rows THEN 'adjusted' ELSE 'under_supervisor_review' END AS status FROM chk""")
def approval_checks(spark, sf_dir):
    plan = _plan(spark, sf_dir)[1].withColumns({"decision": F.when(F.col("id") % 6 == 0, "accept"), "reason": F.when(F.col("id") % 12 == 0, "local_knowledge")})
    return uncertainty.approval_checks(plan, CELL)


from . import operations, studies  # noqa: E402, F401  (their queries register themselves)
