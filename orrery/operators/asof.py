"""As-of operators: what was known of an entity strictly before a date.

History and targets are laid on one time line for each entity, and a target reads the rows in a
range frame that ends the day before it.  So there is one shuffle, on the entity, and no pair
of a target and an earlier row is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOK_BACKS = (365, 730, 1095)


def _timeline(targets: DataFrame, history: DataFrame, columns: list[str]) -> DataFrame:
    """History rows (``_seen``) and target rows by day; rows without entity or date have no history."""
    past = history.where("establishment_id is not null and d is not null").select("establishment_id", F.unix_date("d").alias("_day"), F.lit(True).alias("_seen"), "d", *columns)
    now = targets.select("establishment_id", F.unix_date("t").alias("_day"), F.lit(False).alias("_seen"), *(c for c in targets.columns if c != "establishment_id"))
    return past.unionByName(now, allowMissingColumns=True)


def features(targets: DataFrame, history: DataFrame, era: str, look_backs: tuple = LOOK_BACKS) -> DataFrame:
    """The features of every target row from the rows of its entity before its date.

    ``targets``: target_id, establishment_id, t, current_name.  ``history``:
    establishment_id, inspection_id, d, kind, results, name, priority, foundation.  Rows
    without history stay; counts are 0, and rates, ages and last values are null.
    """
    rows = _timeline(targets, history, ["inspection_id", "kind", "results", "name", "priority", "foundation"])
    seen = F.col("_seen")
    # Target rows are no history: every condition is false for them.
    rows = rows.withColumns({
        "_any": seen, "_c": F.coalesce(seen & (F.col("kind") == "CANVASS"), F.lit(False)),
        "_name": F.when(seen, F.col("name")).otherwise(F.col("current_name")),
    }).withColumn("_e", F.col("_c") & (F.col("d") >= F.lit(era).cast("date"))).withColumn("_i", F.col("_c") & F.col("results").isin("Fail", "Pass", "Pass w/ Conditions"))
    before = Window.partitionBy("establishment_id").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    named = Window.partitionBy("establishment_id", "_name").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    c, e, i = F.col("_c"), F.col("_e"), F.col("_i")
    n = lambda cond, w=before: F.count(F.when(cond, 1)).over(w)
    last = lambda x, cond: F.max(F.when(cond & x.isNotNull(), F.struct("d", "inspection_id", x.alias("x")))).over(before)["x"]
    date = lambda cond: F.max(F.when(cond, F.col("d"))).over(before)
    found = {
        "prior_canvass_count": n(c), "prior_canvass_count_code_era": n(e), "prior_canvass_inspected_count": n(i),
        "_last_c": date(c), "prior_canvass_fail_count": n(i & (F.col("results") == "Fail")),
        "prior_canvass_pass_w_conditions_count": n(i & (F.col("results") == "Pass w/ Conditions")),
        "_last_result": last(F.col("results"), c), "_priority": n(e & F.col("priority")), "_foundation": n(e & F.col("foundation")),
        "priority_at_last_canvass": last(F.col("priority"), e), "prior_inspection_count_any_type": n(seen), "_last": date(seen),
        "prior_complaint_count": n(F.col("kind").like("%COMPLAINT%")), "prior_reinspection_count": n(F.col("kind").like("%RE-INSPECTION%")),
        "prior_license_inspection_count": n(F.col("kind").like("LICENSE%")), "_last_name": last(F.col("name"), c),
        "_first": F.min(F.when(seen, F.col("d"))).over(before),
    }
    for days in look_backs:
        frame = Window.partitionBy("establishment_id").orderBy("_day").rangeBetween(-days, -1)
        found[f"canvasses_last_{days}d"] = n(c, frame)
        found[f"canvass_priority_events_last_{days}d"] = n(e & F.col("priority"), frame)
    g = rows.withColumns(found).withColumn("prior_canvass_count_current_name", n(c, named)).where("not _seen")
    had = F.col("prior_canvass_count") > 0
    coded = F.col("prior_canvass_count_code_era") > 0
    g = g.withColumns({
        "days_since_last_canvass": F.datediff("t", "_last_c"),
        "prior_canvass_fail_rate": ratio(F.col("prior_canvass_fail_count"), F.col("prior_canvass_inspected_count")),
        "fail_at_last_canvass": F.when(had, F.col("_last_result") == "Fail"),
        "prior_canvass_priority_count": F.when(coded, F.col("_priority")),
        "prior_canvass_priority_foundation_count": F.when(coded, F.col("_foundation")),
        "prior_canvass_priority_rate": ratio(F.col("_priority"), F.col("prior_canvass_count_code_era")),
        "days_since_any_inspection": F.datediff("t", "_last"),
        "name_changed_since_last_canvass": F.when(had, ~F.col("_last_name").eqNullSafe(F.col("current_name"))),
        "days_since_first_inspection": F.datediff("t", "_first"),
    })
    extra = ["days_since_last_canvass", "prior_canvass_fail_rate", "fail_at_last_canvass", "prior_canvass_priority_count", "prior_canvass_priority_foundation_count", "prior_canvass_priority_rate", "days_since_any_inspection", "name_changed_since_last_canvass", "days_since_first_inspection"]
    return g.select("target_id", "establishment_id", "t", *(k for k in found if not k.startswith("_")), "prior_canvass_count_current_name", *extra)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the denominator is zero."""
    return F.when(bottom > 0, top / bottom)


def last_attribute(targets: DataFrame, history: DataFrame, value: str) -> DataFrame:
    """The latest earlier ``value`` of the entity; of equal dates the last id as text counts."""
    return last_attributes(targets, history, [value]).select("target_id", "establishment_id", value, "source_id", "days_since_source")


def last_attributes(targets: DataFrame, history: DataFrame, values: list[str]) -> DataFrame:
    """The latest earlier value of every attribute, each from its own last row that has one;
    ``source_id`` and ``days_since_source`` are of the first attribute's row."""
    rows = _timeline(targets.select("target_id", "establishment_id", "t"), history, ["inspection_id", *values])
    before = Window.partitionBy("establishment_id").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    for v in values:
        row = F.struct("d", F.col("inspection_id").cast("string").alias("id"), F.col(v).alias("v"))
        rows = rows.withColumn(f"_{v}", F.max(F.when(F.col("_seen") & F.col(v).isNotNull(), row)).over(before))
    first = f"_{values[0]}"
    out = rows.where("not _seen")
    return out.select("target_id", "establishment_id", *(F.coalesce(F.col(f"_{v}")["v"], F.lit("__UNKNOWN__")).alias(v) for v in values), F.col(first)["id"].alias("source_id"), F.datediff("t", F.col(first)["d"]).alias("days_since_source"))


def universe(history: DataFrame, planning: str) -> DataFrame:
    """Entities with a record strictly before the planning date, with their latest state."""
    before = history.where(F.col("d") < F.lit(planning).cast("date"))
    order = F.struct("d", "inspection_id")
    return before.groupBy("establishment_id").agg(
        F.count("*").alias("prior_count"), F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.max_by("name", order).alias("last_name"), F.max_by("kind", order).alias("last_kind")
    ).select(F.concat(F.lit(f"CANDIDATE::{planning}::"), F.col("establishment_id").cast("string")).alias("candidate_id"), "*")


def fixed_fold(rows: DataFrame, name: str, start: str, train_end: str, calibration_end: str, test_end: str) -> DataFrame:
    """Rows of a fold whose dates are given, with their split."""
    day = lambda x: F.lit(x).cast("date")
    split = F.when(F.col("d") <= day(train_end), "train").when(F.col("d") <= day(calibration_end), "calibration").otherwise("test")
    return rows.where(F.col("d").between(day(start), day(test_end))).withColumn("split", split).withColumn("fold_id", F.lit(name))
