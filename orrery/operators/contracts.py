"""Contracts that refuse or count: what must hold of the tables that operators are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table that breaks a contract."""


# Columns that tell the outcome and must not reach a decision.
OUTCOMES = ("label", "target", "results", "result", "violations", "priority", "foundation", "target_status")


def refuse_outcomes(rows: DataFrame, forbidden: tuple = OUTCOMES) -> DataFrame:
    """``rows`` unless a column tells the outcome that the decision is about."""
    found = sorted(c for c in rows.columns if c.lower() in forbidden)
    if found:
        raise ContractError(f"outcome columns reach the decision: {', '.join(found)}")
    return rows


def scoped(rows: DataFrame, scope: dict, needed: list[str]) -> DataFrame:
    """Rows equal to every given value of the scope; the ``needed`` keys must be given."""
    missing = [c for c in needed if scope.get(c) is None]
    if missing:
        raise ContractError(f"scope lacks {', '.join(missing)}")
    for c, v in scope.items():
        if v is not None:
            if c not in rows.columns:
                raise ContractError(f"no column {c} to scope by")
            rows = rows.where(F.col(c) == v)
    return rows


def refuse_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` unless a key comes twice; a null counts as a value."""
    twice = duplicates(rows, key).limit(3).collect()
    if twice:
        raise ContractError(f"{', '.join(key)} repeated: {[tuple(r)[: len(key)] for r in twice]}")
    return rows


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def refuse_nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` unless one of the columns is null somewhere."""
    bad = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first().asDict()
    if any(bad.values()):
        raise ContractError(f"nulls: {({c: n for c, n in bad.items() if n})}")
    return rows


def scorable(rows: DataFrame, needed: list[str], key: str) -> DataFrame:
    """Every row with ``scoring_status``: scored, or the first needed column that it lacks; rows
    that repeat a key are all marked."""
    status = F.when(F.col(key).isNull(), f"missing_{key}")
    for c in needed:
        bad = F.col(c).isNull() | F.isnan(c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c).isNull()
        status = status.when(bad, f"missing_{c}")
    twice = duplicates(rows.where(F.col(key).isNotNull()), [key]).select(key, F.lit(True).alias("_twice"))
    out = rows.join(twice, key, "left").withColumn("scoring_status", F.when(F.col("_twice"), "repeated").otherwise(F.coalesce(status, F.lit("scored"))))
    return out.drop("_twice")


def prediction_violations(predictions: DataFrame, universe: DataFrame, cell: list[str], through: str = "trained_through", end: str = "calibration_end") -> DataFrame:
    """Per cell: ids of the universe without a score, scores outside it, repeated ids, scores that
    are null or not finite or no probabilities, and rows trained past the end of calibration.

    ``universe`` has one row an id, with ``end``.  A cell without any violation has zeros.
    """
    key = [*cell, "id"]
    p = predictions.groupBy(*key).agg(
        F.count("*").alias("_n"), F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("_bad"),
        F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("_out"), F.max(through).alias("_through"),
    )
    both = universe.select(*key, end).withColumn("_known", F.lit(True)).join(p, key, "full")
    return both.groupBy(*cell).agg(
        F.count_if(F.col("_n").isNull()).alias("n_missing"), F.count_if(F.col("_known").isNull()).alias("n_unexpected"), F.count_if(F.col("_n") > 1).alias("n_repeated"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_not_finite"), F.coalesce(F.sum("_out"), F.lit(0)).alias("n_no_probability"), F.count_if(F.col("_through") > F.col(end)).alias("n_trained_late"),
    )


def aligned(universe: DataFrame, predictions: DataFrame, cell: list[str]) -> DataFrame:
    """The scores in the universe's rows, by id: rows without a score keep a null one."""
    return universe.join(predictions.select(*cell, "id", "score"), [*cell, "id"], "left")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """``check_name, violations``: how many rows each frame of violations has."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def policy_violations(decided: DataFrame, universe: DataFrame, cell: list[str]) -> dict[str, DataFrame]:
    """What must hold of a decided queue of every cell."""
    s, risk, reserve = F.col("is_selected"), F.col("mechanism") == "risk_priority", F.col("mechanism") == "coverage_reserve"
    per = decided.groupBy(*cell).agg(
        F.count("*").alias("n"), F.max("k").alias("k"), F.count_if(s).alias("selected"), F.count_if(risk).alias("risk"), F.count_if(reserve).alias("reserve"),
        F.count_if(F.col("eligible")).alias("eligible"), F.max("g").alias("g"), F.min(F.when(s, F.col("final_rank"))).alias("first"), F.max(F.when(s, F.col("final_rank"))).alias("last"),
        F.countDistinct(F.when(s, F.col("final_rank"))).alias("ranks"),
    )
    legal = (risk & (F.col("reason") == "selected_by_risk_rank")) | (reserve & (F.col("reason") == "selected_by_coverage_reserve")) | ((F.col("mechanism") == "not_selected") & F.col("reason").isin("not_selected_capacity_exhausted", "not_selected_reserve_exhausted"))
    whole = per.select(*cell, "n").join(universe, cell, "full").where(~F.col("n").eqNullSafe(F.col("n_universe")))
    return {
        "cell_covers_universe": whole,
        "selected_is_capacity": per.where("selected <> least(k, n)"),
        "mechanisms_add_up": per.where("risk + reserve <> selected"),
        "reserve_within_target_and_supply": per.where("reserve > g or reserve > eligible"),
        "risk_is_the_best_ranks": decided.join(per.select(*cell, F.col("risk").alias("_risk")), cell).where(risk != (F.col("model_rank") <= F.col("_risk"))),
        "reserve_is_eligible": decided.where(reserve & ~F.col("eligible")),
        "mechanism_fits_reason": decided.where(~legal),
        "selected_by_a_selected_reason": decided.where(s != F.col("reason").startswith("selected_")),
        "ranks_unique_and_contiguous": per.where("selected > 0 and (first <> 1 or last <> selected or ranks <> selected)"),
        "unselected_have_no_rank": decided.where(~s & F.col("final_rank").isNotNull()),
        "id_selected_once": decided.where(s).groupBy(*cell, "id").count().where("count > 1"),
    }


def schedule_violations(plan: DataFrame, days: DataFrame, queue: DataFrame, cell: list[str]) -> dict[str, DataFrame]:
    """What must hold of a plan laid on its horizon."""
    placed = plan.where("status = 'scheduled'")
    used = placed.groupBy(*cell, "slot_date").agg(F.count("*").alias("used"), F.max("slot_index").alias("top"))
    span = days.groupBy(*cell).agg(F.count("*").alias("n"), F.min("day_index").alias("first"), F.max("day_index").alias("last"), F.countDistinct("slot_date").alias("dates"))
    known = days.select(*(F.col(c) for c in cell), "slot_date", "n_slots")
    return {
        "slot_taken_once": placed.groupBy(*cell, "slot_date", "slot_index").count().where("count > 1"),
        "id_in_one_slot": placed.groupBy(*cell, "id").count().where("count > 1"),
        "day_within_capacity": used.join(known, [*cell, "slot_date"], "left").where("n_slots is null or used > n_slots or top > n_slots"),
        "queue_is_accounted_for": queue.select(*cell, "id").join(plan.select(*cell, "id", F.lit(1).alias("_p")), [*cell, "id"], "full").where("_p is null"),
        "days_contiguous": span.where("first <> 1 or last <> n or dates <> n"),
        "backlog_has_no_slot": plan.where("(status = 'backlog') <> (slot_date is null) or (status = 'backlog') <> (slot_index is null)"),
        "status_is_known": plan.where("status not in ('scheduled', 'backlog')"),
    }
