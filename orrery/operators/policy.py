"""Selection under capacity with a coverage reserve, and what comes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import by_risk

# How a row came to its place, and why.
RISK, RESERVE, NOT_SELECTED = "risk_priority", "coverage_reserve", "not_selected"
BY_RISK, BY_RESERVE, OUTRANKED, RESERVE_USED = "selected_by_risk_rank", "selected_by_coverage_reserve", "not_selected_capacity_exhausted", "not_selected_reserve_exhausted"


def ranked(rows: DataFrame, cell: list[str]) -> DataFrame:
    """``model_rank``, and ``cum``: eligible rows up to and with each, along the risk order.

    Neither depends on the policy or the capacity, so a grid of those is laid over the result.
    """
    return by_risk(rows, cell, {"cum": F.col("eligible").cast("int")}, "model_rank").withColumn("model_rank", F.col("model_rank").cast("int"))


def allocate(rows: DataFrame, cell: list[str], share: Column, forced: Column) -> DataFrame:
    """Every row with its mechanism, reason and place in the queue of its cell.

    ``rows`` carry id, score, eligible, label and the capacity ``k``, and may be ``ranked``
    already.  Of k places, g go to the first eligible rows below the cut at k - g and the rest to
    the best by risk; g is the largest feasible number up to the target.  With running counts E
    of eligible rows, g is feasible if the rows below rank k - g hold at least g eligible ones.
    What holds for the whole cell is two small aggregates; no row meets another.
    """
    r = rows if "model_rank" in rows.columns else ranked(rows, cell)
    r = r.withColumns({"_share": share, "_forced": forced})
    whole = r.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum(F.col("eligible").cast("int")).alias("_total"), F.max(F.when(F.col("model_rank") <= F.col("k"), F.col("cum"))).alias("_at_k"), F.max("k").alias("_k"), F.max("_share").alias("_s"), F.max("_forced").alias("_f"))
    whole = whole.withColumn("_k", F.least("_k", "_n").cast("int"))
    target = F.floor(F.col("_k") * F.col("_s"))
    whole = whole.withColumn("_wanted", F.when(F.col("_f"), F.least(target, F.col("_k"))).otherwise(F.greatest(F.lit(0), target - F.coalesce("_at_k", F.lit(0)))))
    # x = k - rank is feasible at a rank if total - cum[rank] >= x; rank 0 has cum 0.
    x = F.col("_k") - F.col("model_rank")
    some = r.select(*cell, "model_rank", "cum").join(whole.select(*cell, "_k", "_wanted", "_total"), cell).where((x >= 0) & (x <= F.col("_wanted")) & (F.col("_total") - F.col("cum") >= x))
    some = some.groupBy(*cell).agg(F.max(x).alias("_g"), F.max_by("cum", x).alias("_cum"))
    all_reserve = (F.col("_wanted") >= F.col("_k")) & (F.col("_total") >= F.col("_k"))
    cut = whole.join(some, cell, "left").withColumn("g", F.when(all_reserve, F.col("_k")).otherwise(F.coalesce("_g", F.lit(0))))
    cut = cut.withColumn("_cum", F.when(all_reserve, F.lit(0)).otherwise(F.coalesce("_cum", F.col("_at_k"), F.lit(0)))).select(*cell, F.col("_k"), "g", "_cum")
    r = r.join(cut, cell).withColumn("k", F.col("_k"))
    risk = F.col("model_rank") <= F.col("k") - F.col("g")
    below = F.col("cum") - F.col("_cum")  # eligible rows since the cut, with this one
    reserve = ~risk & F.col("eligible") & (below <= F.col("g"))
    r = r.withColumn("mechanism", F.when(risk, RISK).when(reserve, RESERVE).otherwise(NOT_SELECTED)).withColumn("is_selected", risk | reserve)
    reason = F.when(risk, BY_RISK).when(reserve, BY_RESERVE).when(F.col("eligible"), RESERVE_USED).otherwise(OUTRANKED)
    place = F.when(risk, F.col("model_rank")).when(reserve, F.col("k") - F.col("g") + below).cast("int")
    return r.withColumn("reason", reason).withColumn("final_rank", place).drop("_k", "_cum", "_share", "_forced", "cum")


def cell_metrics(decided: DataFrame, cell: list[str]) -> DataFrame:
    """Selected, risk and reserve rows, hits, and capture of all positives."""
    s = F.col("is_selected")
    return decided.groupBy(*cell).agg(
        F.count_if(s).alias("n_selected"), F.count_if(F.col("mechanism") == RISK).alias("n_risk"), F.count_if(F.col("mechanism") == RESERVE).alias("n_reserve"),
        F.sum(F.when(s, F.col("label")).otherwise(0)).alias("hits"), (F.sum(F.when(s, F.col("label")).otherwise(0)) / F.nullif(F.sum("label"), F.lit(0))).alias("capture"),
        (F.count_if(s & F.col("eligible")) / F.nullif(F.count_if(F.col("eligible")), F.lit(0))).alias("coverage"),
    )


def opportunity_cost(metrics: DataFrame, cell: list[str], baseline: str = "pure_risk") -> DataFrame:
    """Hits given up against the baseline policy of the same cell."""
    base = metrics.where(F.col("policy_id") == baseline).select(*cell, F.col("hits").alias("base_hits"))
    return metrics.join(base, cell).withColumn("cost", F.col("base_hits") - F.col("hits"))


def frontier(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Points that no other point beats on one axis without losing on the other.

    Sorted by x downwards, a point stays if its y is above all y of larger x; equal points
    stay together.  One sort instead of a self-join of all pairs.
    """
    best_y = points.groupBy(x).agg(F.max(y).alias(y))
    before = F.max(y).over(Window.partitionBy(F.lit(0)).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    kept = best_y.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(y) > F.col("_b"))).drop("_b")
    return points.join(kept, [x, y], "left_semi").select(key, x, y)


def dominance(points: DataFrame, cell: list[str], key: str, axes: list[str]) -> DataFrame:
    """``points`` with ``is_dominated``, ``dominated_by`` (comma-joined keys) and ``winner``.

    A point is dominated by one of its cell that is no worse on any axis and better on one.  The
    winner is the one point of a cell that is left, null if there are several.  Points are the
    policies of a grid, a few a cell, whatever the rows behind them.
    """
    a, b = points.alias("a"), points.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cell] + [F.col(f"b.{x}") >= F.col(f"a.{x}") for x in axes]
    on.append(F.greatest(*(F.col(f"b.{x}") - F.col(f"a.{x}") for x in axes)) > 0)
    beaten = a.join(b, on).groupBy(*(F.col(f"a.{c}").alias(c) for c in [*cell, key])).agg(F.array_join(F.array_sort(F.collect_list(f"b.{key}")), ", ").alias("dominated_by"))
    out = points.join(beaten, [*cell, key], "left").withColumn("is_dominated", F.col("dominated_by").isNotNull()).withColumn("dominated_by", F.coalesce("dominated_by", F.lit("")))
    left = out.where(~F.col("is_dominated")).groupBy(*cell).agg(F.count("*").alias("_n"), F.min(key).alias("_only"))
    return out.join(left.select(*cell, F.when(F.col("_n") == 1, F.col("_only")).alias("winner")), cell, "left")
