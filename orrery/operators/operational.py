"""The operational path: candidates scored at a planning date, ranked, and selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import policy
from .contracts import refuse_outcomes, scorable
from .running import by_risk

UNSCORABLE = "excluded_unscorable"


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Every candidate with ``scoring_status`` and, if scored, ``operational_rank``: 1, 2, ... by
    falling score, then id."""
    marked = scorable(rows, ["score"], key)
    scored = by_risk(marked.where("scoring_status = 'scored'").withColumns({"id": F.col(key), "_cell": F.lit(0)}), ["_cell"], pos="operational_rank").drop("id", "_cell")
    return scored.unionByName(marked.where("scoring_status <> 'scored'"), allowMissingColumns=True)


def select(rows: DataFrame, key: str, capacity: int, share: float, forced: bool) -> DataFrame:
    """``key, mechanism, reason, policy_rank`` of every ranked candidate at the requested capacity.

    Rows without a score are never selected and say so; a capacity of zero selects none.
    Outcome columns are refused.
    """
    if capacity < 0:
        raise ValueError("capacity is negative")
    refuse_outcomes(rows)
    window = rows.where("scoring_status = 'scored'").select(F.col(key).alias("id"), "score", "eligible", F.lit("planned").alias("cell"), F.lit(max(capacity, 1)).alias("k"))
    decided = policy.allocate(window, ["cell"], F.lit(share), F.lit(forced)).select(F.col("id").alias(key), "mechanism", "reason", F.col("final_rank").alias("policy_rank"))
    if capacity == 0:
        decided = decided.select(key, F.lit(policy.NOT_SELECTED).alias("mechanism"), F.lit(policy.OUTRANKED).alias("reason"), F.lit(None).cast("int").alias("policy_rank"))
    left_out = rows.where("scoring_status <> 'scored'").select(key, F.lit(policy.NOT_SELECTED).alias("mechanism"), F.lit(UNSCORABLE).alias("reason"), F.lit(None).cast("int").alias("policy_rank"))
    return decided.unionByName(left_out)
