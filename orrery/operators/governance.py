"""Human decisions: overrides, review cases, execution records and approvals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policy import RISK


def apply_overrides(queue: DataFrame, overrides: DataFrame, cell: list[str]) -> DataFrame:
    """The outcome of every override of a cell, applied in id order; the queue stays as it is.

    force_include displaces the lowest-ranked risk row still standing; force_exclude leaves a
    hole.  Order matters inside a cell, which holds one approved queue: its size is the
    capacity, not the data.  Outcomes: applied, already_selected, not_selected, not_in_queue.
    """
    schema = ", ".join([*(f"{c} {dict(queue.dtypes)[c]}" for c in cell), "override_id string, target_id string, action string, outcome string, displaced_id string"])

    def run(key: tuple, q: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        known = {str(r.id): [bool(r.is_selected), r.mechanism, r.model_rank] for r in q.itertuples()}
        out = []
        for r in o.sort_values("override_id").itertuples():
            row, displaced = known.get(str(r.target_id)), None
            if row is None:
                outcome = "not_in_queue"
            elif r.action == "force_include":
                outcome = "already_selected"
                if not row[0]:
                    standing = [(v[2], i) for i, v in known.items() if v[0] and v[1] == RISK]
                    if standing:
                        displaced = max(standing)[1]
                        known[displaced][0] = False
                    row[0], row[1], outcome = True, "override", "applied"
            else:
                outcome = "applied" if row[0] else "not_selected"
                row[0] = False
            out.append((*key, r.override_id, str(r.target_id), r.action, outcome, displaced))
        return pd.DataFrame(out, columns=[*cell, "override_id", "target_id", "action", "outcome", "displaced_id"])

    return queue.groupBy(*cell).cogroup(overrides.groupBy(*cell)).applyInPandas(run, schema)


def execution_summary(plan: DataFrame, events: DataFrame, cell: list[str]) -> DataFrame:
    """Events by what they say of the plan: recorded, no_op on backlog rows, not_in_plan."""
    e = events.join(plan.select(*cell, "id", "status"), [*cell, "id"], "left")
    outcome = F.when(F.col("status").isNull(), "not_in_plan").when(F.col("status") == "scheduled", "recorded").otherwise("no_op")
    return e.groupBy(*cell, outcome.alias("outcome"), "execution_status").agg(F.count("*").alias("n"))


def review_cases(flagged: DataFrame, unrecorded: DataFrame, key: list[str]) -> DataFrame:
    """Union of both triggers, one case a key, reasons as a sorted set."""
    both = flagged.select(*key, F.lit("warning").alias("r")).unionByName(unrecorded.select(*key, F.lit("no_execution_record").alias("r")))
    return both.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("r")), "|").alias("reasons"))


def resolve(cases: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Each case with its first decision by id, else open."""
    first = decisions.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("decision_id"))).where("_n = 1").select(*key, "decision")
    return cases.join(first, key, "left").withColumn("status", F.coalesce("decision", F.lit("open"))).drop("decision")


def nearest_order(places: DataFrame, group: str) -> DataFrame:
    """Greedy nearest-neighbour visiting order inside a block, from its best rank.

    Ties go by rank, then id.  A block is one crew's area; the walk is sequential by nature.
    """
    kind = dict(places.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left = pdf.sort_values(["final_rank", "id"]).reset_index(drop=True)
        y, x = np.radians(left.lat.to_numpy()), np.radians(left.lon.to_numpy())
        open_, at, order = np.ones(len(left), bool), 0, []
        while True:
            order.append(at)
            open_[at] = False
            if not open_.any():
                break
            h = np.sin((y - y[at]) / 2) ** 2 + np.cos(y) * np.cos(y[at]) * np.sin((x - x[at]) / 2) ** 2
            h[~open_] = np.inf
            at = int(np.argmin(np.round(h, 15)))
        return pd.DataFrame({group: left[group].to_numpy()[order], "id": left.id.to_numpy()[order], "visit": np.arange(1, len(order) + 1)})

    return places.groupBy(group).applyInPandas(walk, f"{group} {kind[group]}, id {kind['id']}, visit long")


def adjust(plan: DataFrame, days: DataFrame, adjustments: DataFrame, cell: list[str]) -> DataFrame:
    """The outcome of every adjustment of a plan, applied in id order.

    ``plan``: id, status, slot_date, slot_index, final_rank, mechanism; ``adjustments``:
    adjustment_id, id, action (cancel, defer_to_date, advance_to_date), target_date.  A moved row
    takes the first free slot of its new day, else that of the day's lowest standing risk row,
    which lands in the slot left.  Reserve rows are never displaced, and no row leaves the
    horizon.  Order matters inside a cell, which holds one approved queue: its size is the
    capacity, not the data.  What the rules refuse is an outcome of its own: ``refused_day``,
    ``refused_direction``, ``refused_full``.
    """
    kinds = dict(plan.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cell), f"adjustment_id string, id {kinds['id']}, action string, outcome string, final_status string, final_date date, displaced_id {kinds['id']}"])
    both = plan.select(*cell, "id", "status", "slot_date", "slot_index", "final_rank", "mechanism")
    rows = both.join(days.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("slot_date", F.col("n_slots").cast("int")))).alias("_days")), cell, "left")

    def run(key: tuple, p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        slots = dict(p["_days"].iloc[0] or {}) if len(p) else {}
        now = {r.id: [r.status, r.slot_date, None if pd.isna(r.slot_index) else int(r.slot_index), int(r.final_rank), r.mechanism] for r in p.itertuples()}
        out = []

        def taken(day) -> dict[int, object]:
            return {v[2]: i for i, v in now.items() if v[1] == day and v[2] is not None}

        for r in a.sort_values("adjustment_id").itertuples():
            row, displaced, status, date = now.get(r.id), None, None, None
            if row is None:
                outcome = "row_not_in_plan"
            elif r.action == "cancel":
                outcome, status = "applied", "cancelled"
                row[0], row[1], row[2] = status, None, None
            elif row[2] is None:
                outcome, status = "no_op_not_scheduled", row[0]
            elif r.target_date not in slots:
                outcome = "refused_day"
            elif r.target_date == row[1]:
                outcome, status, date = "no_op_already_on_date", row[0], row[1]
            elif (r.action == "defer_to_date") != (r.target_date > row[1]):
                outcome = "refused_direction"
            else:
                used = taken(r.target_date)
                free = next((s for s in range(1, slots[r.target_date] + 1) if s not in used), None)
                if free is None:
                    standing = [(now[i][3], i) for i in used.values() if now[i][4] == RISK and i != r.id]
                    displaced = max(standing)[1] if standing else None
                if free is None and displaced is None:
                    outcome = "refused_full"
                else:
                    if displaced is not None:
                        free = now[displaced][2]
                        now[displaced][:3] = ["deferred", row[1], row[2]]
                    status = "deferred" if r.action == "defer_to_date" else "scheduled"
                    row[:3] = [status, r.target_date, free]
                    outcome, date = "applied", r.target_date
            out.append((*key, r.adjustment_id, r.id, r.action, outcome, status, date, displaced))
        return pd.DataFrame(out, columns=[*cell, "adjustment_id", "id", "action", "outcome", "final_status", "final_date", "displaced_id"])

    return rows.groupBy(*cell).cogroup(adjustments.groupBy(*cell)).applyInPandas(run, schema)
