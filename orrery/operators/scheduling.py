"""Laying a ranked queue onto an operating calendar, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def horizon(calendar: DataFrame, cell: list[str], k: int, weeks_cap: int | None = None) -> DataFrame:
    """The first ceil(k / median slots) days of every calendar, with the slots before each."""
    days = Window.partitionBy(*cell).orderBy("slot_date")
    c = calendar.join(calendar.groupBy(*cell).agg(F.median("n_slots").alias("_m")), cell)
    c = c.withColumn("day_index", F.row_number().over(days)).withColumn("_span", F.ceil(F.lit(k) / F.col("_m")))
    c = c.where(F.col("day_index") <= (F.least("_span", F.lit(weeks_cap)) if weeks_cap else F.col("_span")))
    before = F.coalesce(F.sum("n_slots").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("slots_before", before).drop("_m", "_span")


def fill(queue: DataFrame, days: DataFrame, cell: list[str], rank: str = "final_rank") -> DataFrame:
    """Rank r goes to the day whose slots cover place r; the rest is backlog.

    The join is on the cell; the range of places is its residue.
    """
    q = queue.withColumn("_place", F.row_number().over(Window.partitionBy(*cell).orderBy(rank)) - 1)
    d = days.select(*cell, "slot_date", "day_index", "slots_before", "n_slots")
    on = [q[c] == d[c] for c in cell] + [(q["_place"] >= d["slots_before"]) & (q["_place"] < d["slots_before"] + d["n_slots"])]
    placed = q.join(d, on, "left").select(*(q[c] for c in q.columns), "slot_date", "day_index", "slots_before")
    slot = F.col("_place") - F.col("slots_before") + 1
    return placed.withColumn("slot_index", slot).withColumn("status", F.when(F.col("slot_date").isNull(), "backlog").otherwise("scheduled")).drop("_place", "slots_before")


def utilization(days: DataFrame, plan: DataFrame, cell: list[str]) -> DataFrame:
    """Used slots and their share for every day of the horizon."""
    used = plan.where("status = 'scheduled'").groupBy(*cell, "slot_date").agg(F.count("*").alias("used"))
    out = days.join(used, [*cell, "slot_date"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.select(*cell, "slot_date", "n_slots", "used", (F.col("used") / F.nullif("n_slots", F.lit(0))).alias("utilization"))


def replan(plan: DataFrame, days: DataFrame, events: DataFrame, cell: list[str], today: str) -> DataFrame:
    """Freeze completed and past rows, drop cancelled ones, and re-place the rest by rank.

    Open slots of the days from today on are numbered in date order; waiting rows take them
    by rank: two numbered sides and one equi join.
    """
    now = F.lit(today).cast("date")
    known = plan.join(events.select(*cell, "id", "execution_status"), [*cell, "id"], "left")
    past = (F.col("execution_status") == "completed") | (F.col("status") == "scheduled") & (F.col("slot_date") < now)
    frozen = known.where(F.coalesce(past, F.lit(False)) & ~F.coalesce(F.col("execution_status") == "cancelled_in_field", F.lit(False)))
    waiting = known.where(~F.coalesce(past, F.lit(False)) & ~F.coalesce(F.col("execution_status") == "cancelled_in_field", F.lit(False)))
    slots = days.where(F.col("slot_date") >= now).select(*cell, "slot_date", "day_index", F.explode(F.sequence(F.lit(1), F.col("n_slots").cast("int"))).alias("slot_index"))
    free = slots.join(frozen.select(*cell, "slot_date", "slot_index"), [*cell, "slot_date", "slot_index"], "left_anti")
    free = free.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy("slot_date", "slot_index")))
    queue = waiting.drop("slot_date", "day_index", "slot_index", "status").withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy("final_rank")))
    moved = queue.join(free, [*cell, "_n"], "left").withColumn("status", F.when(F.col("slot_date").isNull(), "backlog").otherwise("scheduled"))
    cols = [*cell, "id", "final_rank", "slot_date", "slot_index", "status"]
    return frozen.select(cols).withColumn("frozen", F.lit(True)).unionByName(moved.select(cols).withColumn("frozen", F.lit(False)))


def preservation(plan: DataFrame, cell: list[str]) -> DataFrame:
    """How far the calendar order departs from the queue order: depth below the running best."""
    w = Window.partitionBy(*cell).orderBy("slot_date", "slot_index")
    p = plan.where("status = 'scheduled'").withColumn("pos", F.row_number().over(w))
    p = p.withColumn("depth", F.greatest(F.lit(0), F.coalesce(F.max("final_rank").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("final_rank")))
    return p.groupBy(*cell).agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"), F.count_if(F.col("depth") > 0).alias("n_inverted"), F.corr("pos", "final_rank").alias("spearman"))


def service(plan: DataFrame, queue: DataFrame, cell: list[str]) -> DataFrame:
    """What a plan does to a queue: waits in operating days, how far the queue got, and the reserve's
    share before and after; a cell without placed rows has null waits.

    ``queue``: cell, id, mechanism of every selected row; ``plan`` lays it out.
    """
    q = queue.select(*cell, "id", "mechanism").join(plan.select(*cell, "id", "final_rank", "day_index", "status"), [*cell, "id"], "left")
    placed, late = F.col("status") == "scheduled", F.col("status") == "backlog"
    reserve = F.col("mechanism") == "coverage_reserve"
    wait = F.when(placed, F.col("day_index") - 1)
    g = q.groupBy(*cell).agg(
        F.count("*").alias("n_queued"), F.count_if(placed).alias("n_scheduled"), F.avg(wait).alias("mean_wait"), F.median(wait).alias("median_wait"), F.max(wait).alias("max_wait"),
        F.max(F.when(placed, F.col("final_rank"))).alias("worst_scheduled_rank"), F.min(F.when(late, F.col("final_rank"))).alias("best_backlogged_rank"),
        F.count_if(reserve).alias("n_reserve_recommended"), F.count_if(reserve & placed).alias("n_reserve_scheduled"),
    )
    before = F.col("n_reserve_recommended") / F.col("n_queued")
    after = F.coalesce(F.col("n_reserve_scheduled") / F.nullif("n_scheduled", F.lit(0)), F.lit(0.0))
    return g.withColumns({"queue_coverage": F.col("n_scheduled") / F.col("n_queued"), "reserve_share_delta": after - before, "reserve_slots_lost": F.col("n_reserve_recommended") - F.col("n_reserve_scheduled")})


def project_backlog(plan: DataFrame, days: DataFrame, calendar: DataFrame, cell: list[str], k: int) -> DataFrame:
    """Every backlog row with its place, what the horizon lacks, and the later day it would fit on.

    The days after the horizon take the backlog in rank order; a row that no day takes has nulls.
    """
    end = days.groupBy(*cell).agg(F.max("slot_date").alias("_end"), F.sum("n_slots").alias("horizon_slots"), F.count("*").alias("_days"))
    rest = calendar.join(end, cell).where(F.col("slot_date") > F.col("_end")).select(*cell, "slot_date", "n_slots")
    by_day = Window.partitionBy(*cell).orderBy("slot_date")
    rest = rest.withColumn("_before", F.coalesce(F.sum("n_slots").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_nth", F.row_number().over(by_day))
    late = plan.where("status = 'backlog'").withColumn("backlog_position", F.row_number().over(Window.partitionBy(*cell).orderBy("final_rank", "id")))
    late = late.select(*cell, "id", "backlog_position").join(end, cell)
    on = [late[c] == rest[c] for c in cell] + [(F.col("backlog_position") > F.col("_before")) & (F.col("backlog_position") <= F.col("_before") + F.col("n_slots"))]
    out = late.join(rest, on, "left")
    return out.select(*(late[c] for c in cell), "id", "backlog_position", "horizon_slots", F.greatest(F.lit(0), F.lit(k) - F.col("horizon_slots")).alias("slots_short"), (F.col("_days") + F.col("_nth")).cast("int").alias("would_fit_on_day_index"), F.col("slot_date").alias("first_available_date"))


def versioned(plans: list[DataFrame], names: list[str]) -> DataFrame:
    """Versions of a plan in one table: ``version``, and ``replan_index`` from 0."""
    out = None
    for i, (plan, name) in enumerate(zip(plans, names)):
        one = plan.withColumn("version", F.lit(name)).withColumn("replan_index", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def latest(versions: DataFrame, key: list[str]) -> DataFrame:
    """Every key's row of its last version."""
    return versions.groupBy(*key).agg(F.max_by(F.struct(*(c for c in versions.columns if c not in key)), "replan_index").alias("_r")).select(*key, "_r.*")


def risk_first(rows: DataFrame, block: list[str]) -> DataFrame:
    """``visit``: the order inside a block by model rank, then id."""
    return rows.withColumn("visit", F.row_number().over(Window.partitionBy(*block).orderBy("model_rank", "id")))
