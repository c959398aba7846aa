"""Ranks, cells and the metrics of a ranked cell; positions come in two levels (``running``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import by_risk, day_run, running, score_run


def order_by_risk(cell: list[str]):
    """Score descending, id ascending: a total order inside a cell."""
    return Window.partitionBy(*cell).orderBy(F.desc_nulls_last("score"), F.asc("id"))


def top_k(rows: DataFrame, cell: list[str], k: int) -> DataFrame:
    """The best ``min(k, n)`` rows of every cell."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return rows.withColumn("rank", F.row_number().over(order_by_risk(cell))).where(F.col("rank") <= k)


def average_rank(rows: DataFrame, value: str, cell: list[str], name: str, run: Column | None = None) -> DataFrame:
    """``rows`` with the rank of ``value`` as ``name``, ties sharing their mean.

    Distinct values are counted first and summed along the order, so ties cost one row.
    """
    counts = rows.groupBy(*cell, value).agg(F.count("*").alias("_m"))
    run = score_run(value, falling=False) if run is None else run
    upto = running(counts, cell, run, [F.asc_nulls_first(value)], {"_upto": F.col("_m")}, "_pos")
    ranks = upto.select(*(F.col(c).alias(f"_c_{c}") for c in cell), F.col(value).alias("_value"), (F.col("_upto") - (F.col("_m") - 1) / 2.0).alias(name))
    on = F.col(value).eqNullSafe(F.col("_value"))
    for c in cell:
        on = on & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return rows.join(ranks, on).drop("_value", *(f"_c_{c}" for c in cell))


def equal_mass_bins(rows: DataFrame, cell: list[str], bins: int = 15) -> DataFrame:
    """``bin``: the slice [b*n//B, (b+1)*n//B) of the ascending (score, id) order, B = min(bins, n)."""
    n = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    placed = running(rows, cell, score_run("score", falling=False), [F.asc("score"), F.asc("id")], {}, "_at").join(n, cell)
    return placed.withColumn("bin", F.expr(f"(_at * least({bins}, _n) - 1) div _n")).drop("_n", "_at")


def roc_auc(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Rank-sum area, ties averaged; null where one class is absent."""
    ties = rows.groupBy(*cell, "score").agg(F.count("*").alias("_m"), F.sum("label").alias("_pos"))
    upto = running(ties, cell, score_run("score", falling=False), [F.asc("score")], {"_upto": F.col("_m")}, "_at")
    rank = F.col("_upto") - (F.col("_m") - 1) / 2.0
    g = upto.groupBy(*cell).agg(F.sum("_pos").cast("double").alias("p"), F.sum(F.col("_m") - F.col("_pos")).cast("double").alias("n"), F.sum(rank * F.col("_pos")).alias("r"))
    return g.select(*cell, F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("roc_auc"))


def pr_auc(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Average precision over distinct scores; null without positives."""
    steps = rows.groupBy(*cell, "score").agg(F.sum("label").alias("tp"), F.count("*").alias("m"))
    steps = running(steps, cell, score_run("score"), [F.desc("score")], {"ctp": F.col("tp"), "cm": F.col("m")})
    return steps.groupBy(*cell).agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cm")) / F.nullif(F.sum("tp"), F.lit(0))).alias("pr_auc"))


def probability_metrics(rows: DataFrame, cell: list[str], floor: float = 1e-15) -> DataFrame:
    """Brier score and log loss."""
    p = F.least(F.greatest(F.col("score"), F.lit(floor)), F.lit(1 - floor))
    loss = -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))
    return rows.groupBy(*cell).agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"), F.avg(loss).alias("log_loss"))


def calibration_error(rows: DataFrame, cell: list[str], bins: int = 15) -> DataFrame:
    """Expected and maximum calibration error, and the terms of the Brier decomposition."""
    b = equal_mass_bins(rows, cell, bins).groupBy(*cell, "bin").agg(F.count("*").alias("m"), F.avg("score").alias("s"), F.avg("label").alias("y"), F.sum("label").alias("pos"))
    total = F.sum("m").over(Window.partitionBy(*cell))
    base = F.sum("pos").over(Window.partitionBy(*cell)) / total
    b = b.withColumn("_n", total).withColumn("_b", base).withColumn("gap", F.abs(F.col("s") - F.col("y")))
    w = F.col("m") / F.col("_n")
    return b.groupBy(*cell).agg(
        F.sum(w * F.col("gap")).alias("ece"), F.max("gap").alias("mce"), F.sum(w * F.pow(F.col("s") - F.col("y"), F.lit(2))).alias("reliability"),
        F.sum(w * F.pow(F.col("y") - F.col("_b"), F.lit(2))).alias("resolution"), F.first(F.col("_b") * (1 - F.col("_b"))).alias("uncertainty"),
    )


def at_k(rows: DataFrame, cell: list[str], k: int) -> DataFrame:
    """Precision, recall and lift of the best k."""
    r = by_risk(rows, cell, pos="rank")
    hit = F.sum(F.when(F.col("rank") <= k, F.col("label")))
    used, n, p = F.least(F.lit(k), F.count("*")), F.count("*"), F.sum("label")
    return r.groupBy(*cell).agg((hit / used).alias("precision_at_k"), (hit / F.nullif(p, F.lit(0))).alias("recall_at_k"), ((hit / used) / F.nullif(p / n, F.lit(0.0))).alias("lift_at_k"))


def at_threshold(rows: DataFrame, cell: list[str], at: float) -> DataFrame:
    """Precision, recall and F1 of ``score >= at``."""
    yes, pos = F.col("score") >= at, F.col("label") == 1
    tp, fp, fn = F.count_if(yes & pos), F.count_if(yes & ~pos), F.count_if(~yes & pos)
    zero = F.lit(0)
    return rows.groupBy(*cell).agg((tp / F.nullif(tp + fp, zero)).alias("precision"), (tp / F.nullif(tp + fn, zero)).alias("recall"), (2 * tp / F.nullif(2 * tp + fp + fn, zero)).alias("f1"))


def discovery(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Position and cumulative positives along the risk order."""
    return by_risk(rows, cell, {"cum": F.col("label")})


def discovery_summary(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Normalised area, its efficiency against the best order, and first-half discovery."""
    n, p = F.count("*"), F.sum("label")
    d = discovery(rows, cell).join(rows.groupBy(*cell).agg(n.alias("_n")), cell)
    half = F.max(F.when(F.col("pos") <= F.floor(F.col("_n") / 2), F.col("cum")))
    g = d.groupBy(*cell).agg(n.alias("n"), p.alias("p"), F.sum(2 * F.col("cum") - F.col("label")).alias("twice"), F.coalesce(half, F.lit(0)).alias("half"))
    g = g.withColumn("area", F.col("twice") / F.nullif(2.0 * F.col("n") * F.col("p"), F.lit(0.0)))
    best = 1 - F.col("p") / (2.0 * F.col("n"))
    return g.select(*cell, "n", "p", "area", ((F.col("area") - 0.5) / F.nullif(best - 0.5, F.lit(0.0))).alias("nde"), (F.col("half") / F.nullif("p", F.lit(0))).alias("first_half"))


def days_earlier(rows: DataFrame, cell: list[str]) -> DataFrame:
    """How much earlier positives come when the p-th row of the risk order gets the p-th date."""
    ranked = by_risk(rows, cell)
    slots = running(rows.select(*cell, "d", "id"), cell, day_run("d"), [F.asc("d"), F.asc("id")], {}).select(*cell, F.col("d").alias("slot_date"), "pos")
    moved = ranked.join(slots, [*cell, "pos"]).where("label = 1").withColumn("gain", F.datediff("d", "slot_date"))
    return moved.groupBy(*cell).agg(
        F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("sd_gain"),
        F.percentile("gain", F.lit(0.25)).alias("p25"), F.percentile("gain", F.lit(0.75)).alias("p75"), F.min("gain").alias("min_gain"), F.max("gain").alias("max_gain"),
        F.avg((F.col("gain") > 0).cast("double")).alias("share_earlier"),
    )
