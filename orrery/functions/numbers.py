"""Dates, rounding and transforms with the reference conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import score_run

ERA, ADOPTED = "2018-07-01", "2019-01-01"


def era_phase(d: Column, era: str = ERA, adopted: str = ADOPTED) -> Column:
    return F.when(d < F.lit(era).cast("date"), "pre_code").when(d < F.lit(adopted).cast("date"), "adoption").otherwise("stable")


def read_date(c: Column) -> Column:
    """The date in the first ten characters, null if there is none."""
    return F.substring(c, 1, 10).try_cast("date")


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def clamped(p: Column, clamp: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(clamp)), F.lit(1 - clamp))


def logit(p: Column, clamp: float = 1e-6) -> Column:
    q = clamped(p, clamp)
    return F.log(q / (1 - q))


def round_away(x: Column, places: int) -> Column:
    """Half away from zero, by scaling as SQL does: a small negative number becomes -0.0."""
    scale = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def capacity_levels(n: Column, per_day: Column) -> Column:
    """Named capacities: a day, a week, a month, and shares of the rows (half to even)."""
    levels = [("day_1", per_day), ("week_1", per_day * 5), ("month_1", per_day * 21), *((f"pct_{p}", F.bround(n * (p / 100.0), 0)) for p in (1, 5, 10, 25, 50))]
    return F.array(*(F.struct(F.lit(name).alias("k_name"), F.greatest(F.lit(1), F.least(k.cast("int"), n.cast("int"))).alias("k")) for name, k in levels))


def folds(spark: SparkSession, first: str, last: str, warm_quarters: int = 14) -> DataFrame:
    """Rolling-origin folds: a calibration quarter, then its test quarter; all earlier trains.

    ``first`` begins training; the last quarter must end by ``last``.
    """
    q = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 3 months)) AS s")
    q = q.select(F.add_months("s", warm_quarters * 3).alias("calibration_start"))
    q = q.withColumn("test_start", F.add_months("calibration_start", 3)).withColumn("test_end", F.date_sub(F.add_months("calibration_start", 6), 1))
    q = q.where(F.col("test_end") <= F.lit(last).cast("date"))
    return q.select(quarter_key(F.col("test_start")).alias("fold_id"), F.lit(first).cast("date").alias("train_start"), F.date_sub("calibration_start", 1).alias("train_end"), "calibration_start", F.date_sub("test_start", 1).alias("calibration_end"), "test_start", "test_end")


def split_of(rows: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Every row in every fold that uses it, with its split.  The fold table is one row a quarter."""
    f = F.broadcast(fold_table)
    split = F.when(F.col("d").between(F.col("train_start"), F.col("train_end")), "train").when(F.col("d").between(F.col("calibration_start"), F.col("calibration_end")), "calibration").otherwise("test")
    return rows.join(f, (F.col("d") >= F.col("train_start")) & (F.col("d") <= F.col("test_end"))).withColumn("split", split)


def interpolate(rows: DataFrame, points: DataFrame, x: str) -> DataFrame:
    """Piecewise linear value at ``x`` between breakpoints (``px, py``), clamped at both ends.

    Breakpoints and rows are merged in one order; each row sees the breakpoint before and
    after it, so there is no join of every row with every breakpoint.  The order goes in two
    levels, like positions do: inside runs of a grid over ``x``, then over the runs of a cell.
    Both sides are read by frames that only grow: a frame that shrinks is read anew for every row.
    A null ``x`` has no value.
    """
    both = rows.withColumn("_side", F.lit(1)).withColumn("px", F.lit(None).cast("double")).withColumn("py", F.lit(None).cast("double")).unionByName(
        points.select("cell", F.col("px").alias(x), F.lit(0).alias("_side"), "px", "py"), allowMissingColumns=True)
    both = both.withColumn("_run", F.when(F.isnan(x), F.lit((1 << 62) - 2)).otherwise(score_run(x, falling=False)))  # NaN is last
    p = F.when(F.col("_side") == 0, F.struct("px", "py"))
    grown = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    inside, runs = Window.partitionBy("cell", "_run"), Window.partitionBy("cell")
    ends = both.groupBy("cell", "_run").agg(F.max(p).alias("_most"), F.min(p).alias("_least"))
    ends = ends.select("cell", "_run", F.last("_most", True).over(grown(runs.orderBy("_run"), -1)).alias("_below"), F.last("_least", True).over(grown(runs.orderBy(F.desc("_run")), -1)).alias("_above"))
    b = both.withColumn("_a", F.last(p, True).over(grown(inside.orderBy(x, "_side"), 0))).withColumn("_z", F.last(p, True).over(grown(inside.orderBy(F.desc(x), F.desc("_side")), 0))).where("_side = 1")
    b = b.join(ends, ["cell", "_run"]).withColumns({"_a": F.coalesce("_a", "_below"), "_z": F.coalesce("_z", "_above")})
    t = (F.col(x) - F.col("_a.px")) / F.nullif(F.col("_z.px") - F.col("_a.px"), F.lit(0.0))
    value = F.when(F.col("_a").isNull(), F.col("_z.py")).when(F.col("_z").isNull(), F.col("_a.py")).otherwise(F.coalesce(F.col("_a.py") + t * (F.col("_z.py") - F.col("_a.py")), F.col("_a.py")))
    return b.withColumn("value", F.when(F.col(x).isNotNull(), value)).drop("_side", "_run", "px", "py", "_a", "_z", "_below", "_above")
