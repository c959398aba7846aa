"""Group audits: support floors, selection by group, missingness, disparity and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def support(rows: DataFrame, cell: list[str], group: str, floor: tuple[int, int, int] = (200, 20, 20)) -> DataFrame:
    """Rows, positives, negatives, base rate and share of every group, with its support verdict."""
    g = rows.groupBy(*cell, group).agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    g = g.withColumn("neg", F.col("n") - F.col("pos")).withColumn("base_rate", F.col("pos") / F.col("n"))
    total = F.sum("n").over(Window.partitionBy(*cell) if cell else Window.partitionBy(F.lit(0)))
    why = F.when(F.col("n") < floor[0], "rows").when(F.col("pos") < floor[1], "positives").when(F.col("neg") < floor[2], "negatives").otherwise("supported")
    return g.withColumn("share", F.col("n") / total).withColumn("support", why)


def priority(rows: DataFrame, group: str) -> DataFrame:
    """Share of each group in the population and in the selection, and their ratio."""
    g = rows.groupBy(group).agg(F.count("*").alias("population"), F.count_if("is_selected").alias("selected"))
    all_ = Window.partitionBy(F.lit(0))
    g = g.withColumn("population_share", F.col("population") / F.sum("population").over(all_)).withColumn("selected_share", F.col("selected") / F.nullif(F.sum("selected").over(all_), F.lit(0)))
    return g.withColumn("selection_ratio", F.col("selected_share") / F.col("population_share"))


def missingness(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Null share by group and column, in one scan."""
    long = rows.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).isNull().cast("int").alias("missing")) for c in columns))).alias("x")).select(group, "x.*")
    return long.groupBy(group, "feature").agg(F.count("*").alias("n"), F.avg("missing").alias("null_rate"))


def disparity(metrics: DataFrame, cell: list[str], group: str, value: str, pooled: DataFrame) -> DataFrame:
    """Spread, ratio, largest deviation from the pooled value, weighted sd, and the extremes."""
    m = metrics.where(F.col(value).isNotNull()).join(pooled.select(*cell, F.col(value).alias("_p")), cell)
    first = lambda sign: F.min_by(group, F.struct(sign * F.col(value), F.col(group)))
    mean = F.sum(F.col("n") * F.col(value)).over(Window.partitionBy(*cell)) / F.sum("n").over(Window.partitionBy(*cell))
    m = m.withColumn("_m", mean)
    low, high = F.min(value), F.max(value)
    return m.groupBy(*cell).agg(
        (high - low).alias("spread"), F.when(low > 0, high / low).alias("ratio"), F.max(F.abs(F.col(value) - F.col("_p"))).alias("max_deviation"),
        F.sqrt(F.sum(F.col("n") * F.pow(F.col(value) - F.col("_m"), F.lit(2))) / F.sum("n")).alias("weighted_sd"), first(F.lit(1)).alias("lowest"), first(F.lit(-1)).alias("highest"),
    )


def drift(metrics: DataFrame, keys: list[str], fold: str, value: str, least: int = 3, change: float = 0.25) -> DataFrame:
    """First-to-last relative change over folds, and its verdict."""
    g = metrics.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_folds"), F.min_by(value, fold).alias("first_value"), F.max_by(value, fold).alias("last_value"))
    rel = (F.col("last_value") - F.col("first_value")) / F.nullif(F.abs("first_value"), F.lit(0.0))
    g = g.withColumn("change", rel)
    return g.withColumn("trend", F.when(F.col("n_folds") < least, "too_few").when(F.col("change") > change, "rising").when(F.col("change") < -change, "falling").otherwise("stable"))
