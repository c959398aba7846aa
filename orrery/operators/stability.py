"""What stays and what changes: importance over folds, queues, methods and model choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _folds():
    """A window over one row a fold: their number is set by the calendar, never by the rows."""
    return Window.partitionBy(F.lit(0)).orderBy("fold_id")


def fold_ranks(values: DataFrame) -> DataFrame:
    """Mean absolute value of every ``feature`` by fold, and its rank there."""
    m = values.groupBy("fold_id", "feature").agg(F.round(F.avg(F.abs("v")), 9).alias("a"))
    return m.withColumn("k", F.rank().over(Window.partitionBy("fold_id").orderBy(F.desc("a"))))


def importance(values: DataFrame) -> DataFrame:
    """Features over all folds: mean, population deviation, best and worst rank."""
    return fold_ranks(values).groupBy("feature").agg(
        F.avg("a").alias("mean_abs"), F.stddev_pop("a").alias("sd"), F.min("k").cast("long").alias("best_rank"), F.max("k").cast("long").alias("worst_rank"), F.count("*").alias("n_folds")
    )


def top_overlap(values: DataFrame, top: int) -> DataFrame:
    """Jaccard overlap of each fold's leading features with those of the fold before it."""
    t = fold_ranks(values).where(F.col("k") <= top).groupBy("fold_id").agg(F.collect_set("feature").alias("top"))
    t = t.withColumn("prev", F.lag("top").over(_folds())).where("prev is not null")
    return t.select("fold_id", (F.size(F.array_intersect("top", "prev")) / F.size(F.array_union("top", "prev"))).alias("jaccard"))


def representative(rows: DataFrame, cell: list[str], percents: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """The rows at the given percentiles of the score order, by nearest rank."""
    w = Window.partitionBy(*cell)
    r = rows.withColumn("rn", F.row_number().over(w.orderBy("score", "id"))).withColumn("n", F.count("*").over(w))
    r = r.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    return r.where("rn = (percent * n + 99) div 100").select(*cell, "percent", "id", "score")


def queue_difference(queues: DataFrame, cell: list[str], left: str, right: str) -> DataFrame:
    """Ids that only one of two policies selects, counted both ways over one grouping."""
    own = lambda p: F.bool_or(F.col("policy_id") == p)
    s = queues.groupBy(*cell, "id").agg(own(left).alias("a"), own(right).alias("b")).where("a or b")
    return s.groupBy(*cell).agg(F.count_if(F.expr("a and not b")).alias("only_left"), F.count_if(F.expr("b and not a")).alias("only_right"), F.bool_and(F.expr("a and b")).alias("same"))


def pooled_capacity(rows: DataFrame, cell: list[str], k: int) -> DataFrame:
    """The capacities of all cells together, none above its rows."""
    n = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.least("n", F.lit(k))).alias("k"), F.sum("n").alias("n"))


def inner_split(rows: DataFrame, cell: list[str], percent: int) -> DataFrame:
    """Whole days, from the last back, until they hold the given share of the rows."""
    days = rows.groupBy(*cell, "d").agg(F.count("*").alias("n"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return days.select(*cell, "d", "n", (later * 100 < F.sum("n").over(Window.partitionBy(*cell)) * percent).alias("held"))


def method_switches(methods: DataFrame) -> DataFrame:
    """How often the method of a fold is not that of the fold before."""
    m = methods.withColumn("prev", F.lag("method").over(_folds()))
    return m.agg(F.count_if(F.col("prev") != F.col("method")).alias("n_switches"), F.count("*").alias("n_folds"))


def chain_names(rows: DataFrame, until: str) -> DataFrame:
    """Names that more than one place has in the rows before a date."""
    seen = rows.where(F.col("d") < F.lit(until).cast("date")).where("name is not null")
    return seen.groupBy("name").agg(F.countDistinct("establishment_id").alias("n_places")).where("n_places > 1")


def model_choice(metrics: DataFrame) -> DataFrame:
    """Contenders are models whose band reaches the leader's; the best calibrated one is chosen.

    Ties go to the higher precision, then to the name.  The table has one row a model.
    """
    lead = metrics.agg(F.max_by("lo", F.struct("nde", F.col("lo"))).alias("floor"))
    m = metrics.join(F.broadcast(lead), F.lit(True)).withColumn("is_contender", F.col("hi") >= F.col("floor"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("is_contender"), "ece", F.desc("prec"), "model"))
    return m.withColumn("_n", place).select("model", "is_contender", (F.col("_n") == 1).alias("is_chosen"))
