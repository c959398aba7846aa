"""Positions and running sums inside a cell, in two levels.

The rows of a cell are dealt into runs by a grid over the ordering value, each run is numbered
and summed by itself, and the totals of the earlier runs are added.  So a cell of any size is
spread over up to ``RUNS`` tasks; the table of totals has at most ``RUNS`` + 1 rows a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the grid over one unit of the ordering value.
RUNS = 1024


def score_run(score: str, falling: bool = True) -> Column:
    """The run of a score by its place on the grid; null scores are last."""
    step = F.floor(F.col(score).cast("double") * RUNS)
    return F.coalesce(-step if falling else step, F.lit((1 << 62) - 1))


def day_run(day: str) -> Column:
    """One run a day."""
    return F.coalesce(F.unix_date(day).cast("long"), F.lit((1 << 62) - 1))


def running(rows: DataFrame, cell: list[str], run: Column, order: list[Column], sums: dict[str, Column], pos: str = "pos") -> DataFrame:
    """``rows`` with ``pos``, their number in ``order`` inside the cell, and for each of ``sums`` the
    total of its column up to and with the row.  ``run`` must not fall along the order."""
    own = [*cell, "_run"]
    numbered = rows.withColumn("_run", run.cast("long"))
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumns({pos: F.row_number().over(inside).cast("long"), **{n: F.sum(c).over(inside) for n, c in sums.items()}})
    totals = rows.withColumn("_run", run.cast("long")).groupBy(*own).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*cell).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*own, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *(F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums))
    out = numbered.join(starts, own)
    out = out.withColumns({pos: F.col(pos) + F.col("_before"), **{n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums}})
    return out.drop("_run", "_before", *(f"_b_{n}" for n in sums))


def by_risk(rows: DataFrame, cell: list[str], sums: dict[str, Column] | None = None, pos: str = "pos") -> DataFrame:
    """Positions in the risk order: score descending, id ascending."""
    return running(rows, cell, score_run("score"), [F.desc_nulls_last("score"), F.asc("id")], sums or {}, pos)
