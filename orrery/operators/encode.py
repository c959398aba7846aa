"""Categories as numbers, by what each cell's training rows hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The code of a category that training did not see, or of none at all.
UNKNOWN = 0


def vocabulary(train: DataFrame, cell: list[str], columns: list[str]) -> DataFrame:
    """``cell, column, category, code``: the distinct categories in string order, from 1.

    The order is that of the strings, never of the rows.  Code 0 is left to unknown ones.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns)))
    seen = train.select(*cell, pairs.alias("p")).select(*cell, "p.*").where("category is not null").distinct()
    return seen.withColumn("code", F.row_number().over(Window.partitionBy(*cell, "column").orderBy("category")))


def codes(rows: DataFrame, cell: list[str], columns: list[str], vocab: DataFrame) -> DataFrame:
    """``rows`` with ``code_<column>``; unseen and null categories have ``UNKNOWN``."""
    out = rows
    for c in columns:
        v = vocab.where(F.col("column") == c).select(*cell, F.col("category").alias(f"_{c}"), F.col("code").alias(f"code_{c}"))
        out = out.withColumn(f"_{c}", F.col(c).cast("string")).join(v, [*cell, f"_{c}"], "left").drop(f"_{c}")
        out = out.withColumn(f"code_{c}", F.coalesce(f"code_{c}", F.lit(UNKNOWN)))
    return out


def one_hot(coded: DataFrame, cell: list[str], columns: list[str], vocab: DataFrame) -> DataFrame:
    """``coded`` with ``width`` and ``ones``, the positions of its indicators that are 1.

    Columns follow each other, each with an indicator for unknown and one a category; a row keeps
    the positions only, as a dense row would be as wide as the vocabulary.
    """
    sizes = vocab.groupBy(*cell).agg(*(F.count_if(F.col("column") == c).alias(f"_n_{c}") for c in columns))
    out = coded.join(sizes, cell, "left").withColumns({f"_n_{c}": F.coalesce(f"_n_{c}", F.lit(0)) + 1 for c in columns})
    starts = [reduce(lambda a, c: a + F.col(f"_n_{c}"), columns[:i], F.lit(0)) for i in range(len(columns) + 1)]
    out = out.withColumn("ones", F.array(*((s + F.col(f"code_{c}")).cast("int") for s, c in zip(starts, columns)))).withColumn("width", starts[-1].cast("int"))
    return out.drop(*(f"_n_{c}" for c in columns))


def unseen_rate(coded: DataFrame, cell: list[str], columns: list[str]) -> DataFrame:
    """``cell, column, rate``: the share of rows whose category is unknown."""
    wide = coded.groupBy(*cell).agg(*(F.avg((F.col(f"code_{c}") == UNKNOWN).cast("double")).alias(c) for c in columns))
    return wide.unpivot(cell, columns, "column", "rate")


def looked_up(coded: DataFrame, cell: list[str], column: str, donor: DataFrame, width: int) -> DataFrame:
    """``coded`` with ``<column>_emb_00`` and on: the donor's vector of the row's code.

    ``donor`` has ``cell, code, vector``; a code it lacks takes the vector of the unknown one, as
    the donor itself would use.
    """
    own = donor.select(*cell, F.col("code").alias(f"code_{column}"), F.col("vector").alias("_own"))
    spare = donor.where(F.col("code") == UNKNOWN).select(*cell, F.col("vector").alias("_spare"))
    out = coded.join(own, [*cell, f"code_{column}"], "left").join(F.broadcast(spare), cell, "left")  # a row a cell
    v = F.coalesce("_own", "_spare")
    return out.withColumns({f"{column}_emb_{i:02d}": v[i] for i in range(width)}).drop("_own", "_spare")
