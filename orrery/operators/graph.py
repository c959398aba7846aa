"""Connected components over an edge table, without collecting the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Tasks that the rows of one key are dealt over.
SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, spread: str, name: str) -> DataFrame:
    """``rows`` with the smallest ``value`` of their ``key`` as ``name``.

    A key's rows are dealt by ``spread`` over ``SALTS`` parts, each with its own minimum; at
    most ``SALTS`` minima meet in one place.  So no task holds all rows of a hot key.  Rows
    with a null key go; values are ignored where null.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    parts = dealt.groupBy(key, "_salt").agg(F.min(value).alias(name))
    parts = parts.withColumn(name, F.min(name).over(Window.partitionBy(key)))
    return dealt.join(parts, [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of ``edges`` with the smallest node id of its component.

    Alternates the large-star and small-star steps until the edge set is a forest of
    stars.  Each step is a map-side combined ``min`` per node and one equi join, both salted,
    so a hub is never gathered.  Every round is written to the shared folder; only its row
    count and a checksum reach the driver.

    Edges with a null end are ignored, self loops and repeated edges are harmless, and an
    empty table gives an empty result.  Returns ``node``, ``label``.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    # Written before its two uses, so that costly edges are computed once.
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = e.where("u = v").select(F.col("u").alias("node"))
    e = e.where("u <> v")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        e = stored(_small_star(_large_star(e)), "edges")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = stars.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    known = stars.unionByName(roots)
    alone = nodes.distinct().join(known.select("node"), "node", "left_anti").withColumn("label", F.col("node"))
    return known.unionByName(alone)


def _large_star(e: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of its neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = with_least(both, "u", "v", "v", "m").where("v > u")
    return least.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = with_least(down, "u", "v", "v", "m")
    return least.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()
