"""Distances, near pairs and proximity groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components

EARTH_KM = 6371.0
#: Places of a tile whose distances are taken together.
TILE = 512


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def near_pairs(places: DataFrame, km: float) -> DataFrame:
    """Pairs ``a < b`` within ``km``: a grid of cells as the equi key, then the distance.

    A cell is at least ``km`` high and wide (up to 70 degrees of latitude), so partners are in
    the nine cells around; no pair of far places is formed.
    """
    lat_step, lon_step = km / 110.0, km / 110.0 / 0.34
    p = places.select("id", "lat", "lon", F.floor(F.col("lat") / lat_step).alias("gy"), F.floor(F.col("lon") / lon_step).alias("gx"))
    around = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)))
    right = p.withColumn("o", F.explode(around)).select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), (F.col("gy") + F.col("o.y")).alias("gy"), (F.col("gx") + F.col("o.x")).alias("gx"))
    pairs = p.withColumnRenamed("id", "a").join(right, ["gy", "gx"]).where("a < b")
    return pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).where(F.col("km") <= km).select("a", "b", "km")


def groups(places: DataFrame, km: float) -> DataFrame:
    """Components of near places, labelled area_1.. by centroid latitude downwards, then id.

    Places without coordinates are ``unmapped``.
    """
    mapped = places.where("lat is not null and lon is not null")
    parts = connected_components(near_pairs(mapped, km), "a", "b")
    own = mapped.join(parts, mapped["id"] == parts["node"], "left").select("id", "lat", "lon", F.coalesce("label", "id").alias("root"))
    mid = own.groupBy("root").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"), F.count("*").alias("n_members"))
    named = mid.withColumn("area", F.concat(F.lit("area_"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("c_lat", 9)), "root")).cast("string")))
    out = own.join(named, "root").select("id", "area", "n_members", "c_lat", "c_lon")
    lost = places.where("lat is null or lon is null").select("id", F.lit("unmapped").alias("area"), F.lit(None).cast("long").alias("n_members"), F.lit(None).cast("double").alias("c_lat"), F.lit(None).cast("double").alias("c_lon"))
    return out.unionByName(lost)


def group_spans(members: DataFrame, group: str) -> DataFrame:
    """``group, n, max_km, avg_km``: the largest and the mean distance over all pairs of a group.

    ``members``: group, lat, lon, none null.  Equal coordinates are one point with a weight, points
    are dealt into tiles of about ``TILE``, and pairs of tiles are measured as matrices: no pair of
    places is a row.  The work is still the square of a group's distinct points, as a mean over
    pairs of great circles has no shorter form.  One place alone has 0 and 0.
    """
    kind = dict(members.dtypes)[group]
    points = members.groupBy(group, "lat", "lon").agg(F.count("*").alias("w"))
    size = points.groupBy(group).agg(F.count("*").alias("_p"), F.sum("w").alias("n")).withColumn("_tiles", F.ceil(F.col("_p") / TILE).cast("long"))
    dealt = points.join(size, group).withColumn("_t", F.pmod(F.xxhash64("lat", "lon"), F.col("_tiles")))
    tiles = dealt.groupBy(group, "_t", "_tiles").agg(F.collect_list(F.struct("lat", "lon", "w")).alias("own"))
    left = tiles.withColumn("_u", F.explode(F.expr("sequence(_t, _tiles - 1)"))).select(group, "_t", "_u", "own")
    right = tiles.select(group, F.col("_t").alias("_u"), F.col("own").alias("other"))
    met = left.join(right, [group, "_u"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacked = lambda rows: np.array([(r["lat"], r["lon"], r["w"]) for r in rows], dtype=float).T
        for pdf in batches:
            out = []
            for g, t, u, a, b in zip(pdf[group], pdf["_t"], pdf["_u"], pdf["own"], pdf["other"]):
                (lat1, lon1, w1), (lat2, lon2, w2) = unpacked(a), unpacked(b)
                la1, la2 = np.radians(lat1)[:, None], np.radians(lat2)[None, :]
                h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((np.radians(lon2)[None, :] - np.radians(lon1)[:, None]) / 2) ** 2
                km = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
                total = float(w1 @ km @ w2)
                out.append((g, float(km.max()), total / 2 if t == u else total))
            yield pd.DataFrame(out, columns=[group, "km", "total"])

    spans = met.mapInPandas(measure, f"{group} {kind}, km double, total double").groupBy(group).agg(F.max("km").alias("max_km"), F.sum("total").alias("_total"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    alone = F.col("n") < 2
    return size.join(spans, group).select(group, "n", F.when(alone, 0.0).otherwise(F.col("max_km")).alias("max_km"), F.when(alone, 0.0).otherwise(F.col("_total") / pairs).alias("avg_km"))
