"""Points and segments in zones. zones: zone, ord, ring (array of lon, lat); where zones overlap the lowest ord wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import cover

#: Up to so many vertices in all zones, the zones go to the points; beyond it, points and zones meet by the cells of a cover.
MOST_VERTICES = 10_000


def order_zones(zones: DataFrame) -> DataFrame:
    """zone, ring as zone, ord, ring: from west to east by the mean longitude of the vertices. One row for each zone."""
    cx = geo.mean_lon(F.col("ring"))
    return zones.select("zone", F.row_number().over(Window.orderBy(cx, "zone")).alias("ord"), "ring")


def _prepared(zones: DataFrame) -> DataFrame:
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    return zones.filter(F.size("ring") > 0).select(
        "ord", "zone", geo.ring_edges(F.col("ring")).alias("edges"),
        F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), F.array_min(lat).alias("south"), F.array_max(lat).alias("north"),
    )


def _inside(z: Column, lon: Column, lat: Column) -> Column:
    boxed = lon.between(z["west"], z["east"]) & lat.between(z["south"], z["north"])
    return F.when(boxed, geo.in_ring(lon, lat, z["edges"])).otherwise(False)


def locate(points: DataFrame, zones: DataFrame, lon: str = "lon", lat: str = "lat", into: str = "zone") -> DataFrame:
    """points with the zone each lies in, null outside all.

    With zones of a checked size this is a projection: one broadcast row holds all zones in order, and each point takes
    the first that holds it. With more, points and zones are joined on the cells of a quadtree (cover.py).
    """
    prepared = _prepared(zones)
    if (zones.agg(F.sum(F.size("ring")).alias("n")).collect()[0]["n"] or 0) <= MOST_VERTICES:
        every = prepared.agg(F.array_sort(F.collect_list(F.struct("ord", "zone", "edges", "west", "east", "south", "north"))).alias("__zones"))
        found = F.get(F.filter("__zones", lambda z: _inside(z, F.col(lon), F.col(lat))), F.lit(0))["zone"]
        return points.crossJoin(F.broadcast(every)).withColumn(into, found).drop("__zones")
    return cover.locate(points, zones, lon, lat, into)


def locate_features(features: DataFrame, zones: DataFrame, into: str = "zone") -> DataFrame:
    """features (gtype, coords) with their zone: of a point its own, of a line that of its middle vertex, else null."""
    placed = features.withColumn("__p", geo.representative(F.col("gtype"), F.col("coords"))).withColumns({"__lon": F.col("__p.lon"), "__lat": F.col("__p.lat")})
    return locate(placed, zones, "__lon", "__lat", into).drop("__p", "__lon", "__lat")


def length_by_zone(segments: DataFrame, zones: DataFrame, *by: str) -> DataFrame:
    """zone, *by, length_m: each segment (lon1, lat1, lon2, lat2, length_m) counts for the zone of its midpoint.

    Every zone is there, those without segments with 0; segments outside all zones count nowhere.
    """
    x, y = geo.midpoint(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    found = locate(segments.withColumns({"__mx": x, "__my": y}), zones, "__mx", "__my", "zone")
    sums = found.filter("zone is not null").groupBy("zone", *by).agg(F.sum("length_m").alias("length_m"))
    every = zones.select("zone").distinct()
    if by:
        every = every.crossJoin(segments.select(*by).distinct())  # the grid of the result
    return every.join(sums, ["zone", *by], "left").withColumn("length_m", F.coalesce("length_m", F.lit(0.0)))
