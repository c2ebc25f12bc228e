"""Geometry as columns: great-circle lengths, rings, tiles and Web Mercator pixels. Coordinates are (lon, lat) degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def parse_coords(text: Column) -> Column:
    """'lon,lat[,alt] lon,lat ...' as array<struct<lon, lat>>; chunks without two numbers are left out."""
    chunks = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|(?<!\s)\s++$", ""), r"(?U)\s+"), lambda c: F.size(F.split(c, ",")) >= 2)
    return F.transform(chunks, lambda c: F.struct(F.split(c, ",")[0].cast("double").alias("lon"), F.split(c, ",")[1].cast("double").alias("lat")))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_M)


def line_length_m(coords: Column) -> Column:
    """Length of an array of points, in one row."""
    n = F.size(coords)
    pairs = F.zip_with(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))), F.slice(coords, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def midpoint(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    return (lon1 + lon2) / 2, (lat1 + lat2) / 2


def representative(gtype: Column, coords: Column) -> Column:
    """The point that stands for a geometry: a point itself, of a line its middle vertex; null for the rest."""
    return F.when(F.size(coords) > 0, F.when(gtype == "Point", F.get(coords, F.lit(0))).when(gtype == "LineString", F.get(coords, F.floor(F.size(coords) / 2).cast("int"))))


def ring_edges(ring: Column) -> Column:
    """Each vertex with the one before it; the first with the last."""
    before = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    edges = F.zip_with(ring, before, lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))
    return F.when(F.size(ring) > 0, edges).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def crosses(lon: Column, lat: Column, edge: Column) -> Column:
    """Whether a ray from the point to the east crosses the edge."""
    rise = edge["y2"] - edge["y1"]
    at = (edge["x2"] - edge["x1"]) * (lat - edge["y1"]) / F.when(rise == 0, F.lit(1e-12)).otherwise(rise) + edge["x1"]
    return ((edge["y1"] > lat) != (edge["y2"] > lat)) & (lon < at)


def in_ring(lon: Column, lat: Column, edges: Column) -> Column:
    """Even-odd rule over the edges of a ring."""
    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(lon, lat, e))


def mean_lon(ring: Column) -> Column:
    """Mean longitude of the vertices; a closing vertex counts twice."""
    return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lon"]) / F.nullif(F.size(ring), F.lit(0))


def interpolate(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def mercator_y(lat: Column) -> Column:
    return F.asinh(F.tan(F.radians(lat))) / F.pi()


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    return ((lon + 180.0) / 360.0 * n).cast("int"), ((1.0 - mercator_y(lat)) / 2.0 * n).cast("int")


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = float(2**zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / n))))


def pixel(lon: Column, lat: Column, box: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a mosaic that spans box (west, south, east, north)."""
    west, south, east, north = box
    top, bottom = mercator_y(F.lit(north)), mercator_y(F.lit(south))
    return (
        F.bround((lon - west) / (east - west) * (width - 1)).cast("int"),
        F.bround((top - mercator_y(lat)) / (top - bottom) * (height - 1)).cast("int"),
    )


def bounding_box(lon: Column, lat: Column, pad: float = 0.0) -> dict[str, Column]:
    """Aggregates west, east, south and north, widened by pad degrees."""
    return {"west": F.min(lon) - pad, "east": F.max(lon) + pad, "south": F.min(lat) - pad, "north": F.max(lat) + pad}


def global_pixel(lon: Column, lat: Column, zoom: int, size: int = 256) -> tuple[Column, Column]:
    """Pixel in the whole tile grid: tile * size + offset, a join key that needs no mosaic."""
    n = float(2**zoom) * size
    return F.floor((lon + 180.0) / 360.0 * n), F.floor((1.0 - mercator_y(lat)) / 2.0 * n)


def decode_height(r: Column, g: Column, b: Column) -> Column:
    """Metres of an elevation tile's pixel."""
    return r * 256 + g + b / 256 - 32768
