"""Readers: placemark folders (XML), GeoJSON, survey CSV, profiles, tiles, settings, manifests."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import geo, text

_GEOMETRIES = "Point: STRUCT<coordinates: STRING>, LineString: STRUCT<coordinates: STRING>, Polygon: STRUCT<outerBoundaryIs: STRUCT<LinearRing: STRUCT<coordinates: STRING>>>"
#: A collection of geometries is taken as the XML that it is, since collections stand in collections to any depth.
PLACEMARK = f"STRUCT<name: STRING, description: STRING, {_GEOMETRIES}, MultiGeometry: STRING>"
#: Folders may stand in folders; so many levels are read at first, twice as many while folders remain below the last.
DEPTH = 4
COORDS = "array<struct<lon:double,lat:double>>"


def _folder(depth: int) -> str:
    inner = f", Folder: ARRAY<STRUCT<{_folder(depth - 1)}>>" if depth > 1 else ", Folder: ARRAY<STRUCT<name: STRING>>"
    return f"name: STRING, Placemark: ARRAY<{PLACEMARK}>{inner}"


def read_folders(spark: SparkSession, path: str, depth: int = DEPTH) -> DataFrame:
    """place, folder, placemarks of every folder at any depth; place, an array, sorts folders as they stand in a file."""
    found = spark.read.format("xml").option("rowTag", "Folder").option("ignoreNamespace", "true").option("ignoreSurroundingSpaces", "false").schema(_folder(depth).replace(": ", " ", 1).replace(", Placemark: ", ", Placemark ").replace(", Folder: ", ", Folder ", 1)).load(path)
    keyed = lambda key, folders: F.transform(folders, lambda f, at: F.struct(F.concat(key, F.array(at.cast("long"))).alias("key"), f.alias("f")))
    found = found.withColumn("key", F.array(F.monotonically_increasing_id()))
    out, below = found.select(F.col("key").alias("place"), F.col("name").alias("folder"), F.col("Placemark").alias("placemarks")), keyed(F.col("key"), F.coalesce("Folder", F.array()))
    for _ in range(depth - 1):
        out = out.unionByName(found.select(F.explode(below).alias("b")).select(F.col("b.key").alias("place"), F.col("b.f.name").alias("folder"), F.col("b.f.Placemark").alias("placemarks")))
        below = F.flatten(F.transform(F.filter(below, lambda b: b["f"]["Folder"].isNotNull()), lambda b: keyed(b["key"], b["f"]["Folder"])))
    return out if found.filter(F.size(below) > 0).isEmpty() else read_folders(spark, path, 2 * depth)


def _first(kind: str, tail: str, inner: str) -> Column:
    """The coordinates of a placemark's geometry of a kind, or of the first such in its collection."""
    found = F.regexp_extract(F.col("p.MultiGeometry"), rf"(?s)<(?:[\w.-]+:)?{kind}\b{inner}.*?<(?:[\w.-]+:)?coordinates[^>]*>([^<]*)<", 1)
    return F.coalesce(F.col(f"p.{kind}.{tail}"), F.when(F.col("p.MultiGeometry").rlike(rf"<(?:[\w.-]+:)?{kind}\b"), found))


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """place, folder, pid, name, norm, gtype, coords, images. Of several geometries a point goes before a line before a
    polygon, and of several of a kind the first; one without coordinates is none.

    pid numbers a folder's placemarks in order, place the folders of a file, so the last line of all can be told.
    """
    p = read_folders(spark, path).select("place", "folder", F.posexplode("placemarks").alias("pid", "p"))
    point, line = _first("Point", "coordinates", ""), _first("LineString", "coordinates", "")
    ring = _first("Polygon", "outerBoundaryIs.LinearRing.coordinates", r".*?<(?:[\w.-]+:)?outerBoundaryIs")
    p = p.withColumns({"kind": F.when(point.isNotNull(), "Point").when(line.isNotNull(), "LineString").when(ring.isNotNull(), "Polygon"), "coords": geo.parse_coords(F.coalesce(point, line, ring))})
    return p.select(
        "place", "folder", F.col("pid").cast("long").alias("pid"), F.col("p.name").alias("name"), text.normalize(F.col("p.name")).alias("norm"),
        F.when(F.size("coords") > 0, F.col("kind")).alias("gtype"), "coords", text.image_urls(F.col("p.description")).alias("images"),
    )


def split_zones(placemarks: DataFrame, prefix: str = "meta_deonice") -> tuple[DataFrame, DataFrame]:
    """Zones (zone, ring) from the folders of that prefix, and the other placemarks."""
    is_zone = F.lower(text.stripped(F.col("folder"))).startswith(prefix)
    zones = placemarks.filter(is_zone & (F.col("gtype") == "Polygon") & (F.size("coords") > 0)).select(text.stripped(F.col("name")).alias("zone"), F.col("coords").alias("ring"))
    return zones, placemarks.filter(~is_zone)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """gtype, coords and the properties (a DDL schema) of a feature collection; of a polygon the outer ring."""
    schema = f"features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: STRUCT<{properties}>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    raw, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    pairs = F.when(kind == "Point", F.array(F.from_json(raw, "array<double>"))).when(kind == "LineString", F.from_json(raw, "array<array<double>>")).when(kind == "Polygon", F.get(F.from_json(raw, "array<array<array<double>>>"), F.lit(0)))
    return f.select(kind.alias("gtype"), F.transform(pairs, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("coords"), "f.properties.*")


def read_survey(spark: SparkSession, path: str, columns: int = 9) -> DataFrame:
    """row_idx, c0 ... of a CSV with header, by position. Short rows end in nulls; rows of blanks only are left out.

    A survey is one small file that is read in one piece (quoted line feeds), so the reading order numbers its rows.
    """
    names = [f"c{k}" for k in range(columns)]
    rows = spark.read.csv(path, schema=", ".join(f"{n} STRING" for n in names), header=True, multiLine=True, quote='"', escape='"', enforceSchema=True, mode="PERMISSIVE")
    any_text = F.exists(F.array(*names), lambda c: F.length(text.stripped(c)) > 0)
    if len(rows.inputFiles()) > 1:
        raise ValueError("a survey is one file: rows of several have no order")
    return rows.withColumn("row_idx", F.monotonically_increasing_id()).filter(any_text).select("row_idx", *names)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """idx, km, lat, lon, elev, elev_smooth, zone of a stored profile document; samples without a zone are left out."""
    schema = "profile ARRAY<STRUCT<km: DOUBLE, lat: DOUBLE, lon: DOUBLE, elev: DOUBLE, elev_smooth: DOUBLE, deonica: STRING>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("profile").alias("idx", "p")).select("idx", "p.km", "p.lat", "p.lon", "p.elev", "p.elev_smooth", F.col("p.deonica").alias("zone")).filter("coalesce(zone, '') <> ''")


def with_elevation(samples: DataFrame, heights: DataFrame) -> DataFrame:
    """samples (idx) with elev from a table of fetched heights (idx, elev); null where none was got."""
    return samples.join(heights, "idx", "left")


def tile_files(spark: SparkSession, path: str) -> DataFrame:
    """z, x, y, content of stored tiles named .../z/x/y.png; decoding the images is left to the caller."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.\w+$", k).cast("long")
    return files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), "content")


def settings(path: str, into: dict[str, str] | None = None) -> Mapping[str, str]:
    """KEY=value lines; comments and blank lines are skipped, quotes taken off, keys that are set already stay."""
    out = os.environ if into is None else into
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    key, _, value = line.partition("=")
                    out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out
