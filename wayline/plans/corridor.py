"""The whole corridor from its placemarks: layers, counts, lengths, densities, profile, in one declarative plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geo, text
from wayline.operators import linear, spatial, stats


# The layers that are shown, with a count even if nothing is in them.
LAYERS = ("trasa", "zelena", "prekidi", "stepenice", "rampe", "staze", "osvetljenje", "klupe", "kante", "letnjikovci", "sport", "urbana_ostalo", "stanja", "socijalni")


def classified(placemarks: DataFrame, zones: DataFrame) -> DataFrame:
    """placemarks with zone, layer (null: counted, not shown), category and length_m of lines."""
    f = spatial.locate_features(placemarks, zones)
    source = text.layer_of(F.col("folder"))
    n, line = F.col("norm"), F.col("gtype") == "LineString"
    shown = F.col("gtype").isNotNull() & ((F.col("source") != "trasa") | line)
    f = f.withColumn("source", source)
    layer = (
        F.when(F.col("source") == "stepenice_rampe", F.when(line, "staze").otherwise(text.stairs_or_ramp(n)))
        .when(F.col("source") == "urbana", text.bucket(text.classify(n, text.URBAN_RULES)))
        .otherwise(F.col("source"))
    )
    category = (
        F.when(F.col("source") == "zelena", text.classify(n, text.GREEN_RULES))
        .when(F.col("source") == "prekidi", text.classify(n, text.OBSTACLE_RULES))
        .when((F.col("source") == "stepenice_rampe") & line, text.classify(n, text.SURFACE_RULES))
        .when(F.col("source") == "urbana", text.classify(n, text.URBAN_RULES))
        .when(F.col("source") == "stanja", text.classify(n, text.STATE_RULES))
    )
    return f.withColumns({"layer": F.when(shown, layer), "category": F.when(shown, category), "length_m": F.when(line, geo.line_length_m(F.col("coords")))})


def line_segments(features: DataFrame) -> DataFrame:
    """The segments of every line: layer, category, lon1, lat1, lon2, lat2, length_m."""
    n = F.size("coords")
    pairs = F.arrays_zip(F.slice("coords", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("coords", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    s = features.filter("gtype = 'LineString'").select("layer", "category", F.explode(pairs).alias("s"))
    s = s.select("layer", "category", F.col("s.a.lon").alias("lon1"), F.col("s.a.lat").alias("lat1"), F.col("s.b.lon").alias("lon2"), F.col("s.b.lat").alias("lat2"))
    return s.withColumn("length_m", geo.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")))


def summary(placemarks: DataFrame, zones: DataFrame) -> dict[str, DataFrame]:
    """Result tables by name. Only the last line of the route layer gives the total; all of them count by zone."""
    f = classified(placemarks, zones)
    shown = f.filter("layer is not null")
    lines = line_segments(shown)
    last = F.struct(*[c for c in ("place", "pid") if c in f.columns])  # in order of the file
    route = shown.filter("layer = 'trasa'").agg(F.max_by("length_m", last).alias("m"))
    layers = f.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    per_layer = stats.dense(stats.counts(shown, "layer"), layers, ["layer"], "n")
    paths = shown.filter("layer = 'staze'")
    return {
        "total": f.agg(F.count(F.lit(1)).alias("n")),
        "sources": stats.counts(f, "folder"),
        "shapes": f.groupBy("folder").agg(*[F.count(F.when(F.col("gtype") == g, 1)).alias(g) for g in ("Point", "LineString", "Polygon")]),
        "line_names": f.filter("gtype = 'LineString'").groupBy("folder", "norm").agg(F.count(F.lit(1)).alias("n"), F.sum("length_m").alias("length_m")),
        "names": folder_names(f),
        "layers": per_layer,
        "zone_counts": stats.counts(shown.filter("layer not in ('trasa', 'staze')"), "zone", "layer"),
        "obstacles": stats.counts(shown.filter("layer = 'prekidi'"), "category"),
        "paths": stats.shares(paths, [], "category", F.col("length_m")),
        "zone_paths": spatial.length_by_zone(lines.filter("layer = 'staze'"), zones, "category"),
        "zone_route": spatial.length_by_zone(lines.filter("layer = 'trasa'"), zones),
        "vegetation": shown.filter("gtype = 'LineString' and category in ('visoka_vegetacija', 'niska_vegetacija')").groupBy("category").agg(F.sum("length_m").alias("length_m")),
        "density": per_layer.crossJoin(F.broadcast(route)).withColumns(stats.density(F.col("n"), F.col("m") / 1000.0)).drop("m"),
    }


def folder_names(placemarks: DataFrame, most: int = 20) -> DataFrame:
    """folder, norm, n, length_m, rank, more: the most frequent names of all placemarks of a folder, of equally frequent ones the
    first seen; the length of the lines so named (null: none is a line); how many names come after these. placemarks: folder, pid, norm, gtype, coords."""
    metres = F.when(F.col("gtype") == "LineString", geo.line_length_m(F.col("coords")))
    named = placemarks.groupBy("folder", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first"), F.sum(metres).alias("length_m"))
    names = named.groupBy("folder").agg(F.count(F.lit(1)).alias("names"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "first", "norm"))).filter(F.col("rank") <= most)
    same = ranked["folder"].eqNullSafe(names["folder"])
    return ranked.join(names, same).select(ranked["folder"], "norm", "n", "length_m", "rank", F.greatest(F.col("names") - most, F.lit(0)).alias("more"))


def gallery(features: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """url, name, zone, layer, category: one row for each image of the features of the categories' layers, repeated ones too.
    features: layer, name, zone, images."""
    of = F.try_element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("layer"))
    name = F.coalesce(F.nullif(text.stripped(F.col("name")), F.lit("")), F.lit(text.UNNAMED))
    shown = features.withColumn("category", of).filter("category is not null")
    return shown.select(F.explode("images").alias("url"), name.alias("name"), F.coalesce("zone", F.lit("")).alias("zone"), "layer", "category")


def gallery_counts(images: DataFrame, all: str = "all") -> DataFrame:
    """category, n: images of each category that has some, and of all. One pass."""
    each = images.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return each.select(F.when(F.col("g") == 1, all).otherwise(F.col("category")).alias("category"), "n")


def shared_scales(counts: DataFrame, by: str, value: str) -> DataFrame:
    """by, most: the largest value over all zones, at least 1, for bars that can be compared."""
    return counts.groupBy(by).agg(F.greatest(F.lit(1.0), F.max(value).cast("double")).alias("most"))


def strip_sums(strips: DataFrame, zone: str = "zone") -> DataFrame:
    """zone, length_m: what the strip's intervals of each zone sum to."""
    return strips.filter(F.col(zone).isNotNull()).groupBy(zone).agg(F.sum("length_m").alias("length_m"))


def of_category(items: DataFrame, category: str, wanted: str, all: str = "all") -> DataFrame:
    """The items of the wanted category, or all."""
    return items.filter((F.lit(wanted) == all) | (F.col(category) == wanted))


def profile(route: DataFrame, heights: DataFrame, zones: DataFrame, step_m: float = 30.0, window: int = 9) -> DataFrame:
    """route, idx, km, lon, lat, elev, elev_smooth, zone at every step of a route (route, i, lon, lat).

    Kilometres are rounded to 3 digits and heights to 1 before anything is derived from them.
    """
    s = linear.resample(route, "route", "i", step_m)
    s = s.withColumn("idx", F.row_number().over(Window.partitionBy("route").orderBy("at_m")) - 1)
    s = s.join(heights, ["route", "idx"], "left")
    s = linear.moving_average(s, "route", "idx", "elev", window, "elev_smooth")
    s = linear.fill_gaps(spatial.locate(s, zones, into="z"), "route", "idx", "z", "zone")
    return s.select("route", "idx", F.round(F.col("at_m") / 1000.0, 3).alias("km"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("elev", 1).alias("elev"), F.round("elev_smooth", 1).alias("elev_smooth"), "zone")
