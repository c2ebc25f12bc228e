"""Counts, lengths, shares, densities, ranges and sun hours over features and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.numbers import share
from wayline.operators import linear


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """*by, n; rows with a null in any of by are left out."""
    return rows.dropna(subset=list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def dense(found: DataFrame, grid: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """Every row of the grid, with 0 where found has none. The grid is a dimension of known size."""
    return grid.join(found, list(by), "left").fillna(0, subset=list(values))


def shares(rows: DataFrame, whole: Sequence[str], part: str, value: Column, digits: int = 1) -> DataFrame:
    """*whole, part, amount, pct: each part's share of the sum over its whole."""
    sums = rows.groupBy(*whole, part).agg(F.sum(value).alias("amount"))
    return sums.withColumn("pct", share(F.col("amount"), F.sum("amount").over(Window.partitionBy(*whole)), digits))


def density(count: Column, km: Column) -> dict[str, Column]:
    return {
        "per_km": F.round(F.coalesce(F.try_divide(count, km), F.lit(0.0)), 2),
        "m_per_item": F.round(F.coalesce(F.try_divide(km * 1000.0, count), F.lit(0.0)), 0),
    }


def ranges(series: DataFrame, value: str, *by: str) -> DataFrame:
    """*by, min_m, max_m, range_m of by's groups with at least two values, one decimal."""
    low, high = F.min(value), F.max(value)
    found = series.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(low, 1).alias("min_m"), F.round(high, 1).alias("max_m"), F.round(high - low, 1).alias("range_m"))
    return found.filter(F.col("n") >= 2).drop("n")


def ranges_and_whole(series: DataFrame, value: str, by: str) -> DataFrame:
    """by (null: the whole, rows without by among them), min_m, max_m, range_m; groups as in ranges. One pass gives both."""
    low, high = F.min(value), F.max(value)
    each = series.filter(F.col(value).isNotNull()).rollup(by).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.round(low, 1).alias("min_m"), F.round(high, 1).alias("max_m"), F.round(high - low, 1).alias("range_m"))
    return each.filter((F.col("n") >= 2) & ((F.col("g") == 1) | F.col(by).isNotNull())).drop("n", "g")


def elevation_stats(profile: DataFrame, step_m: float = 30.0) -> DataFrame:
    """zone (null: the whole), min_m, max_m, range_m, max_gradient_pct of a profile with route, idx, km, elev_smooth, zone.

    The whole counts points of no zone too; pairs of points closer than half a step give no gradient.
    """
    p = profile.withColumn("m", F.col("km") * 1000.0)
    scopes = p.withColumn("scope", F.explode(F.array(F.struct(F.lit(None).cast("string").alias("zone"), F.lit(True).alias("all")), F.struct(F.col("zone"), F.lit(False).alias("all")))))
    scopes = scopes.drop("zone").select("*", "scope.zone", "scope.all").filter("all or zone is not null").drop("scope")
    steep = linear.max_gradient(scopes, ["route", "all", "zone"], "idx", "m", "elev_smooth", step_m * 0.5)
    found = ranges(scopes, "elev_smooth", "route", "all", "zone")
    same = lambda c: F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = found.alias("f").join(steep.alias("s"), same("route") & same("all") & same("zone"))
    return joined.select("f.route", "f.zone", "min_m", "max_m", "range_m", F.round("gradient", 1).alias("max_gradient_pct"))


def class_shares(samples: DataFrame, zone: str = "zone", klass: str = "klass") -> DataFrame:
    """zone (null: all samples), klass, pct of the samples with a class. One rollup counts zones and the whole."""
    each = samples.filter(F.col(klass).isNotNull()).rollup(klass, zone).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    each = each.filter(((F.col("g") == 0) & F.col(zone).isNotNull()) | (F.col("g") == 1))
    return each.select(zone, klass, share(F.col("n"), F.sum("n").over(Window.partitionBy("g", zone)), 1).alias("pct"))


def cover_runs(samples: DataFrame, sets: dict[str, Sequence[str]], step_m: int, by: str = "route", order: str = "idx") -> DataFrame:
    """zone (null: all), metric, pct, longest_m, longest_gap_m, transitions for each set of classes. Each sample is expanded
    once, to its sets and scopes, and one sort serves all of them."""
    scopes = [F.struct(F.lit(name).alias("metric"), F.col("klass").isin(*classes).alias("on"), F.lit(whole).alias("whole"), (F.lit(None).cast("string") if whole else F.col("zone")).alias("zone")) for name, classes in sets.items() for whole in (True, False)]
    each = samples.filter("klass is not null").select(by, order, F.explode(F.array(*scopes)).alias("s")).select(by, order, "s.*").filter("whole or zone is not null")
    return linear.run_stats(each, [by, "metric", "whole", "zone"], order, "on", step_m).drop("whole").select(by, "pct", "longest_m", "longest_gap_m", "transitions", "zone", "metric")


def sun_shares(samples: DataFrame, dates: DataFrame, zone: str = "zone", hours: str = "sun_hours") -> DataFrame:
    """zone (null: all), date, n_samples, avg_hours, pct_sun, pct_shade. hours: a map by date key; a missing key counts 0.

    dates: key, daylight; a few rows.
    """
    each = samples.crossJoin(dates).withColumn("h", F.coalesce(F.try_element_at(F.col(hours), F.col("key")), F.lit(0.0)))
    mean = F.avg("h")
    return each.rollup("key", "daylight", zone).agg(F.count(F.lit(1)).alias("n_samples"), mean.alias("m"), F.grouping_id().alias("g")).filter("g in (0, 1)").filter(F.col(zone).isNotNull() | (F.col("g") == 1)).select(
        zone, F.col("key").alias("date"), "n_samples", F.round("m", 2).alias("avg_hours"), F.round(F.col("m") / F.col("daylight"), 3).alias("pct_sun"), F.round(1.0 - F.col("m") / F.col("daylight"), 3).alias("pct_shade")
    )


def catch_all_last(counts_: DataFrame, by: Sequence[str], label: str, rest: str) -> DataFrame:
    """rank and pct of each label: by n, the catch-all last whatever its n."""
    w = Window.partitionBy(*by)
    return counts_.withColumn("rank", F.row_number().over(w.orderBy(F.col(label) == rest, F.desc("n"), label))).withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(w), 1))
