"""Ordered series: segments, resampling, smoothing, gaps, runs, nearest neighbours in order.

Every window here is partitioned by the line (or user, or route), so lines run side by side; a null-free key column
names the line. by may be several columns. A line has to fit one task; scan.py has the same operators for lines that do not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayline.functions import geo

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _w(by: str | Sequence[str], order: str | Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*([order] if isinstance(order, str) else order))


def sides(rows: DataFrame, by: str | Sequence[str], order: str | Sequence[str], value: str, own: int) -> DataFrame:
    """rows with __l and __r, the nearest value there is before and after each row; own 0: a row's own value counts, 1: it does not.

    What comes after is looked for in reverse: a frame that reaches from each row to the end is gone through again for each row.
    """
    near = lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -own))
    told = rows.withColumns({"__k": F.row_number().over(_w(by, order)), "__l": near(_w(by, order))})
    return told.withColumn("__r", near(_w(by, [F.desc("__k")]))).drop("__k")


def segments(points: DataFrame, by: str, order: str, *keep: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """by, order, lon1, lat1, lon2, lat2, length_m for each two consecutive points, with keep of the first."""
    w = _w(by, order)
    pairs = points.select(by, order, *keep, F.col(lon).alias("lon1"), F.col(lat).alias("lat1"), F.lead(lon).over(w).alias("lon2"), F.lead(lat).over(w).alias("lat2"))
    return pairs.filter("lon2 is not null").withColumn("length_m", geo.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")))


def cumulative(segs: DataFrame, by: str, order: str) -> DataFrame:
    """segments with from_m and to_m along the line."""
    to = F.sum("length_m").over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return segs.withColumn("to_m", to).withColumn("from_m", F.col("to_m") - F.col("length_m"))


def resample(points: DataFrame, by: str, order: str, step_m: float, tail_m: float = 1.0) -> DataFrame:
    """by, at_m, lon, lat at 0, step, 2 step, ... and at the end if the last of these is more than tail_m before it."""
    return resampled(points, cumulative(segments(points, by, order), by, order), by, order, step_m, tail_m)


def resampled(points: DataFrame, along: DataFrame, by: str | Sequence[str], order: str, step_m: float, tail_m: float) -> DataFrame:
    """resample by the segments of the points, with from_m and to_m."""
    keys = [by] if isinstance(by, str) else list(by)
    c = along.filter("length_m > 0")
    first, last = F.floor(F.col("from_m") / step_m) + 1, F.floor(F.col("to_m") / step_m)
    each = c.filter(last >= first).withColumn("k", F.explode(F.sequence(first, last))).withColumn("at_m", F.col("k") * F.lit(float(step_m)))
    share = (F.col("at_m") - F.col("from_m")) / F.col("length_m")
    inner = each.select(*keys, "at_m", geo.interpolate(F.col("lon1"), F.col("lon2"), share).alias("lon"), geo.interpolate(F.col("lat1"), F.col("lat2"), share).alias("lat"))
    ends = points.groupBy(*keys).agg(F.min_by(F.struct("lon", "lat"), order).alias("a"), F.max_by(F.struct("lon", "lat"), order).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    start = ends.select(*keys, F.lit(0.0).alias("at_m"), "a.lon", "a.lat")
    total = c.groupBy(*keys).agg(F.max("to_m").alias("at_m"))
    whole = ends.join(total, keys) if keys else ends.crossJoin(total)  # without keys one row each
    end = whole.filter(F.floor(F.col("at_m") / step_m) * step_m < F.col("at_m") - tail_m).select(*keys, "at_m", "b.lon", "b.lat")
    return start.unionByName(inner).unionByName(end)


def moving_average(series: DataFrame, by: str, order: str, value: str, window: int, into: str = "smooth") -> DataFrame:
    """Centred mean over the rows there are; nulls in the window are skipped."""
    half = window // 2
    return series.withColumn(into, F.avg(value).over(_w(by, order).rowsBetween(-half, half)))


def fill_gaps(series: DataFrame, by: str, order: str, value: str, into: str = "filled") -> DataFrame:
    """A run of nulls takes the value beside it, if both sides agree or there is only one side."""
    return sides(series, by, order, value, 1).withColumn(into, F.coalesce(F.col(value), between(F.col("__l"), F.col("__r")))).drop("__l", "__r")


def between(left: Column, right: Column) -> Column:
    """What a gap between two values takes: either if they agree, the one there is if there is one."""
    return F.when(left == right, left).when(right.isNull(), left).when(left.isNull(), right)


def runs(series: DataFrame, by: str | Sequence[str], order: str, *states: str, into: str = "run") -> DataFrame:
    """series with the number of the run: a new one wherever any of states differs from the row before, null-safe."""
    w = _w(by, order)
    same = F.lit(True)
    for s in states:
        same = same & F.col(s).eqNullSafe(F.lag(s).over(w))
    first = F.row_number().over(w) == 1
    return series.withColumn("__new", F.when(first | ~same, 1).otherwise(0)).withColumn(into, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def run_stats(series: DataFrame, by: str | Sequence[str], order: str, state: str, step_m: int, number: Callable[..., DataFrame] = runs) -> DataFrame:
    """*by, pct, longest_m, longest_gap_m, transitions of a boolean; a run of n rows is n * step long."""
    keys = [by] if isinstance(by, str) else list(by)
    each = number(series, keys, order, state).groupBy(*keys, "run", state).agg(F.count(F.lit(1)).alias("n"))
    longest = lambda on: F.coalesce(F.max(F.when(F.col(state) == on, F.col("n") * step_m)), F.lit(0)).cast("long")
    return each.groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col(state), F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 1).alias("pct"),
        longest(True).alias("longest_m"), longest(False).alias("longest_gap_m"), (F.count(F.lit(1)) - 1).alias("transitions"),
    )


def strips(series: DataFrame, by: str | Sequence[str], order: str, km: str, state: str, zone: str, step_m: int, number: Callable[..., DataFrame] = runs) -> DataFrame:
    """Intervals that break where the state or the zone changes: km_start, km_end, length_m."""
    keys = [by] if isinstance(by, str) else list(by)
    each = number(series, keys, order, state, zone).groupBy(*keys, "run", state, zone).agg(F.min(km).alias("km"), F.count(F.lit(1)).alias("n"))
    return each.select(*keys, "run", F.round("km", 3).alias("km_start"), F.round(F.col("km") + F.col("n") * (step_m / 1000.0), 3).alias("km_end"), (F.col("n") * step_m).alias("length_m"), state, zone)


def bands(series: DataFrame, by: str | Sequence[str], order: str, km: str, zone: str, number: Callable[..., DataFrame] = runs) -> DataFrame:
    """Stretches of one zone, km_start to km_end; a null ends a stretch and makes none."""
    keys = [by] if isinstance(by, str) else list(by)
    each = number(series, keys, order, zone).filter(F.col(zone).isNotNull()).groupBy(*keys, "run", zone).agg(F.min(km).alias("km_start"), F.max(km).alias("km_end"))
    return each.select(*keys, zone, "km_start", "km_end")


def max_gradient(series: DataFrame, by: str | Sequence[str], order: str, x: str, y: str, least: float, scale: float = 100.0) -> DataFrame:
    """*by, gradient: the largest abs(dy / dx) * scale between consecutive rows with dx of at least least; null y is left out first."""
    keys = [by] if isinstance(by, str) else list(by)
    w = _w(keys, order)
    steps = series.filter(F.col(y).isNotNull()).withColumns({"__dy": F.col(y) - F.lag(y).over(w), "__dx": F.col(x) - F.lag(x).over(w)})
    steep = F.when(F.col("__dx") >= least, F.abs(F.col("__dy") / F.nullif(F.col("__dx"), F.lit(0.0))) * scale)
    return steps.groupBy(*keys).agg(F.coalesce(F.max(steep), F.lit(0.0)).alias("gradient"))


def nearest(asked: DataFrame, series: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """asked (by, at, ...) with the series' value (by, at, value) nearest to at; the later of two as near.

    Both are sorted together; each asked row looks back and ahead for the next of the series.
    """
    return nearer(sides(together(asked, series, by, at, value), by, "__at", "__s", 0), at, value)


def together(asked: DataFrame, series: DataFrame, by: str | Sequence[str], at: str, value: str) -> DataFrame:
    """*by, __at, and __s of the series' rows or __a of the asked ones, a struct each."""
    keys = [by] if isinstance(by, str) else list(by)
    s = series.select(*keys, F.col(at).alias("__at"), F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("__s"), F.lit(None).alias("__a").cast(asked.select(F.struct("*").alias("a")).schema["a"].dataType))
    return s.unionByName(asked.select(*keys, F.col(at).alias("__at"), F.lit(None).cast(s.schema["__s"].dataType).alias("__s"), F.struct("*").alias("__a")))


def nearer(sides: DataFrame, at: str, value: str) -> DataFrame:
    """Of what lies before (__l) and after (__r) each asked row the nearer."""
    left, right = F.col("__l"), F.col("__r")
    found = F.when(left.isNull(), right).when(right.isNull() | ((F.col("__at") - left["at"]) < (right["at"] - F.col("__at"))), left).otherwise(right)
    return sides.filter("__a is not null").withColumn("__n", found).select("__a.*", F.col("__n.at").alias(f"nearest_{at}"), F.col("__n.value").alias(value))


def spline_controls(points: DataFrame, by: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Bezier controls of the curve through the points: for each but the last, c1 and c2 towards the next."""
    w = _w(by, order)

    def controls(c: str, n: str) -> dict[str, Column]:
        here, on = F.col(c), F.lead(c).over(w)
        back, beyond = F.coalesce(F.lag(c).over(w), here), F.coalesce(F.lead(c, 2).over(w), on)
        return {f"c1{n}": here + (on - back) / 6, f"c2{n}": on - (beyond - here) / 6}

    return points.withColumns(controls(x, "x") | controls(y, "y")).filter(F.col("c1x").isNotNull())


def running_offset(series: DataFrame, by: str | Sequence[str], order: str | Sequence[str], value: str, into: str = "offset") -> DataFrame:
    """The sum of all rows before."""
    return series.withColumn(into, F.coalesce(F.sum(value).over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def ordered_hash(series: DataFrame, by: str, order: str, row: Column, into: str = "hash") -> DataFrame:
    """by, hash: SHA-1 over the rows' text in order, 16 hexadecimal digits."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("t"))))
    return series.groupBy(by).agg(F.substring(F.sha1(F.array_join(F.transform(rows, lambda r: r["t"]), "")), 1, 16).alias(into))
