"""Points in many or large zones: an adaptive quadtree cover of the zones, joined to the points by cell.

A cell of a zone holds the edges that decide which of its points lie inside, and inside, what a point is before any of them
is crossed. Of the edges that a ray to the east may meet, those that pass the whole height of a cell east of it are met
by every ray, so they only turn inside over; those west of it or beyond its height are met by none. A cell that no edge touches
is all inside or all outside: it is decided once, at its centre, and keeps no edge, or goes. A cell with more than
EDGES_IN_CELL edges is cut into STEP x STEP cells, down to the finest level. So a zone has large cells within and small
ones where its border is busy, and a point is tested against few edges, with the result of the ray over the whole ring.
A zone whose level would hold more than HELD_PER_EDGE cells and edges for each edge of its ring is cut no further, so a
border of hairlines makes cells with more edges, not endless cells.

The cover is built level by level over all zones at once; each level is written to the shared folder. Points look at
the levels that occur, MOST_LEVELS at most; each place is looked up once.

Where zones overlap only the first counts, so the work is that of what can be first, not of all pairs: a zone that comes after one
whose cell is wholly inside has no cell there nor below, and a place meets the zones of its cell in their order, up to the first that holds it.
A task holds the places of a cell, PLACES_IN_SHARE or so of them, and reads past its zones; a cell with more places is dealt to several.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions import geo
from wayline.session import stored

EDGES_IN_CELL = 16
HELD_PER_EDGE = 32
#: A cell of level k has 360 / STEP ** k degrees, from 360 down to 38 m on the equator.
STEP = 4
MOST_LEVELS = 11
#: Closer than this to a cell's border an edge counts as beside it on neither side: far beyond what rounding moves a point.
MARGIN = 1e-9
PLACES_IN_SHARE = 50_000
#: Zones that a place is held against at first (twice as many each time), and pairs of a place and a zone at once.
ZONES_AT_FIRST, PAIRS_AT_ONCE = 8, 1 << 17
CELL = ["level", "x", "y"]


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(float(STEP)), level)


def _cell(degrees: Column, level: Column) -> Column:
    return F.floor((degrees + 180.0) / _size(level))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (level, x, y, inside, edges, ...) with the edges that matter there; cells wholly outside go."""
    for batch in batches:
        level, x, y, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*CELL, "inside"))
        size = 360.0 / np.power(float(STEP), level)
        w, s = x * size - 180.0, y * size - 180.0
        e, n = w + size, s + size
        edges = batch.column("edges")
        ends, rows = edges.offsets.to_numpy(), batch.num_rows
        of, values = np.repeat(np.arange(rows), np.diff(ends)), edges.values.slice(ends[0], ends[-1] - ends[0])
        x1, y1, x2, y2 = (values.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
        count = lambda which: np.bincount(of[which], minlength=rows)
        low, high, left, right = np.minimum(y1, y2), np.maximum(y1, y2), np.minimum(x1, x2), np.maximum(x1, x2)
        unknown = np.isnan(left)  # a vertex without a longitude: its edges may be anywhere
        left[unknown], right[unknown] = -np.inf, np.inf
        met = (high >= s[of] - MARGIN) & (low <= n[of] + MARGIN) & (right >= w[of] - MARGIN)
        always = met & (left > e[of] + MARGIN) & (low < s[of] - MARGIN) & (high > n[of] + MARGIN)
        met &= ~always
        inside = inside.astype(bool) != (count(always) % 2 == 1)
        touched = count(met & (left <= e[of] + MARGIN)) > 0
        at = np.flatnonzero(met & ~touched[of])  # cells that no edge touches
        at = at[(y1[at] > ((s + n) / 2)[of[at]]) != (y2[at] > ((s + n) / 2)[of[at]])]
        east = (x2[at] - x1[at]) * (((s + n) / 2)[of[at]] - y1[at]) / (y2[at] - y1[at]) + x1[at]
        crossed = at[((w + e) / 2)[of[at]] < east]
        inside = np.where(touched, inside, inside != (count(crossed) % 2 == 1))
        met &= touched[of]
        kept = touched | inside
        ends = np.concatenate([[0], np.cumsum(count(met)[kept])]).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v[met], from_pandas=True) for v in (x1, y1, x2, y2)], ["x1", "y1", "x2", "y2"]))
        found = batch.filter(pa.array(kept))
        own = {"inside": pa.array(inside[kept]), "edges": held}
        yield pa.RecordBatch.from_arrays([own.get(c, found.column(c)) for c in batch.schema.names], names=batch.schema.names)


def cover(zones: DataFrame, edges_in_cell: int = EDGES_IN_CELL) -> DataFrame:
    """zone, ord, level, x, y, inside, edges of zones (zone, ord, ring)."""
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    sound = (F.size("ring") > 0) & ~F.exists("ring", lambda p: p["lat"].isNull())  # the others hold nothing
    given = stored(zones.select("zone", "ord", "ring").repartition("zone"), "zones")  # rings are made once, and dealt out
    boxed = given.filter(sound).select(
        "zone", "ord", geo.ring_edges(F.col("ring")).alias("edges"),
        F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), F.array_min(lat).alias("south"), F.array_max(lat).alias("north"),
    )
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-6))
    fits = F.floor(F.log(F.lit(360.0) / extent) / F.log(F.lit(float(STEP)))).cast("int")
    cells = boxed.withColumn("level", F.least(F.greatest(fits, F.lit(0)), F.lit(MOST_LEVELS - 1)))
    between = lambda a, b: F.explode(F.sequence(_cell(F.col(a), F.col("level")), _cell(F.col(b), F.col("level"))))
    cells = cells.withColumn("x", between("west", "east")).withColumn("y", between("south", "north"))
    cells = cells.select("zone", "ord", "level", "x", "y", F.lit(False).alias("inside"), F.size("edges").alias("ring"), "edges")
    done = []
    large = (F.size("edges") > edges_in_cell) & (F.col("level") < MOST_LEVELS - 1)
    for _ in range(MOST_LEVELS):
        level = stored(cells.mapInArrow(_settle, cells.schema), "cells")
        held = level.filter(large).groupBy("zone", "ord").agg(F.sum(F.size("edges") + 1).alias("held"))
        fine = F.col("held") <= F.col("ring") * HELD_PER_EDGE
        rest = stored(level.filter(large).join(held, ["zone", "ord"]).withColumn("fine", fine), "large")
        done += [level.filter(~large), rest.filter("not fine")]
        rest = rest.filter("fine")
        if rest.isEmpty():
            break
        k = F.explode(F.sequence(F.lit(0), F.lit(STEP * STEP - 1)))
        cells = rest.withColumn("k", k).select(
            "zone", "ord", (F.col("level") + 1).alias("level"), (F.col("x") * STEP + F.col("k") % STEP).alias("x"), (F.col("y") * STEP + F.expr(f"k div {STEP}")).alias("y"), "inside", "ring", "edges"
        )
    return reduce(DataFrame.unionByName, [c.select("zone", "ord", "level", "x", "y", "inside", "edges") for c in done])


def visible(cells: DataFrame, levels: list[int]) -> DataFrame:
    """cells (with x, y and ord) without those of zones that come after one which holds the whole cell, or a cell around it."""
    whole = cells.filter("inside and size(edges) = 0").groupBy(*CELL).agg(F.min("ord").alias("__most"))
    spots = cells.select(*CELL).distinct()
    up = F.pow(F.lit(float(STEP)), F.col("level") - F.col("__l"))
    around = spots.withColumn("__l", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k <= F.col("level"))))
    around = around.withColumns({"__x": F.floor(F.col("x") / up), "__y": F.floor(F.col("y") / up)})
    above = whole.select(F.col("level").alias("__l"), F.col("x").alias("__x"), F.col("y").alias("__y"), "__most")
    most = stored(around.join(above, ["__l", "__x", "__y"]).groupBy(*CELL).agg(F.min("__most").alias("__most")), "most")
    return cells.join(most, CELL, "left").filter("__most is null or ord <= __most").drop("__most")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... counts[k] of them, for each k."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class _Entries:
    """The zones of cells: whether each holds a place, for many pairs of both at once."""

    def __init__(self, inside: pa.Array, edges: pa.ListArray) -> None:
        self.inside = inside.to_numpy(zero_copy_only=False).astype(bool)
        ends = edges.offsets.to_numpy().astype(np.int64)
        self.start, self.size = ends[:-1], np.diff(ends)
        self.x1, self.y1, self.x2, self.y2 = (edges.values.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
        none, held = np.full(len(self.size), -np.inf), np.flatnonzero(self.size)
        over = lambda f, v: f.reduceat(v, self.start[held]) if len(held) else np.empty(0)
        self.low, self.high, self.east = -none, none.copy(), none.copy()  # without edges nothing is met
        self.low[held], self.high[held] = over(np.minimum, np.minimum(self.y1, self.y2)), over(np.maximum, np.maximum(self.y1, self.y2))
        self.east[held] = np.nan_to_num(over(np.maximum, np.maximum(self.x1, self.x2)) + MARGIN, nan=np.inf)

    def hold(self, lon: np.ndarray, lat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """geo.in_ring, for entry at[k] and the place lon[k], lat[k]."""
        near = np.flatnonzero((self.low[at] <= lat) & (lat < self.high[at]) & (lon < self.east[at]))
        size = self.size[at[near]]
        pair, edge = np.repeat(near, size), _spread(self.start[at[near]], size)
        y = lat[pair]
        met = np.flatnonzero((self.y1[edge] > y) != (self.y2[edge] > y))
        pair, edge, y = pair[met], edge[met], y[met]
        x1, y1 = self.x1[edge], self.y1[edge]
        x = (self.x2[edge] - x1) * (y - y1) / (self.y2[edge] - y1) + x1  # an edge that is met is not level
        odd = np.bincount(pair[lon[pair] < x], minlength=len(at)) % 2 == 1
        unknown = np.bincount(pair[np.isnan(x)], minlength=len(at)) > 0
        return (odd != self.inside[at]) & ~unknown


def _first(lon: np.ndarray, lat: np.ndarray, begin: np.ndarray, end: np.ndarray, entries: _Entries) -> np.ndarray:
    """For each place the first of entries begin to end that holds it, or -1."""
    found, most = np.full(len(lon), -1), ZONES_AT_FIRST
    begin, left = begin.copy(), np.flatnonzero(begin < end)
    while len(left):
        for part in np.array_split(left, -(-len(left) * most // PAIRS_AT_ONCE)):
            n = np.minimum(end[part] - begin[part], most)
            place, at = np.repeat(part, n), _spread(begin[part], n)
            hit = np.flatnonzero(entries.hold(lon[place], lat[place], at))
            who, first = np.unique(place[hit], return_index=True)
            found[who] = at[hit[first]]
            begin[part] += n
        left, most = left[(found[left] < 0) & (begin[left] < end[left])], min(2 * most, PAIRS_AT_ONCE)
    return found


def _first_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell and share, the places of one before its zones in order: __lon, __lat, ord, zone of each place that a zone holds."""
    last, lon, lat = None, np.empty(0), np.empty(0)  # the cell that may go on, its places without a zone so far
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*CELL, "share")])
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        places = batch.column("__lon").is_valid()
        is_place = places.to_numpy(zero_copy_only=False)
        if last != tuple(keys[0]):
            lon, lat = lon[:0], lat[:0]
        of = np.concatenate([np.zeros(len(lon), np.int64), group[is_place]])
        here = batch.filter(places)
        lon, lat = (np.concatenate([a, here.column(c).to_numpy(zero_copy_only=False)]) for a, c in ((lon, "__lon"), (lat, "__lat")))
        zones = batch.filter(pa.array(~is_place))
        ends = np.cumsum(np.bincount(group[~is_place], minlength=group[-1] + 1))
        found = _first(lon, lat, np.concatenate([[0], ends[:-1]])[of], ends[of], _Entries(zones.column("inside"), zones.column("edges")))
        hit = np.flatnonzero(found >= 0)
        which = pa.array(found[hit])
        yield pa.RecordBatch.from_arrays([pa.array(lon[hit]), pa.array(lat[hit]), zones.column("ord").take(which), zones.column("zone").take(which)], names=["__lon", "__lat", "ord", "zone"])
        rest = (found < 0) & (of == group[-1])
        last, lon, lat = tuple(keys[-1]), lon[rest], lat[rest]


def first_zones(places: DataFrame, cells: DataFrame, levels: list[int]) -> DataFrame:
    """__lon, __lat, ord, zone: for places (__lon, __lat) the first zone of their cell at each level, where there is one."""
    at = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"x": _cell(F.col("__lon"), F.col("level")), "y": _cell(F.col("__lat"), F.col("level"))})
    crowds = stored(at.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / PLACES_IN_SHARE).alias("shares")), "crowds")
    dealt = at.join(F.broadcast(crowds.filter("shares > 1")), CELL, "left")  # one for each PLACES_IN_SHARE places at most
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("__lon", "__lat"), F.coalesce("shares", F.lit(1)))).drop("shares")
    asked = cells.filter("ord is not null").join(crowds, CELL).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    rows = dealt.unionByName(asked, allowMissingColumns=True).repartition(*CELL, "share").sortWithinPartitions(*CELL, "share", F.asc_nulls_first("ord"))
    schema = T.StructType([T.StructField("__lon", T.DoubleType()), T.StructField("__lat", T.DoubleType()), cells.schema["ord"], cells.schema["zone"]])
    return rows.select(*CELL, "share", "__lon", "__lat", "ord", "zone", "inside", "edges").mapInArrow(_first_zones, schema)


def locate(points: DataFrame, zones: DataFrame, lon: str = "lon", lat: str = "lat", into: str = "zone", edges_in_cell: int = EDGES_IN_CELL) -> DataFrame:
    """points with the zone each lies in, of several the lowest ord, null outside all."""
    every = cover(zones, edges_in_cell)
    levels = sorted(r["level"] for r in every.select("level").distinct().collect())  # MOST_LEVELS at most
    cells = stored(visible(every, levels), "cover")
    places = stored(points.select(F.col(lon).cast("double").alias("__lon"), F.col(lat).cast("double").alias("__lat")).dropna().distinct(), "places")
    first = first_zones(places, cells, levels).groupBy("__lon", "__lat").agg(F.min_by("zone", "ord").alias(into))
    return points.join(first, (F.col(lon) == F.col("__lon")) & (F.col(lat) == F.col("__lat")), "left").drop("__lon", "__lat")
