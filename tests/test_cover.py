import math
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import cover, spatial
from wayline.plans.scale_queries import QUERIES, SQL


def star(x, y, r, n, rng):
    at = [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [{"lon": a, "lat": b} for a, b in at + at[:1]]


def zones(spark):
    """Tiny to continental, one on a vertex grid that points lie on, one that crosses itself, one without a ring, one of a point."""
    rng = random.Random(7)
    rings = [star(rng.uniform(-20, 20), rng.uniform(-10, 10), rng.choice([0.001, 0.5, 3, 15]), rng.choice([3, 5, 40, 150]), rng) for _ in range(16)]
    rings += [[{"lon": float(a), "lat": float(b)} for a, b in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))], [{"lon": float(a), "lat": float(b)} for a, b in ((-5, -5), (5, 5), (5, -5), (-5, 5))], [], [{"lon": 1.0, "lat": 1.0}]]
    return spark.createDataFrame([(f"z{k}", len(rings) - k, r) for k, r in enumerate(rings)], "zone string, ord int, ring array<struct<lon:double,lat:double>>")


def points(spark):
    rng = random.Random(8)
    at = [(rng.uniform(-25, 25), rng.uniform(-15, 15)) for _ in range(800)] + [(float(a), float(b)) for a in range(-6, 7) for b in range(-6, 7)] + [(None, 1.0), (1.0, None)] + [(2.0, 2.0)] * 5
    return spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id int, lon double, lat double")


def test_cover_finds_what_whole_rings_do(spark):
    z, p = zones(spark), points(spark)
    want = {r.id: r.zone for r in spatial.locate(p, z).collect()}
    for edges in (3, 16):
        assert {r.id: r.zone for r in cover.locate(p, z, edges_in_cell=edges).collect()} == want
    assert len(set(want.values())) > 5


def test_every_cell_agrees_with_its_zone(spark):
    """Not the first zone alone: for each zone by itself, whether it holds each point."""
    z, p = zones(spark), points(spark).dropna()
    cells = cover.cover(z, 4)
    at = p.withColumn("level", F.explode(F.array(*map(F.lit, range(cover.MOST_LEVELS))))).withColumns({"x": cover._cell(F.col("lon"), F.col("level")), "y": cover._cell(F.col("lat"), F.col("level"))})
    found = at.join(cells, ["level", "x", "y"])
    found = {(r.id, r.zone) for r in found.filter(F.col("inside") != geo.in_ring(F.col("lon"), F.col("lat"), F.col("edges"))).collect()}
    whole = p.crossJoin(z.select("zone", geo.ring_edges(F.col("ring")).alias("edges")))
    assert found == {(r.id, r.zone) for r in whole.filter(geo.in_ring(F.col("lon"), F.col("lat"), F.col("edges"))).collect()}


def test_cells_follow_the_border(spark):
    """A continental zone of many edges: whole cells hold none, border cells few, and there are not many more cells than edges."""
    ring = [{"lon": 30 * math.cos(k / 240) * (1 + 0.05 * math.sin(k / 9)), "lat": 30 * math.sin(k / 240) * (1 + 0.05 * math.sin(k / 9))} for k in range(1508)]
    cells = cover.cover(spark.createDataFrame([("z", 1, ring)], "zone string, ord int, ring array<struct<lon:double,lat:double>>")).select("level", F.size("edges").alias("n")).collect()
    whole, border = [c for c in cells if c.n == 0], [c for c in cells if c.n]
    assert min(c.level for c in whole) < max(c.level for c in border)
    assert max(c.n for c in border) <= cover.EDGES_IN_CELL and len(cells) < 8 * len(ring)


def test_hairlines_do_not_make_endless_cells(spark):
    teeth = [{"lon": 1 + (k + j) * 1e-6, "lat": float(b)} for k in range(0, 120, 2) for j, b in ((0, 0), (0, 10), (1, 10), (1, 0))]
    z = spark.createDataFrame([("comb", 1, teeth)], "zone string, ord int, ring array<struct<lon:double,lat:double>>")
    assert cover.cover(z).count() < 40 * len(teeth)
    p = spark.createDataFrame([(k, 1 + k * 3.1e-7, 5.0) for k in range(400)], "id int, lon double, lat double")
    assert {r.id: r.zone for r in cover.locate(p, z).collect()} == {r.id: r.zone for r in spatial.locate(p, z).collect()}


def test_many_zones_above_each_other(spark, monkeypatch):
    """Cells that go on over many batches, crowded ones dealt to several tasks, vertices without coordinates, names as order."""
    rng = random.Random(9)
    rings = [star(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([0.2, 0.5, 3.0]), rng.choice([5, 30]), rng) for _ in range(300)]
    rings[0] = [*rings[0], {"lon": None, "lat": 1.0}]
    z = spark.createDataFrame([(k, f"{7919 * k % 1000:03}", r) for k, r in enumerate(rings)], "zone long, ord string, ring array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(2000)], "id int, lon double, lat double")
    want = {r.id: r.zone for r in spatial.locate(p, z).collect()}
    monkeypatch.setattr(cover, "PLACES_IN_SHARE", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        assert {r.id: r.zone for r in cover.locate(p, z).collect()} == want and len(set(want.values())) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cells = cover.cover(z)
    seen = cover.visible(cells, sorted(r.level for r in cells.select("level").distinct().collect()))
    assert seen.count() < cells.count() * 3 // 4


def test_a_place_meets_zones_up_to_the_first_that_holds_it(monkeypatch):
    """Not all pairs of a cell: 2,000 places, 5,000 zones that all hold them, in batches that part the cell; one place is in the last zone only."""
    held = []

    class Counted(cover._Entries):
        def hold(self, lon, lat, at):
            held.append(len(at))
            return super().hold(lon, lat, at)

    monkeypatch.setattr(cover, "_Entries", Counted)
    square = lambda a, b: [{"x1": x1, "y1": y1, "x2": x2, "y2": y2} for x1, y1, x2, y2 in ((a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a))]
    key = {"level": 3, "x": 32, "y": 32, "share": 0}
    places = [key | {"__lon": k / 2000, "__lat": 0.5, "ord": None, "zone": None, "inside": None, "edges": None} for k in range(2000)] + [key | {"__lon": 3.0, "__lat": 3.0, "ord": None, "zone": None, "inside": None, "edges": None}]
    zones = [key | {"__lon": None, "__lat": None, "ord": k, "zone": f"z{k}", "inside": False, "edges": square(-1.0, 2.0 if k < 4999 else 4.0)} for k in range(5000)]
    edge = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
    schema = pa.schema([("level", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("share", pa.int64()), ("__lon", pa.float64()), ("__lat", pa.float64()), ("ord", pa.int32()), ("zone", pa.string()), ("inside", pa.bool_()), ("edges", pa.list_(edge))])
    batches = pa.Table.from_pylist(places + zones, schema).to_batches(max_chunksize=900)
    got = [r for b in cover._first_zones(iter(batches)) for r in b.to_pylist()]
    assert len(got) == 2001 and {r["zone"] for r in got if r["__lon"] < 1} == {"z0"} and [r["zone"] for r in got if r["__lon"] == 3] == ["z4999"]
    assert sum(held) <= 2000 * cover.ZONES_AT_FIRST + 5000 + 2001


def test_lengths_by_zones_of_a_cover_equal_their_sql(spark, sf, monkeypatch):
    """The query on tables as small as these broadcasts its zones; here it takes the way of many."""
    monkeypatch.setattr(spatial, "MOST_VERTICES", 0)
    with duckdb.connect() as c:
        for t in ("part", "events"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = {zone: m for zone, m in c.sql(SQL["many_zone_lengths"]).fetchall()}
    got = {r.zone: r.length_m for r in QUERIES["many_zone_lengths"](spark, sf).collect()}
    assert got == want and sum(m > 0 for m in want.values()) > 5
