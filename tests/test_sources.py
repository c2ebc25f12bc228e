import json

from pyspark.sql import functions as F

from wayline.operators import stats
from wayline.plans import corridor
from wayline.sources import readers, writers
from wayline.streaming import incremental

RING = "0,0,0 0.02,0,0 0.02,0.02,0 0,0.02,0 0,0,0"
KML = f"""<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Folder><name>META_deonice</name><Placemark><name>A</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{RING}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>
<Folder><name>Indicaciones</name><Placemark><name>route</name><LineString><coordinates>0.001,0.001 0.011,0.001 0.031,0.001</coordinates></LineString></Placemark></Folder>
<Folder><name>Stepenice i rampe</name>
 <Placemark><name>Rampa </name><Point><coordinates>0.01,0.01,5</coordinates></Point></Placemark>
 <Placemark><name>asfalt</name><LineString><coordinates>0.001,0.001 0.002,0.001</coordinates></LineString></Placemark>
 <Placemark><name>no shape</name></Placemark>
 <Folder><name>Urbana oprema</name><Placemark><name>Klupa</name><description><![CDATA[<img src="u"/> <img src="u"/>]]></description><MultiGeometry><Point><coordinates>0.5,0.5</coordinates></Point></MultiGeometry></Placemark></Folder>
</Folder>
<Folder><name>Something else</name><Placemark><name>x</name><Point><coordinates>0.01,0.01</coordinates></Point></Placemark></Folder>
</Document></kml>"""


def test_corridor_from_placemarks(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML, encoding="utf-8")
    zones, rest = readers.split_zones(readers.read_placemarks(spark, str(tmp_path / "a.kml")))
    zones = zones.withColumn("ord", F.lit(1))
    f = corridor.classified(rest, zones).cache()
    got = {r.name: (r.layer, r.category, r.zone, r.gtype) for r in f.collect()}
    assert got == {
        "route": ("trasa", None, "A", "LineString"), "Rampa ": ("rampe", None, "A", "Point"), "asfalt": ("staze", "asfalt", "A", "LineString"),
        "no shape": (None, None, None, None), "Klupa": ("klupe", "klupe", None, "Point"), "x": (None, None, "A", "Point"),
    }
    assert [r.images for r in f.filter("name = 'Klupa'").collect()] == [["u"]]
    s = corridor.summary(rest, zones)
    assert {r.folder: r.n for r in s["sources"].collect()} == {"Indicaciones": 1, "Stepenice i rampe": 3, "Urbana oprema": 1, "Something else": 1}
    assert {r.zone: round(r.length_m) for r in s["zone_route"].collect()} == {"A": 1112}
    assert {(r.zone, r.category): round(r.length_m) for r in s["zone_paths"].collect()} == {("A", "asfalt"): 111}
    assert {r.category: r.pct for r in s["paths"].collect()} == {"asfalt": 100.0}
    layers = {r.layer: r.n for r in s["layers"].collect()}
    assert set(layers) == set(corridor.LAYERS) and layers["klupe"] == 1 and layers["sport"] == 0 and s["total"].first().n == 6
    assert {r.layer: (r.n, r.per_km) for r in s["density"].collect()}["klupe"] == (1, 0.3)
    shown = f.filter("layer is not null").withColumn("feature", writers.feature(F.col("gtype"), F.col("coords"), {"name": F.col("name"), "deonica": writers.truthy(F.col("zone")), "images": writers.filled(F.col("images"))}))
    rows = {r.layer: json.loads(r.value) for r in writers.collection(shown).collect()}
    assert rows["klupe"]["features"] == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [0.5, 0.5]}, "properties": {"name": "Klupa", "images": ["u"]}}]
    writers.write_features(shown, str(tmp_path / "layers"))
    assert spark.read.text(str(tmp_path / "layers")).count() == 4
    (tmp_path / "g.json").write_text(json.dumps(rows["trasa"]))
    back = readers.read_geojson(spark, str(tmp_path / "g.json"), "name: STRING, deonica: STRING").collect()
    assert [(r.gtype, len(r.coords), r.deonica) for r in back] == [("LineString", 3, "A")]
    route = spark.createDataFrame([("r", 0, 0.001, 0.001), ("r", 1, 0.031, 0.001)], "route string, i int, lon double, lat double")
    p = corridor.profile(route, spark.createDataFrame([("r", k, 100.0 + k) for k in range(113)], "route string, idx int, elev double"), zones)
    assert p.count() == 113 and p.filter("zone is null").count() == 0
    assert {r.zone: r.max_gradient_pct for r in stats.elevation_stats(p).collect()}[None] > 3


def test_folders_at_any_depth(spark, tmp_path):
    for depth in (1, 4, 5, 11):
        inner = ""
        for k in range(depth, 0, -1):
            inner = f"<Folder><name>f{k}</name><Placemark><name>p{k}</name><Point><coordinates>{k},1</coordinates></Point></Placemark>{inner}</Folder>"
        (tmp_path / f"{depth}.kml").write_text(f"<kml><Document>{inner}</Document></kml>", encoding="utf-8")
        got = readers.read_placemarks(spark, str(tmp_path / f"{depth}.kml")).collect()
        assert sorted((r.folder, r.name, r.coords[0].lon) for r in got) == sorted((f"f{k}", f"p{k}", float(k)) for k in range(1, depth + 1))


def test_first_geometry_of_collections(spark, tmp_path):
    point = lambda x: f"<Point><coordinates>{x},1</coordinates></Point>"
    line = "<LineString><coordinates>5,5 6,6</coordinates></LineString>"
    marks = [f"<MultiGeometry>{line}{point(1)}{point(2)}</MultiGeometry>", f"<MultiGeometry>{line}<MultiGeometry>{point(3)}</MultiGeometry></MultiGeometry>", f"<MultiGeometry>{line}{line}</MultiGeometry>", "<Point><coordinates> </coordinates></Point>"]
    (tmp_path / "m.kml").write_text("<kml><Folder><name>f</name>" + "".join(f"<Placemark><name>{k}</name>{m}</Placemark>" for k, m in enumerate(marks)) + "</Folder></kml>", encoding="utf-8")
    got = readers.read_placemarks(spark, str(tmp_path / "m.kml")).orderBy("pid").collect()
    assert [(r.gtype, [tuple(c) for c in r.coords]) for r in got] == [("Point", [(1, 1)]), ("Point", [(3, 1)]), ("LineString", [(5, 5), (6, 6)]), (None, [])]


def test_tiles_and_heights(spark, tmp_path):
    (tmp_path / "14/9188").mkdir(parents=True)
    (tmp_path / "14/9188/5990.png").write_bytes(b"png")
    assert [tuple(r) for r in readers.tile_files(spark, str(tmp_path)).collect()] == [(14, 9188, 5990, bytearray(b"png"))]
    s = readers.with_elevation(spark.range(3).withColumnRenamed("id", "idx"), spark.createDataFrame([(0, 1.5), (2, None)], "idx long, elev double"))
    assert [tuple(r) for r in s.orderBy("idx").collect()] == [(0, 1.5), (1, None), (2, None)]


def test_survey_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('t,n,e,q1,q2\n1,,,"a\nb",x\n,,,,\n2,,,c\n', encoding="utf-8")
    got = readers.read_survey(spark, str(tmp_path / "s.csv"), 5).orderBy("row_idx").collect()
    assert [(r.c3, r.c4) for r in got] == [("a\nb", "x"), ("c", None)]


def test_profile_settings_and_manifest(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"profile": [{"km": 0.0, "lat": 1.0, "lon": 2.0, "elev_smooth": 3.0, "deonica": "A"}, {"km": 0.03, "lat": 1.0, "lon": 2.0, "deonica": None}]}))
    assert [(r.idx, r.zone, r.elev_smooth) for r in readers.read_profile(spark, str(tmp_path / "p.json")).collect()] == [(0, "A", 3.0)]
    (tmp_path / ".env").write_text("# c\nA=1\nB='2'\nA = 3\n")
    assert readers.settings(str(tmp_path / ".env"), {"B": "0"}) == {"A": "1", "B": "0"}
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for stamp in ("1", "1", "2"):
        assert writers.computed(spark, str(tmp_path / "m"), {"hash": stamp}, make).count() == 3
    assert len(calls) == 2
    doc = json.loads(writers.document(a=spark.createDataFrame([(1, "x")], "n int, s string"), b=spark.range(1)).first().value)
    assert doc == {"a": [{"n": 1, "s": "x"}], "b": [{"id": 0}]}
    used = spark.createDataFrame([("a",), (None,)], "name string")
    assert [r.name for r in writers.orphans(spark.createDataFrame([("a",), ("b",)], "name string"), used).collect()] == ["b"]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = spark.range(60).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), (F.col("id") % 2).alias("k"))
    for k in range(2):
        rows.filter(F.floor(F.unix_seconds("at") / 1800) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(stream, "at", "10 minutes", "5 minutes", "k").writeStream.outputMode("append").format("memory").queryName("wc").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("wc").select(F.unix_seconds("window.start").alias("s"), "k", "n").collect()
    assert sorted(map(tuple, got)) == [(s, k, 5) for s in range(0, 3000, 600) for k in (0, 1)]


def test_stream_equals_batch(spark, tmp_path):
    from wayline.plans.queries import zones

    points = spark.range(200).select("id", (21.8 + F.col("id") / 1000.0).alias("lon"), (43.2 + F.col("id") / 2000.0).alias("lat"))
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.zone_counts(stream, zones(spark)).writeStream.outputMode("complete").format("memory").queryName("zc").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.zone: r.n for r in incremental.zone_counts(points, zones(spark)).collect()}
    assert want and {r.zone: r.n for r in spark.table("zc").collect()} == want


def test_prefixed_geometries_in_collections(spark, tmp_path):
    shape = "<kml:Polygon><kml:outerBoundaryIs><kml:LinearRing><kml:coordinates>1,2 3,4 5,6</kml:coordinates></kml:LinearRing></kml:outerBoundaryIs></kml:Polygon>"
    marks = [f"<kml:MultiGeometry>{shape}</kml:MultiGeometry>", f"<kml:MultiGeometry>{shape}<kml:LineString><kml:coordinates>7,8 9,9</kml:coordinates></kml:LineString></kml:MultiGeometry>", "<kml:Point><kml:coordinates>5,5</kml:coordinates></kml:Point>"]
    text = "".join(f"<kml:Placemark><kml:name>p</kml:name>{m}</kml:Placemark>" for m in marks)
    (tmp_path / "p.kml").write_text(f'<kml:kml xmlns:kml="http://www.opengis.net/kml/2.2"><kml:Folder><kml:name>f</kml:name>{text}</kml:Folder></kml:kml>')
    got = readers.read_placemarks(spark, str(tmp_path / "p.kml")).orderBy("pid").collect()
    assert [(g.gtype, len(g.coords)) for g in got] == [("Polygon", 3), ("LineString", 2), ("Point", 1)]


def test_tiles_are_written_under_their_names(spark, tmp_path):
    from wayline.sources import writers

    tiles = spark.createDataFrame([(14, k, k % 3, bytes([k]) if k != 4 else None) for k in range(9)], "z int, x int, y int, content binary")
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        for _ in range(2):
            writers.write_tiles(tiles.repartition(3), path)
        assert sorted(map(tuple, readers.tile_files(spark, path).collect())) == [(14, k, k % 3, bytearray([k])) for k in range(9) if k != 4]
