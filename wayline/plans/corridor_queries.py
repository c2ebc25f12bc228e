"""Queries for the corridor's own rules and documents, over placemarks and samples made of the driver's tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import geo, numbers, text
from wayline.operators import linear, raster, spatial, stats
from wayline.plans import corridor
from wayline.plans.queries import _RING_SQL, _ZONE_SQL, QUERIES, SQL, _events, _located_sql, _lon_sql, _meters_sql, _place, _t, query, zones
from wayline.session import scratch
from wayline.sources import readers, writers

__all__ = ["QUERIES", "SQL"]

NAMES = (
    "Osvetljenje", "Klupa drvena", "Kanta", "Kontejner  mali", "Letnjikovac", "Ljetnikovac", "Sportski teren", "Decji mobilijar", "Asfalt", "Poplocana staza",
    "Popločana staza", "Zemljana staza", "Visoka vegetacija", "Niska vegetacija", "Izvire voda", "Voda", "Česma", "Lose stanje", "Loše stanje", "Srednje stanje",
    "Dobro stanje", "Deponija", "Dalekovod", "Njiva privatna", "Most preko reke", "Bedem, nedostatak rampe", "Kutinska reka", "Nedostatak rampe", "Nedostatak stepenica",
    "Objekat", "Zemljan put", "Rampa", "Stepenice i rampa", "Nesto drugo",
)
FOLDERS = ("Indicaciones", "Zelena", "Prekidi", "Stepenice i rampe", "Urbana oprema", "Stanja", "URBANI dzepovi", "Razno")


def _values(items: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(items)) + ") AS v(k, v)"


def _pick(items: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in items]), (k % len(items) + 1).cast("int"))


_RULES_SQL = {
    "urban": "CASE WHEN n LIKE '%osvetl%' THEN 'osvetljenje' WHEN regexp_matches(n, '\\bklup') THEN 'klupe' WHEN regexp_matches(n, 'kant|konten?jer') THEN 'kante' WHEN regexp_matches(n, 'l[ej]tn?[ij]+kovac') THEN 'letnjikovci' WHEN regexp_matches(n, 'sport|vezban|odbojk|kosh?ar|fudbal|teren') THEN 'sport' WHEN regexp_matches(n, 'decji|deciji|mobilijar') THEN 'decji_mobilijar' ELSE 'ostalo' END",
    "surface": "CASE WHEN n LIKE '%asfalt%' THEN 'asfalt' WHEN regexp_matches(n, 'poplo[cč]an|kaldrm') THEN 'popločana' WHEN regexp_matches(n, 'zemlj?[ae]n') THEN 'zemljana' ELSE 'ostalo' END",
    "green": "CASE WHEN regexp_matches(n, 'vi?oska? veget|visoka veget') THEN 'visoka_vegetacija' WHEN n LIKE '%niska veget%' THEN 'niska_vegetacija' WHEN n LIKE '%izvire%' OR n = 'voda' OR n LIKE '%izvor%' THEN 'izvor_vode' WHEN n LIKE '%cesma%' OR n LIKE '%česma%' THEN 'cesma' ELSE 'ostalo' END",
    "state": "CASE WHEN regexp_matches(n, 'lo[sš]e? stanj|lose stanje|loshe stanje') THEN 'loše' WHEN n LIKE '%srednje stanj%' THEN 'srednje' WHEN n LIKE '%dobro stanj%' THEN 'dobro' WHEN n LIKE '%deponij%' THEN 'deponija' ELSE 'ostalo' END",
    "obstacle": "CASE WHEN n LIKE '%dalekovod%' THEN 'dalekovod' WHEN n LIKE '%njiv%' OR n LIKE '%privatn%' THEN 'privatno_zemljiste' WHEN n LIKE '%most%' THEN 'most_prelaz' WHEN n LIKE '%bedem%' THEN 'bedem' WHEN regexp_matches(n, 'kutinsk|reka|potok|pritok') THEN 'pritoka' WHEN n LIKE '%nedostatak%' AND n LIKE '%ramp%' THEN 'nedostatak_rampe' WHEN n LIKE '%nedostatak%' AND (n LIKE '%stepenist%' OR n LIKE '%stepenic%') THEN 'nedostatak_stepenista' WHEN regexp_matches(n, 'objekat|objekt|ograd') THEN 'objekat' WHEN n LIKE '%zemljen%' OR n LIKE '%zemljan%' THEN 'promena_puta' ELSE 'ostalo' END",
    "stairs": "CASE WHEN n LIKE '%stepenic%' THEN 'stepenice' WHEN n LIKE '%rampa%' OR n LIKE '%rampe%' THEN 'rampe' ELSE 'stepenice' END",
}
_LAYER_SQL = "CASE WHEN f LIKE '%Indicaciones%' THEN 'trasa' WHEN f LIKE '%Zelena%' THEN 'zelena' WHEN f LIKE '%Prekid%' THEN 'prekidi' WHEN f LIKE '%Stepenice i rampe%' THEN 'stepenice_rampe' WHEN f LIKE '%Urbana oprema%' THEN 'urbana' WHEN f LIKE '%Stanja%' THEN 'stanja' WHEN f LIKE '%Javni socijalni%' OR lower(f) LIKE '%urbani dzepovi%' THEN 'socijalni' END"
_BUCKET_SQL = "CASE WHEN urban IN ('osvetljenje', 'klupe', 'kante', 'letnjikovci', 'sport') THEN urban ELSE 'urbana_ostalo' END"
_NAMED_SQL = f"named AS (SELECT p_partkey, lower(regexp_replace(trim(v), '\\s+', ' ', 'g')) AS n FROM part JOIN {_values(NAMES)} ON p_partkey % {len(NAMES)} = v.k)"


@query(f"""WITH {_NAMED_SQL}, r AS (SELECT p_partkey, n, {', '.join(f'{s} AS {k}' for k, s in _RULES_SQL.items())} FROM named)
SELECT p_partkey, n AS norm, urban, surface, green, state, obstacle, stairs, {_BUCKET_SQL} AS bucket FROM r""")
def classify_domain(spark: SparkSession, d: str) -> DataFrame:
    """C14 to C19 and C21."""
    n = F.col("norm")
    named = _t(spark, d, "part").select("p_partkey", text.normalize(F.concat(F.lit(" "), _pick(NAMES, F.col("p_partkey")), F.lit("\t "))).alias("norm"))
    rules = {"urban": text.URBAN_RULES, "surface": text.SURFACE_RULES, "green": text.GREEN_RULES, "state": text.STATE_RULES, "obstacle": text.OBSTACLE_RULES}
    found = named.withColumns({k: text.classify(n, r) for k, r in rules.items()} | {"stairs": text.stairs_or_ramp(n)})
    return found.withColumn("bucket", text.bucket(F.col("urban")))


@query(f"""WITH p AS (SELECT p_partkey, v || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_partkey ELSE '' END AS f FROM part JOIN {_values((*FOLDERS, 'Javni socijalni prostori', 'zelena'))} ON p_partkey % 10 = v.k)
SELECT coalesce({_LAYER_SQL}, 'none') AS layer, count(*) AS n FROM p GROUP BY ALL""")
def route_layers(spark, d):
    """C20."""
    k = F.col("p_partkey")
    folder = F.concat(_pick((*FOLDERS, "Javni socijalni prostori", "zelena"), k), F.when(k % 2 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(""))
    return _t(spark, d, "part").groupBy(F.coalesce(text.layer_of(folder), F.lit("none")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


def placemarks(spark: SparkSession, d: str) -> DataFrame:
    """A placemark for each customer: folder, pid, name, norm, gtype, coords."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer").select("c_custkey").withColumns(_place("c_custkey"))
    at = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    kind = F.floor(k / 3) % 5
    gtype = F.when(kind.isin(1, 2), "Point").when(kind == 3, "LineString").when(kind == 4, "Polygon")
    coords = F.when(gtype == "Point", F.array(at(0.0, 0.0))).when(gtype.isNotNull(), F.array(at(0.0, 0.0), at(0.004, 0.002), at(0.008, -0.001))).otherwise(F.array().cast(readers.COORDS))
    name = _pick(NAMES, F.floor(k / 8))
    return c.select(_pick(FOLDERS, k).alias("folder"), k.alias("pid"), name.alias("name"), text.normalize(name).alias("norm"), gtype.alias("gtype"), coords.alias("coords"))


_MARKS_SQL = f"""{_ZONE_SQL}, mark AS (SELECT c_custkey AS id, f.v AS f, lower(regexp_replace(trim(nm.v), '\\s+', ' ', 'g')) AS n, {_lon_sql('c_custkey')},
  CASE (c_custkey // 3) % 5 WHEN 1 THEN 'Point' WHEN 2 THEN 'Point' WHEN 3 THEN 'LineString' WHEN 4 THEN 'Polygon' END AS g
  FROM customer JOIN {_values(FOLDERS)[:-8].removesuffix(' AS')} AS f(k, v) ON c_custkey % {len(FOLDERS)} = f.k JOIN {_values(NAMES)[:-8].removesuffix(' AS')} AS nm(k, v) ON (c_custkey // 8) % {len(NAMES)} = nm.k),
repr AS (SELECT id, CASE WHEN g = 'LineString' THEN lon + 0.004::DOUBLE ELSE lon END AS lon, CASE WHEN g = 'LineString' THEN lat + 0.002::DOUBLE ELSE lat END AS lat FROM mark WHERE g IN ('Point', 'LineString')),
zoned AS ({_located_sql('repr')}),
ruled AS (SELECT mark.*, zone, {_LAYER_SQL} AS source, {', '.join(f'{s} AS {k}' for k, s in _RULES_SQL.items())} FROM mark LEFT JOIN zoned USING (id)),
layered AS (SELECT *, CASE WHEN g IS NULL OR source = 'trasa' AND g <> 'LineString' THEN NULL WHEN source = 'stepenice_rampe' THEN CASE WHEN g = 'LineString' THEN 'staze' ELSE stairs END WHEN source = 'urbana' THEN {_BUCKET_SQL} ELSE source END AS layer FROM ruled),
segs AS (SELECT id, 0 AS s, lon, lat, lon + 0.004::DOUBLE AS lon2, lat + 0.002::DOUBLE AS lat2 FROM mark WHERE g = 'LineString' UNION ALL SELECT id, 1, lon + 0.004::DOUBLE, lat + 0.002::DOUBLE, lon + 0.008::DOUBLE, lat - 0.001::DOUBLE FROM mark WHERE g = 'LineString'),
a AS (SELECT id, s, lon, lat FROM segs), b AS (SELECT id, s, lon2 AS lon, lat2 AS lat FROM segs),
measured AS (SELECT a.id, a.s, a.id * 2 + a.s AS sid, {_meters_sql('a', 'b')} AS m, (a.lon + b.lon) / 2 AS mlon, (a.lat + b.lat) / 2 AS mlat FROM a JOIN b ON a.id = b.id AND a.s = b.s),
mid AS (SELECT sid, mlon AS lon, mlat AS lat FROM measured), seg_zone AS ({_located_sql('mid', 'sid')}),
whole AS (SELECT id, sum(m) AS m FROM measured GROUP BY id)"""


@query(f"""WITH {_MARKS_SQL} SELECT id AS pid, coalesce(zone, '-') AS zone, coalesce(layer, '-') AS layer,
  coalesce(CASE WHEN layer IS NULL THEN NULL WHEN source = 'zelena' THEN green WHEN source = 'prekidi' THEN obstacle WHEN source = 'stepenice_rampe' AND g = 'LineString' THEN surface WHEN source = 'urbana' THEN urban WHEN source = 'stanja' THEN state END, '-') AS category, round(m, 1) AS length_m
FROM layered LEFT JOIN whole USING (id)""")
def classify_placemarks(spark, d):
    """Every placemark with its zone, layer, category and length."""
    f = corridor.classified(placemarks(spark, d), zones(spark))
    known = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return f.select("pid", known("zone"), known("layer"), known("category"), F.round("length_m", 1).alias("length_m"))


_LAYERS_SQL = "(VALUES " + ", ".join(f"('{x}')" for x in corridor.LAYERS) + ") AS layers(layer)"


@query(f"""WITH {_MARKS_SQL}, shown AS (SELECT * FROM layered WHERE layer IS NOT NULL), route AS (SELECT m FROM shown JOIN whole USING (id) WHERE layer = 'trasa' ORDER BY id DESC LIMIT 1),
line AS (SELECT sh.layer, sh.surface, sz.zone, x.m FROM measured x JOIN shown sh USING (id) LEFT JOIN seg_zone sz USING (sid)),
per_layer AS (SELECT layers.layer, count(shown.id) AS n FROM {_LAYERS_SQL} LEFT JOIN shown ON shown.layer = layers.layer GROUP BY ALL),
r(part, a, b, n, amount) AS (
  SELECT 'total', '', '', count(*), 0.0::DOUBLE FROM mark UNION ALL SELECT 'sources', f, '', count(*), 0 FROM mark GROUP BY f
  UNION ALL SELECT 'layers', layer, '', n, 0 FROM per_layer
  UNION ALL SELECT 'zone_counts', zone, layer, count(*), 0 FROM shown WHERE zone IS NOT NULL AND layer NOT IN ('trasa', 'staze') GROUP BY ALL
  UNION ALL SELECT 'obstacles', obstacle, '', count(*), 0 FROM shown WHERE layer = 'prekidi' GROUP BY ALL
  UNION ALL SELECT 'paths', surface, '', 0, sum(m) FROM shown JOIN whole USING (id) WHERE layer = 'staze' GROUP BY ALL
  UNION ALL SELECT 'zone_paths', z.zone, s.surface, 0, coalesce(sum(line.m), 0) FROM (SELECT DISTINCT zone FROM ring) z CROSS JOIN (SELECT DISTINCT surface FROM line WHERE layer = 'staze') s LEFT JOIN line ON line.zone = z.zone AND line.surface = s.surface AND line.layer = 'staze' GROUP BY ALL
  UNION ALL SELECT 'zone_route', z.zone, '', 0, coalesce(sum(line.m), 0) FROM (SELECT DISTINCT zone FROM ring) z LEFT JOIN line ON line.zone = z.zone AND line.layer = 'trasa' GROUP BY ALL
  UNION ALL SELECT 'vegetation', green, '', 0, sum(m) FROM shown JOIN whole USING (id) WHERE layer = 'zelena' AND green IN ('visoka_vegetacija', 'niska_vegetacija') GROUP BY ALL
  UNION ALL SELECT 'density', layer, '', n, round(n / (SELECT m / 1000 FROM route), 2) FROM per_layer
  UNION ALL SELECT 'shapes', f, g, count(*), 0 FROM mark WHERE g IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'line_names', f, n, count(*), sum(m) FROM mark JOIN whole USING (id) GROUP BY ALL)
SELECT part, a, b, n::BIGINT AS n, round(amount, 1) AS amount FROM r""")
def corridor_summary(spark, d):
    """Every table of the summary, one under another."""
    s = corridor.summary(placemarks(spark, d), zones(spark))
    rows = lambda part, a, b="", n=None, amount=None: s[part].select(F.lit(part).alias("part"), F.col(a).alias("a") if a else F.lit("").alias("a"), F.col(b).alias("b") if b else F.lit("").alias("b"), (F.col(n) if n else F.lit(0)).cast("long").alias("n"), F.round((F.col(amount) if amount else F.lit(0)).cast("double"), 1).alias("amount"))
    shapes = s["shapes"].unpivot("folder", ["Point", "LineString", "Polygon"], "g", "n").filter("n > 0")
    s["shapes"] = shapes
    parts = [
        rows("total", "", n="n"), rows("sources", "folder", n="n"), rows("layers", "layer", n="n"), rows("zone_counts", "zone", "layer", "n"), rows("obstacles", "category", n="n"),
        rows("paths", "category", amount="amount"), rows("zone_paths", "zone", "category", amount="length_m"), rows("zone_route", "zone", amount="length_m"), rows("vegetation", "category", amount="length_m"),
        rows("density", "layer", n="n", amount="per_km"), rows("shapes", "folder", "g", "n"), rows("line_names", "folder", "norm", "n", "length_m"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_HTML = "'<p><IMG alt=\"x\" SRC=''https://h/' || page_id || '?fife=s16&k=1''> <img src=\"b' || page_id % 7 || '?fife=w9\"><img src=''https://h/' || page_id || '?fife=s16&k=1''></p>'"


@query(f"""WITH h AS (SELECT page_id, {_HTML} AS html FROM pages), u AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1)) AS url, generate_subscripts(regexp_extract_all(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), 1) AS k FROM h),
f AS (SELECT page_id, url, min(k) AS k FROM u GROUP BY ALL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS pos, url, regexp_replace(url, '\\bfife=s\\d+\\b', 'fife=s1024', 'g') AS resized, sha1(url)[1:16] AS id FROM f""")
def image_links(spark, d):
    """C22 to C24, A13, I3."""
    k = F.col("page_id").cast("string")
    big = F.concat(F.lit("https://h/"), k, F.lit("?fife=s16&k=1"))
    html = F.concat(F.lit("<p><IMG alt=\"x\" SRC='"), big, F.lit("'> <img src=\"b"), (F.col("page_id") % 7).cast("string"), F.lit("?fife=w9\"><img src='"), big, F.lit("'></p>"))
    p = _t(spark, d, "pages").select("page_id", F.posexplode(text.image_urls(html)).alias("pos", "url"))
    return p.select("page_id", "pos", "url", text.resized(F.col("url")).alias("resized"), text.content_id(F.col("url")).alias("id"))


@query(f"""WITH c AS (SELECT c_custkey, {_lon_sql('c_custkey')} FROM customer), y AS (SELECT *, asinh(tan(radians(lat))) / pi() AS my FROM c), s AS (SELECT *, asinh(tan(radians(43.1::DOUBLE))) / pi() AS b, asinh(tan(radians(43.4::DOUBLE))) / pi() AS t FROM y)
SELECT c_custkey, floor((lon + 180) / 360 * 4194304)::BIGINT AS gx, floor((1 - my) / 2 * 4194304)::BIGINT AS gy, round_even((lon - 21.85::DOUBLE) / (22.0::DOUBLE - 21.85::DOUBLE) * 1499, 0)::INT AS px, round_even((t - my) / (t - b) * 999, 0)::INT AS py FROM s
WHERE round_even((lon - 21.85::DOUBLE) / (22.0::DOUBLE - 21.85::DOUBLE) * 1499, 0) BETWEEN 0 AND 1499 AND round_even((t - my) / (t - b) * 999, 0) BETWEEN 0 AND 999""")
def pixel_keys(spark, d):
    """Pixels in the whole grid at zoom 14 and in a mosaic, of the points inside it."""
    c = _t(spark, d, "customer").select("c_custkey").withColumns(_place("c_custkey"))
    gx, gy = geo.global_pixel(F.col("lon"), F.col("lat"), 14)
    px, py = geo.pixel(F.col("lon"), F.col("lat"), (21.85, 43.1, 22.0, 43.4), 1500, 1000)
    return c.select("c_custkey", gx.alias("gx"), gy.alias("gy"), px.alias("px"), py.alias("py")).filter(F.col("px").between(0, 1499) & F.col("py").between(0, 999))


_PALETTE_SQL = "(VALUES " + ", ".join(f"({k}, {c}, '{n}')" for k, (_, _, _, c, n) in enumerate(raster.PALETTE)) + ") AS pal(k, code, klass)"


@query(f"""WITH px AS (SELECT x, y, pal.code, pal.klass FROM (SELECT o_orderkey % 211 AS x, (o_orderkey // 211) % 97 AS y, min(o_orderkey * 7 % 13) AS k FROM orders GROUP BY ALL) JOIN {_PALETTE_SQL} USING (k)),
smp AS (SELECT c_custkey AS idx, c_custkey % 211 AS x, (c_custkey * 3) % 97 AS y FROM customer), o AS (SELECT dx, dy, (dy + 1) * 3 + dx + 1 AS ord FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
v AS (SELECT idx, ord, code, klass FROM smp CROSS JOIN o JOIN px ON px.x = smp.x + dx AND px.y = smp.y + dy), c AS (SELECT idx, code, klass, count(*) AS n, min(ord) AS first FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY klass = 'water', n DESC, first) AS k FROM c)
SELECT smp.idx, coalesce(code, 0)::INT AS code, coalesce(klass, '-') AS klass FROM smp LEFT JOIN r ON smp.idx = r.idx AND k = 1""")
def neighbourhood_classes(spark, d):
    """C27, E4, F14, D12."""
    o = _t(spark, d, "orders").select((F.col("o_orderkey") % 211).alias("px"), (F.floor(F.col("o_orderkey") / 211) % 97).alias("py"), (F.col("o_orderkey") * 7 % 13).alias("k"))
    colours = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", p[:3], strict=True)]) for p in (*raster.PALETTE, (1, 2, 3), (4, 5, 6))])
    pixels = o.groupBy("px", "py").agg(F.min("k").alias("k")).withColumn("c", F.element_at(colours, (F.col("k") + 1).cast("int"))).select("px", "py", "c.r", "c.g", "c.b")
    samples = _t(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") % 211).alias("px"), (F.col("c_custkey") * 3 % 97).alias("py"))
    found = raster.sample_classes(samples, pixels, raster.palette(spark))
    return found.select("idx", F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("klass", F.lit("-")).alias("klass"))


_CLASS_SQL = "CASE event_type WHEN 'click' THEN 'tree_cover' WHEN 'view' THEN 'grassland' WHEN 'error' THEN NULL ELSE 'built_up' END"


@query(f"""WITH s AS (SELECT 'r' || user_id % 5 AS route, event_id AS idx, {_CLASS_SQL} AS klass, CASE WHEN user_id % 4 > 0 THEN 'z' || user_id % 4 END AS zone FROM events), k AS (SELECT * FROM s WHERE klass IS NOT NULL),
m AS (SELECT 'shade' AS metric, ['tree_cover'] AS c UNION ALL SELECT 'green', ['tree_cover', 'shrubland', 'grassland', 'cropland', 'wetland']),
q AS (SELECT metric, route, '-' AS zone, idx, list_contains(c, klass) AS v FROM k CROSS JOIN m UNION ALL SELECT metric, route, zone, idx, list_contains(c, klass) FROM k CROSS JOIN m WHERE zone IS NOT NULL),
n AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY metric, route, zone ORDER BY idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY metric, route, zone ORDER BY idx) AS run FROM n),
g AS (SELECT metric, route, zone, run, v, count(*) AS n FROM r GROUP BY ALL)
SELECT route, zone, metric, round(sum(CASE WHEN v THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n), 1) AS pct, coalesce(max(n * 30) FILTER (v), 0) AS longest_m, coalesce(max(n * 30) FILTER (NOT v), 0) AS longest_gap_m, count(*) - 1 AS transitions FROM g GROUP BY ALL""")
def cover_runs(spark, d):
    """F16, E10, D7."""
    klass = F.when(F.col("event_type") == "click", "tree_cover").when(F.col("event_type") == "view", "grassland").when(F.col("event_type") != "error", "built_up")
    zone = F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("z"), (F.col("user_id") % 4).cast("string")))
    s = _t(spark, d, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("route"), F.col("event_id").alias("idx"), klass.alias("klass"), zone.alias("zone"))
    found = stats.cover_runs(s, {"shade": raster.SHADE_CLASSES, "green": raster.GREEN_CLASSES}, 30)
    return found.select("route", F.coalesce("zone", F.lit("-")).alias("zone"), "metric", "pct", "longest_m", "longest_gap_m", "transitions")


@query("SELECT event_id, event_id % 256 * 256 + event_id // 256 % 256 + (event_id % 7) / 256.0::DOUBLE - 32768 AS height FROM events")
def terrarium(spark, d):
    """A16."""
    k = F.col("event_id")
    return _t(spark, d, "events").select("event_id", geo.decode_height(k % 256, F.floor(k / 256) % 256, k % 7).alias("height"))


@query("""SELECT c_custkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || c_custkey % 90 || '.5,' || c_custkey % 60 || '.25]},"properties":{' || CASE WHEN c_custkey % 3 > 0 THEN '"name":"' || c_name || '",' ELSE '' END || '"n":' || c_custkey % 7 || CASE WHEN c_custkey % 2 = 0 THEN ',"images":["i' || c_custkey || '"]' ELSE '' END || '}}' AS feature FROM customer""")
def geojson_strings(spark, d):
    """B1, B2: empty names and lists are left out."""
    k = F.col("c_custkey")
    shape = F.array(F.struct((k % 90 + 0.5).cast("double").alias("lon"), (k % 60 + 0.25).cast("double").alias("lat")))
    images = F.when(k % 2 == 0, F.array(F.concat(F.lit("i"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    properties = {"name": writers.truthy(F.when(k % 3 > 0, F.col("c_name")).otherwise("")), "n": k % 7, "images": writers.filled(images)}
    return _t(spark, d, "customer").select("c_custkey", writers.feature(F.lit("Point"), shape, properties).alias("feature"))


@query("""SELECT CASE n_nationkey % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS gtype, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 4 END::INT AS points, n_nationkey + 0.5::DOUBLE AS lon, n_name AS name FROM nation""")
def geojson_scan(spark, d):
    """Feature collections written and read back."""
    k = F.col("n_nationkey")
    gtype = F.when(k % 3 == 0, "Point").when(k % 3 == 1, "LineString").otherwise("Polygon")
    at = lambda x: F.struct((k + x).cast("double").alias("lon"), F.lit(1.25).alias("lat"))
    coords = F.when(gtype == "Point", F.array(at(0.5))).otherwise(F.array(at(0.5), at(0.75), at(1.0), at(0.5)))
    f = _t(spark, d, "nation").select(F.lit("x").alias("layer"), k.alias("pid"), writers.feature(gtype, coords, {"name": F.col("n_name")}).alias("feature"))
    path = scratch(spark, "collection")
    writers.collection(f).select("value").coalesce(1).write.text(path)
    back = readers.read_geojson(spark, path, "name: STRING")
    return back.select("gtype", F.size("coords").alias("points"), F.get("coords", F.lit(0))["lon"].alias("lon"), "name")


@query("""SELECT n_nationkey::INT AS idx, n_nationkey * 0.03::DOUBLE AS km, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey + 0.5::DOUBLE END AS elev_smooth, 'z' || n_nationkey % 3 AS zone FROM nation WHERE n_nationkey % 3 > 0""")
def profile_scan(spark, d):
    """A stored profile written and read back; samples without a zone are left out."""
    k = F.col("n_nationkey")
    sample = F.struct((k * F.lit(0.03)).alias("km"), F.lit(43.2).alias("lat"), F.lit(21.8).alias("lon"), F.when(k % 4 > 0, k + 0.5).cast("double").alias("elev_smooth"), F.when(k % 3 > 0, F.concat(F.lit("z"), (k % 3).cast("string"))).alias("deonica"))
    path = scratch(spark, "profile")
    _t(spark, d, "nation").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), sample.alias("s")))), lambda x: x["s"]).alias("profile"))).alias("value")).coalesce(1).write.text(path)
    return readers.read_profile(spark, path).select("idx", "km", "elev_smooth", "zone")


@query("""SELECT row_number() OVER (ORDER BY n_nationkey)::INT AS row, 'c ' || n_nationkey AS c0, CASE WHEN n_nationkey % 2 = 0 THEN 'two' || chr(10) || 'lines, "' || n_name || '"' ELSE n_name END AS c1, CASE WHEN n_nationkey % 3 > 0 THEN 'x' ELSE '' END AS c2 FROM nation WHERE n_nationkey % 5 > 0""")
def survey_scan(spark, d):
    """A survey with short rows, blank rows and quoted line feeds, written as CSV and read back in order."""
    k = F.col("n_nationkey")
    cell = F.when(k % 2 == 0, F.concat(F.lit('"two\nlines, ""'), F.col("n_name"), F.lit('"""'))).otherwise(F.col("n_name"))
    row = F.concat(F.lit("c "), k.cast("string"), F.lit(","), cell, F.when(k % 3 > 0, ",x").otherwise(""))
    row = F.when(k % 5 == 0, ",  ,").otherwise(row)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r")))), lambda x: x["r"]), "\n")
    path = scratch(spark, "survey")
    _t(spark, d, "nation").agg(F.concat(F.lit("a,b,c\n"), lines).alias("value")).coalesce(1).write.text(path)
    back = readers.read_survey(spark, path, 3)
    return back.select(F.row_number().over(Window.orderBy("row_idx")).alias("row"), "c0", "c1", F.coalesce("c2", F.lit("")).alias("c2"))  # 25 rows at most


@query(f"SELECT 'n' || n_nationkey AS zone, 4 + n_nationkey % 3 AS vertices, round((3 * lon + lon + 0.01 + n_nationkey % 3 * (lon + 0.02)) / (4 + n_nationkey % 3), 6) AS mean_lon, (SELECT count(*) FROM region) AS others FROM (SELECT n_nationkey, {_lon_sql('n_nationkey')} FROM nation)")
def zone_scan(spark, d):
    """A3: zones are the polygons of the folder of their prefix, whatever its case; the rest are placemarks. A zone for each nation, made of its id."""
    x, y, k = F.col("lon"), F.col("lat"), F.col("n_nationkey") % 3
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    ring = F.concat(F.array(corner(0.0, 0.0), corner(0.01, 0.0)), F.array_repeat(corner(0.02, 0.01), k.cast("int")), F.array(corner(0.0, 0.01), corner(0.0, 0.0)))
    rings = _t(spark, d, "nation").withColumns(_place("n_nationkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("zone"), F.array_join(F.transform(ring, lambda p: F.format_string("%.6f,%.6f,0", p["lon"], p["lat"])), " ").alias("c"))
    others = _t(spark, d, "region").agg(F.array_join(F.collect_list(F.concat(F.lit("<Placemark><name>"), "r_name", F.lit("</name><Point><coordinates>1,2</coordinates></Point></Placemark>"))), "").alias("o"))
    mark = F.concat(F.lit("<Placemark><name> "), F.col("zone"), F.lit(" </name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.col("c"), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    stray = "<Placemark><name>p</name><Point><coordinates>1,2</coordinates></Point></Placemark>"
    zone_marks = rings.agg(F.array_join(F.array_sort(F.collect_list(mark)), "").alias("z"))  # 25 nations
    document = F.concat(F.lit(f"<kml><Folder><name> META_deonice v2</name>{stray}"), "z", F.lit("</Folder><Folder><name>x</name>"), "o", F.lit("</Folder></kml>"))
    path = scratch(spark, "zones")
    zone_marks.crossJoin(others).select(document.alias("value")).coalesce(1).write.text(path)
    found, rest = readers.split_zones(readers.read_placemarks(spark, path))
    n = rest.agg(F.count(F.lit(1)).alias("others"))
    return found.select("zone", F.size("ring").alias("vertices"), F.round(geo.mean_lon(F.col("ring")), 6).alias("mean_lon")).crossJoin(n)


@query("""SELECT '{"nations":[' || (SELECT string_agg('{"k":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) FROM nation) || '],"regions":[' || (SELECT string_agg('{"n_regionkey":' || n_regionkey || ',"n":' || n || '}', ',' ORDER BY n_regionkey) FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL)) || ']}' AS value""")
def stats_document(spark, d):
    """B3."""
    n = _t(spark, d, "nation")
    return writers.document(nations=n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), regions=stats.counts(n, "n_regionkey"))


@query("SELECT n_regionkey, count(*) AS n, 2::BIGINT AS computed FROM nation GROUP BY n_regionkey")
def stored_table(spark, d):
    """Computed for a new stamp, read again under the same, computed anew under another."""
    path, calls = scratch(spark, "stored"), []

    def compute() -> DataFrame:
        calls.append(1)
        return stats.counts(_t(spark, d, "nation"), "n_regionkey")

    for step in ("30", "30", "50"):
        found = writers.computed(spark, path, {"step": step}, compute)
    return found.withColumn("computed", F.lit(len(calls)).cast("long"))


@query("""SELECT c_custkey AS idx, (c_custkey // 2)::BIGINT AS raw, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 500 + 0.5::DOUBLE END AS elev FROM customer""")
def elevation_zip(spark, d):
    """Samples, raw and fetched heights meet by position; where nothing was got it is null."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    samples = c.select(k.alias("idx"), F.floor(k / 2).alias("raw"))
    return readers.with_elevation(samples, c.filter(k % 3 > 0).select(k.alias("idx"), (k % 500 + 0.5).cast("double").alias("elev")))


@query("""WITH s AS (SELECT 'z' || user_id % 6 AS zone, event_type, value FROM events), c AS (SELECT zone, event_type, count(*) AS n, sum(value) AS m FROM s GROUP BY ALL), p AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY zone) AS pct FROM c),
z AS (SELECT zone, sum(m) AS m, coalesce(max(pct) FILTER (event_type = 'view'), 0) AS green, coalesce(max(pct) FILTER (event_type = 'click'), 0) AS shade FROM p GROUP BY zone), mx AS (SELECT event_type, greatest(1, max(m)) AS most FROM c GROUP BY ALL)
SELECT z.zone, round(z.m, 1) AS length_m, round(greatest(0, floor((green - shade) * 10 + 0.5) / 10), 1) AS open_green, event_type AS kind, round(most, 1) AS most FROM z CROSS JOIN mx WHERE z.m > 0 AND green > 0""")
def zone_cards(spark, d):
    """For each zone with a length and a share the open green, beside the scale that all zones share."""
    s = _t(spark, d, "events").select(F.concat(F.lit("z"), (F.col("user_id") % 6).cast("string")).alias("zone"), F.col("event_type").alias("kind"), "value")
    c = s.groupBy("zone", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("m"))
    pct = c.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("zone")))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("pct"))), F.lit(0.0))
    sums = corridor.strip_sums(s.withColumnRenamed("value", "length_m"))
    cards = pct.groupBy("zone").agg(of("view").alias("green"), of("click").alias("shade")).join(sums, "zone").filter("length_m > 0 and green > 0")
    most = corridor.shared_scales(c, "kind", "m")  # a few kinds
    return cards.crossJoin(F.broadcast(most)).select("zone", F.round("length_m", 1).alias("length_m"), F.round(numbers.open_green(F.col("green"), F.col("shade")), 1).alias("open_green"), "kind", F.round("most", 1).alias("most"))


_LABELS = ("Да", "сигурно ДА", "Неколико пута недељно", "викендом", "можда, не", "Нисам сигуран", "не", "Никад", "друго", "")


@query(f"""WITH l AS (SELECT p_partkey, v, lower(v) AS l FROM part JOIN {_values(_LABELS)} ON p_partkey % {len(_LABELS)} = v.k)
SELECT p_partkey, CASE WHEN contains(l, 'сигурно') OR l = 'да' OR contains(l, 'свакодневно') THEN '#2f6b46' WHEN contains(l, 'неколико пута') THEN '#4a9367' WHEN contains(l, 'повремено') OR contains(l, 'можда') OR contains(l, 'викенд') THEN '#d8a93a' WHEN contains(l, 'информи') OR contains(l, 'нисам сигуран') THEN '#9aa5a2' WHEN l = 'не' OR contains(l, 'никад') THEN '#c0392b'
  ELSE (['#2f6b46', '#4a9367', '#d8a93a', '#c08a4f', '#4f87a5', '#9aa5a2', '#c0392b'])[p_partkey % 7 + 1] END AS colour FROM l""")
def colour_by_label(spark, d):
    """C34."""
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", text.tone(_pick(_LABELS, k), text.TONE_RULES, text.TONE_PALETTE, k).alias("colour"))


@query("""SELECT p_partkey, '<strong>' || CASE WHEN p_partkey % 4 = 0 THEN '(bez imena)' ELSE p_name END || '</strong>' || '<br><span class="muted">kategorija: ' || p_brand || '</span>' || CASE WHEN p_partkey % 3 = 0 THEN '<br><span class="muted">dužina: ' || floor(p_size + 0.5)::BIGINT || ' m</span>' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '<br><span class="muted">stanje: ' || p_type || '</span>' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN '<div class="popup-images"><a href="data/i' || p_partkey || '" target="_blank" rel="noopener"><img src="data/i' || p_partkey || '" alt="" loading="lazy"></a></div>' ELSE '' END AS popup,
  'https://s/@' || printf('%.5f', p_size / 8.0) || ',' || printf('%.5f', p_size / 16.0) || ',' || p_partkey % 19 || 'z,' || p_partkey * 1000 || 't,0b,0p,1m' AS link FROM part""")
def popups_and_links(spark, d):
    """C35, C36."""
    k, size = F.col("p_partkey"), F.col("p_size")
    images = F.when(k % 2 == 0, F.array(F.concat(F.lit("i"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    html = text.popup(F.when(k % 4 == 0, "  ").otherwise(F.col("p_name")), F.when(k % 3 == 0, size.cast("double")), images, "data/", last={"stanje": F.when(k % 5 == 0, F.col("p_type"))}, kategorija=F.col("p_brand"))
    return _t(spark, d, "part").select("p_partkey", html.alias("popup"), text.deep_link("https://s", size / 8.0, size / 16.0, k % 19, F.timestamp_seconds(k)).alias("link"))


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL), q AS (SELECT unnest(['all', 'src1', 'none']) AS wanted)
SELECT wanted, source, n FROM s JOIN q ON wanted = 'all' OR source = wanted""")
def category_filter(spark, d):
    """Items by category, for all of them and for two choices."""
    counts = stats.counts(_t(spark, d, "documents").select("source"), "source")
    picked = [corridor.of_category(counts, "source", w).withColumn("wanted", F.lit(w)) for w in ("all", "src1", "none")]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).select("wanted", "source", "n")


@query(f"""WITH c AS (SELECT c_nationkey AS nation, min(lon) - 0.005::DOUBLE AS west, max(lon) + 0.005::DOUBLE AS east, min(lat) - 0.005::DOUBLE AS south, max(lat) + 0.005::DOUBLE AS north, count(*) / 4.0::DOUBLE AS km FROM (SELECT c_nationkey, {_lon_sql('c_custkey')} FROM customer) GROUP BY ALL)
SELECT nation, round(west, 6) AS west, round(east, 6) AS east, round(south, 6) AS south, round(north, 6) AS north, CASE WHEN km > 8 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS step, floor(km / CASE WHEN km > 8 THEN 2 ELSE 1 END)::INT + 1 AS ticks FROM c""")
def padded_boxes(spark, d):
    """C12 with its margin, C33 with its steps."""
    c = _t(spark, d, "customer").withColumns(_place("c_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(*[v.alias(k) for k, v in geo.bounding_box(F.col("lon"), F.col("lat"), 0.005).items()], (F.count(F.lit(1)) / 4.0).alias("km"))
    step = numbers.km_step(F.col("km"))
    return c.select("nation", *[F.round(k, 6).alias(k) for k in ("west", "east", "south", "north")], step.alias("step"), F.size(numbers.ticks(F.lit(0.0), F.col("km"), step)).alias("ticks"))


@query("""WITH p AS (SELECT 'r' || user_id % 3 AS route, event_id AS idx, event_id * 0.02::DOUBLE AS km, value AS e, CASE WHEN user_id % 4 > 0 THEN 'z' || user_id % 4 END AS zone FROM events), q AS (SELECT *, '-' AS scope FROM p UNION ALL SELECT *, zone FROM p WHERE zone IS NOT NULL),
g AS (SELECT route, scope, e, e - lag(e) OVER w AS de, km * 1000.0::DOUBLE - lag(km * 1000.0::DOUBLE) OVER w AS dx FROM q WINDOW w AS (PARTITION BY route, scope ORDER BY idx))
SELECT route, scope AS zone, round(min(e), 1) AS min_m, round(max(e), 1) AS max_m, round(max(e) - min(e), 1) AS range_m, round(coalesce(max(abs(de / dx) * 100) FILTER (dx >= 15), 0), 1) AS max_gradient_pct FROM g GROUP BY ALL HAVING count(*) >= 2""")
def elevation_summary(spark, d):
    """D8, D9, F11, F12, for the whole and by zone."""
    zone = F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("z"), (F.col("user_id") % 4).cast("string")))
    p = _events(spark, d, F.col("value").alias("elev_smooth")).select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("route"), F.col("event_id").alias("idx"), (F.col("event_id") * F.lit(0.02)).alias("km"), "elev_smooth", zone.alias("zone"))
    return stats.elevation_stats(p).withColumn("zone", F.coalesce("zone", F.lit("-")))
