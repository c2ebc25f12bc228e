"""Queries over the driver's tables by the operators for long lines, many zones, blocks of pixels and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import cover, linear, scan, spatial
from wayline.functions import geo, text
from wayline.plans import corridor
from wayline.plans.corridor_queries import QUERIES, SQL
from wayline.plans.queries import _tabulated, _SEGMENT_SQL, _lon_sql, _micros, _place, _t, _track, query
from wayline.session import scratch, stored
from wayline.sources import heights, readers, writers
from wayline.streaming import tabulation

__all__ = ["QUERIES", "SQL"]

#: All events as one line, in order of their ids.
_ONE_LINE_SQL = _SEGMENT_SQL.replace("PARTITION BY user_id ORDER BY ts", "ORDER BY event_id").replace("a.user_id = b.user_id AND ", "")
_ALONG_SQL = f"""WITH {_ONE_LINE_SQL}, mm AS (SELECT *, round(m * 1000)::BIGINT AS mm FROM seg), c AS (SELECT *, (sum(mm) OVER (ORDER BY k))::BIGINT AS upto FROM mm)"""


def _one_line(spark, d):
    return _t(spark, d, "events").select("event_id").withColumns(_place("event_id"))


@query(f"{_ALONG_SQL} SELECT event_id, mm / 1000::DOUBLE AS length_m, upto / 1000::DOUBLE AS to_m FROM c")
def long_line_distance(spark, d):
    return scan.cumulative(_one_line(spark, d), [], "event_id").select("event_id", "length_m", "to_m")


@query(f"""{_ALONG_SQL}, c2 AS (SELECT *, (upto - mm) / 1000::DOUBLE AS a, upto / 1000::DOUBLE AS b, mm / 1000::DOUBLE AS l FROM c WHERE mm > 0),
inner_ AS (SELECT k5 * 50000.0::DOUBLE AS at_m, lon1 + (lon2 - lon1) * ((k5 * 50000.0::DOUBLE - a) / l) AS lon, lat1 + (lat2 - lat1) * ((k5 * 50000.0::DOUBLE - a) / l) AS lat
  FROM (SELECT *, unnest(range(floor(a / 50000)::BIGINT + 1, floor(b / 50000)::BIGINT + 1)) AS k5 FROM c2)),
ends AS (SELECT arg_min(lon, k) AS lon0, arg_min(lat, k) AS lat0, arg_max(lon, k) AS lon9, arg_max(lat, k) AS lat9 FROM pt), last AS (SELECT max(b) AS total FROM c2)
SELECT round(at_m, 3) AS at_m, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (
  SELECT * FROM inner_ UNION ALL SELECT 0, lon0, lat0 FROM ends UNION ALL SELECT total, lon9, lat9 FROM ends, last WHERE floor(total / 50000) * 50000 < total - 1)""")
def long_line_resample(spark, d):
    s = scan.resample(_one_line(spark, d), [], "event_id", 50_000.0)
    return s.select(F.round("at_m", 3).alias("at_m"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM events")
def long_line_average(spark, d):
    return scan.moving_average(_t(spark, d, "events").select("event_id", "value"), [], "event_id", "value", 9, rows_in_block=2_000).select("event_id", F.round("smooth", 6).alias("smooth"))


_RARE_SQL = "CASE WHEN event_id % 997 = 5 THEN event_type END"


@query(f"""WITH g AS (SELECT event_id, {_RARE_SQL} AS z FROM events), n AS (SELECT *, last_value(z IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  first_value(z IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM g)
SELECT event_id, coalesce(z, CASE WHEN l = r THEN l WHEN r IS NULL THEN l WHEN l IS NULL THEN r END) AS filled FROM n""")
def long_line_gaps(spark, d):
    """Gaps of a thousand rows: the values on either side of one are in other pieces."""
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 997 == 5, F.col("event_type")).alias("z"))
    return scan.fill_gaps(e, [], "event_id", "z").select("event_id", "filled")


@query("""WITH s AS (SELECT event_id, value > 50 AS v, event_id // 1500 % 2 AS half FROM events), c AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NOT NULL AND v IS NOT DISTINCT FROM lag(v) OVER w AND half = lag(half) OVER w THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (ORDER BY event_id)),
r AS (SELECT *, sum(n) OVER (ORDER BY event_id) AS run FROM c)
SELECT run::BIGINT AS run, min(event_id) / 1000.0::DOUBLE AS km_start, round(min(event_id) / 1000.0::DOUBLE + count(*) * 0.03::DOUBLE, 3) AS km_end, count(*) * 30 AS length_m, v AS shade, half FROM r GROUP BY run, v, half""")
def long_line_strips(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("value") > 50).alias("shade"), F.expr("event_id div 1500 % 2").alias("half"), (F.col("event_id") / F.lit(1000.0)).alias("km"))
    return scan.strips(e, [], "event_id", "km", "shade", "half", 30)


@query("""WITH s AS (SELECT event_id, event_id // 2500 % 3 = 1 AS v FROM events), c AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS n FROM s),
r AS (SELECT *, sum(n) OVER (ORDER BY event_id) AS run FROM c), g AS (SELECT run, v, count(*) AS n FROM r GROUP BY ALL)
SELECT round(sum(CASE WHEN v THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n), 1) AS pct, coalesce(max(n * 30) FILTER (v), 0) AS longest_m, coalesce(max(n * 30) FILTER (NOT v), 0) AS longest_gap_m, count(*) - 1 AS transitions FROM g""")
def long_line_runs(spark, d):
    """Runs of thousands of rows, longer than a piece."""
    return scan.run_stats(_t(spark, d, "events").select("event_id", F.expr("event_id div 2500 % 3 = 1").alias("v")), [], "event_id", "v", 30)


@query("""WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) AS at FROM orders), e AS (SELECT epoch_us(ts) AS at, min(event_id) AS event_id FROM events GROUP BY ALL),
b AS (SELECT o.*, e.at AS eat, e.event_id FROM o ASOF LEFT JOIN e ON o.at >= e.at), f AS (SELECT o.o_orderkey, e.at AS eat, e.event_id FROM o ASOF LEFT JOIN e ON o.at <= e.at)
SELECT b.o_orderkey, b.at, CASE WHEN b.eat IS NULL THEN f.eat WHEN f.eat IS NULL OR b.at - b.eat < f.eat - b.at THEN b.eat ELSE f.eat END AS nearest_at,
  CASE WHEN b.eat IS NULL THEN f.event_id WHEN f.eat IS NULL OR b.at - b.eat < f.eat - b.at THEN b.event_id ELSE f.event_id END AS event_id FROM b JOIN f USING (o_orderkey)""")
def long_line_nearest(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", _micros("o_orderdate").alias("at"))
    e = _t(spark, d, "events").groupBy(_micros("ts").alias("at")).agg(F.min("event_id").alias("event_id"))
    return scan.nearest(o, e, [], "at", "event_id")


@query("""WITH r AS (SELECT event_id || ',' || event_type || '|' AS t, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events),
c AS (SELECT pos // 512 AS k, sha1(string_agg(t, '' ORDER BY pos)) AS t FROM r GROUP BY pos // 512), c2 AS (SELECT sha1(string_agg(t, '' ORDER BY k)) AS t FROM c)
SELECT (SELECT count(*) FROM r) AS n, (SELECT t FROM c2)[1:16] AS hash""")
def long_line_hash(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type")
    found = scan.chunked_hash(e, [], "event_id", F.concat("event_id", F.lit(","), "event_type", F.lit("|")), rows_in_chunk=512)
    return found.crossJoin(e.agg(F.count(F.lit(1)).alias("n")))  # one row each


# A star for each part, about a place made of its id: small ones of 8 vertices, each 50th one of 64 and large.
_STARS_SQL = f"""part_ AS (SELECT p_partkey AS zone, CASE WHEN p_partkey % 50 = 7 THEN 64 ELSE 8 END AS n, CASE WHEN p_partkey % 50 = 7 THEN 0.06 ELSE 0.002 + p_size % 7 / 1000.0 END::DOUBLE AS r, {_lon_sql("p_partkey")} FROM part),
v AS (SELECT zone, i, n, round(lon + r * (1 - 0.35 * (i % 2)) * cos(2 * pi() * i / n), 7) AS x, round(lat + r * (1 - 0.35 * (i % 2)) * sin(2 * pi() * i / n), 7) AS y FROM (SELECT *, unnest(range(n)) AS i FROM part_)),
edge AS (SELECT a.zone, a.zone AS ord, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.zone = b.zone AND b.i = (a.i + a.n - 1) % a.n)"""
_HITS_SQL = """(e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (CASE WHEN e.y2 = e.y1 THEN 1e-12 ELSE e.y2 - e.y1 END) + e.x1"""


def _stars(spark, d):
    large = F.col("p_partkey") % 50 == 7
    part = _t(spark, d, "part").withColumns(_place("p_partkey")).withColumns({"n": F.when(large, 64).otherwise(8), "r": F.when(large, 0.06).otherwise(F.lit(0.002) + F.col("p_size") % 7 / F.lit(1000.0))})
    reach = lambda i: F.col("r") * (1 - 0.35 * (i % 2))
    turn = lambda i: 2 * F.pi() * i / F.col("n")
    vertex = lambda i: F.struct(F.round(F.col("lon") + reach(i) * F.cos(turn(i)), 7).alias("lon"), F.round(F.col("lat") + reach(i) * F.sin(turn(i)), 7).alias("lat"))
    return part.select(F.col("p_partkey").alias("zone"), F.col("p_partkey").alias("ord"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), vertex).alias("ring"))


@query(f"""WITH {_STARS_SQL}, p AS (SELECT c_custkey AS id, {_lon_sql("c_custkey")} FROM customer), h AS (SELECT p.id, e.zone FROM p JOIN edge e ON {_HITS_SQL} GROUP BY p.id, e.zone HAVING count(*) % 2 = 1)
SELECT p.id AS c_custkey, min(h.zone) AS zone FROM p LEFT JOIN h USING (id) GROUP BY p.id""")
def many_zones(spark, d):
    """The first of a zone for each part that holds a customer."""
    c = _t(spark, d, "customer").select("c_custkey").withColumns(_place("c_custkey"))
    return cover.locate(c, _stars(spark, d)).select("c_custkey", "zone")


@query(f"""WITH {_STARS_SQL}, {_SEGMENT_SQL}, p AS (SELECT event_id AS id, (lon1 + lon2) / 2 AS lon, (lat1 + lat2) / 2 AS lat, m FROM seg),
spot AS (SELECT DISTINCT lon, lat FROM p), h AS (SELECT p.lon, p.lat, e.zone FROM spot p JOIN edge e ON {_HITS_SQL} GROUP BY p.lon, p.lat, e.zone HAVING count(*) % 2 = 1),
f AS (SELECT lon, lat, min(zone) AS zone FROM h GROUP BY lon, lat), s AS (SELECT zone, sum(m) AS m FROM p JOIN f USING (lon, lat) GROUP BY zone)
SELECT p_partkey AS zone, round(coalesce(m, 0), 1) AS length_m FROM part LEFT JOIN s ON zone = p_partkey""")
def many_zone_lengths(spark, d):
    """Length of the users' tracks in the zone of each part, by the segments' midpoints."""
    s = linear.segments(_track(spark, d), "user_id", "ts")
    return spatial.length_by_zone(s, _stars(spark, d)).select("zone", F.round("length_m", 1).alias("length_m"))


@query("""WITH k AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)
SELECT idx, c_custkey, CASE WHEN idx // 100 % 7 <> 3 AND idx // 100 % 7 <> 5 AND idx % 11 > 0 THEN round(c_acctbal, 2) END AS elev FROM k""")
def heights_by_batch(spark, d):
    """A10: heights stored as responses to batches of 100 and read back; some responses are missing, some broken, some have a null."""
    k = scan.positions(_t(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("v")), [], "c_custkey", "idx")
    k = stored(k, "samples")
    path, batch = scratch(spark, "responses"), F.expr("idx div 100 % 7")
    heights.write_responses(k.filter((batch != 3) & ((batch != 5) | (F.col("idx") % 100 < 60))).select("idx", F.when(F.col("idx") % 11 > 0, F.col("v")).alias("elev")), path)
    return heights.read_heights(path, k.select("idx", "c_custkey"), k.count())


@query(_tabulated("SELECT DISTINCT row_idx, label FROM (SELECT p_partkey AS row_idx, trim(unnest(string_split(p_name, ' '))) AS label FROM part) WHERE label <> ''"))
def streamed_survey(spark, d):
    """F17, F18, G11 on a stream of three files; the last batch is taken in again."""
    source, state = scratch(spark, "responses"), scratch(spark, "state")
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), "p_name")
    parts.repartition(3, "row_idx").write.parquet(source)
    questions = {"q": ("p_name", "multi")}
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    tabulation.start(stream, state, scratch(spark, "progress"), questions, " ").awaitTermination()
    tabulation.merge(state, questions, " ")(parts.limit(0), 0)
    return tabulation.tabulation(spark, state).select("label", "n", "base", "first", "rank")


_GALLERY = {"l0": "first", "l1": "second", "l2": "second", "l5": "empty"}
_GALLERY_SQL = """f AS (SELECT 'l' || page_id % 4 AS layer, CASE WHEN page_id % 5 = 0 THEN ' ' || chr(160) ELSE url END AS name, CASE WHEN page_id % 3 > 0 THEN 'z' || page_id % 3 END AS zone,
  unnest(list_distinct(regexp_extract_all(coalesce(html, ''), 'href=["'']([^"'']+)["'']', 1))) AS u FROM pages),
i AS (SELECT u AS url, CASE WHEN trim(name, ' ' || chr(160)) = '' THEN '(bez imena)' ELSE trim(name, ' ' || chr(160)) END AS name, coalesce(zone, '') AS zone, layer, CASE layer WHEN 'l0' THEN 'first' WHEN 'l1' THEN 'second' WHEN 'l2' THEN 'second' END AS category FROM f WHERE layer <> 'l3')"""


def _gallery(spark, d):
    k = F.col("page_id")
    name = F.when(k % 5 == 0, " \u00a0").otherwise(F.col("url"))
    pages = _t(spark, d, "pages").select(F.concat(F.lit("l"), k % 4).alias("layer"), name.alias("name"), F.when(k % 3 > 0, F.concat(F.lit("z"), k % 3)).alias("zone"), text.hrefs(F.col("html")).alias("images"))
    return corridor.gallery(pages, _GALLERY)


@query(f"WITH {_GALLERY_SQL} SELECT * FROM i")
def gallery_images(spark, d):
    """Pages as features, their link targets as images; a layer in no category, names of blanks beyond ASCII."""
    return _gallery(spark, d)


@query(f"WITH {_GALLERY_SQL} SELECT category, count(*) AS n FROM i GROUP BY category UNION ALL SELECT 'all', count(*) FROM i")
def gallery_counts(spark, d):
    """images by category, those without an image left out, and all."""
    return corridor.gallery_counts(_gallery(spark, d))


@query(f"""WITH p AS (SELECT p_brand AS folder, p_partkey AS pid, lower(split_part(p_name, ' ', 1)) AS norm, p_partkey % 3 = 1 AS line, 21.8::DOUBLE + p_partkey % 1000 / 5000.0::DOUBLE AS lon, 43.2::DOUBLE + p_partkey % 777 / 5000.0::DOUBLE AS lat FROM part),
m AS (SELECT a.*, CASE WHEN line THEN asin(sqrt(least(pow(sin(radians(0.5) / 2), 2), 1.0::DOUBLE))) * 12742000.0::DOUBLE END AS m FROM p a),
n AS (SELECT folder, norm, count(*) AS n, min(pid) AS first, sum(m) AS m FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, first, norm) AS rank, count(*) OVER (PARTITION BY folder) AS names FROM n)
SELECT folder, norm, n, round(m, 1) AS length_m, rank::INT AS rank, greatest(names - 4, 0) AS more FROM r WHERE rank <= 4""")
def folder_names(spark, d):
    """The names of every placemark by folder, lines with their length."""
    k = F.col("p_partkey")
    place = _place("p_partkey")
    ends = F.array(F.struct(place["lon"].alias("lon"), place["lat"].alias("lat")), F.struct(place["lon"].alias("lon"), (place["lat"] + 0.5).alias("lat")))
    marks = _t(spark, d, "part").select(F.col("p_brand").alias("folder"), k.alias("pid"), text.normalize(F.split("p_name", " ")[0]).alias("norm"), F.when(k % 3 == 1, "LineString").when(k % 3 == 2, "Point").alias("gtype"), ends.alias("coords"))
    return corridor.folder_names(marks, 4).withColumn("length_m", F.round("length_m", 1))


@query(f"""WITH c AS (SELECT c_custkey, {_lon_sql("c_custkey")} FROM customer), t AS (SELECT trunc((lon + 180) / 360 * 16384)::BIGINT AS x, trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384)::BIGINT AS y, count(*) AS n FROM c GROUP BY ALL)
SELECT 14::BIGINT AS z, x, y, 'tile of ' || n AS content FROM t WHERE n % 5 > 0""")
def tile_store(spark, d):
    """A tile for each place of customers, stored under its name and read back; some could not be had."""
    c = _t(spark, d, "customer").select("c_custkey").withColumns(_place("c_custkey"))
    x, y = geo.tile(F.col("lon"), F.col("lat"), 14)
    n = F.count(F.lit(1))
    tiles = c.groupBy(x.alias("x"), y.alias("y")).agg(F.when(n % 5 > 0, F.concat(F.lit("tile of "), n.cast("string")).cast("binary")).alias("content")).withColumn("z", F.lit(14))
    path = scratch(spark, "tiles")
    writers.write_tiles(tiles, path)
    return readers.tile_files(spark, path).withColumn("content", F.col("content").cast("string"))


@query("""WITH p AS (SELECT p_partkey, chr(160) || chr(8195) || replace(p_name, ' ', ' ' || chr(160) || chr(12288)) || chr(133) || chr(8239) || p_brand || chr(9) || chr(160) AS n FROM part)
SELECT p_partkey, lower(regexp_replace(regexp_replace(n, '^[\\x09-\\x0D\\x20\\x{85}\\p{Z}]+|[\\x09-\\x0D\\x20\\x{85}\\p{Z}]+$', '', 'g'), '[\\x09-\\x0D\\x20\\x{85}\\p{Z}]+', ' ', 'g')) AS norm FROM p""")
def unicode_names(spark, d):
    """C13 with blanks beyond ASCII at both ends and within: no-break, em, ideographic and narrow ones, a next-line sign."""
    messy = F.concat(F.lit("\u00a0\u2003"), F.replace("p_name", F.lit(" "), F.lit(" \u00a0\u3000")), F.lit("\x85\u202f"), "p_brand", F.lit("\t\u00a0"))
    return _t(spark, d, "part").select("p_partkey", text.normalize(messy).alias("norm"))
