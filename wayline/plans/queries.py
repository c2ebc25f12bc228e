"""The engine's operators as queries over the driver's tables, each with the same result as DuckDB SQL.

The tables have no coordinates, so points are made of ids: lon = 21.8 + (id % 1000) / 5000, lat = 43.2 + (id % 777) / 5000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import geo, numbers, text
from wayline.operators import linear, raster, spatial, stats, survey
from wayline.session import scratch
from wayline.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ZONES = {
    "east": [(21.92, 43.24), (22.0, 43.2), (21.97, 43.34), (21.92, 43.24)],
    "far": [(22.5, 44.0), (22.6, 44.0), (22.6, 44.1), (22.5, 44.0)],
    "middle": [(21.84, 43.22), (21.92, 43.21), (21.93, 43.3), (21.85, 43.31), (21.84, 43.22)],
    "west": [(21.8, 43.2), (21.86, 43.2), (21.86, 43.28), (21.8, 43.28), (21.8, 43.2)],
}
_RING_SQL = "(VALUES " + ", ".join(f"('{z}', {i}, {x}::DOUBLE, {y}::DOUBLE)" for z, ring in ZONES.items() for i, (x, y) in enumerate(ring)) + ") AS r(zone, i, x, y)"
_ZONE_SQL = f"""ring AS (SELECT * FROM {_RING_SQL}),
zone_ord AS (SELECT zone, row_number() OVER (ORDER BY avg(x), zone) AS ord FROM ring GROUP BY zone),
edge AS (SELECT a.zone, o.ord, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a JOIN zone_ord o USING (zone)
  JOIN ring b ON a.zone = b.zone AND b.i = CASE WHEN a.i = 0 THEN (SELECT max(i) FROM ring r WHERE r.zone = a.zone) ELSE a.i - 1 END)"""


def _located_sql(points: str, key: str = "id") -> str:
    """Columns key and zone of points that have key, lon, lat."""
    return f"""SELECT {key}, arg_min(zone, ord) AS zone FROM (
  SELECT p.{key}, e.zone, e.ord FROM {points} p JOIN edge e ON (e.y1 > p.lat) <> (e.y2 > p.lat)
   AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (CASE WHEN e.y2 = e.y1 THEN 1e-12 ELSE e.y2 - e.y1 END) + e.x1
  GROUP BY p.{key}, e.zone, e.ord HAVING count(*) % 2 = 1) GROUP BY {key}"""


def _lon_sql(id: str) -> str:
    return f"(21.8::DOUBLE + ({id} % 1000) / 5000.0::DOUBLE) AS lon, (43.2::DOUBLE + ({id} % 777) / 5000.0::DOUBLE) AS lat"


def _meters_sql(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    return f"asin(sqrt(least({h}, 1.0::DOUBLE))) * 12742000.0::DOUBLE"


_SEGMENT_SQL = f"""pt AS (SELECT event_id, user_id, ts, {_lon_sql('event_id')}, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
seg AS (SELECT a.event_id, a.user_id, a.ts, a.k, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2, {_meters_sql('a', 'b')} AS m
  FROM pt a JOIN pt b ON a.user_id = b.user_id AND b.k = a.k + 1)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def zones(spark: SparkSession) -> DataFrame:
    rows = [(z, [{"lon": x, "lat": y} for x, y in ring]) for z, ring in ZONES.items()]
    return spatial.order_zones(spark.createDataFrame(rows, "zone string, ring array<struct<lon:double,lat:double>>"))


def _place(id: str) -> dict[str, Column]:
    return {"lon": F.lit(21.8) + (F.col(id) % 1000) / F.lit(5000.0), "lat": F.lit(43.2) + (F.col(id) % 777) / F.lit(5000.0)}


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "ts", *columns)


def _track(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumns(_place("event_id"))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


@query(f"""WITH {_ZONE_SQL}, c AS (SELECT c_custkey AS id, c_mktsegment, {_lon_sql('c_custkey')} FROM customer), l AS ({_located_sql('c')})
SELECT l.zone, c_mktsegment AS category, count(*) AS n FROM c JOIN l USING (id) GROUP BY ALL""")
def zone_counts(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category")).withColumns(_place("c_custkey"))
    return stats.counts(spatial.locate(c, zones(spark)), "zone", "category")


@query(f"""WITH z AS (SELECT 's' || s_suppkey AS zone, (lon + (lon + 0.01 * (1 + s_suppkey % 4)) + lon + lon) / 4 AS cx FROM (SELECT s_suppkey, {_lon_sql("s_suppkey")} FROM supplier))
SELECT zone, row_number() OVER (ORDER BY cx, zone)::INT AS ord, round(cx, 6) AS mean_lon FROM z""")
def zone_order(spark, d):
    """A triangle for each supplier, made of its id."""
    x, y = F.col("lon"), F.col("lat")
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    wide = F.lit(0.01) * (1 + F.col("s_suppkey") % 4)
    ring = F.array(corner(F.lit(0.0), 0.0), corner(wide, 0.0), corner(F.lit(0.0), 0.01), corner(F.lit(0.0), 0.0))
    s = _t(spark, d, "supplier").withColumns(_place("s_suppkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("zone"), ring.alias("ring"))
    return spatial.order_zones(s).select("zone", "ord", F.round(geo.mean_lon(F.col("ring")), 6).alias("mean_lon"))


@query(f"WITH {_SEGMENT_SQL} SELECT user_id, count(*) AS segments, round(sum(m), 2) AS length_m FROM seg GROUP BY user_id")
def segment_length_by_user(spark, d):
    s = linear.segments(_track(spark, d), "user_id", "ts")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("length_m"), 2).alias("length_m"))


@query(f"""WITH {_ZONE_SQL}, {_SEGMENT_SQL}, mid AS (SELECT event_id, (lon1 + lon2) / 2 AS lon, (lat1 + lat2) / 2 AS lat, m FROM seg), l AS ({_located_sql('mid', 'event_id')})
SELECT o.zone, round(coalesce(sum(m), 0), 1) AS length_m, round(coalesce(sum(m), 0) / 1000, 2) AS km
FROM zone_ord o LEFT JOIN (SELECT l.zone, m FROM l JOIN mid USING (event_id)) s ON o.zone = s.zone GROUP BY o.zone""")
def length_by_zone(spark, d):
    found = spatial.length_by_zone(linear.segments(_track(spark, d), "user_id", "ts"), zones(spark))
    return found.select("zone", F.round("length_m", 1).alias("length_m"), F.round(F.col("length_m") / 1000, 2).alias("km"))


@query(f"WITH {_SEGMENT_SQL} SELECT event_id, user_id, round(sum(m) OVER (PARTITION BY user_id ORDER BY k), 2) AS to_m FROM seg")
def cumulative_distance(spark, d):
    s = linear.cumulative(linear.segments(_track(spark, d), "user_id", "ts", "event_id"), "user_id", "ts")
    return s.select("event_id", "user_id", F.round("to_m", 2).alias("to_m"))


@query(f"""WITH {_SEGMENT_SQL}, c AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY k) AS b FROM seg), c2 AS (SELECT *, b - m AS a FROM c WHERE m > 0),
inner_ AS (SELECT user_id, k5 * 5000.0::DOUBLE AS at_m, lon1 + (lon2 - lon1) * ((k5 * 5000.0::DOUBLE - a) / m) AS lon, lat1 + (lat2 - lat1) * ((k5 * 5000.0::DOUBLE - a) / m) AS lat
  FROM (SELECT *, unnest(range(floor(a / 5000)::BIGINT + 1, floor(b / 5000)::BIGINT + 1)) AS k5 FROM c2)),
last AS (SELECT user_id, max(b) AS total FROM c2 GROUP BY user_id),
ends AS (SELECT user_id, arg_min(lon, k) AS lon0, arg_min(lat, k) AS lat0, arg_max(lon, k) AS lon9, arg_max(lat, k) AS lat9 FROM pt GROUP BY user_id HAVING count(*) > 1)
SELECT user_id, round(at_m, 3) AS at_m, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (
  SELECT * FROM inner_ UNION ALL SELECT user_id, 0, lon0, lat0 FROM ends
  UNION ALL SELECT user_id, total, lon9, lat9 FROM ends JOIN last USING (user_id) WHERE floor(total / 5000) * 5000 < total - 1)""")
def resample_line(spark, d):
    s = linear.resample(_track(spark, d), "user_id", "ts", 5000.0)
    return s.select("user_id", F.round("at_m", 3).alias("at_m"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM events")
def moving_average(spark, d):
    return linear.moving_average(_events(spark, d, "value"), "user_id", "ts", "value", 9).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""WITH s AS (SELECT user_id, value - lag(value) OVER w AS dy, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, round(coalesce(max(abs(dy / dx) * 100) FILTER (dx >= 600), 0), 4) AS gradient FROM s GROUP BY user_id""")
def max_gradient(spark, d):
    e = _events(spark, d, "value").withColumn("s", _micros("ts") / F.lit(1e6))
    return linear.max_gradient(e, "user_id", "ts", "s", "value", 600.0).select("user_id", F.round("gradient", 4).alias("gradient"))


@query("""SELECT coalesce(user_id, -1) AS user_id, round(min(value), 1) AS min_m, round(max(value), 1) AS max_m, round(max(value) - min(value), 1) AS range_m FROM events GROUP BY GROUPING SETS ((user_id), ()) HAVING count(*) >= 2""")
def range_stats(spark, d):
    e = _t(spark, d, "events").select("user_id", "value")
    return stats.ranges_and_whole(e, "value", "user_id").select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "min_m", "max_m", "range_m")


_GAP_SQL = "g AS (SELECT event_id, user_id, ts, value, CASE WHEN event_type <> 'error' THEN event_type END AS z FROM events)"


@query(f"""WITH {_GAP_SQL}, n AS (SELECT *, last_value(z IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  first_value(z IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM g)
SELECT event_id, coalesce(z, CASE WHEN l = r THEN l WHEN r IS NULL THEN l WHEN l IS NULL THEN r END) AS filled FROM n""")
def gap_fill(spark, d):
    e = _events(spark, d, "event_type").withColumn("z", F.when(F.col("event_type") != "error", F.col("event_type")))
    return linear.fill_gaps(e, "user_id", "ts", "z").select("event_id", "filled")


@query("""WITH s AS (SELECT user_id, ts, value > 50 AS v FROM events), c AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM c), g AS (SELECT user_id, run, v, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, round(sum(CASE WHEN v THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n), 1) AS pct, coalesce(max(n * 30) FILTER (v), 0) AS longest_m, coalesce(max(n * 30) FILTER (NOT v), 0) AS longest_gap_m, count(*) - 1 AS transitions FROM g GROUP BY user_id""")
def run_stats(spark, d):
    return linear.run_stats(_events(spark, d, (F.col("value") > 50).alias("v")), "user_id", "ts", "v", 30)


@query(f"""WITH {_GAP_SQL}, k AS (SELECT user_id, ts, value > 50 AS v, z, (row_number() OVER w - 1) * 0.03::DOUBLE AS km FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND v IS NOT DISTINCT FROM lag(v) OVER w AND z IS NOT DISTINCT FROM lag(z) OVER w THEN 0 ELSE 1 END AS n FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM c)
SELECT user_id, run::BIGINT AS run, round(min(km), 3) AS km_start, round(min(km) + count(*) * 0.03::DOUBLE, 3) AS km_end, count(*) * 30 AS length_m, v AS shade, z AS zone FROM r GROUP BY user_id, run, v, z""")
def strip_intervals(spark, d):
    e = _events(spark, d, (F.col("value") > 50).alias("shade"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("zone"))
    e = e.withColumn("km", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1) * F.lit(0.03))
    return linear.strips(e, "user_id", "ts", "km", "shade", "zone", 30)


@query(f"""WITH {_GAP_SQL}, k AS (SELECT user_id, ts, z, epoch_us(ts) AS km, CASE WHEN row_number() OVER w > 1 AND z IS NOT DISTINCT FROM lag(z) OVER w THEN 0 ELSE 1 END AS n FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM k)
SELECT user_id, z AS zone, min(km) AS km_start, max(km) AS km_end FROM r WHERE z IS NOT NULL GROUP BY user_id, run, z""")
def bands(spark, d):
    e = _events(spark, d, F.when(F.col("event_type") != "error", F.col("event_type")).alias("zone")).withColumn("us", _micros("ts"))
    return linear.bands(e, "user_id", "ts", "us", "zone")


@query("""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS n FROM part)
SELECT CASE WHEN regexp_matches(n, 'e{1,2}l\\b') THEN 'metal' WHEN regexp_matches(n, '\\bb[lr]') THEN 'tone' WHEN n LIKE '%ti%' AND n LIKE '%er%' THEN 'both' ELSE 'ostalo' END AS category, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY ALL""")
def classify_rules(spark, d):
    n = text.normalize(F.concat_ws(" ", "p_name", "p_type"))
    rules = [(r"e{1,2}l\b", "metal"), (r"\bb[lr]", "tone"), (r"(?s)^(?=.*ti)(?=.*er)", "both")]
    return _t(spark, d, "part").groupBy(text.classify(n, rules).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT p_partkey, regexp_replace(lower(regexp_replace('  ' || upper(p_name) || chr(9) || p_type || ' ', '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS norm FROM part")
def normalize_names(spark, d):
    messy = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"), "p_type", F.lit(" "))
    return _t(spark, d, "part").select("p_partkey", text.normalize(messy).alias("norm"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)https?://\S+', '[link]', 'g'), '\S+@\S+\.\S+', '[e-mail]', 'g'), '\b0\d{1,2}[/\s.\-]?\d{2,4}[/\s.\-]?\d{2,4}\b', '[telefon]', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents)
SELECT doc_id, text FROM r WHERE length(text) >= 15""")
def redact(spark, d):
    r = _t(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))
    return r.filter(F.length("text") >= survey.LEAST_COMMENT)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(coalesce(text, ''))")
def dedupe_first(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return survey.keep_first(docs.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("k")), F.col("k"), "doc_id").select("doc_id")


def _tabulated(rows: str) -> str:
    return f"""WITH a AS ({rows}), c AS (SELECT label, count(*) AS n, min(row_idx) AS first FROM a GROUP BY label)
SELECT label, n, (SELECT count(DISTINCT row_idx) FROM a) AS base, first, row_number() OVER (ORDER BY n DESC, first, label)::INT AS rank FROM c"""


@query(_tabulated("SELECT c_custkey AS row_idx, trim(c_mktsegment) AS label FROM customer WHERE trim(coalesce(c_mktsegment, '')) <> ''"))
def single_choice(spark, d):
    r = _t(spark, d, "customer").select(F.col("c_custkey").alias("row_idx"), "c_mktsegment")
    return survey.tabulate(survey.long_answers(r, {"q": ("c_mktsegment", "single")})).drop("question")


@query(_tabulated("SELECT DISTINCT row_idx, label FROM (SELECT p_partkey AS row_idx, trim(unnest(string_split(p_name, ' '))) AS label FROM part) WHERE label <> ''"))
def multi_choice(spark, d):
    r = _t(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), "p_name")
    return survey.tabulate(survey.long_answers(r, {"q": ("p_name", "multi")}, separator=" ")).drop("question")


@query("""WITH c AS (SELECT p_type AS label, count(*) AS n FROM part GROUP BY p_type), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) <= 7 AND n >= 5 AS own FROM c)
SELECT CASE WHEN own THEN label ELSE 'other' END AS label, sum(n)::BIGINT AS n, CASE WHEN own THEN 0 ELSE count(*) END AS merged FROM r GROUP BY CASE WHEN own THEN label ELSE 'other' END, own""")
def topk_other(spark, d):
    return survey.top_and_other(stats.counts(_t(spark, d, "part").select(F.col("p_type").alias("label")), "label"))


@query("""WITH c AS (SELECT user_id % 10 AS grp, event_type AS label, count(*) AS n FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY label = 'error', n DESC, label)::INT AS rank, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY grp), 1) AS pct FROM c""")
def catchall_last(spark, d):
    c = stats.counts(_t(spark, d, "events").select((F.col("user_id") % 10).alias("grp"), F.col("event_type").alias("label")), "grp", "label")
    return stats.catch_all_last(c, ["grp"], "label", "error")


@query("""WITH s AS (SELECT l_linestatus, l_returnflag, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL)
SELECT *, round(coalesce(amount * 100 / nullif(sum(amount) OVER (PARTITION BY l_linestatus), 0), 0), 1) AS pct FROM s""")
def shares(spark, d):
    return stats.shares(_t(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", F.col("l_quantity"))


@query("""WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY ALL), o AS (SELECT c_nationkey AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT n_nationkey AS nation, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(coalesce(customers, 0) / 1000.0::DOUBLE, 0), 0), 2) AS per_km, round(coalesce(coalesce(customers, 0) / 1000.0::DOUBLE * 1000 / nullif(coalesce(n, 0), 0), 0), 0) AS m_per_item
FROM nation LEFT JOIN c ON n_nationkey = c.nation LEFT JOIN o ON n_nationkey = o.nation""")
def density(spark, d):
    customers = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = _t(spark, d, "orders").select("o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    both = stats.counts(customers, "nation").withColumnRenamed("n", "customers").join(stats.counts(orders, "nation"), "nation", "full")
    grid = _t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    found = stats.dense(both, grid, ["nation"], "customers", "n")
    return found.withColumns(stats.density(F.col("n"), F.col("customers") / F.lit(1000.0))).drop("customers")


@query("""WITH c AS (SELECT user_id, ts::DATE::VARCHAR AS day, event_type, count(*) AS n, min(epoch_us(ts)) AS f FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_type = 'error', n DESC, f) AS k FROM c)
SELECT user_id, day, event_type AS klass FROM r WHERE k = 1""")
def majority_vote(spark, d):
    e = _events(spark, d, F.col("event_type").alias("klass")).withColumns({"day": F.to_date("ts").cast("string"), "ord": _micros("ts")})
    return raster.majority(e, "user_id", "day", last_resort="error")


@query("""WITH p AS (SELECT page_id, list_distinct(regexp_extract_all(coalesce(html, ''), 'href=["'']([^"'']+)["'']', 1)) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS url FROM p)
SELECT page_id, url, sha1(url)[1:16] AS id FROM u""")
def extract_links(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.explode(text.hrefs(F.col("html"))).alias("url"))
    return p.select("page_id", "url", text.content_id(F.col("url")).alias("id"))


@query("""WITH u AS (SELECT 'documents' AS layer, source AS item FROM documents UNION ALL SELECT 'pages', url FROM pages UNION ALL SELECT 'conversations', role FROM conversations)
SELECT coalesce(g.category, u.layer) AS category, u.layer, count(*) AS n, count(DISTINCT item) AS items FROM u LEFT JOIN (VALUES ('documents', 'text'), ('conversations', 'text')) g(layer, category) ON u.layer = g.layer GROUP BY ALL""")
def gallery_union(spark, d):
    parts = [_t(spark, d, t).select(F.lit(t).alias("layer"), F.col(c).alias("item")) for t, c in (("documents", "source"), ("pages", "url"), ("conversations", "role"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    named = every.withColumn("category", text.label_of(F.col("layer"), {"documents": "text", "conversations": "text"}))
    return named.groupBy("category", "layer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("items"))


@query("""WITH k AS (SELECT DISTINCT event_type AS key FROM events UNION SELECT 'none'), s AS (SELECT event_type AS key, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 1) AS pct FROM events GROUP BY ALL)
SELECT k.key, coalesce(pct, 0) AS pct, row_number() OVER (ORDER BY coalesce(pct, 0) DESC, k.key)::INT AS rank FROM k LEFT JOIN s USING (key)""")
def key_union_order(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("key"))
    keys = e.distinct().union(spark.createDataFrame([("none",)], "key string")).distinct()
    found = keys.join(stats.shares(e, [], "key", F.lit(1)).select("key", "pct"), "key", "left").withColumn("pct", F.coalesce("pct", F.lit(0.0)))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pct"), "key")))  # one row for each key


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphans(spark, d):
    return writers.orphans(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 150 AS u, epoch_us(o_orderdate) AS at FROM orders), e AS (SELECT user_id AS u, epoch_us(ts) AS at, event_id FROM events),
b AS (SELECT o.*, e.at AS eat, e.event_id FROM o ASOF LEFT JOIN e ON o.u = e.u AND o.at >= e.at), f AS (SELECT o.o_orderkey, e.at AS eat, e.event_id FROM o ASOF LEFT JOIN e ON o.u = e.u AND o.at <= e.at)
SELECT b.o_orderkey, b.u, b.at, CASE WHEN b.eat IS NULL THEN f.eat WHEN f.eat IS NULL OR b.at - b.eat < f.eat - b.at THEN b.eat ELSE f.eat END AS nearest_at,
  CASE WHEN b.eat IS NULL THEN f.event_id WHEN f.eat IS NULL OR b.at - b.eat < f.eat - b.at THEN b.event_id ELSE f.event_id END AS event_id FROM b JOIN f USING (o_orderkey) WHERE b.eat IS NOT NULL OR f.eat IS NOT NULL""")
def nearest_sample(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("u"), _micros("o_orderdate").alias("at"))
    e = _events(spark, d).select(F.col("user_id").alias("u"), _micros("ts").alias("at"), "event_id")
    return linear.nearest(o, e, "u", "at", "event_id").filter("nearest_at is not null")


@query(f"""WITH c AS (SELECT c_custkey, {_lon_sql('c_custkey')} FROM customer), t AS (SELECT *, trunc((lon + 180) / 360 * 16384)::INT AS x, trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384)::INT AS y FROM c)
SELECT c_custkey, x, y, round(x / 16384.0::DOUBLE * 360 - 180, 6) AS corner_lon, round(degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * y / 16384)))), 6) AS corner_lat FROM t""")
def tile_math(spark, d):
    c = _t(spark, d, "customer").select("c_custkey").withColumns(_place("c_custkey"))
    x, y = geo.tile(F.col("lon"), F.col("lat"), 14)
    lon, lat = geo.tile_corner(F.col("x"), F.col("y"), 14)
    return c.withColumns({"x": x, "y": y}).select("c_custkey", "x", "y", F.round(lon, 6).alias("corner_lon"), F.round(lat, 6).alias("corner_lat"))


@query("SELECT user_id, sha1(string_agg(event_id || ',' || event_type || '|', '' ORDER BY ts))[1:16] AS hash FROM events GROUP BY user_id")
def ordered_hash(spark, d):
    return linear.ordered_hash(_events(spark, d, "event_type"), "user_id", "ts", F.concat("event_id", F.lit(","), "event_type", F.lit("|")))


@query("""WITH g AS (SELECT DISTINCT user_id % 10 AS grp FROM events), t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT user_id % 10 AS grp, event_type, round(sum(value), 2) AS amount FROM events GROUP BY ALL)
SELECT grp, event_type, coalesce(amount, 0) AS amount FROM g CROSS JOIN t LEFT JOIN c USING (grp, event_type)""")
def pivot_dense(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 10).alias("grp"), "event_type", "value")
    grid = e.select("grp").distinct().crossJoin(e.select("event_type").distinct())  # ten groups by a few types
    found = e.groupBy("grp", "event_type").agg(F.round(F.sum("value"), 2).alias("amount"))
    return stats.dense(found, grid, ["grp", "event_type"], "amount")


@query("""WITH g AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT ts::DATE::VARCHAR AS day FROM events), c AS (SELECT user_id, ts::DATE::VARCHAR AS day, round(sum(value), 2) AS amount FROM events GROUP BY ALL)
SELECT user_id, day, coalesce(amount, 0) AS amount FROM g CROSS JOIN t LEFT JOIN c USING (user_id, day)""")
def pivot_dense_all(spark, d):
    """Every event counts; the zero cells are days without an event of the user."""
    e = _t(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "value")
    grid = e.select("user_id").distinct().crossJoin(e.select("day").distinct())  # users by a few days
    found = e.groupBy("user_id", "day").agg(F.round(F.sum("value"), 2).alias("amount"))
    return stats.dense(found, grid, ["user_id", "day"], "amount")


@query("""WITH d AS (SELECT * FROM (VALUES ('click', 12.5::DOUBLE), ('error', 8.0::DOUBLE), ('none', 10.0::DOUBLE)) d(date, daylight)), s AS (SELECT CASE WHEN user_id % 4 > 0 THEN 'z' || user_id % 4 END AS zone, event_type, value FROM events),
e AS (SELECT zone, date, daylight, CASE WHEN event_type = date THEN value / 10 ELSE 0 END AS h FROM s CROSS JOIN d),
a AS (SELECT NULL AS zone, date, daylight, count(*) AS n, avg(h) AS m FROM e GROUP BY date, daylight UNION ALL SELECT zone, date, daylight, count(*), avg(h) FROM e WHERE zone IS NOT NULL GROUP BY zone, date, daylight)
SELECT zone, date, n AS n_samples, round(m, 2) AS avg_hours, round(m / daylight, 3) AS pct_sun, round(1 - m / daylight, 3) AS pct_shade FROM a""")
def hours_by_key(spark, d):
    zone = F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("z"), (F.col("user_id") % 4).cast("string")))
    s = _t(spark, d, "events").select(zone.alias("zone"), F.create_map("event_type", F.col("value") / 10).alias("sun_hours"))
    days = spark.createDataFrame([("click", "2026-03-21T06:00:00+01:00", "2026-03-21T18:30:00+01:00"), ("error", "2026-12-21T08:00:00+01:00", "2026-12-21T16:00:00+01:00"), ("none", "2026-06-21T05:00:00+02:00", "2026-06-21T15:00:00+02:00")], "key string, a string, b string")
    return stats.sun_shares(s, days.select("key", numbers.hours_between(F.to_timestamp("a"), F.to_timestamp("b")).alias("daylight")))


@query("""WITH c AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label)::INT AS rank FROM c)
SELECT label, n, rank, greatest((SELECT count(*) FROM c) - 20, 0) AS more FROM r WHERE rank <= 20""")
def profile_names(spark, d):
    c = stats.counts(_t(spark, d, "part").select(F.col("p_brand").alias("label")), "label")
    top = c.orderBy(F.desc("n"), "label").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    return top.crossJoin(c.agg(F.greatest(F.count(F.lit(1)) - 20, F.lit(0)).cast("long").alias("more")))


@query("""WITH p AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS x, value AS y FROM events),
n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, coalesce(lag(x) OVER w, x) AS x0, coalesce(lag(y) OVER w, y) AS y0, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS x3, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS y3 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, round(x + (x2 - x0) / 6, 2) AS c1x, round(y + (y2 - y0) / 6, 4) AS c1y, round(x2 - (x3 - x) / 6, 2) AS c2x, round(y2 - (y3 - y) / 6, 4) AS c2y FROM n WHERE x2 IS NOT NULL""")
def spline_controls(spark, d):
    e = _events(spark, d, F.col("value").alias("y")).withColumn("x", _micros("ts") / F.lit(1e6))
    c = linear.spline_controls(e, "user_id", "ts")
    return c.select("event_id", *(F.round(k, n).alias(k) for k, n in (("c1x", 2), ("c1y", 4), ("c2x", 2), ("c2y", 4))))


@query("""WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL)
SELECT nation, label, n, (coalesce(sum(n) OVER (PARTITION BY nation ORDER BY n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM c""")
def running_offset(spark, d):
    c = stats.counts(_t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("label")), "nation", "label")
    return linear.running_offset(c.withColumn("m", -F.col("n")), "nation", ["m", "label"], "n").drop("m")


@query(f"""WITH c AS (SELECT c_mktsegment AS segment, {_lon_sql('c_custkey')} FROM customer)
SELECT segment, count(*) AS n, round(min(lon), 4) AS west, round(max(lon), 4) AS east, round(min(lat), 4) AS south, round(max(lat), 4) AS north FROM c GROUP BY segment""")
def coord_parse(spark, d):
    place = _place("c_custkey")
    line = F.concat(F.lit(" bad "), F.format_string("%.6f,%.6f,0", place["lon"], place["lat"]), F.lit("\n"))
    c = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.explode(geo.parse_coords(line)).alias("p"))
    return c.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("p.lon"), 4).alias("west"), F.round(F.max("p.lon"), 4).alias("east"), F.round(F.min("p.lat"), 4).alias("south"), F.round(F.max("p.lat"), 4).alias("north"))


@query("""WITH s AS (SELECT CASE WHEN user_id % 4 > 0 THEN 'z' || user_id % 4 END AS zone, CASE WHEN event_type <> 'error' THEN event_type END AS klass FROM events),
c AS (SELECT NULL AS zone, klass FROM s WHERE klass IS NOT NULL UNION ALL SELECT zone, klass FROM s WHERE klass IS NOT NULL AND zone IS NOT NULL), g AS (SELECT zone, klass, count(*) AS n FROM c GROUP BY zone, klass)
SELECT zone, klass, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY zone), 1) AS pct FROM g""")
def class_shares(spark, d):
    zone = F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("z"), (F.col("user_id") % 4).cast("string")))
    return stats.class_shares(_t(spark, d, "events").select(zone.alias("zone"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("klass")))


@query("""WITH v AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), t AS (SELECT *, max(q) OVER () AS most FROM v)
SELECT l_orderkey, CASE WHEN q > 0 AND most > 0 THEN round(greatest(2, q / most * 100), 4) ELSE 0 END AS width, CASE WHEN q * 10 >= 1000 THEN printf('%.2f km', q * 10 / 1000) ELSE printf('%d m', floor(q * 10 + 0.5)::BIGINT) END AS label,
  floor(q / 5) * 5 AS low, ceil(q / 5) * 5 AS high FROM t""")
def bars_and_labels(spark, d):
    v = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    t = v.crossJoin(F.broadcast(v.agg(F.max("q").alias("most"))))
    low, high = numbers.axis(F.col("q"), F.col("q"))
    return t.select("l_orderkey", F.round(numbers.bar_width(F.col("q"), F.col("most")), 4).alias("width"), text.metres(F.col("q") * 10).alias("label"), low.alias("low"), high.alias("high"))


@query(f"""SELECT 'folder ' || n_regionkey AS folder, 'Nation ' || n_nationkey || ' ' AS name, 'nation ' || n_nationkey AS norm, CASE WHEN n_nationkey % 5 > 0 THEN 'Point' END AS gtype,
  CASE WHEN n_nationkey % 5 > 0 THEN round(21.8::DOUBLE + n_nationkey / 5000.0::DOUBLE, 4) END AS lon, CASE WHEN n_nationkey % 5 = 1 THEN 1 ELSE 0 END::INT AS images FROM nation""")
def xml_scan(spark, d):
    """Folders of placemarks, some without a shape, some with the same image twice, some in a collection of shapes, written as XML and read back."""
    k = F.col("n_nationkey")
    point = F.format_string("<Point><coordinates>%.4f,43.2,0</coordinates></Point>", F.lit(21.8) + k / F.lit(5000.0))
    shape = F.when(k % 5 == 0, "").when(k % 5 == 2, F.concat(F.lit("<MultiGeometry>"), point, F.lit("</MultiGeometry>"))).otherwise(point)
    images = F.when(k % 5 == 1, "<description><![CDATA[<img src='u'/><img src='u'/>]]></description>").otherwise("")
    mark = F.concat(F.lit("<Placemark><name>Nation "), k.cast("string"), F.lit(" </name>"), images, shape, F.lit("</Placemark>"))
    folders = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(mark)), "").alias("m"))
    path = scratch(spark, "folders")
    folder = F.concat(F.lit("<Folder><name>folder "), F.col("n_regionkey").cast("string"), F.lit("</name>"), F.col("m"), F.lit("</Folder>"))
    document = F.concat(F.lit("<kml><Document>"), F.array_join(F.array_sort(F.collect_list(folder)), ""), F.lit("</Document></kml>"))  # one of 25 placemarks
    folders.agg(document.alias("value")).write.text(path)
    p = readers.read_placemarks(spark, path)
    return p.select("folder", "name", "norm", "gtype", F.round(F.get("coords", F.lit(0))["lon"], 4).alias("lon"), F.size("images").alias("images"))


@query(f"""SELECT c_custkey, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"name":"' || c_name || '"}}}}' AS feature FROM (SELECT c_custkey, c_name, {_lon_sql('c_custkey')} FROM customer)""")
def geojson_features(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")).withColumns(_place("c_custkey"))
    shape = F.array(F.struct("lon", "lat"))
    return c.select(F.col("c_custkey"), writers.feature(F.lit("Point"), shape, {"name": writers.truthy(F.col("name"))}).alias("feature"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)https?://\S+', '[link]', 'g'), '\S+@\S+\.\S+', '[e-mail]', 'g'), '\b0\d{1,2}[/\s.\-]?\d{2,4}[/\s.\-]?\d{2,4}\b', '[telefon]', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS k FROM c WHERE length(text) >= 15)
SELECT row_number() OVER (ORDER BY md5('42:' || text), doc_id)::INT AS ord, text FROM o WHERE k = 1""")
def seeded_order(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("c"))
    return survey.comments(docs, "c")
