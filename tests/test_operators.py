import pytest
from pyspark.sql import functions as F

from wayline.operators import linear, raster, spatial, stats, survey

M = 360.0 / (2 * 3.141592653589793 * 6_371_000)  # degrees of a metre on the equator


def line(spark, metres, by=1):
    return spark.createDataFrame([(by, k, m * M, 0.0) for k, m in enumerate(metres)], "r int, i int, lon double, lat double")


def series(spark, values, kind="string"):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], f"r int, i int, v {kind}")


def squares(spark):
    ring = lambda x: [{"lon": a, "lat": b} for a, b in ((x, 0.0), (x + 2, 0.0), (x + 2, 1.0), (x, 1.0), (x, 0.0))]
    return spatial.order_zones(spark.createDataFrame([("b", ring(1.0)), ("a", ring(0.0)), ("none", ring(50.0))], "zone string, ring array<struct<lon:double,lat:double>>"))


def test_zones_in_order_and_overlap(spark, monkeypatch):
    z = squares(spark)
    assert [r.zone for r in z.orderBy("ord").collect()] == ["a", "b", "none"]
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 2.5, 0.5), (4, 9.0, 0.5), (5, None, None)], "id int, lon double, lat double")
    want = {1: "a", 2: "a", 3: "b", 4: None, 5: None}
    assert {r.id: r.zone for r in spatial.locate(p, z).collect()} == want
    monkeypatch.setattr(spatial, "MOST_VERTICES", 0)
    assert {r.id: r.zone for r in spatial.locate(p, z).collect()} == want


def test_lengths_add_up(spark):
    s = linear.segments(spark.createDataFrame([(1, k, x, 0.5) for k, x in enumerate((0.1, 0.5, 2.6, 2.8, 30.0))], "r int, i int, lon double, lat double"), "r", "i")
    got = {r.zone: r.length_m for r in spatial.length_by_zone(s, squares(spark)).collect()}
    total = s.agg(F.sum("length_m")).collect()[0][0]
    last = s.orderBy(F.desc("i")).first().length_m
    assert got["none"] == 0 and got["a"] > got["b"] > 0 and got["a"] + got["b"] == pytest.approx(total - last)


@pytest.mark.parametrize(("metres", "want"), [((0, 100), (0, 30, 60, 90, 100)), ((0, 90.5), (0, 30, 60, 90)), ((0, 0, 45, 45, 60.5), (0, 30, 60)), ((0, 10), (0, 10))])
def test_resample(spark, metres, want):
    got = linear.resample(line(spark, metres), "r", "i", 30.0).orderBy("at_m").collect()
    assert [round(r.at_m, 3) for r in got] == list(want) and [round(r.lon / M, 3) for r in got] == list(want)


def test_moving_average_skips_nulls(spark):
    got = linear.moving_average(series(spark, [1.0, None, 3.0, 5.0], "double"), "r", "i", "v", 3).orderBy("i").collect()
    assert [r.smooth for r in got] == [1, 2, 4, 4]


@pytest.mark.parametrize(("values", "want"), [("A.A", "AAA"), ("A.B", "A.B"), (".A", "AA"), ("A.", "AA"), ("..", "..")])
def test_gap_fill(spark, values, want):
    s = series(spark, [None if v == "." else v for v in values])
    got = linear.fill_gaps(s, "r", "i", "v")
    assert "".join(r.filled or "." for r in got.orderBy("i").collect()) == want
    again = linear.fill_gaps(got.select("r", "i", F.col("filled").alias("v")), "r", "i", "v")
    assert "".join(r.filled or "." for r in again.orderBy("i").collect()) == want


def test_runs(spark):
    s = series(spark, [True, True, False, True], "boolean")
    assert tuple(linear.run_stats(s, "r", "i", "v", 30).collect()[0]) == (1, 75.0, 60, 30, 2)
    strip = linear.strips(s.withColumns({"km": F.col("i") * 0.03, "zone": F.when(F.col("i") > 0, "z")}), "r", "i", "km", "v", "zone", 30).orderBy("run").collect()
    assert [(x.km_start, x.km_end, x.length_m, x.v, x.zone) for x in strip] == [(0, 0.03, 30, True, None), (0.03, 0.06, 30, True, "z"), (0.06, 0.09, 30, False, "z"), (0.09, 0.12, 30, True, "z")]
    b = linear.bands(series(spark, ["a", "a", None, "a", "b"]), "r", "i", "i", "v").orderBy("km_start").collect()
    assert [(x.v, x.km_start, x.km_end) for x in b] == [("a", 0, 1), ("a", 3, 3), ("b", 4, 4)]


def test_gradient_ignores_the_short_tail(spark):
    p = spark.createDataFrame([("q", 0, 0.0, 10.0, "z"), ("q", 1, 0.030, 10.3, "z"), ("q", 2, 0.031, 10.4, None)], "route string, idx int, km double, elev_smooth double, zone string")
    got = {r.zone: (r.min_m, r.max_m, r.range_m, r.max_gradient_pct) for r in stats.elevation_stats(p).collect()}
    assert got == {None: (10.0, 10.4, 0.4, 1.0), "z": (10.0, 10.3, 0.3, 1.0)}


def test_nearest_takes_the_later_of_two(spark):
    s = spark.createDataFrame([(1, 0, "a"), (1, 10, "b")], "k int, at int, v string")
    asked = spark.createDataFrame([(1, -5), (1, 4), (1, 5), (1, 99), (2, 1)], "k int, at int")
    assert [(r.k, r.at, r.v) for r in linear.nearest(asked, s, "k", "at", "v").orderBy("k", "at").collect()] == [(1, -5, "a"), (1, 4, "a"), (1, 5, "b"), (1, 99, "b"), (2, 1, None)]


def test_splines_and_offsets(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 6.0, 0.0), (1, 2, 12.0, 6.0)], "r int, i int, x double, y double")
    got = linear.spline_controls(p, "r", "i").orderBy("i").collect()
    assert [(r.c1x, r.c1y, r.c2x, r.c2y) for r in got] == [(1, 0, 4, -1), (8, 1, 11, 5)]
    assert [r.offset for r in linear.running_offset(p, "r", "i", "x").orderBy("i").collect()] == [0, 0, 6]


def test_majority(spark):
    votes = spark.createDataFrame([(1, k, "water") for k in range(5)] + [(1, 5 + k, "built_up") for k in range(4)] + [(2, k, "water") for k in range(9)] + [(3, 0, "bare"), (3, 1, "cropland"), (4, 0, None)], "idx int, ord int, klass string")
    assert {r.idx: r.klass for r in raster.majority(votes, "idx").collect()} == {1: "built_up", 2: "water", 3: "bare"}
    pixels = spark.createDataFrame([(5, 5, 0, 100, 200), (6, 5, 250, 0, 0), (9, 9, 1, 2, 3)], "px long, py long, r int, g int, b int")
    got = raster.sample_classes(spark.createDataFrame([(1, 5, 5), (2, 9, 9)], "idx int, px long, py long"), pixels, raster.palette(spark))
    assert {r.idx: (r.code, r.klass) for r in got.collect()} == {1: (50, "built_up"), 2: (None, None)}


def test_cover(spark):
    s = spark.createDataFrame([("q", k, c, z) for k, (c, z) in enumerate([("tree_cover", "z"), (None, "z"), ("tree_cover", "z"), ("bare", None)])], "route string, idx int, klass string, zone string")
    got = {(r.metric, r.zone): (r.pct, r.longest_m, r.longest_gap_m, r.transitions) for r in stats.cover_runs(s, {"shade": raster.SHADE_CLASSES}, 30).collect()}
    assert got == {("shade", None): (66.7, 60, 30, 1), ("shade", "z"): (100.0, 60, 0, 0)}


def test_survey(spark):
    r = spark.createDataFrame([(0, "a; b;a", " x "), (1, "b", ""), (2, None, "y"), (3, "b ;", "x")], "row_idx long, m string, s string")
    got = survey.tabulate(survey.long_answers(r, {"multi": ("m", "multi"), "single": ("s", "single")})).orderBy("question", "rank").collect()
    assert [(x.question, x.label, x.n, x.base, x["first"]) for x in got] == [("multi", "b", 3, 3, 0), ("multi", "a", 1, 3, 0), ("single", "x", 2, 3, 0), ("single", "y", 1, 3, 2)]
    top = survey.top_and_other(spark.createDataFrame([("p", 9), ("q", 6), ("r", 4), ("s", 1)], "label string, n long"))
    assert {(x.label, x.n, x.merged) for x in top.collect()} == {("p", 9, 0), ("q", 6, 0), ("other", 5, 2)}
    c = spark.createDataFrame([(0, "Too short"), (1, "Exactly 15 char"), (2, "EXACTLY 15 CHAR"), (3, "14 characters!"), (4, "mail me at someone@example.org please")], "row_idx long, c string")
    assert sorted(x.text for x in survey.comments(c, "c").collect()) == ["Exactly 15 char", "mail me at [e-mail] please"]


def test_shares_and_dense(spark):
    s = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0)], "w string, p string, v double")
    assert {(r.w, r.p): r.pct for r in stats.shares(s, ["w"], "p", F.col("v")).collect()} == {("a", "x"): 25.0, ("a", "y"): 75.0, ("b", "x"): 0.0}
    sun = stats.sun_shares(spark.createDataFrame([("z", {"d": 5.0}), (None, {"e": 1.0})], "zone string, sun_hours map<string,double>"), spark.createDataFrame([("d", 10.0)], "key string, daylight double"))
    assert {r.zone: (r.n_samples, r.avg_hours, r.pct_sun, r.pct_shade) for r in sun.collect()} == {None: (2, 2.5, 0.25, 0.75), "z": (1, 5.0, 0.5, 0.5)}
