from pyspark.sql import functions as F

from wayline.functions import geo, numbers, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()[0])


def points(spark, *pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in pts])


def test_coordinates_and_lengths(spark):
    parsed, length, none = one(spark, geo.parse_coords(F.lit("1,2,0 3,4  5\n")), geo.line_length_m(points(spark, (0, 0), (0, 1))), geo.parse_coords(F.lit(None).cast("string")))
    assert [tuple(p) for p in parsed] == [(1, 2), (3, 4)] and none == []
    assert round(length, 2) == 111194.93


def test_point_in_ring(spark):
    ring = geo.ring_edges(points(spark, (0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
    assert one(spark, *[geo.in_ring(F.lit(x), F.lit(0.5), ring) for x in (0.5, 1.5, -0.5)]) == (True, False, False)


def test_middle_vertex_stands_for_a_line(spark):
    line = points(spark, (0, 0), (1, 1), (2, 2), (3, 3))
    assert tuple(one(spark, geo.representative(F.lit("LineString"), line))[0]) == (2, 2)
    assert one(spark, geo.representative(F.lit("Polygon"), line)) == (None,)


def test_tiles(spark):
    x, y = geo.tile(F.lit(21.9), F.lit(43.3), 14)
    lon, lat = geo.tile_corner(x, y, 14)
    got = one(spark, x, y, lon, lat)
    assert got[0] == 9188 and got[2] <= 21.9 < got[2] + 360 / 2**14
    assert one(spark, geo.tile_corner(F.lit(got[0]), F.lit(got[1] + 1), 14)[1])[0] < 43.3 <= got[3]
    assert one(spark, *geo.pixel(F.lit(2.0), F.lit(0.0), (0.0, 0.0, 2.0, 10.0), 101, 51)) == (100, 50)
    assert one(spark, geo.decode_height(F.lit(128), F.lit(10), F.lit(128))) == (10.5,)


def test_names_with_unicode_blanks(spark):
    assert one(spark, text.normalize(F.lit(" Rampa  A "))) == ("rampa a",)


def test_rules_first_match_wins(spark):
    names = {
        "most preko reke": "most_prelaz", "bedem, nedostatak rampe": "bedem", "nedostatak rampe": "nedostatak_rampe",
        "ramp nedostatak": "nedostatak_rampe", "nedostatak stepenica": "nedostatak_stepenista", "xyz": "ostalo",
    }
    assert one(spark, *[text.classify(F.lit(n), text.OBSTACLE_RULES) for n in names]) == tuple(names.values())
    assert one(spark, text.stairs_or_ramp(F.lit("rampa")), text.stairs_or_ramp(F.lit("?")), text.layer_of(F.lit("Other"))) == ("rampe", "stepenice", None)
    assert one(spark, text.bucket(F.lit("klupe")), text.bucket(F.lit("ostalo"))) == ("klupe", "urbana_ostalo")
    assert one(spark, text.label_of(F.lit("bedem"), {"bedem": "Wall"}), text.label_of(F.lit("q"), {"bedem": "Wall"})) == ("Wall", "q")


def test_redaction_and_links(spark):
    assert one(spark, text.redact(F.lit(" x a@b.co http://u 018/123-456 "))) == ("x [e-mail] [link] [telefon]",)
    html = "<img src=\"a?fife=s16\"> <img class='q' src='b'><img src=\"a?fife=s16\">"
    urls, sized = one(spark, text.image_urls(F.lit(html)), text.resized(F.lit("a?fife=s16")))
    assert urls == ["a?fife=s16", "b"] and sized == "a?fife=s1024"
    assert len(one(spark, text.content_id(F.lit("u")))[0]) == 16


def test_image_patterns(spark):
    urls = one(spark, text.image_urls(F.lit("<IMG alt=1 SRC='a'><img src=\"b\">")), text.resized(F.lit("a?fife=w200-h300")), text.resized(F.lit("a?xfife=s16&fife=s16")))
    assert urls == (["a", "b"], "a?fife=w200-h300", "a?xfife=s16&fife=s1024")


def test_redaction_searches_no_run_twice(spark):
    import random

    r = random.Random(2)
    rows = [("".join(r.choice("ab@@.. \u00a0:/h") for _ in range(r.randint(0, 30))),) for _ in range(3000)] + [("x" * 200_000 + "@a.b " + "y@" * 50_000,)]
    df = spark.createDataFrame(rows[:-1], "t string")
    bad = df.filter(F.regexp_replace("t", text.EMAIL_PATTERN, "[e-mail]") != F.regexp_replace("t", r"(?U)(?<!\S)" + text.EMAIL_PATTERN.removeprefix("(?U)"), "[e-mail]"))
    assert bad.count() == 0
    assert spark.createDataFrame(rows[-1:], "t string").select(text.redact(F.col("t"))).first()[0].startswith("[e-mail] y@y@")


def test_text_for_display(spark):
    got = one(spark, text.popup(F.lit(" \u00a0"), F.lit(12.5), F.array(F.lit("i")), "d/", last={"stanje": F.lit("s"), "x": F.lit(None).cast("string")}, kategorija=F.lit("k"), podloga=F.lit("")), text.deep_link("https://s", F.lit(1.0), F.lit(2.0), F.lit(14), F.timestamp_millis(F.lit(5))))
    assert got == ('<strong>(bez imena)</strong><br><span class="muted">kategorija: k</span><br><span class="muted">dužina: 13 m</span><br><span class="muted">stanje: s</span><div class="popup-images"><a href="d/i" target="_blank" rel="noopener"><img src="d/i" alt="" loading="lazy"></a></div>', "https://s/@1.00000,2.00000,14z,5t,0b,0p,1m")
    labels = ["Да", "да, можда", "Не", "x", None]
    assert one(spark, *[text.tone(F.lit(v).cast("string"), text.TONE_RULES, text.TONE_PALETTE, F.lit(8)) for v in labels]) == ("#2f6b46", "#d8a93a", "#c0392b", "#4a9367", "#4a9367")


def test_numbers(spark):
    got = one(spark, numbers.share(F.lit(1.0), F.lit(0.0)), numbers.bar_width(F.lit(1.0), F.lit(100.0)), numbers.open_green(F.lit(1.0), F.lit(2.0)), text.metres(F.lit(1234.0)), text.metres(F.lit(999.4)), numbers.ticks(F.lit(1.0), F.lit(5.0), F.lit(2.0)))
    assert got == (0.0, 2.0, 0.0, "1.23 km", "999 m", [2.0, 4.0])
    assert one(spark, numbers.hours_between(F.to_timestamp(F.lit("2026-06-21T05:00:00+02:00")), F.to_timestamp(F.lit("2026-06-21T20:00:00+02:00")))) == (15.0,)
