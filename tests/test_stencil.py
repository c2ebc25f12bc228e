import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wayline.operators import raster


def plain(samples, pixels):
    out = {}
    for idx, px, py in samples:
        if px is None or py is None:
            out[idx] = None
            continue
        seen = [c for c in (pixels.get((px + dx, py + dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) if c]
        land = [c for c in seen if c != "water"] or seen
        n = Counter(land)
        out[idx] = max(n, key=lambda c: (n[c], -seen.index(c))) if n else None
    return out


def test_stencil_equals_nine_lookups(spark):
    """Samples across blocks, beside holes and far from any pixel, on negative pixels too, many in one place."""
    rng = random.Random(2)
    colours = [p[:3] for p in raster.PALETTE if p[4] in ("water", "bare", "tree_cover", "built_up")]
    klass = {p[:3]: p[4] for p in raster.PALETTE}
    grid = {(x, y): rng.choice([*colours, colours[0], (1, 2, 3)]) for x in range(-40, 60) for y in range(-10, 50) if rng.random() < 0.7}
    samples = [(k, rng.randint(-42, 62), rng.randint(-12, 52)) for k in range(3000)] + [(3000 + k, 5, 5) for k in range(500)] + [(4000, None, 3), (4001, 3, None), (4002, 9999, -9999)]
    s = spark.createDataFrame(samples, "idx int, px long, py long").withColumn("more", F.array(F.lit("kept")))
    pixels = spark.createDataFrame([(*k, *v) for k, v in grid.items()], "px long, py long, r int, g int, b int")
    want = plain(samples, {k: klass.get(v) for k, v in grid.items()})
    code = {p[4]: p[3] for p in raster.PALETTE}
    for block in (4, 32):
        got = raster.sample_classes(s, pixels, raster.palette(spark), block=block).collect()
        assert {r.idx: r.klass for r in got} == want and len(got) == len(samples)
        assert all(r.more == ["kept"] and r.code == code.get(r.klass) for r in got)
    assert raster.sample_classes(s.limit(0), pixels, raster.palette(spark)).collect() == []
    assert {r.klass for r in raster.sample_classes(s, pixels.limit(0), raster.palette(spark)).collect()} == {None}


def test_majority_of_codes():
    around = np.array([[80, 80, 50, -1], [80, -1, -1, 80], [60, 50, 50, 60], [-1, -1, -1, -1]])
    assert raster._majority(around, {80}).tolist() == [50, 80, 60, -1]


def test_samples_are_shipped_once(spark):
    """As many rows as there are packs go to the blocks, not nine for each sample."""
    line = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("idx"), F.expr("id div 7").alias("px"), (F.col("id") % 3).alias("py"))
    found = raster.sample_classes(line, line.select("px", "py", F.lit(0).alias("r"), F.lit(100).alias("g"), F.lit(0).alias("b")).distinct(), raster.palette(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20_000 and plan.count("explode(") == 2
    assert {r.klass for r in found.select("klass").distinct().collect()} == {"tree_cover"}
