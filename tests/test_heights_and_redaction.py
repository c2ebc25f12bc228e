import random
import re
import time

import pytest
from pyspark.sql import functions as F

from wayline.functions import text
from wayline.sources import heights


def test_batches_that_fail_are_nulls(spark, tmp_path):
    path = str(tmp_path / "r")
    heights.write_responses(spark.range(250).select(F.col("id").alias("idx"), F.when(F.col("id") != 7, F.col("id") / 2).alias("elev")), path, batch=50)
    (tmp_path / "r" / "batch=1" / "part-x.txt").write_text("")
    for f in (tmp_path / "r" / "batch=2").glob("part-*"):
        f.write_text("<html>429</html>")
    for f in (tmp_path / "r" / "batch=3").glob("*"):
        f.unlink()
    samples = spark.range(260).select(F.col("id").alias("idx"))
    for batches in (1, 4):
        got = {r.idx: r.elev for r in heights.read_heights(path, samples, 260, 50, batches).collect()}
        assert got == {k: None if k == 7 or 100 <= k < 200 or k >= 250 else k / 2 for k in range(260)}
    found = spark.read.format("stored_heights").options(path=f"file://{path}", rows=260, batch=50).load()
    assert found.rdd.getNumPartitions() == 6 and found.count() == 260
    assert spark.read.format("stored_heights").options(path=path, rows=0).load().count() == 0


def plain(t):
    t = re.sub(r"(?i)https?://\S+", "[link]", t)
    t = re.sub(r"\S+@\S+\.\S+", "[e-mail]", t)
    return re.sub(r"\b0\d{1,2}[/\s.\-]?\d{2,4}[/\s.\-]?\d{2,4}\b", "[telefon]", t).strip()


def test_redaction_equals_the_plain_patterns(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("a@@..  b1\u00a0\n0") for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["@b.c", "@@b.c", "a@b.", "a@.c", "a@b.c", "x@y z.w", "http://a@b.c q@r.s"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string").orderBy("k").select(text.redact(F.col("c")).alias("t")).collect()]
    assert got == [plain(t) for t in texts]


@pytest.mark.parametrize("part", ["y@", "@", "a.", "y@b", "x@y.", "http:", "0", "01", " ", "\u00a0 "])
def test_redaction_is_linear(spark, part):
    df = spark.createDataFrame([("z" + part * 500_000 + "z",)], "c string")
    began = time.time()
    df.select(F.length(text.redact(F.col("c")))).collect()
    assert time.time() - began < 5
