import pytest
from pyspark.sql import functions as F

from wayline.operators import survey
from wayline.sources import writers
from wayline.streaming import tabulation


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_stamp_is_computed_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def compute(*v):
        calls.append(v)
        return table(spark, *v)

    for stamp, v, want in (("a", 1, [1]), ("a", 2, [1]), ("b", 3, [3]), ("a", 4, [4])):
        assert values(writers.computed(spark, path, {"input": stamp}, lambda v=v: compute(v))) == want
    assert calls == [(1,), (3,), (4,)]
    assert writers.prune(spark, path) == 2 and values(writers.computed(spark, path, {"input": "a"}, lambda: compute(9))) == [4]


@pytest.mark.parametrize("when", ["while writing", "before the manifest"])
def test_a_failure_leaves_the_old_result(spark, tmp_path, monkeypatch, when):
    path = str(tmp_path / "t")
    old = writers.computed(spark, path, {"input": "a"}, lambda: table(spark, 1, 2))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        if when == "while writing":
            writers.publish(spark, path, {"input": "b"}, lambda to: (table(spark, 7).write.parquet(to), fail()))
        else:
            m.setattr(writers, "_names", fail)
            writers.publish(spark, path, {"input": "b"}, lambda to: table(spark, 7).write.parquet(to))
    assert writers.published(spark, path)["input"] == "a"
    assert values(old) == [1, 2] and values(writers.computed(spark, path, {"input": "a"}, fail)) == [1, 2]
    assert values(writers.computed(spark, path, {"input": "b"}, lambda: table(spark, 7))) == [7] and values(old) == [1, 2]


def test_fingerprint_tells_rows_not_storage(spark):
    a = spark.range(10_000).select("id", (F.col("id") * 3).alias("v"))
    same = writers.fingerprint(a, "id")
    assert writers.fingerprint(a.repartition(7), "id") == same and len(same) == 16
    assert writers.fingerprint(a.withColumn("v", F.when(F.col("id") == 9_999, 0).otherwise(F.col("v"))), "id") != same
    assert writers.fingerprint(a.limit(0), "id") == ""


QUESTIONS = {"m": ("m", "multi"), "s": ("s", "single")}


def answers(spark, first, rows):
    return spark.createDataFrame([(first + k, *r) for k, r in enumerate(rows)], "row_idx long, m string, s string")


def test_batches_make_the_tabulation_of_all(spark, tmp_path):
    path, source = str(tmp_path / "state"), str(tmp_path / "in")
    parts = [answers(spark, 0, [("a; b;a", "x"), (None, " "), ("c", "y")]), answers(spark, 3, [("b", "y"), ("b;d", None)]), answers(spark, 5, [("a", "z"), ("", "x")])]
    whole = parts[0]
    shown = lambda df: sorted(map(str, df.select("question", "label", "n", "base", "first", "rank").collect()))
    assert shown(tabulation.tabulation(spark, path)) == []
    for k, p in enumerate(parts):
        p.write.mode("append").parquet(source)
        stream = spark.readStream.schema(p.schema).parquet(source)
        tabulation.start(stream, path, str(tmp_path / "checkpoint"), QUESTIONS).awaitTermination()
        whole = p if k == 0 else whole.unionByName(p)
        assert shown(tabulation.tabulation(spark, path)) == shown(survey.tabulate(survey.long_answers(whole, QUESTIONS)))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    take_in = tabulation.merge(path, QUESTIONS)
    first, second = answers(spark, 0, [("a", "x")]), answers(spark, 1, [("a;b", "x")])
    take_in(first, 0)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        publish = writers.publish
        m.setattr(writers, "publish", lambda spark, path, stamp, write: (write(f"{path}/half"), (_ for _ in ()).throw(RuntimeError()))[1])
        take_in(second, 1)
    assert publish is writers.publish
    want = None
    for batch, number in ((second, 1), (second, 1), (first, 0)):
        take_in(batch, number)
        got = sorted(map(str, tabulation.tabulation(spark, path).collect()))
        want = want or sorted(map(str, survey.tabulate(survey.long_answers(first.unionByName(second), QUESTIONS)).select("question", "label", "n", "first", "base", "rank").collect()))
        assert sorted(map(str, tabulation.tabulation(spark, path).select("question", "label", "n", "first", "base", "rank").collect())) == want and got
