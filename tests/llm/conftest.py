import os

import duckdb
import pytest

UGLY = [
    (1, None, "en", "s1"), (2, "", "en", None), (3, "   \t\n", None, "s1"), (4, "one", "en", "s1"), (4, "one", "en", "s1"), (None, "one", "en", "s2"),
    (None, None, None, None), (5, "  one ", "de", "s2"), (6, "naïve café — 中文 😀 a@b.co +1 (219) 555-0563 4111 1111 1111 1111 1.2.3.4", "en", "s2"),
    (7, "w" * 30_000, "en", "s1"), (8, " ".join(f"word{k % 977}" for k in range(30_000)), "en", "s1"), (8, "another text under the same id", "en", "s1"),
    (-9, " ".join(["same"] * 60), "en", "s3"), (10, " ".join(["same"] * 60), "en", "s3"), (11, "a\x00b \x0b c\x85d", "en", "s3"),
]


@pytest.fixture(scope="session")
def ugly(spark):
    """Nulls, blanks, very long texts, repeated rows and ids, and columns with names that operators like to use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(UGLY, "doc_id long, text string, lang string, source string")
    names = ("id", "digest", "__digest", "size", "target", "taken", "kept", "node", "rid", "hash", "score", "ids", "label", "s_", "dropped", "n", "block", "v", "__size", "spans", "component_id")
    return df.withColumns({n: F.lit(None).cast("string") for n in names})


@pytest.fixture(scope="session")
def nothing(ugly):
    return ugly.limit(0)


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return c


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
