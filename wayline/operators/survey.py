"""Survey tabulation. responses: row_idx and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.text import redact
from wayline.operators import scan

LEAST_COMMENT = 15


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|(?<!\s)\s++$", "")


def long_answers(responses: DataFrame, questions: dict[str, tuple[str, str]], separator: str = ";") -> DataFrame:
    """row_idx, question, label for every answer of every question: {name: (column, 'single' or 'multi')}, in one pass.

    Of a multiple choice each option counts once for a respondent; blank answers are left out.
    """
    each = [
        F.struct(
            F.lit(name).alias("question"),
            (F.array_distinct(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), separator), _trim)) if kind == "multi" else F.array(_trim(F.col(column)))).alias("labels"),
        )
        for name, (column, kind) in questions.items()
    ]
    rows = responses.select("row_idx", F.explode(F.array(*each)).alias("a"))
    return rows.select("row_idx", "a.question", F.explode("a.labels").alias("label")).filter("label <> ''")


def tabulate(answers: DataFrame) -> DataFrame:
    """question, label, n, base (who answered at all), first (row that named the label first), rank (by n, then first)."""
    counts = answers.groupBy("question", "label").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    base = answers.groupBy("question").agg(F.countDistinct("row_idx").alias("base"))
    order = Window.partitionBy("question").orderBy(F.desc("n"), "first", "label")
    return counts.join(base, "question").withColumn("rank", F.row_number().over(order))


def top_and_other(counts: DataFrame, *by: str, most: int = 7, least: int = 5, other: str = "other") -> DataFrame:
    """*by, label, n, merged: the first most labels with n of at least least; the rest as one, with how many it holds."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "label")
    own = (F.row_number().over(order) <= most) & (F.col("n") >= least)
    named = counts.withColumn("own", own)
    return named.groupBy(*by, F.when(F.col("own"), F.col("label")).otherwise(other).alias("label"), "own").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("merged")).withColumn("merged", F.when(F.col("own"), 0).otherwise(F.col("merged"))).drop("own")


def keep_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """Of rows of equal key the first. Each task keeps one row of a key before the shuffle, so no task meets all of them."""
    return rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")


def comments(responses: DataFrame, column: str, seed: int = 42, least: int = LEAST_COMMENT) -> DataFrame:
    """ord, text: comments redacted, then those of at least least characters, each once whatever its case, in a mixed
    order that stays the same. ord is a position among all of them, counted by ranges, so no task sorts them all."""
    clean = responses.select("row_idx", redact(F.col(column)).alias("text")).filter(F.length("text") >= least)
    once = keep_first(clean, F.lower("text"), "row_idx")
    drawn = once.withColumn("drawn", F.md5(F.concat(F.lit(f"{seed}:"), F.col("text")).cast("binary")))
    return scan.positions(drawn, [], ["drawn", "row_idx"], "at").select((F.col("at") + 1).cast("int").alias("ord"), "text")
