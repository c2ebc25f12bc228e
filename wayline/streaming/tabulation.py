"""Survey tabulation kept up to date over appended responses.

The state is the tabulation itself: a row for each question and label with its count and the first row that named it, and one for
each question with who answered. Each micro-batch is tabulated, merged with the state and published as a new
version whose manifest names the batch. A batch that comes again, after a failure or a restart, is told by its number
and changes nothing; a failure before the manifest leaves the state of the batch before.

Every response arrives in one batch. The state grows with labels, not with responses.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.operators import survey
from wayline.sources import writers

Questions = Mapping[str, tuple[str, str]]


def _counted(answers: DataFrame) -> DataFrame:
    """question, label, n, first; and with label null the respondents of the question."""
    labels = answers.groupBy("question", "label").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    base = answers.groupBy("question").agg(F.countDistinct("row_idx").alias("n"), F.min("row_idx").alias("first"))
    return labels.unionByName(base.withColumn("label", F.lit(None).cast("string")))


def merge(path: str, questions: Questions, separator: str = ";") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: take a batch of responses (row_idx and text columns) into the state at path."""

    def take_in(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = writers.published(spark, path)
        if now and int(now["batch"]) >= number:
            return
        every = _counted(survey.long_answers(batch, dict(questions), separator))
        if now:
            every = every.unionByName(spark.read.parquet(f"{path}/{now['folder']}"))
        state = every.groupBy("question", "label").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        writers.publish(spark, path, {"batch": str(number)}, lambda to: state.write.parquet(to))

    return take_in


def tabulation(spark: SparkSession, path: str) -> DataFrame:
    """What survey.tabulate gives for all responses so far."""
    now = writers.published(spark, path)
    if not now:
        return spark.createDataFrame([], "question string, label string, n long, first long, base long, rank int")
    state = spark.read.parquet(f"{path}/{now['folder']}")
    base = state.filter("label is null").select("question", F.col("n").alias("base"))
    order = Window.partitionBy("question").orderBy(F.desc("n"), "first", "label")
    return state.filter("label is not null").join(base, "question").withColumn("rank", F.row_number().over(order))


def start(responses: DataFrame, path: str, checkpoint: str, questions: Questions, separator: str = ";") -> StreamingQuery:
    """Keep the tabulation at path up to date with what there is of a stream of responses."""
    return responses.writeStream.foreachBatch(merge(path, questions, separator)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
