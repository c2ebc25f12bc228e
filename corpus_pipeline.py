"""From raw documents to a tokenised training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again for the next. All stages but the last keep the columns of documents:
  toxicity      documents that score as toxic go;
  exact_dedup   of documents of equal text one stays;
  near_dedup    of each group of near duplicates one stays;
  mixing        each source is taken as often as its target weight asks, whole epochs repeated;
  sentencepiece doc_id, n_tokens, ids, and digests of the ids and of what they decode to, for each row of the mixture.

Cases: nulls in any column, empty and very long texts, repeated rows and empty tables are handled as each operator
states; further columns pass through the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm._common import forget, materialize, table
from wayline.llm.exact_dedup import drop_exact_duplicates
from wayline.llm.mixing import mixed_rows
from wayline.llm.near_dedup import drop_near_duplicates
from wayline.llm.pieces import encode_decode, model_path, with_digests
from wayline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_digests(encode_decode(docs, model_path())).select("doc_id", "n_tokens", F.col("ids"), "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the nearest-neighbour scores nor the sketches nor the encoder; tests/llm holds both
#: dedup stages against plain versions, toxicity against op5_toxicity, mixing against mixing.mix and 50 rows' ids against the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written: list[DataFrame] = []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        written.append(docs)
        if len(written) > 1:
            forget(written[-2])
    return docs
