"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Misra-Gries counters (Spark's frequent-items aggregate, at most 1/support of them) name the digests that may be
frequent. One more pass counts those exactly; the verified winners, again at most 1/support rows, are broadcast,
so the copies of a frequent text are judged without meeting in one task. All other digests hold fewer than
support * rows copies each and take an ordinary shuffle, after rows equal in digest and id were counted.

Cases: a null text counts as empty; a null id sorts after all others; of rows equal in text and id one stays
(of a frequent text as of any other); an empty table gives an empty table; other columns are carried untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm._common import SPACES, internal, materialize, table, whole_text

#: Share of the rows from which a digest counts as frequent; also bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001
#: Of equal rows, so many are told one after another in one place.
CHUNK = 8192


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text after each run of white space became one space."""
    return F.sha2(F.regexp_replace(whole_text(text), SPACES, " ").cast("binary"), 256)


def frequent_digests(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Of (id, digest) rows, the digests of at least support * rows: digest, first_id, copies."""
    rows = keyed.count()
    candidates = keyed.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return (
        keyed.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") >= F.lit(support * rows))
    )


def duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """Every row as id, keep_id, group_size, kept, text_sha256."""
    keyed = materialize(docs.select(F.col(id).alias("id"), text_digest(text).alias("digest")), "digests")
    winners = materialize(frequent_digests(keyed, support), "frequent")
    # Rows equal in digest and id are counted before they are shuffled, and dealt out again in chunks.
    counted = keyed.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.join(F.broadcast(winners.select("digest", F.col("first_id").alias("keep_id"), F.col("copies").alias("group_size"))), "digest")
    rest = counted.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    named = frequent.unionByName(rest.join(groups, "digest"))
    few = named.filter(F.col("n") <= CHUNK).withColumn("chunk", F.lit(0).cast("long"))
    many = named.filter(F.col("n") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition("digest", "id", "chunk")
    out = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("chunk") * CHUNK))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chunk") == 0) & (F.col("copy") == 1)
    return out.select(F.col("id").alias(id), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    digest, first, copies, rank = internal(docs, "digest", "first", "copies", "rank")
    keyed = materialize(docs.select(F.col(id).alias("id"), text_digest(text).alias("digest")), "digests")
    winners = materialize(frequent_digests(keyed, support), "frequent").toDF(digest, first, copies)
    split = docs.withColumn(digest, text_digest(text)).join(F.broadcast(winners), digest, "left")
    staying = split.filter(F.col(copies).isNull() | F.col(id).eqNullSafe(F.col(first)))
    order = Window.partitionBy(digest).orderBy(F.col(id).asc_nulls_last())
    return staying.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept
  FROM d
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
