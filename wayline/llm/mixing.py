"""Mixing sources to target weights, in DataFrame operations only.

Each row gets a hash-random key. Within each source the key space is cut into ranges of about ROWS_IN_RANGE rows,
so no source, however large, is sorted in one task: sizes are summed by range and by block of ranges, these totals give
each range its offset in its source, and a window inside the range adds the rest. A source takes floor(target / size) whole
epochs, then the rows at the front of its order up to its exact budget; the row on the cut is taken if at least
half of it fits.

Cases: a null text has size 0 and a null source is a source of its own, last in order; rows with equal ids are
ordered by id and text together and take part one by one; which of several rows equal in both is taken is open; a source of size 0 has target 0; an empty table gives an empty
table; other columns are carried untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm._common import WORD, internal, materialize, table, whole_text

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
ROWS_IN_RANGE = 4096
#: Ranges are summed up in blocks, so their offsets too are found in parts.
RANGES_IN_BLOCK = 4096


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def row_key(id: str, text: str) -> Column:
    """A digest of id and text, so rows that share an id, or have none, are spread too."""
    whole = F.md5(whole_text(text).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit("|"), whole).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Of (source, rows, size) rows, one for each source: the same and target.

    The targets share the sum of all sizes by weight. A target stops at most_epochs * size and the excess is
    shared anew until none is above, which has one solution: with the sources ordered by size / weight, the first
    k are at their stop, and the rest take level * weight. There is one row for each source here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    named = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("size") * most_epochs
    filled = Window.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    levels = named.withColumn(
        "level", (F.sum("size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    ).withColumn("fits", F.col("level") * F.col("weight") <= cap)
    level = F.min(F.when(F.col("fits"), F.struct(cap / F.col("weight"), F.col("level")))).over(all_rows)
    return levels.withColumn("open", level["level"]).select(
        "source", "rows", "size", F.least(F.coalesce(F.col("open") * F.col("weight"), cap.cast("double")), cap.cast("double")).alias("target")
    )


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS, rows_in_range: int = ROWS_IN_RANGE,
) -> tuple[DataFrame, dict[str, str]]:
    """The rows of docs with five more columns; and their names by size, source_size, target, copies, taken."""
    names = dict(zip(("size", "source_size", "target", "copies", "taken"), internal(docs, "size", "source_size", "target", "copies", "taken"), strict=True))
    key, part, place, total, rows, s_, r_ = internal(docs, "key", "range", "place", "total", "source_rows", "s", "r")
    src = internal(docs, "source")[0]
    size = names["size"]

    sized = docs.withColumns({size: word_count(text), src: F.col(source), key: row_key(id, text)})
    slim = materialize(sized.select(F.col(src).alias("source"), F.col(key).alias("key"), F.col(size).alias("size")), "sizes")
    totals = slim.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
    targets = materialize(source_targets(totals, weights, most_epochs), "targets")

    def range_of(key: Column, rows: Column) -> Column:
        """The key's range: its first 32 bits scaled to the number of ranges of its source."""
        ranges = F.ceil(rows / F.lit(rows_in_range))
        return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * ranges).cast("long")

    same = lambda a, b: a.eqNullSafe(b)
    t = targets.toDF(*(f"{c}_of_source" for c in targets.columns))
    ranges = (
        slim.join(t, same(slim["source"], t["source_of_source"]))
        .groupBy("source", range_of(F.col("key"), F.col("rows_of_source")).alias("range"))
        .agg(F.sum("size").alias("size"), F.first("rows_of_source").alias("rows"), F.first("size_of_source").alias("source_size"), F.first("target_of_source").alias("target"))
        .withColumn("block", F.floor(F.col("range") / RANGES_IN_BLOCK))
    )
    ranges = materialize(ranges, "ranges")
    earlier = lambda *by, order: F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = ranges.groupBy("source", "block").agg(F.sum("size").alias("size")).select(F.col("source").alias("s"), F.col("block").alias("b"), earlier("source", order="block").alias("ahead"))
    inside_block = ranges.withColumn("before", earlier("source", "block", order="range"))
    offsets = inside_block.join(blocks, same(F.col("source"), F.col("s")) & (F.col("block") == F.col("b"))).select(
        F.col("source").alias(s_), F.col("range").alias(r_), (F.col("before") + F.col("ahead")).alias(total), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"])
    )
    rows_of = targets.select(F.col("source").alias(s_), F.col("rows").alias(rows))
    placed = sized.join(rows_of, same(F.col(src), F.col(s_)), "left").drop(s_).withColumn(part, range_of(F.col(key), F.col(rows)))
    placed = placed.join(offsets, same(F.col(src), F.col(s_)) & (F.col(part) == F.col(r_)), "left").drop(s_, r_)
    inside = Window.partitionBy(src, part).orderBy(key, F.col(id).asc_nulls_last(), size).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col(total) + F.coalesce(F.sum(size).over(inside), F.lit(0))
    whole = F.coalesce(F.floor(F.try_divide(F.col(names["target"]), F.col(names["source_size"]))), F.lit(0))
    placed = placed.withColumn(place, before).withColumn(names["copies"], (whole + F.when(
        (F.col(size) > 0) & (F.col(place) + F.col(size) / 2 <= F.col(names["target"]) - whole * F.col(names["source_size"])), 1
    ).otherwise(0)).cast("long"))
    placed = placed.withColumn(names["taken"], F.col(names["copies"]) * F.col(size))
    return placed.select(*docs.columns, *names.values()), names


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as often as the mix takes it, with the columns of docs."""
    found, names = mix(docs, **options)
    again = internal(found, "again")[0]
    taken = found.filter(F.col(names["copies"]) > 0)
    return taken.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", *(F.col(n[c]).alias(c) for c in ("size", "source_size", "target", "taken")))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / (sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM w
), m AS (
  SELECT arg_min(lvl, 3.0::DOUBLE * source_size / weight) AS lvl FROM l WHERE lvl * weight <= 3 * source_size
), t AS (
  SELECT source, source_size, least(coalesce(m.lvl * weight, 3.0::DOUBLE * source_size), 3.0::DOUBLE * source_size)::DOUBLE AS target FROM w LEFT JOIN m ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND place + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
