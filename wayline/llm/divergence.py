"""How far the sources of each language diverge in their words, and by which words: exact chi-square like sums.

A group is a language and a source; a language alone is one too, for reference. A term is kept in a language if at
least LEAST_DOCS of its documents have it; V is the number of kept terms. A group's p of a term is
1 + floor(ONE * (count + 1) / (N + V)), with N the sum of its counts, and f(p, q) = floor((p - q)^2 / q).

pair: for each two sources s, t of a language the sum of f(p_s, p_t) over all V terms. Most counts are 0, so the sum is
not taken term by term. It starts at V * f(z_s, z_t), where z is the p of a count of 0, and postings of the inverted
index (term: sources that have it, with their p) add only what differs from that:
  - where s has the term, f(p_s, z_t) - f(z_s, z_t), as if t had it not. This depends on the term through p_s alone,
    so the postings of s with the same p are taken together: a histogram of s, joined to its pairs;
  - where t has it, f(z_s, p_t) - f(z_s, z_t), likewise;
  - where both have it, what the two are wrong by: f(p_s, p_t) - f(p_s, z_t) - f(z_s, p_t) + f(z_s, z_t). Only here is a
    posting list joined with itself, on (language, term), each two sources once, for both directions.
term: a source's terms with p above the language's q by f(p, q); a window keeps the first ranks.

The index is partitioned by (language, term), which splits a hot source over all its terms; counts are partial sums before their
shuffle. The pairs are the result itself, so nothing is larger than texts, index or result. p takes decimals and f fits 64
bits, so all is exact.

Cases: null text, language or source count as empty; a source without kept terms, or with no terms at all, has N = 0;
V = 0 gives 0 for each pair; repeated rows count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm._common import materialize, table

#: A byte as it stands in a term; what is in none is a space. Bytes from 0x80 on are parts of other letters.
_AS_TERMS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Counts that a task holds, and rows that it hands on at once.
ENTRIES = 400_000
ROWS = 65_536
LEAST_DOCS = 3
ONE = 1_000_000_000
RANKS = 200


def scaled(count: Column, n: Column, v: Column) -> Column:
    """p of a count; exact, whatever the counts."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * whole(count + 1), whole(n + v))


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it). docs: lang, source, text, none null.

    A byte of a text is a separator, a letter to lower, or stays, so terms are found on the UTF-8 bytes. Each task adds up at most
    ENTRIES counts, and what one more text brings, before it hands them on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                words = text.as_buffer().to_pybytes().translate(_AS_TERMS).split()
                n, in_docs = found.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                in_docs.update(set(words))
                held += len(n)
                if held > ENTRIES:
                    yield from _rows(found)
                    found, held = {}, 0
        yield from _rows(found)

    rows = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rows(found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in found.items():
        for first in range(0, len(n), ROWS):
            terms = list(islice(n, first, first + ROWS))
            same = lambda v: pa.repeat(pa.scalar(v, pa.string()), len(terms))  # noqa: E731, B023
            columns = [same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    d = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(d).withColumns({"in_docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term)}).filter(F.col("in_docs") >= least_docs)
    counted = counted.withColumn("first", (F.row_number().over(of_term.orderBy("source")) == 1).cast("int")).select("lang", "source", "term", "n", "n_lang", "first")
    counted = materialize(counted, "term-counts")

    sizes = counted.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.sum("first").alias("v"))
    groups = d.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["n_source", "v"])
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"all_n": F.sum("n_source").over(of_lang), "all_v": F.sum("v").over(of_lang)}).select("lang", "source", "n_source", "all_n", F.col("all_v").alias("v"))
    groups = materialize(groups.withColumn("z", F.when(F.col("v") > 0, scaled(F.lit(0), F.col("n_source"), F.col("v")))), "sources")
    index = counted.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "z", scaled(F.col("n"), F.col("n_source"), F.col("v")).alias("p"), scaled(F.col("n_lang"), F.col("all_n"), F.col("v")).alias("q")
    )
    index = materialize(index, "postings")

    def side(df: DataFrame, mark: str, *columns: str) -> DataFrame:
        return df.select("lang", *(F.col(c).alias(f"{c}_{mark}") for c in columns))

    z_s, z_t, p_s, p_t = (F.col(c) for c in ("z_s", "z_t", "p_s", "p_t"))
    pairs = side(groups, "s", "source", "z", "v").join(side(groups, "t", "source", "z"), "lang").filter("source_s <> source_t")
    zero = f(z_s, z_t)
    start = pairs.select("lang", "source_s", "source_t", F.coalesce(F.col("v_s") * zero, F.lit(0)).alias("value"))
    alike = materialize(index.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")), "alike")
    from_s = side(alike, "s", "source", "p", "m").join(pairs, ["lang", "source_s"]).groupBy("lang", "source_s", "source_t").agg(F.sum(F.col("m_s") * (f(p_s, z_t) - zero)).alias("value"))
    from_t = side(alike, "t", "source", "p", "m").join(pairs, ["lang", "source_t"]).groupBy("lang", "source_s", "source_t").agg(F.sum(F.col("m_t") * (f(z_s, p_t) - zero)).alias("value"))
    both = side(index, "s", "source", "z", "p", "term").withColumnRenamed("term_s", "term").join(side(index, "t", "source", "z", "p", "term").withColumnRenamed("term_t", "term"), ["lang", "term"]).filter("source_s < source_t")
    wrong = lambda ps, zs, pt, zt: f(ps, pt) - f(ps, zt) - f(zs, pt) + f(zs, zt)
    both = both.groupBy("lang", "source_s", "source_t").agg(F.sum(wrong(p_s, z_s, p_t, z_t)).alias("there"), F.sum(wrong(p_t, z_t, p_s, z_s)).alias("back"))
    turned = F.explode(F.array(*(F.struct(F.col(a).alias("source_s"), F.col(b).alias("source_t"), F.col(c).alias("value")) for a, b, c in (("source_s", "source_t", "there"), ("source_t", "source_s", "back")))))
    both = both.select("lang", turned.alias("e")).select("lang", "e.*")
    sums = reduce(DataFrame.unionByName, (start, from_s, from_t, both)).groupBy("lang", "source_s", "source_t").agg(F.sum("value").alias("value"))

    by_rank = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pair = by_rank(sums.select("lang", F.col("source_s").alias("source"), F.lit("pair").alias("part"), F.col("source_t").alias("item"), "value"))
    above = index.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    return pair.unionByName(by_rank(above).filter(F.col("rank") <= ranks))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


_SQL_P = "(1 + (1000000000::HUGEINT * ({c} + 1)) // ({n} + {v}))"
OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3
), lang_n AS (
  SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, coalesce(sum(c.n), 0)::BIGINT AS n, coalesce(any_value(l.v), 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c USING (lang, source) LEFT JOIN lang_n l ON s.lang = l.lang GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_SQL_P.format(c="coalesce(c.n, 0)", n="g.n", v="g.v")} AS p,
         {_SQL_P.format(c="kept.n", n="l.n", v="l.v")} AS q
  FROM g JOIN kept USING (lang) JOIN lang_n l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
