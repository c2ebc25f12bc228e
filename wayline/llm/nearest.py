"""Nearest neighbours by additive quantisation: codes bound every score, and what a bound lets through is scored exactly.

A vector is coded as a sum of one codeword from each of CODEBOOKS full-dimensional codebooks. The codebooks are
learned one after another on the residuals of a sample of SAMPLE vectors, taken in hash order of their values. Every
vector is coded by beam search: BEAM partial sums go from codebook to codebook, those nearest to the vector. With the
code go the squared norm of the sum and the length of what it leaves, so inner product and Euclidean search both need
only a table of the query's products with all codewords: a candidate's score is a sum of CODEBOOKS table entries, off by
at most the query's length times the length that was left (Cauchy-Schwarz), and by the rounding of the sum.

Equal vectors are coded once; a class of copies stands for its smallest ids, of which a search for k needs k + 1.
Codes and vectors are kept in blocks of BLOCK rows, at most BLOCK_BYTES. Queries come in batches of QUERY_BATCH, whose
vectors are broadcast (at most QUERY_BYTES): each batch is one pass over the blocks, in which a task keeps the k + 1 best
classes for each query. A block's codes are scored for all queries; every vector whose bound reaches the worst of the best
so far is scored on the original vectors in double precision, so the result is that of brute force, whatever the rows
and however well the codebooks fit them: they decide only how many vectors are scored. Nothing of the codes is shuffled or
copied, and the tasks of a pass do not grow with the queries. A pass first goes through one block of each square root of
its tasks: the worst of the best there is a floor from which the tasks of the other blocks start.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id;
vectors of different lengths are searched apart, each among those of its length; rows of equal id and vector count
once, and of differing vectors under one id each is a candidate and a query of its own; ties go to the smaller id; with
fewer than k candidates all are returned; components that are not floats are read as doubles; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm._common import forget, materialize, materialize_all, table

CODEBOOKS, CODEWORDS = 32, 256
SAMPLE = 16_384
BEAM = 4
#: If the bounds of a block let through more than these for a query, so many of best score by code are scored first, to raise the bar.
RERANKED = 400
BLOCK, QUERY_BATCH = 8192, 8192
BLOCK_BYTES, QUERY_BYTES = 4 << 20, 16 << 20
#: Queries that meet a block at once.
QUERIES_AT_ONCE = 16
ROUNDS = 8


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def learn_codebooks(sample: np.ndarray, seed: int = 7) -> np.ndarray:
    """(CODEBOOKS, codewords, dimension) float32, each codebook on what the ones before leave."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    books = []
    for _ in range(CODEBOOKS):
        book = kmeans(rest, min(CODEWORDS, len(rest)), rng)
        rest = rest - book[np.argmax(rest @ book.T - 0.5 * (book**2).sum(1), axis=1)]
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, CODEBOOKS) as bytes, and the squared norms of the coded vectors."""
    n, d = x.shape
    rest = x.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        k = len(book)
        cost = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, -1, k) + (book**2).sum(1)
        cost = cost.reshape(n, -1)
        width = min(beam, cost.shape[1])
        best = np.argpartition(cost, width - 1, axis=1)[:, :width]
        from_, word = best // k, best % k
        rest = np.take_along_axis(rest, from_[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    best = np.argmin((rest**2).sum(2), axis=1)
    coded = x - rest[np.arange(n), best]
    return codes[np.arange(n), best], (coded**2).sum(1).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def left(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of coded vectors the squared norms of the codes' sums, the lengths of what these leave, and bounds on the rounding
    of a sum of table entries for a query of length 1."""
    coded, words = np.zeros(x.shape), np.zeros(len(x))
    for book, code in zip(books.astype(np.float64), codes.T, strict=True):
        coded += book[code]
        words += np.sqrt((book**2).sum(1))[code]
    return (coded**2).sum(1), np.sqrt(((x - coded) ** 2).sum(1)) * (1 + 1e-12), words * ((x.shape[1] + len(books) + 16) * 2.0**-24) + 1e-36


def _coder(books, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                given = _matrix(rows.column(2))
                x = given.astype(np.float64) / scale
                codes, _ = encode(x.astype(np.float32), books.value)
                packed = [pa.array([row.tobytes() for row in each], pa.binary()) for each in (codes, given)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *packed, *map(pa.array, left(x, codes, books.value))], names=["class", "least", "code", "vector", "norm", "rest", "slack"])

    return run


def lengths(x: np.ndarray) -> np.ndarray:
    """Of each row that is not zero, whatever the size of its components."""
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


class Best:
    """The keep best classes of one query: largest score, then smallest id."""

    def __init__(self, keep: int, floor: float) -> None:
        self.keep, self.bar = keep, floor
        self.score, self.least, self.name = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, least: np.ndarray, name: np.ndarray) -> None:
        score, least, name = np.concatenate([self.score, score]), np.concatenate([self.least, least]), np.concatenate([self.name, name])
        order = np.lexsort((least, -score))
        order = order[score[order] >= self.bar][: self.keep]
        self.score, self.least, self.name = score[order], least[order], name[order]
        if len(order) == self.keep:
            self.bar = float(self.score[-1])


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """The measure of q and each row of v, summed one component after another."""
    each = q * v if metric == "ip" else -((q - v) ** 2)
    return np.cumsum(each, axis=1)[:, -1] + 0.0


def _scanner(books, scale: float, asked, metric: str, keep: int, reranked: int):
    """Of each query in asked (numbers, vectors, floors) the keep best of a task's blocks, none below its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, given, floors = asked.value
        queries = given.astype(np.float64)
        sizes = lengths(queries / scale)
        units = (queries / scale / sizes[:, None]).astype(np.float32)
        words = books.value.reshape(-1, books.value.shape[2])
        best = [Best(keep, floor) for floor in floors.tolist()]
        for batch in batches:
            for k in range(batch.num_rows):
                names, least, norms, rest, slack = (batch.column(c)[k].values.to_numpy() for c in ("classes", "leasts", "norms", "rests", "slacks"))
                codes = np.frombuffer(b"".join(batch.column("codes")[k].as_py()), np.uint8).reshape(len(names), -1).T.copy()
                v = np.frombuffer(b"".join(batch.column("vectors")[k].as_py()), given.dtype).reshape(len(names), -1).astype(np.float64)
                own_sizes = lengths(v)
                for at in range(0, len(queries), QUERIES_AT_ONCE):
                    part = slice(at, at + QUERIES_AT_ONCE)
                    tables = (units[part] @ words.T).reshape(len(units[part]), len(codes), -1)
                    near = np.zeros((len(tables), len(names)), np.float32)
                    for m, code in enumerate(codes):
                        near += tables[:, m][:, code]
                    size, bars = sizes[part, None], np.array([b.bar for b in best[part]])
                    if metric == "ip":  # in terms of vectors divided by scale and queries of length 1
                        unit, most = scale * size[:, 0], near + (rest + slack)
                    else:
                        unit = np.full(len(near), scale)
                        near = 2 * size * near - norms - size**2
                        most = -(np.maximum(np.sqrt(np.maximum(-near - 2 * size * slack - (size**2 + norms) * 2.0**-40, 0)) - rest, 0) ** 2) * (1 - 1e-12)
                    reach = most >= (bars / scale / unit)[:, None]
                    every = queries[part] @ v.T if reach.mean() > 1 / 8 else None
                    for j in np.flatnonzero(reach.any(axis=1)):
                        q, own, there = queries[at + j], best[at + j], np.flatnonzero(reach[j])
                        parts = [there]
                        if len(there) > reranked:
                            order = np.argpartition(-near[j, there], reranked)
                            parts = [there[order[:reranked]], there[order[reranked:]]]
                        for some in parts:
                            some = some[most[j, some] >= own.bar / scale / unit[j]]
                            about = every[j, some] if every is not None else v[some] @ q
                            if metric == "l2":
                                about = 2 * about - own_sizes[some] ** 2 - q @ q
                            length = scale * sizes[at + j]
                            off = (len(q) + 16) * 2.0**-51 * (length * own_sizes[some] if metric == "ip" else (length + own_sizes[some]) ** 2)
                            low = about - off  # what is surely below the keep-th best, or the bar, needs no exact score
                            bar = max(own.bar, float(np.partition(low, -keep)[-keep]) if len(low) >= keep else own.bar)
                            some = some[about + off >= bar]
                            for begin in range(0, len(some), 1024):
                                piece = some[begin : begin + 1024]
                                own.add(scores(q, v[piece], metric), least[piece], names[piece])
        for at in range(0, len(best), 1024):
            some = best[at : at + 1024]
            each = np.repeat(numbers[at : at + 1024], [len(b.score) for b in some])
            found = [np.concatenate([getattr(b, c) for b in some]) for c in ("name", "least", "score")]
            yield pa.RecordBatch.from_arrays([pa.array(each), *map(pa.array, found)], names=["query", "class", "least", "near"])

    return run


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """id and v, an array of floats or doubles, of the rows that take part."""
    v, kind = F.col("v"), "float" if vectors.schema[vector].dataType.elementType == T.FloatType() else "double"
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine)
    return materialize(rows.distinct(), "vectors")


def _product(a: Column, b: Column, metric: str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double") if metric == "ip" else -((x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", metric: str = "ip", reranked: int = RERANKED) -> DataFrame:
    """query_id, rank, id and score of the k nearest of each query, itself left out. is_query: a condition on the id column, named id.

    metric: ip (inner product) or l2 (minus the squared distance); reranked: see RERANKED, the result is the same with any.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id, vector)
    lengths = [r["d"] for r in rows.filter(is_query).select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    found = [_search(rows.filter(F.size("v") == d), is_query, d, k, metric, reranked) for d in lengths]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "query_id long, rank int, id long, score double")


def _search(rows: DataFrame, is_query: Column, length: int, k: int, metric: str, reranked: int) -> DataFrame:
    """search() among distinct rows (id, v) of one length, at least one of them a query."""
    spark = rows.sparkSession
    # Of equal vectors k + 1 ids are enough: first within each of 64 parts, then of these.
    part = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
    few = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    classes = materialize(few.withColumn("class", F.monotonically_increasing_id()), "classes")

    # A power of two, so that products of components stay within a float.
    scale = 2.0 ** math.frexp(classes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])[1]
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    books = spark.sparkContext.broadcast(learn_codebooks(_matrix(sample).astype(np.float64) / scale))
    kept = "class long, least long, code binary, vector binary, norm double, rest double, slack double"
    codes = classes.select("class", F.col("ids")[0].alias("least"), "v").mapInArrow(_coder(books, scale), kept)
    n_blocks = -(-classes.count() // min(BLOCK, max(1, BLOCK_BYTES // (4 * length))))
    blocks = codes.groupBy(F.pmod(F.xxhash64("class"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct(*codes.columns)).alias("rows"))
    plural = {"class": "classes", "least": "leasts", "code": "codes", "vector": "vectors", "norm": "norms", "rest": "rests", "slack": "slacks"}
    blocks = blocks.select("block", *[F.col(f"rows.{one}").alias(many) for one, many in plural.items()])
    n_tasks = min(n_blocks, max(4 * spark.sparkContext.defaultParallelism, n_blocks // 16))
    blocks = materialize(blocks.repartition(n_tasks), "codes")
    first = F.col("block") % max(1, math.isqrt(n_tasks)) == 0

    asking = rows.filter(is_query)
    n_batches = -(-asking.count() // min(QUERY_BATCH, max(1, QUERY_BYTES // (4 * length))))
    numbered = asking.withColumns({"query": F.monotonically_increasing_id(), "batch": F.pmod(F.xxhash64("id"), F.lit(n_batches)).cast("int")})
    asking = materialize(materialize(numbered, "numbered").repartitionByRange("batch").sortWithinPartitions("batch"), "queries")

    keep = k + 1  # one of them may be the query's own class, with no other id
    best = Window.partitionBy("query").orderBy(F.desc("near"), "least")

    def scan(part: DataFrame, asked) -> DataFrame:
        return part.mapInArrow(_scanner(books, scale, asked, metric, keep, reranked), "query long, class long, least long, near double")

    def cut(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep).drop("n")

    def passes() -> Iterator[DataFrame]:
        for b in range(n_batches):
            batch = asking.filter(F.col("batch") == b).select("query", "v").toArrow().combine_chunks()
            if not batch.num_rows:
                continue
            numbers, queries = batch["query"].to_numpy(), _matrix(batch["v"].combine_chunks())
            asked = spark.sparkContext.broadcast((numbers, queries, np.full(len(numbers), -np.inf)))
            pilot = materialize(cut(scan(blocks.filter(first), asked)), "pilot")
            asked.destroy()
            full = pilot.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).filter(F.col("n") == keep)
            floor = {r["query"]: r["near"] for r in full.collect()}  # one number for each query of the batch
            asked = spark.sparkContext.broadcast((numbers, queries, np.array([floor.get(q, -np.inf) for q in numbers.tolist()])))
            yield cut(pilot.unionAll(scan(blocks.filter(~first), asked))).select("query", "class")
            forget(pilot)
            asked.destroy()

    near = materialize_all(passes(), "near")
    of_query = asking.select("query", F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = near.join(classes, "class").join(of_query, "query")
    each = exact.select("query", "query_id", (F.col("q") == F.col("v")).alias("equal"), _product(F.col("q"), F.col("v"), metric).alias("score"), F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = each.filter("id <> query_id or not equal").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
