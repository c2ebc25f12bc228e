"""Quality of texts by a factorisation machine over hashed words, structure and metadata.

A text's features are its words, hashed into BUCKETS ((1 + ln tf), scaled to length 1), the statistics of its structure
(STATS: lengths, shares of upper case, digits, symbols, other scripts, line ends, of distinct and of most frequent words) and the table's own n_chars,
standardised over the examples. The score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),   v_i of RANK numbers,

and the sum over pairs is half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2, so a text costs RANK times its features.

Learning: of the labelled rows that may be learned from and whose id is in the table, EXAMPLES are taken in hash order of the id, one text for
each id (the least digest, if rows share it). This is the only bound; their texts count whole. They are dealt over tasks of about
EXAMPLES_IN_TASK; in each of ROUNDS rounds every task starts from the same model and runs over its examples in small
batches with AdaGrad, and each weight moves by the mean of what the tasks that met its feature propose. The driver holds
models only, of (BUCKETS + stats) * (RANK + 1) numbers each. Weights of features that no example has stay 0.

Scoring is one pass over the texts with the model as a broadcast of that size.

Cases: a null text is empty, and an empty text is scored by its statistics; a null n_chars is 0 and says so; labels that
are null are not learned, of contradicting labels of one id the larger counts; without labelled rows every score is 0.5; an empty table gives no rows;
other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm._common import internal, materialize, table
from wayline.llm._hashing import slices, word_hashes

BUCKETS = 1 << 16
RANK = 8
EXAMPLES = 16_384
EXAMPLES_IN_TASK = 1024
ROUNDS = 6
BATCH = 32
RATE = 0.1
DECAY = 1e-4
STATS = ("log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "other_scripts", "line_ends", "distinct", "most_frequent", "log_n_chars", "no_n_chars")


@dataclass
class Entries:
    """Features of n texts: row, feature and value of each that is not 0. The first BUCKETS features are words."""

    n: int
    row: np.ndarray
    at: np.ndarray
    x: np.ndarray


def entries(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[Entries, np.ndarray]:
    """The words of texts that lie side by side, and their statistics, a row each. n_chars: NaN where null."""
    n, size = len(offsets) - 1, np.diff(offsets)
    words, where = word_hashes(data, offsets, lower=True)
    count = np.diff(where)
    key = np.repeat(np.arange(n, dtype=np.uint64), count) * np.uint64(BUCKETS) + (words >> np.uint64(40)) % np.uint64(BUCKETS)
    key, tf = np.unique(key, return_counts=True)
    row, at = (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)
    x = 1 + np.log(tf)
    x /= np.sqrt(np.bincount(row, x * x, n))[row]
    most = np.zeros(n)
    np.maximum.at(most, row, tf)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    upper, lower, digit, other = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57), data >= 128
    symbol = (data > 32) & ~(upper | lower | digit | other)
    known = ~np.isnan(n_chars)
    stats = np.stack([
        np.log1p(count), np.log1p(size), size / np.maximum(count, 1), share(upper, size), share(digit, size), share(symbol, size), share(other, size), share(data == 10, size),
        np.bincount(row, minlength=n) / np.maximum(count, 1), most / np.maximum(count, 1), np.log1p(np.maximum(np.where(known, n_chars, 0), 0)), ~known,
    ], axis=1).astype(np.float64)
    return Entries(n, row, at, x), stats


def with_stats(words: Entries, stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Entries:
    z = np.clip((stats - mean) / scale, -4, 4)
    row, k = np.nonzero(z)
    return Entries(words.n, np.concatenate([words.row, row]), np.concatenate([words.at, BUCKETS + k]), np.concatenate([words.x, z[row, k]]))


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # a number for each feature
    v: np.ndarray  # RANK numbers for each feature
    mean: np.ndarray  # of the statistics, over the examples
    scale: np.ndarray

    def sums(self, e: Entries) -> tuple[np.ndarray, np.ndarray]:
        """For each text the logit, and the sum of v_i x_i."""
        logit, sums = self.w0 + np.bincount(e.row, self.w[e.at] * e.x, e.n), np.empty((e.n, self.v.shape[1]))
        for f in range(self.v.shape[1]):
            vx = self.v[e.at, f] * e.x
            sums[:, f] = np.bincount(e.row, vx, e.n)
            logit += (sums[:, f] ** 2 - np.bincount(e.row, vx * vx, e.n)) / 2
        return logit, sums

    def score(self, e: Entries) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(e)[0], -30, 30)))


def trained(m: Machine, e: Entries, labels: np.ndarray, rate: float, batch: int = BATCH) -> Machine:
    """m after one pass over the texts, a step of AdaGrad for each batch."""
    by_row = np.argsort(e.row, kind="stable")
    row, at, x = e.row[by_row], e.at[by_row], e.x[by_row]
    m = Machine(m.w0, m.w.copy(), m.v.copy(), m.mean, m.scale)
    g0, gw, gv = 1.0, np.full_like(m.w, 1e-2), np.full_like(m.v, 1e-2)
    for first in range(0, e.n, batch):
        last = min(first + batch, e.n)
        a, b = np.searchsorted(row, [first, last])
        part = Entries(last - first, row[a:b] - first, at[a:b], x[a:b])
        logit, sums = m.sums(part)
        off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[first:last]) / part.n
        met, place = np.unique(part.at, return_inverse=True)
        ex = off[part.row] * part.x
        dw = np.bincount(place, ex, len(met)) + DECAY * m.w[met]
        dv = np.stack([np.bincount(place, ex * (sums[part.row, f] - m.v[part.at, f] * part.x), len(met)) for f in range(m.v.shape[1])], axis=1) + DECAY * m.v[met]
        d0 = off.sum()
        g0 += d0 * d0
        gw[met] += dw * dw
        gv[met] += dv * dv
        m.w0 -= rate * d0 / np.sqrt(g0)
        m.w[met] -= rate * dw / np.sqrt(gw[met])
        m.v[met] -= rate * dv / np.sqrt(gv[met])
    return m


def _texts(batch: pa.RecordBatch, text: str, n_chars: str) -> Iterator[tuple[int, int, Entries, np.ndarray]]:
    """First row, end, words and statistics of parts of a batch."""
    told = pc.cast(batch.column(n_chars), pa.float64()).to_numpy(zero_copy_only=False)
    for first, end, data, offsets in slices(batch.column(text)):
        yield first, end, *entries(data, offsets, told[first:end].astype(np.float64))


def examples(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """id, label, at, x, stats of at most so many labelled texts. docs: id, text, n_chars; labels: id, label."""
    each = labels.dropna().groupBy("id").agg(F.max("label").alias("label"))
    known = each.join(docs.select("id").distinct(), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)  # ids and labels only

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, e, stats in _texts(batch, "text", "n_chars"):
                cut = np.searchsorted(e.row, np.arange(e.n + 1))
                pack = lambda a, kind: [a[i:j].astype(kind).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(first, e.n), "label": batch.column("label").slice(first, e.n), "digest": batch.column("digest").slice(first, e.n),
                    "at": pa.array(pack(e.at, np.int32), pa.binary()), "x": pa.array(pack(e.x, np.float32), pa.binary()), "stats": pa.array(list(stats), pa.list_(pa.float64())),
                })

    rows = docs.join(F.broadcast(chosen), "id").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).select("id", F.col("label").cast("double").alias("label"), "digest", "text", F.col("n_chars").cast("double").alias("n_chars"))
    found = rows.mapInArrow(extract, "id string, label double, digest string, at binary, x binary, stats array<double>")
    return found.groupBy("id").agg(F.min_by(F.struct("label", "at", "x", "stats"), F.struct("digest", "stats")).alias("e")).select("id", "e.*")


def _round(sent: Broadcast[Machine], rate: float, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a task does in a round: one pass over its examples, in an order drawn by seed; it proposes the weights it met."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").iloc[np.random.default_rng(seed).permutation(len(group))]
        row = np.repeat(np.arange(len(group)), [len(a) // 4 for a in group["at"]])
        words = Entries(len(group), row, np.frombuffer(b"".join(group["at"]), np.int32).astype(np.int64), np.frombuffer(b"".join(group["x"]), np.float32).astype(np.float64))
        old = sent.value
        e = with_stats(words, np.stack(list(group["stats"])), old.mean, old.scale)
        new, met = trained(old, e, group["label"].to_numpy(), rate), np.unique(e.at)
        packed = {n: [a.tobytes()] for n, a in (("met", met.astype(np.int32)), ("w", new.w[met].astype(np.float32)), ("v", new.v[met].astype(np.float32)))}
        return pd.DataFrame({"w0": [new.w0], **packed})

    return run


def learn(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, rank: int = RANK, rounds: int = ROUNDS) -> Machine:
    spark = docs.sparkSession
    found = materialize(examples(docs, labels, most), "examples")
    of_stats = [F.col("stats")[k] for k in range(len(STATS))]
    told = found.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.array(*map(F.avg, of_stats)).alias("mean"), F.array(*map(F.stddev_pop, of_stats)).alias("scale")).first()
    size = BUCKETS + len(STATS)
    if not told["n"]:
        return Machine(0.0, np.zeros(size), np.zeros((size, rank)), np.zeros(len(STATS)), np.ones(len(STATS)))
    scale = np.maximum(np.array(told["scale"]), 1e-3)
    start = 0.01 * np.random.default_rng(7).standard_normal((size, rank))
    m = Machine(float(np.log((told["ones"] + 1) / (told["n"] - told["ones"] + 1))), np.zeros(size), start.copy(), np.array(told["mean"]), scale)
    tasks = -(-told["n"] // EXAMPLES_IN_TASK)
    dealt = found.withColumn("task", F.pmod(F.xxhash64(F.lit("task"), "id"), F.lit(tasks)))
    ever = np.zeros(size, bool)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(m)
        proposed = dealt.groupBy("task").applyInPandas(_round(sent, RATE / (1 + k / 2), k), "w0 double, met binary, w binary, v binary")
        w0, dw, dv, times = 0.0, np.zeros(size), np.zeros((size, rank)), np.zeros(size)
        parts = sorted(proposed.collect(), key=lambda r: (r["w0"], bytes(r["met"])))  # a model for each task, tasks bounded by EXAMPLES
        for r in parts:
            met = np.frombuffer(r["met"], np.int32)
            w0 += r["w0"] / len(parts)
            dw[met] += np.frombuffer(r["w"], np.float32) - m.w[met]
            dv[met] += np.frombuffer(r["v"], np.float32).reshape(-1, rank) - m.v[met]
            times[met] += 1
        ever |= times > 0
        m = Machine(w0, m.w + dw / np.maximum(times, 1), m.v + dv / np.maximum(times, 1)[:, None], m.mean, m.scale)
        sent.unpersist()
    return Machine(m.w0, m.w, np.where(ever[:, None], m.v, 0), m.mean, m.scale)


def classify(docs: DataFrame, labels: DataFrame, learnable: Column, id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality", most: int = EXAMPLES) -> tuple[DataFrame, str]:
    """docs with one more column, the score, and its name. learnable: of labels, which rows may be learned from."""
    spark = docs.sparkSession
    name, t, c = internal(docs, "score", "text", "n_chars")
    known = labels.filter(learnable).select(F.col(id).cast("string").alias("id"), F.col(label).alias("label"))
    slim = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(n_chars).alias("n_chars"))
    m = learn(slim, known, most)
    sent = spark.sparkContext.broadcast(Machine(m.w0, m.w.astype(np.float32), m.v.astype(np.float32), m.mean, m.scale))
    given = docs.withColumns({t: F.col(text), c: F.col(n_chars).cast("double")})
    kept = [k for k, n in enumerate(given.columns) if n not in (t, c)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for first, end, e, stats in _texts(batch, t, c):
                scores[first:end] = m.score(with_stats(e, stats, m.mean, m.scale))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(scores)], names=[*(batch.schema.names[k] for k in kept), name])

    schema = docs.withColumn(name, F.lit(0.0)).schema
    return given.mapInArrow(score, schema), name


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    scored, score = classify(docs.withColumn("held_out", out), table(spark, sf_dir, "labels"), ~out)
    return scored.select("doc_id", "held_out", F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))
