"""Stupid-backoff language-model scores of every document against the rest of the corpus.

The n-gram counts are those of all documents; a document is scored with its own counts taken off, so what only it
says counts as unseen. For a word w after a history h of up to ORDER - 1 words:
  S(w | h) = count(h w) / count(h) if count(h w) > 0, else BACKOFF * S(w | h without its first word);
  S(w) = max(count(w), 1) / max(words, 1).
A document's score is the sum of ln S over its words.

Relations, all exploded and packed: the documents are packed once, where they are read, into blocks of about BLOCK_BYTES
of text, one row each. A block lists its distinct n-grams of each order with their counts, in order of hash; the list is
cut by the leading bits of the hash, so each count table partition gets one row from each block, with a binary column of
hashes, as steps from one to the next, and one of counts. A partition sums the counts of each n-gram (the count table), joins to each row what the other
blocks have more, and hands that back to the blocks, which look up each word's counts and sum by document. An n-gram
arrives once from each block, so a frequent one is no heavier than another; equal rows stay in the blocks they are in.

Hashes are of 64 bits: the leading bits by partition, the next 48 in the row; from 2 ** 16 partitions on all of them.

Cases: a null or empty text has no words and score 0; rows that share an id are scored as documents of their own;
a null id is a document like others; texts of any length are read whole, a longer one than a block in one of its own; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm._common import free_shuffles, materialize, table
from wayline.llm._hashing import mix, slices, word_hashes
from wayline.llm.mixing import word_count

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 6 << 20
#: n-grams of one order in one count table partition, about.
PARTITION_NGRAMS = 1 << 20
#: Lists shorter than this are not compressed.
FEW = 16

_U = np.uint64


class Grams:
    """The words of a block's documents, and for each order its n-grams: the sorted distinct hashes, their counts, and
    for each place the number of the n-gram that ends there (-1: none)."""

    def __init__(self, texts: pa.Array, order: int) -> None:
        words, ends, base = [], [0], 0
        for _, _, data, offsets in slices(texts):
            found, at = word_hashes(data, offsets, lower=False)
            words.append(found)
            ends += [base + int(e) for e in at[1:]]
            base += len(found)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.ends = np.array(ends)
        self.sizes = np.diff(self.ends)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        place = np.arange(len(self.words)) - np.repeat(self.ends[:-1], self.sizes)
        self.distinct, self.counts, self.at = [], [], []
        hashes = np.zeros(len(self.words), np.uint64)
        for n in range(1, order + 1):
            # of the n words that end here: the last word's hash and the hash of the n - 1 before it
            before = np.concatenate([hashes[:1] * _U(0), hashes[:-1]])
            hashes = mix(before * _U(0xD6E8FEB86659FD93) + self.words + _U(n))
            whole = place >= n - 1
            distinct, inverse, counts = np.unique(hashes[whole], return_inverse=True, return_counts=True)
            at = np.full(len(self.words), -1, np.int32)
            at[whole] = inverse
            self.distinct.append(distinct)
            self.counts.append(counts.astype(np.uint32))
            self.at.append(at)

    def own(self, n: int) -> np.ndarray:
        """For each place, how often its document holds the n-gram that ends there."""
        at, out = self.at[n - 1], np.zeros(len(self.words), np.int64)
        there = at >= 0
        _, inverse, counts = np.unique(self.doc[there].astype(np.int64) * (len(self.distinct[n - 1]) + 1) + at[there], return_inverse=True, return_counts=True)
        out[there] = counts[inverse]
        return out


def _pack(x: np.ndarray) -> bytes:
    """Integers, byte planes apart, compressed; a few stay as they are."""
    if len(x) < FEW:
        return x.astype("<i8").tobytes()
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    if n < FEW:
        return np.frombuffer(data, "<i8")
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, ids, sizes and texts (bytes one after another, compressed) of documents read one after another."""
    held: list[pa.RecordBatch] = []
    number, size = TaskContext.get().partitionId() << 32, 0

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = [(t or "").encode() for t in rows.column(1).to_pylist()]
        data, sizes = b"".join(texts), np.array([len(t) for t in texts])
        ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows.column(0).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([_pack(sizes)]), pa.array([pa.compress(data, "zstd", asbytes=True)]), pa.array([len(data)])], names=["block", "ids", "sizes", "texts", "bytes"])

    for batch in batches:
        at = 0
        lengths = np.cumsum([len(t or "") for t in batch.column(1).to_pylist()])
        while at < batch.num_rows:
            before = lengths[at - 1] if at else 0
            end = min(batch.num_rows, max(at + 1, int(np.searchsorted(lengths, before + BLOCK_BYTES - size, "right"))))
            held.append(batch.slice(at, end - at))
            size += int(lengths[end - 1] - before)
            at = end
            if size >= BLOCK_BYTES or at < batch.num_rows:
                yield packed()
                held, size, number = [], 0, number + 1
    if held:
        yield packed()


def _texts(block: dict) -> pa.Array:
    """The texts of a block's row, as a column."""
    sizes = _unpack(block["sizes"], len(block["ids"]))
    data = pa.decompress(block["texts"], block["bytes"], "zstd") if block["bytes"] else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), data)


def _lists(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for block in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                grams = Grams(_texts(block), order)
                for n in range(1, order + 1):
                    distinct, counts = grams.distinct[n - 1], grams.counts[n - 1]
                    part = (distinct >> _U(64 - bits) if bits else distinct & _U(0)).astype(np.int64)
                    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))  # the parts that the block has, however many there are
                    low = (distinct << _U(bits) >> _U(16)).astype(np.int64)  # in order within a partition
                    rows = [(block["block"], n, part[a], _pack(np.diff(low[a:b], prepend=0)), counts[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "n", "part", "low", "counts"])

    return run


def _more(pdf: pd.DataFrame) -> pd.DataFrame:
    """The count table of one partition, joined to what each block has: how often the other blocks have it."""
    sizes = [len(x) // 4 for x in pdf["counts"]]
    low = np.concatenate([np.cumsum(_unpack(x, n)) for x, n in zip(pdf["low"], sizes, strict=True)])
    counts = np.frombuffer(b"".join(pdf["counts"]), np.uint32).astype(np.int64)
    _, inverse = np.unique(low, return_inverse=True)
    totals = np.zeros(len(low) and inverse.max() + 1, np.int64)
    np.add.at(totals, inverse, counts)
    each = np.split(totals[inverse] - counts, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"block": pdf["block"], "n": pdf["n"], "part": pdf["part"], "size": sizes, "more": [_pack(x) for x in each]})


def _scores(order: int, backoff: float, words_in_all: int):
    def run(blocks: pa.Table, more: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        grams = Grams(_texts(block), order)
        got = more.sort_by([("n", "ascending"), ("part", "ascending")]).to_pydict()
        counts: list[np.ndarray] = []  # for each order and place, the count outside the document of the n-gram that ends there
        for n in range(1, order + 1):
            parts = [_unpack(m, size) for k, size, m in zip(got["n"], got["size"], got["more"], strict=True) if k == n]
            all_ = np.concatenate([*parts, np.zeros(0, np.int64)]) + grams.counts[n - 1]
            at = grams.at[n - 1]
            counts.append(np.where(at >= 0, all_[at], 0) - grams.own(n) if len(all_) else np.zeros(len(at), np.int64))
        outside = np.maximum(words_in_all - grams.sizes, 1)[grams.doc]
        level = np.zeros(len(grams.words), np.int32)
        score = np.log(np.maximum(counts[0], 1) / outside)
        level[counts[0] > 0] = 1
        for n in range(2, order + 1):
            history = np.concatenate([counts[n - 2][:1] * 0, counts[n - 2][:-1]])
            there = grams.at[n - 1] >= 0
            seen = there & (counts[n - 1] > 0)
            score = np.where(there, score + np.log(backoff), score)
            score[seen] = np.log(counts[n - 1][seen] / history[seen])
            level[seen] = n
        sums = np.bincount(grams.doc, weights=score, minlength=len(grams.sizes)) if len(score) else np.zeros(len(grams.sizes))
        full = np.bincount(grams.doc, weights=level == order, minlength=len(grams.sizes)) if len(score) else np.zeros(len(grams.sizes))
        return pa.Table.from_arrays([blocks["ids"].combine_chunks().flatten(), pa.array(grams.sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(full.astype(np.int64))], names=["id", "n_words", "log_score", "n_seen"])

    return run


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """id, n_words, log_score and n_seen (words whose whole n-gram of the highest order stands elsewhere too) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    words = rows.select(F.sum(word_count("text")).alias("n")).collect()[0]["n"] or 0
    bits = max(0, (words // PARTITION_NGRAMS).bit_length())
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id].dataType)), T.StructField("sizes", T.BinaryType()), T.StructField("texts", T.BinaryType()), T.StructField("bytes", T.LongType())])
    blocks = materialize(rows.mapInArrow(_blocks, kind), "blocks")
    lists = blocks.mapInArrow(_lists(order, bits), "block long, n int, part long, low binary, counts binary")
    more = materialize(lists.groupBy("n", "part").applyInPandas(_more, "block long, n int, part long, size long, more binary"), "more")
    del lists
    free_shuffles(spark)  # the lists
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("n_seen", T.LongType())])
    found = blocks.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(_scores(order, backoff, words), schema)
    return found.withColumnRenamed("id", id)


def op4_lm_score(spark: SparkSession, sf_dir: str, order: int = ORDER) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), order=order)
    per_word = F.coalesce(F.try_divide(F.col("log_score"), F.col("n_words")), F.lit(0.0))
    return found.select("doc_id", "n_words", "n_seen", F.round("log_score", 3).alias("log_score"), F.round(per_word, 6).alias("log_score_per_word"))


def op4_lm_score_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with contexts of one word."""
    return op4_lm_score(spark, sf_dir, order=2)


OP4_ORDER2_SQL = r"""
WITH l AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), d AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words FROM l
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l
), p AS (
  SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM w
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1 FROM p
), g AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS ch,
         CASE WHEN h IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY h, w) - count(*) OVER (PARTITION BY doc_id, h, w) END AS c2
  FROM c
), s AS (
  SELECT g.doc_id, CASE WHEN c2 > 0 THEN ln(c2::DOUBLE / ch)
         ELSE ln(greatest(c1, 1)::DOUBLE / greatest((SELECT sum(n_words) FROM d)::BIGINT - d.n_words, 1)) + CASE WHEN h IS NULL THEN 0 ELSE ln(0.4) END END AS s,
         c2 > 0 AS seen
  FROM g JOIN d ON g.doc_id = d.doc_id
), t AS (
  SELECT doc_id, sum(s) AS s, count(*) FILTER (seen) AS n_seen FROM s GROUP BY doc_id
)
SELECT d.doc_id, d.n_words, coalesce(n_seen, 0) AS n_seen, round(coalesce(s, 0), 3) AS log_score,
       round(CASE WHEN d.n_words = 0 THEN 0 ELSE s / d.n_words END, 6) AS log_score_per_word
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), d AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words FROM l
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l
), p AS (
  SELECT *, lag(w) OVER o AS h1, lag(w, 2) OVER o AS h2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
         CASE WHEN h1 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY h1, w) - count(*) OVER (PARTITION BY doc_id, h1, w) END AS c2,
         CASE WHEN h2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY h2, h1, w) - count(*) OVER (PARTITION BY doc_id, h2, h1, w) END AS c3
  FROM p
), g AS (
  SELECT *, lag(c1) OVER o AS ch1, lag(c2) OVER o AS ch2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT g.doc_id, CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / ch2)
         WHEN c2 > 0 THEN ln(c2::DOUBLE / ch1) + CASE WHEN h2 IS NULL THEN 0 ELSE ln(0.4) END
         ELSE ln(greatest(c1, 1)::DOUBLE / greatest((SELECT sum(n_words) FROM d)::BIGINT - d.n_words, 1)) + CASE WHEN h1 IS NULL THEN 0 WHEN h2 IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS s,
         c3 > 0 AS seen
  FROM g JOIN d ON g.doc_id = d.doc_id
), t AS (
  SELECT doc_id, sum(s) AS s, count(*) FILTER (seen) AS n_seen FROM s GROUP BY doc_id
)
SELECT d.doc_id, d.n_words, coalesce(n_seen, 0) AS n_seen, round(coalesce(s, 0), 3) AS log_score,
       round(CASE WHEN d.n_words = 0 THEN 0 ELSE s / d.n_words END, 6) AS log_score_per_word
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
