"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning:
  1. of the labelled rows that may be learned from, EXAMPLES of each class are taken in hash order of their id, one text
     for each id (the least, if documents share it). This is the only bound: 2 * EXAMPLES rows, whole texts, all words;
  2. the document frequency of each word of the examples is counted over all documents;
  3. a word weighs (1 + ln tf) * idf. Apart from that, its lean is how much it leans toxic among the examples: the
     lower end of a confidence interval of the logarithm of its odds ratio, so 0 for a word that tells nothing;
  4. each example becomes a unit vector over all its words. The examples are dealt in blocks of similar ones; the index
     holds the postings of each word, and of frequent words the largest weight in each block.
Scoring, for every whole text: postings of words that are not frequent are added up for all examples; with the largest
weights of the frequent words they bound each block. The best blocks set a threshold, and every block whose bound
reaches it is scored in full, so the NEAREST neighbours are exact. Each votes with the square of its cosine, times what
its class lost when examples were taken, times FLOOR plus the share of the lean of both texts' leaning words that they
have in common (1 if neither has any), plus a small vote of the toxic rate among examples that like the text have, or
lack, leaning words; so a score estimates the toxic share among such documents. The neighbours are returned as evidence.
FLOOR, NEAREST and SMOOTHING are those of least log loss on learnable rows, each without itself among its neighbours.

Cases: a null text is empty; a text without a word of any example gets that toxic rate; no labelled rows give score 0;
ties between neighbours (cosines of 9 digits) go to the earlier example; a label that is null is not learned; of
differing labels for one id the higher counts; texts of any length are read whole; repeated rows each give a row; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm._common import materialize, table, tidy

EXAMPLES = 4096
NEAREST = 64
BLOCK = 128
#: What a neighbour's vote weighs besides the lean it shares, and the normal quantile of the lean's confidence interval (0.1 % level).
FLOOR, QUANTILE = 0.005, 3.29
SMOOTHING = 0.0005
#: Neighbours that the query shows, nearest first; all vote.
SHOWN = 8
THRESHOLD = 0.3
ROWS_AT_ONCE = 1000
#: Texts that meet the index at once; words in a larger share of the examples are frequent.
TEXTS_AT_ONCE, FREQUENT = 64, 1 / 16

any_words = re.compile(r"\w+").findall
#: Bytes of Latin-1 texts: those of words as they are, others as blanks.
BLANKED = bytes(c if re.match(r"\w", chr(c)) else 32 for c in range(256))


def words(text: str) -> list[str]:
    """The matches of \\w+; texts of Latin-1 characters, in which that is a third of the work, are split at blanks."""
    try:
        return text.encode("latin-1").translate(BLANKED).decode("latin-1").split()
    except UnicodeEncodeError:
        return any_words(text)


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Index:
    """Unit vectors of examples over all their words: postings by word, and of frequent words the weights by block with the
    largest of each block."""

    def __init__(self, terms: list[str], idf: np.ndarray, lean: np.ndarray, ids: list, label: np.ndarray, votes: tuple[float, float], sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> None:
        """Of the examples ids and label, and one after another their sizes words, at, with counts tf; votes: what an example
        of class 0 and of class 1 stands for."""
        # Frequent words lie together in memory, where most look-ups then end.
        self.terms = {terms[k]: k for k in np.argsort(-np.bincount(at, minlength=len(terms)), kind="stable").tolist()}
        self.scale, self.lean, self.leans = idf, lean, lean > 0
        n = len(ids)
        row = np.repeat(np.arange(n), sizes)
        weight = (1 + np.log(tf)) * self.scale[at]
        weight /= np.sqrt(np.bincount(row, weight**2, n))[row]
        leaning = np.bincount(row, self.leans[at], n) > 0
        # Like beside like, so that the bounds of most blocks are low: by the frequent word of largest weight.
        frequent = np.where((np.bincount(at, minlength=len(terms)) > n * FREQUENT)[at], weight, 0.0)
        most = np.zeros(n)
        np.maximum.at(most, row, frequent)
        word = np.full(n, -1)
        heaviest = np.flatnonzero((frequent == most[row]) & (frequent > 0))
        word[row[heaviest]] = at[heaviest]
        order = np.lexsort((-most, word))
        self.ids, self.label = [ids[k] for k in order], label[order].astype(np.int8)
        self.vote, leaning = np.array(votes)[self.label], leaning[order]
        self.rate = [self.share(float(self.vote[(leaning == k) & (self.label == 1)].sum()), float(self.vote[leaning == k].sum()), 0.0) for k in (False, True)]
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        place = place[row]
        by_term = np.lexsort((place, at))
        self.place, self.weight = place[by_term], weight[by_term]
        # The leaning words of each example, one example after another.
        by_place = np.lexsort((at, place))
        by_place = by_place[self.leans[at[by_place]]]
        self.held, self.leaning = at[by_place].astype(np.int32), np.bincount(place, lean[at], n)
        self.firsts = np.concatenate([[0], np.cumsum(np.bincount(place[by_place], minlength=n))])
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))])
        self.dense: np.ndarray | None = None
        self.meant: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "row": None, "most": None, "meant": None}

    def unit(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.scale[at]
        return w / np.sqrt(w @ w) if len(w) else w

    def open(self) -> np.ndarray:
        """The weights of the frequent words by block, word and place in the block, laid out where they are used."""
        if self.dense is None:
            sizes, blocks = np.diff(self.starts), -(-len(self.ids) // BLOCK)
            often = np.flatnonzero(sizes > len(self.ids) * FREQUENT)
            self.row = np.full(len(sizes), -1)
            self.row[often] = np.arange(len(often))
            self.dense = np.zeros((blocks, len(often), BLOCK))
            for k, t in enumerate(often):
                part = slice(self.starts[t], self.starts[t + 1])
                self.dense[self.place[part] // BLOCK, k, self.place[part] % BLOCK] = self.weight[part]
            self.most = self.dense.max(axis=2).T if len(often) else np.zeros((0, blocks))
        return self.dense

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and unit weights of the text's words that examples have."""
        tf = Counter(words(text.lower()))
        at = np.fromiter(map(self.terms.get, tf, repeat(-1)), np.int64, len(tf))
        known = at >= 0
        at = at[known]
        return at, self.unit(at, np.fromiter(tf.values(), np.int64, len(tf))[known])

    def nearest(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its leaning words, and the places and cosines of the nearest examples with a positive cosine,
        nearest first."""
        dense = self.open()
        blocks = len(dense)
        for begin in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[begin : begin + TEXTS_AT_ONCE]
            queries, scores, leaning = np.zeros((len(part), self.most.shape[0])), np.zeros((len(part), blocks * BLOCK)), []
            for k, text in enumerate(part):
                at, w = self.vector(text)
                leaning.append(at[self.leans[at]])
                row = self.row[at]
                queries[k, row[row >= 0]] = w[row >= 0]
                at, w = at[row < 0], w[row < 0]
                sizes = self.starts[at + 1] - self.starts[at]
                ends = np.cumsum(sizes)
                where = np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
                scores[k] = np.bincount(self.place[where], self.weight[where] * np.repeat(w, sizes), blocks * BLOCK)
            by_block = scores.reshape(len(part), blocks, BLOCK)
            bound = by_block.max(axis=2) + queries @ self.most
            full = np.zeros(bound.shape, bool)
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, np.argpartition(-bound, min(4, blocks) - 1, axis=1)[:, :4] if blocks else np.zeros((len(part), 0), int), True, axis=1)
            for wanted in (first, None):
                if wanted is None:  # what the best blocks hold is a threshold for the bounds of the rest
                    wanted = bound >= self.floors(by_block[first].reshape(len(part), -1))[:, None] * (1 - 1e-12)
                for b in np.flatnonzero((wanted & ~full).any(axis=0)):
                    k = np.flatnonzero(wanted[:, b] & ~full[:, b])
                    by_block[k, b] += queries[k] @ dense[b]
                full |= wanted
            for k, one in enumerate(leaning):
                there = np.flatnonzero(full[k])
                row = by_block[k, there].reshape(1, -1)
                at = np.flatnonzero((row[0] >= self.floors(row)[0] - 1e-9) & (row[0] > 0))
                places = there[at // BLOCK] * BLOCK + at % BLOCK
                found = np.minimum(np.round(row[0, at], 9), 1.0)
                best = np.lexsort((places, -found))[:NEAREST]
                yield one, places[best], found[best]

    def floors(self, scores: np.ndarray) -> np.ndarray:
        """The NEAREST-th largest of each row."""
        return np.partition(scores, -NEAREST, axis=1)[:, -NEAREST] if scores.shape[1] >= NEAREST else np.zeros(len(scores))

    def share(self, toxic: float, all: float, rate: float) -> float:
        return (toxic + SMOOTHING * rate) / (all + SMOOTHING)

    def shared(self, leaning: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the lean of the words that a text and each example have, the share of those that both have; 1 without such words."""
        sizes = self.firsts[places + 1] - self.firsts[places]
        ends = np.cumsum(sizes)
        where = np.repeat(self.firsts[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        if self.meant is None:
            self.meant = np.zeros(len(self.lean))
        self.meant[leaning] = self.lean[leaning]
        both = np.bincount(np.repeat(np.arange(len(places)), sizes), self.meant[self.held[where]], len(places))
        self.meant[leaning] = 0
        every = self.lean[leaning].sum() + self.leaning[places] - both
        return np.divide(both, every, out=np.ones(len(places)), where=every > 0)

    def scores(self, texts: list[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the score and its evidence: of the nearest examples the places, cosines and shared leans."""
        for leaning, places, cosines in self.nearest(texts):
            shared = self.shared(leaning, places)
            vote, toxic = self.vote[places] * cosines**2 * (FLOOR + shared), self.label[places] == 1
            yield min(1.0, self.share(float(vote[toxic].sum()), float(vote.sum()), self.rate[len(leaning) > 0])), places, cosines, shared


def choose_examples(docs: DataFrame, labels: DataFrame, label: str, examples: int) -> tuple[DataFrame, tuple[float, float]]:
    """(id, label, text) of the examples, and the weight of an example of each class."""
    known = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels of absent texts take no example's place
    known = materialize(known.withColumn("at", F.md5(F.col("doc_id").cast("string").cast("binary"))), "known")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = known.filter("label = 0").orderBy("at").limit(examples).unionAll(known.filter("label = 1").orderBy("at").limit(examples))
    there = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    chosen = there.groupBy("doc_id", "label", "at").agg(F.min("text").alias("text"))
    votes = tuple(max(1.0, counts.get(c, 0) / examples) for c in (0, 1))
    return materialize(chosen, "examples"), votes


def class_counts(examples: DataFrame) -> DataFrame:
    """term, clean, toxic: of each word of the examples, how many of each class have it."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[label].update(set(words(text.lower())))
        every = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([by[0][w] for w in every], pa.int64()), pa.array([by[1][w] for w in every], pa.int64())], names=["term", "clean", "toxic"])

    found = examples.select("label", "text").mapInArrow(count, "term string, clean long, toxic long")
    return found.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def leans(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """How much words lean toxic: the lower end of the interval of ln(odds ratio), at least 0."""
    a, b = toxic + 0.5, clean + 0.5
    c, d = all_toxic - toxic + 0.5, all_clean - clean + 0.5
    return np.maximum(0.0, np.log(a * d / (b * c)) - QUANTILE * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def document_frequencies(docs: DataFrame, terms: list[str]) -> DataFrame:
    """term, n: the number of documents that hold each term, over the whole table; without a term, of all documents.

    Terms that are frequent had better come first.
    """
    wanted = {t: k for k, t in enumerate(terms)}

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, by = 0, np.zeros(len(terms) + 1, np.int64)  # the last: words that are not wanted
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                held = [np.fromiter(map(wanted.get, each, repeat(len(terms))), np.int32, len(each)) for each in (set(words((text or "").lower())) for text in batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist())]
                by += np.bincount(np.concatenate(held), minlength=len(by))
        there = np.flatnonzero(by[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([None, *[terms[k] for k in there]], pa.string()), pa.array([n, *by[there].tolist()], pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Index:
    chosen, votes = choose_examples(docs, labels, label, examples)
    counts = materialize(class_counts(chosen), "terms")
    by_use = counts.select("term", (F.col("clean") + F.col("toxic")).alias("n")).toArrow().sort_by([("n", "descending"), ("term", "ascending")])
    df = materialize(document_frequencies(docs, by_use["term"].to_pylist()), "frequencies")
    n = df.filter("term is null").agg(F.sum("n")).first()[0] or 0
    known = counts.join(df, "term", "left").orderBy("term").toArrow()
    every = known["term"].to_pylist()
    toxic, clean, holders = (known[c].fill_null(0).to_numpy().astype(np.float64) for c in ("toxic", "clean", "n"))
    at = {t: k for k, t in enumerate(every)}

    @tidy
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf = [Counter(at[w] for w in words(t.lower())) for t in batch.column(3).to_pylist()]
            packed = [pa.array([np.array(list(v), np.int32).tobytes() for v in each], pa.binary()) for each in (tf, [x.values() for x in tf])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *packed], names=["doc_id", "label", "at", "terms", "tf"])

    schema = T.StructType([chosen.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("at", T.StringType()), T.StructField("terms", T.BinaryType()), T.StructField("tf", T.BinaryType())])
    got = chosen.select("doc_id", "label", "at", "text").mapInArrow(vectors, schema).toArrow().sort_by([("at", "ascending")])
    terms, tf = (np.frombuffer(b"".join(got[c].to_pylist()), np.int32) for c in ("terms", "tf"))
    sizes = np.array([len(x) // 4 for x in got["terms"].to_pylist()], np.int64)
    y = got["label"].to_numpy().astype(np.int64)
    lean = leans(toxic, clean, int((y == 1).sum()), int((y == 0).sum()))
    return Index(every, np.log((1 + n) / (1 + holders)) + 1, lean, got["doc_id"].to_pylist(), y, votes, sizes, terms, tf)


def shipped(spark: SparkSession, index: Index) -> Broadcast:
    """The index, packed: workers keep what is broadcast for as long as they live."""
    arrays: list[pickle.PickleBuffer] = []
    rest = pickle.dumps(index, 5, buffer_callback=arrays.append)
    return spark.sparkContext.broadcast([zlib.compress(x, 1) for x in (rest, *[a.raw() for a in arrays])])


def opened(packed: Broadcast) -> Index:
    """The index, its arrays as they are unpacked, without a copy."""
    rest, *arrays = packed.value
    return pickle.loads(zlib.decompress(rest), buffers=map(zlib.decompress, arrays))


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score and evidence (nearest examples: doc_id, label, cosine, shared lean) of every row of docs."""
    spark = docs.sparkSession
    index = shipped(spark, learn(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), labels))
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", docs.schema[id].dataType), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType()), T.StructField("shared", T.DoubleType())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = opened(index)  # of this task, so a worker that goes on to other work holds none
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                scores, places, cosines, shared = zip(*examples.scores([t or "" for t in rows.column(1).to_pylist()]), strict=True)
                at_ids, ends = np.concatenate(places), np.cumsum([0, *map(len, places)])
                ids = pa.array([examples.ids[k] for k in at_ids], rows.column(0).type)
                fields = [ids, pa.array(examples.label[at_ids].astype(np.int32)), pa.array(np.concatenate(cosines)), pa.array(np.concatenate(shared))]
                shown = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["doc_id", "label", "cosine", "shared"]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64()), shown], names=[id, "score", "evidence"])

    schema = T.StructType([docs.schema[id], T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    return docs.select(id, text).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns."""
    spark = docs.sparkSession
    index = shipped(spark, learn(docs.select("doc_id", "text"), labels))
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = opened(index).scores
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                yield rows.filter(pa.array([found[0] < threshold for found in scores([t or "" for t in rows.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.slice("evidence", 1, SHOWN).alias("evidence"))
