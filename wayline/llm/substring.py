"""Substring deduplication by suffix automata of reference shards.

A window is WINDOW consecutive words. A window is removed if its words also start earlier: in a document of smaller
id, or earlier in the same one. Windows are judged on the input.

Routing. Each window names an anchor, the run of ANCHOR words in it with the smallest hash, so equal windows name
equal anchors and about one word in eight starts one. Anchors are counted over the corpus; an anchor that occurs
once ends there. The others get a home, the first document that holds them, and the stretches of text whose windows
name anchors of one home go to that home's shard. So every occurrence of a repeated window meets in one shard, and
a shard is a bounded part of the repeated text, however large the corpus is.

Matching. Each shard streams its stretches, in order of document and place, past a suffix automaton of what it has
seen, which takes each stretch in as it goes: after each word, the automaton's state tells how long a suffix of the
stretch has occurred before. From WINDOW words on, the window that ends here is a repeat. The automaton is dropped
at the shard's end.

Skew. A home with more than SPLIT anchors (a passage that a large part of the corpus shares) is dealt to several
shards by document. Each finds what repeats within it, and passes on the words, first document and place of each window
that it holds; the first of these over all its shards is the window's first, the others are repeats.

Cases: a null text has no words; rows that share an id are documents of their own, ordered by their text's digest,
then in any order; a null id sorts last; texts of any length are read whole; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm._common import forget, materialize, table
from wayline.llm._hashing import mix, slices, window_hashes, word_hashes

WINDOW = 20
ANCHOR = 6
#: Anchors of one home that go to one shard, and words of all stretches in one shard, about.
SPLIT = 16_384
SHARD_WORDS = 250_000

_U = np.uint64
_PLACE = _U((1 << 20) - 1)
_words = re.compile("[^\x20\x09-\x0d]+").findall


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of the texts that lie side by side in data."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    starts[first], ends[last] = inside[first], inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def anchor_runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the hashed words of texts side by side: for each run of windows that name one anchor, its text, first and
    last window (word numbers in words) and the anchor's hash."""
    grams = window_hashes(words, ANCHOR)
    span = WINDOW - ANCHOR + 1
    sizes = np.diff(at)
    n = len(words) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    place = np.arange(len(grams), dtype=np.uint64)
    low, width = (grams & ~_PLACE) | (place & _PLACE), 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])[:n]
    window = np.arange(n)
    left = np.repeat(at[1:], sizes)[:n] - window  # words from here to the text's end
    window = window[left >= WINDOW]
    if not len(window):
        return none, none, none, none
    named = window + ((low[window] - window.astype(np.uint64)) & _PLACE).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (named[1:] != named[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    last = window[np.append(begin[1:], len(window)) - 1]
    return np.searchsorted(at, window[begin], "right") - 1, window[begin], last, grams[named[begin]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, hash and number of each document's anchors."""
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            words, at = word_hashes(data, offsets, lower=False)
            text, begin, _, hashes = anchor_runs(words, at)
            if not len(text):
                continue
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
            k = np.flatnonzero(new)
            ids = batch.column(0).slice(first, end - first).take(pa.array(text[k]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes[k].view(np.int64)), pa.array(np.diff(np.append(k, len(text))))], names=["rid", "hash", "n"])


def _stretches(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches of each document whose windows name repeated anchors of one home."""
        for batch in batches:
            rids, lists = batch.column(0).to_pylist(), batch.column(2)
            for first, end, data, offsets in slices(batch.column(1)):
                words, at = word_hashes(data, offsets, lower=False)
                starts, ends = word_bounds(data, offsets)
                text, begin, last, hashes = (x.tolist() for x in anchor_runs(words, at))
                raw = data.tobytes()
                homes = [{h["hash"]: (h["home"], h["chunks"]) for h in lists[k].as_py()} for k in range(first, end)]
                out: list[tuple[int, bool, int, int, str]] = []
                open_: list = []  # text, home, chunk, chunks, first window, last window

                def close(open_: list = open_) -> None:
                    if open_:
                        k, home, chunk, chunks, a, b = open_
                        shard = int(mix(np.array([home & 0xFFFFFFFFFFFFFFFF], np.uint64) * _U(31) + _U(chunk))[0] % _U(shards))
                        out.append((shard, chunks == 1, rids[first + k], a - int(at[k]), raw[starts[a] : ends[b + WINDOW - 1]].decode()))  # noqa: B023
                        open_.clear()

                for k, a, b, h in zip(text, begin, last, hashes, strict=True):
                    home = homes[k].get(h - (1 << 64) if h >> 63 else h)
                    if home is None:
                        close()
                        continue
                    chunk = int(mix(np.array([rids[first + k] & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] % _U(home[1])) if home[1] > 1 else 0
                    if open_ and open_[0] == k and open_[1:4] == [home[0], chunk, home[1]] and open_[5] + 1 == a:
                        open_[5] = b
                    else:
                        close()
                        open_[:] = k, home[0], chunk, home[1], a, b
                close()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "whole", "rid", "start", "text"])

    return run


class SuffixAutomaton:
    """Takes texts in word by word and tells how long a suffix of each text, up to each word, has occurred before."""

    def __init__(self) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def take_in(self, words: list[str]) -> list[int]:
        step, link, length = self.step, self.link, self.length
        state, out = 0, []
        for w in words:
            after = step[state].get(w)
            if after is not None:  # the text so far has occurred, or a suffix of it that is as long as this state
                if length[after] != length[state] + 1:
                    after = self.clone(state, w, after)
                state = after
                out.append(length[state])
                continue
            new = len(step)
            step.append({})
            length.append(length[state] + 1)
            link.append(0)
            at = state
            while at >= 0 and w not in step[at]:
                step[at][w] = new
                at = link[at]
            if at >= 0:
                after = step[at][w]
                link[new] = after if length[after] == length[at] + 1 else self.clone(at, w, after)
            state = new
            out.append(length[link[new]])
        return out

    def clone(self, at: int, w: str, after: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[after]))
        length.append(length[at] + 1)
        link.append(link[after])
        link[after] = copy
        while at >= 0 and step[at].get(w) == after:
            step[at][w] = copy
            at = link[at]
        return copy


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows (rid, first, last), and of split homes each other window with its words."""
    automaton, of = SuffixAutomaton(), None
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            rows = batch.slice(begin, 2000)
            out: list[tuple[int, int, int, str | None]] = []
            for shard, whole, rid, start, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if shard != of:
                    automaton, of = SuffixAutomaton(), shard
                words = _words(text)
                seen = np.array(automaton.take_in(words))[WINDOW - 1 :] >= WINDOW
                edges = np.flatnonzero(np.diff(np.concatenate([[0], seen.view(np.int8), [0]])))
                out += [(rid, start + int(a), start + int(b) - 1, None) for a, b in zip(edges[::2], edges[1::2], strict=True)]
                if not whole:
                    out += [(rid, start + k, start + k, " ".join(words[k : k + WINDOW])) for k, old in enumerate(seen) if not old]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["rid", "first", "last", "window"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            rows = batch.slice(begin, 500)
            counts, removed, spans, texts = [], [], [], []
            for text, runs in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                words = _words(text or "")
                gone: list[list[int]] = []
                for r in sorted((r["first"], r["last"] + WINDOW) for r in runs or []):
                    if gone and r[0] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], r[1])
                    else:
                        gone.append(list(r))
                left, at = [], 0
                for a, b in gone:
                    left += words[at:a]
                    at = b
                left += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                spans.append([{"start": a, "end": b} for a, b in gone])
                texts.append(" ".join(left))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "spans", "kept_text"])


def numbered(docs: DataFrame, id: str, text: str) -> DataFrame:
    """rid, id, text: the id itself numbers the rows if it is an integer of its own for each row."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    whole = isinstance(docs.schema[id].dataType, (T.LongType, T.IntegerType))
    if whole and rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").isEmpty():
        return rows.select(F.col("id").cast("long").alias("rid"), "id", "text")
    order = [F.col("id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("rid"), "id", "text"), "numbered")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """rid, first, last: runs of windows that also start earlier. rows: rid (in order of precedence), text."""
    text = rows.select("rid", "text")
    anchors = materialize(text.mapInArrow(_anchors, "rid long, hash long, n long"), "anchors")
    totals = anchors.groupBy("hash").agg(F.sum("n").alias("n"), F.min("rid").alias("home")).filter("n > 1")
    totals = totals.withColumn("chunks", F.ceil(F.sum("n").over(Window.partitionBy("home")) / F.lit(float(SPLIT))))
    hits = materialize(anchors.join(totals.drop("n"), "hash").select("rid", "hash", "home", "chunks"), "hits")
    forget(anchors)
    shards = max(1, -(-hits.count() * 8 // SHARD_WORDS))
    by_row = hits.groupBy("rid").agg(F.collect_list(F.struct("hash", "home", "chunks")).alias("hits"))
    stretches = text.join(by_row, "rid").select("rid", "text", "hits").mapInArrow(_stretches(shards), "shard long, whole boolean, rid long, start long, text string")
    in_order = stretches.repartition("shard").sortWithinPartitions("shard", "rid", "start")
    matched = materialize(in_order.mapInArrow(_matched, "rid long, first long, last long, window string"), "matched")
    forget(hits)
    found = matched.filter("window is null").select("rid", "first", "last")
    passed = matched.filter("window is not null")
    firsts = passed.groupBy("window").agg(F.min(F.struct("rid", "first")).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = passed.join(firsts, "window").filter(F.struct("rid", "first") != F.col("origin")).select("rid", "first", "last")
    return found.unionAll(later)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans (removed words, start and end) and kept_text of every row of docs."""
    rows = numbered(docs, id, text)
    runs = repeated_windows(rows).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    schema = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_text", T.StringType()),
    ])
    found = rows.join(runs, "rid", "left").select("id", "text", "runs").mapInArrow(_kept, schema)
    return found.withColumnRenamed("id", id)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d
), k AS (
  SELECT *, CASE WHEN i + 19 <= n THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS k FROM w
), r AS (
  SELECT doc_id, w, i, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM k
), c AS (
  SELECT doc_id, w, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), t AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
