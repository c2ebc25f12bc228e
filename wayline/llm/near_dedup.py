"""Near-duplicate detection on word shingles by fast similarity sketching, banding and exact verification.

Sketch: in round i each shingle of a set is hashed to one of the COORDINATES bins with a value, and a bin keeps the
smallest value of the earliest round that reached it; in round COORDINATES + b all shingles go to bin b. Rounds end
once every bin is filled, so every coordinate is filled after about t ln t hashes in all, whatever the set's size,
and two sketches agree in a share of coordinates that is concentrated about the Jaccard similarity.

Banding: BANDS runs of ROWS_IN_BAND coordinates; sets of similarity 0.75 share a band but for 1 in 100,000.

Verification: rows whose word sequences are equal (by SHA-256) form one class and stand as one node, numbered apart from
their ids. In each bucket every node is held against one pivot on the full sets of shingles, as words and not as hashes; links join nodes into components; what still stands apart in a bucket is held against another
pivot, and in the end against the nodes of the bucket in another component that it could be linked with. Two nodes x
and y held against one pivot p share shingles inside p, at most |x & p|, and outside it. Of the latter, one that at
most RARE such nodes have is rare. Two nodes that share a rare shingle are found by it, a row meeting RARE others at
most; two that share none have at most s = |x & p| + (x's shingles outside p that are neither rare nor its own) in
common, and unless 7 s >= 3 (|x| + |y|) their similarity is below 0.75. Edited copies differ from each other where
they differ from the pivot, so this leaves few pairs. So within a bucket every two nodes are linked, reached through
links, compared, or known to be too far apart; a bucket of n copies takes about n comparisons, no pair list of a
bucket is made, and no bucket is cut.

Cases: a null text is empty; a set without shingles is linked with nothing; rows that share an id, and rows without one,
are rows of their own and link by their texts; a component without any id has a null component_id; kept tells whether a
row's id is its component's, so it holds for each of several rows of that id, or without ids; drop_near_duplicates keeps
exactly one row of a component; texts of any length are read whole; an empty table gives an empty table; further columns
are ignored, or carried untouched by drop_near_duplicates. n_shingles counts 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm._common import forget, internal, materialize, table, tidy, whole_text
from wayline.llm._hashing import mix, slices, window_hashes, word_hashes
from wayline.llm.components import components, merge

SHINGLE = 5
#: Similarity from which two sets are linked, as a share of 100.
LEAST_PERCENT = 75
BANDS, ROWS_IN_BAND = 60, 6
COORDINATES = BANDS * ROWS_IN_BAND
#: Sets below this size take many rounds and are sketched together.
SMALL = 128
#: A shingle outside the pivot that so many nodes at most have leads from each of them to the others.
RARE = 64

_U = np.uint64
_ROUND = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407))
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9FB21C651E98DF25))
_OPEN = _U(0xFFFFFFFFFFFFFFFF)


def normal_words(text: str) -> list[bytes]:
    """The words that shingles are made of: A-Z in lower case, cut at 0x20 and 0x09 to 0x0D."""
    return text.encode().lower().split()


def shingles(text: str, size: int = SHINGLE) -> frozenset[tuple[bytes, ...]]:
    """The set itself, of words."""
    words = normal_words(text)
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(size)), strict=False))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its set of shingle hashes, sorted."""
    for first, end, data, offsets in slices(texts):
        words, at = word_hashes(data, offsets, lower=True)
        whole = window_hashes(words, size)
        for k in range(end - first):
            a, b = at[k], at[k + 1]
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            else:
                yield window_hashes(words[a:b], int(b - a)) if b > a else words[:0]


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t coordinates for each non-empty set."""
    x = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full((len(sets), t), _OPEN)
    flat = out.reshape(-1)
    for i in range(2 * t):
        h = mix(x ^ _ROUND[i])
        value = _U(i << 32) | (h & _U(0xFFFFFFFF))
        bin = ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, row * t + bin, value)
        if i % 4 == 0 or i > t:
            live = np.unique(row)
            done = np.zeros(len(sets), bool)
            done[live] = (out[live] != _OPEN).all(axis=1)
            left = ~done[row]
            x, row = x[left], row[left]
            if not len(x):
                break
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(_BAND, (len(sketch), BANDS)).copy()
    parts = sketch.reshape(len(sketch), BANDS, ROWS_IN_BAND)
    for k in range(ROWS_IN_BAND):
        keys = mix(keys ^ parts[:, :, k])
    return keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


@tidy
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            rows = batch.slice(start, 2000)
            keys = np.zeros((rows.num_rows, BANDS), np.uint64)
            sizes = np.zeros(rows.num_rows, np.int64)
            small, large = [], []

            def sketched(part: list[tuple[int, np.ndarray]], keys: np.ndarray = keys) -> None:
                if part:
                    keys[[k for k, _ in part]] = band_keys(sketches([s for _, s in part]))

            held = 0
            for k, s in enumerate(shingle_sets(rows.column(2))):
                sizes[k] = len(s)
                if not len(s):
                    continue
                (small if len(s) < SMALL else large).append((k, s))
                held += len(s)
                if held > 200_000:
                    sketched(large)
                    large, held = [], 0
            sketched(large)
            sketched(small)
            filled = np.flatnonzero(sizes)
            ends = np.zeros(rows.num_rows + 1, np.int32)
            ends[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
            bands = pa.ListArray.from_arrays(pa.array(ends), _signed(keys[filled].reshape(-1)))
            words = (normal_words(t or "") for t in rows.column(2).to_pylist())
            digests = pa.array([hashlib.sha256(b" ".join(w)).digest() if w else None for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), digests, pa.array(sizes), bands], names=["id", "raw", "digest", "n_shingles", "bands"])


def similar(a: frozenset, b: frozenset) -> bool:
    shared = len(a & b)
    return 100 * shared >= LEAST_PERCENT * (len(a) + len(b) - shared)


@tidy
def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivot: tuple[str, frozenset] = ("", frozenset())
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            rows = batch.slice(start, 1000)
            good = []
            for text, other in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if pivot[0] != text:
                    pivot = text, shingles(text)
                good.append(similar(pivot[1], shingles(other)))
            kept = rows.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


@tidy
def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair: the size of b's set, what it shares with a's, and its shingles outside that."""
    pivot: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            rows = batch.slice(start, 1000)
            sizes, rest = [], []
            for text, other in zip(rows.column(2).to_pylist(), shingle_sets(rows.column(3)), strict=True):
                if pivot[0] != text:
                    pivot = text, next(shingle_sets(pa.array([text])))
                sizes.append(len(other))
                rest.append(np.setdiff1d(other, pivot[1], assume_unique=True).view(np.int64))
            shared = [n - len(r) for n, r in zip(sizes, rest, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], names=["a", "b", "size", "shared", "outside"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a, text_b of pairs (a, b), by a, which many pairs share."""
    first = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    return _with_texts(pairs, texts).mapInArrow(_confirmed, f"a {kind}, b {kind}")


def _possible(named: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket and two components that may be similar enough. first: key, a, the pivot that all of a bucket met."""
    kind = named.schema["node"].dataType.simpleString()
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    there = named.join(sizes.filter("parts > 1").select("key", "main"), "key").join(first, "key").filter("node <> a")
    there = materialize(there, "open")
    met = materialize(_with_texts(there.select("a", F.col("node").alias("b")).distinct(), texts).mapInArrow(_outside, f"a {kind}, b {kind}, size long, shared long, outside array<long>"), "outside")
    rest = met.select("a", "b", F.explode("outside").alias("shingle"))
    common = rest.groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    others = materialize(rest.join(common, ["a", "shingle"]), "others")
    also = others.groupBy("a", "b").agg(F.count(F.lit(1)).alias("also"), F.count(F.when(F.col("n") > RARE, 1)).alias("wide"))
    bound = met.drop("outside").join(also, ["a", "b"], "left").select(
        "a", F.col("b").alias("node"), "size", (F.col("shared") + F.coalesce("also", F.lit(0))).alias("most"), (F.col("shared") + F.coalesce("wide", F.lit(0))).alias("most_wide")
    )
    # What shares less than 3/4 of its own size with any other is far from all.
    known = materialize(there.join(bound, ["a", "node"]).filter("4 * most >= 3 * size"), "known")
    two = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "size", "most", "most_wide")]
    far = F.col("component_x") != F.col("component_y")
    enough = lambda most: 7 * F.least(f"{most}_x", f"{most}_y") >= 3 * (F.col("size_x") + F.col("size_y"))
    wide = known.filter("4 * most_wide >= 3 * size")
    apart = wide.filter("component <> main").select("key", *two("x"))
    in_bucket = apart.join(wide.select("key", *two("y")), "key").filter(far & enough("most_wide"))
    nodes = known.select("a", "node", "component", "size", "most", "most_wide").distinct()
    rare = others.filter(F.col("n") <= RARE).select("a", "shingle", F.col("b").alias("node")).join(nodes, ["a", "node"])
    by_shingle = rare.select("a", "shingle", *two("x")).join(rare.select("a", "shingle", *two("y")), ["a", "shingle"]).filter((F.col("node_x") < F.col("node_y")) & far & enough("most"))
    pairs = in_bucket.select("node_x", "node_y").unionAll(by_shingle.select("node_x", "node_y"))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def link_buckets(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Components over the nodes of buckets: node, component. members: key, node, least, of buckets with at least two."""
    tested: DataFrame | None = None
    labels: DataFrame | None = None
    # An original is mostly older than its copies, so the smallest id makes a good pivot.
    oldest = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    first = materialize(members.groupBy("key").agg(oldest.alias("o")).select("key", F.col("o.node").alias("a")), "pivots")
    members = members.drop("least")
    for turn in range(3):
        named = members.withColumn("component", F.col("node"))
        if labels is not None:
            named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = materialize(named, "named")
        if turn == 0:
            pairs = named.join(first, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
        elif turn == 1:
            pivots = named.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", "component")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"))
            pivots = pivots.filter("low < high").select("key", F.col("p.node").alias("a"), F.col("p.component").alias("ca"))
            pairs = named.join(pivots, "key").filter("component <> ca").select("a", F.col("node").alias("b")).distinct()
        else:
            pairs = _possible(named, first, texts)
        if tested is not None:
            done = tested.unionAll(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        forget(named)
        if pairs.isEmpty():
            continue
        found = materialize(_links(pairs, texts), "confirmed")
        tested = pairs if tested is None else tested.unionAll(pairs)
        labels = components(found) if labels is None else merge(labels, found)
    if labels is None:
        return members.select("node", F.col("node").alias("component")).limit(0)
    return labels


def _raw(text: str) -> Column:
    """A digest of the text as it is."""
    return F.unhex(F.sha2(whole_text(text).cast("binary"), 256))


def _classes(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Of every row id, raw, digest (of its words; null without any) and n_shingles; and of every class digest, rep (the row of
    the smallest id: none, id, raw) and stays, the rep of its whole component."""
    rows = docs.select(F.col(id).alias("id"), _raw(text).alias("raw"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("raw", T.BinaryType()), T.StructField("digest", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    signed = materialize(rows.mapInArrow(_signatures, schema), "signatures")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "raw"))
    grouped = signed.filter("digest is not null").groupBy("digest").agg(rep.alias("rep"), F.first("bands").alias("bands"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", F.col("rep.id").alias("least"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = materialize(keyed.join(buckets, "key").select("key", "node", "least").distinct(), "members")
    known = classes.select("node", "digest", "rep")
    asked = known.join(members.select("node").distinct(), "node").select("node", "rep")
    there = rows.join(asked, (F.col("raw") == F.col("rep.raw")) & rows["id"].eqNullSafe(F.col("rep.id")))
    texts = materialize(there.groupBy("node").agg(F.first("text").alias("text")), "texts")  # rows may share id and text
    linked = link_buckets(members, texts).join(known.select("node", "rep"), "node")
    stays = linked.groupBy("component").agg(F.min("rep").alias("stays"))
    named = known.join(linked.join(stays, "component").select("node", "stays"), "node", "left")
    return signed.drop("bands"), named.select("digest", "rep", F.coalesce("stays", "rep").alias("stays"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row of docs."""
    rows, classes = _classes(docs, id, text)
    found = rows.join(classes.select("digest", "stays"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("stays.id"))
    return found.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component, with their own columns: one of its smallest id, of several the
    one of smallest digest."""
    raw, rank, of_raw, of_id = internal(docs, "raw", "rank", "of_raw", "of_id")
    rows, classes = _classes(docs, id, text)
    found = rows.join(classes.select("digest", "stays"), "digest")
    is_it = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("raw") == F.col("stays.raw"))
    judged = materialize(found.groupBy("raw", "id").agg(F.first(is_it).alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"), "judged")
    marked, same = docs.withColumn(raw, _raw(text)), judged.filter("stays").select(F.col("raw").alias(of_raw), F.col("id").alias(of_id))
    both = (F.col(raw) == F.col(of_raw)) & F.col(id).eqNullSafe(F.col(of_id))
    out = marked.join(judged.select(F.col("raw").alias(of_raw), F.col("id").alias(of_id)), both, "left_anti").select(*docs.columns)
    if same.isEmpty():
        return out
    # Rows that equal the row that stays in id and text: one of them.
    again = marked.join(same, both).withColumn(rank, F.row_number().over(Window.partitionBy(raw).orderBy(raw)))
    return out.unionAll(again.filter(F.col(rank) == 1).select(*docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_ x JOIN n m ON x.a = m.doc_id JOIN n k ON x.b = k.doc_id WHERE 100 * x.n >= 75 * (m.n + k.n - x.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reached r JOIN edges e ON r.a = e.a WHERE r.c < e.b
), least_ AS (
  SELECT a, min(c) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN least_ ON d.doc_id = least_.a
"""
