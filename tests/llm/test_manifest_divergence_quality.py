import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import divergence, manifest, quality, registry, toxicity

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """The root and each leaf's [(left, right)] up to it."""
    level, paths, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(level) > 1:
        for k, p in enumerate(paths):
            a = at[k] // 3 * 3
            p.append(("".join(level[a : at[k]]), "".join(level[at[k] + 1 : a + 3])))
            at[k] //= 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    """[(doc_id, source, lang, n_chars, text)] -> Counter of what the query returns."""
    groups = defaultdict(list)
    for r in rows:
        groups[b"" if r[1] is None else b"s" + r[1].encode()].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))
    names, subs = sorted(groups), {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        subs[g] = tree([x[2] for x in groups[g]])
    root, tops = tree([subs[g][0] for g in names])
    out = Counter()
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, r), own in zip(groups[g], subs[g][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = sha("".join(map(field, (*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4]))))
            for a, b in own + top:
                acc = sha(a + acc + b)
            out[r[0], leaf, subs[g][0], root, sha("".join(a + b for a, b in own + top)), acc, acc == root] += 1
    return out


def told(spark, df):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return Counter(map(tuple, manifest.manifest(df, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))).drop("path").collect()))


def test_manifest_on_ugly_rows(spark, ugly, nothing):
    df = ugly.withColumn("n_chars", F.length("text").cast("long"))
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert told(spark, df) == plain_manifest(rows)
    assert told(spark, nothing.withColumn("n_chars", F.lit(1).cast("long"))) == Counter()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 250])
def test_manifest_of_one_large_and_many_small_sources(spark, n):
    rows = [(k, "big", "en", k, f"a\nb {k}") for k in range(n)] + [(-k, f"s{k}", None, None, "x\n") for k in range(n // 25)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert told(spark, df) == plain_manifest(rows)


def test_a_large_source_is_numbered_in_parts(spark):
    """A third and more of the rows in one source, and one id for all of them: no task of the numbering has them all."""
    rows = spark.range(0, 30_000, 1, 8).select(F.lit("s").alias("group"), F.lit(1).alias("id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = manifest.numbered(rows, ["id", "hash"], "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [r.idx for r in found.orderBy("hash").collect()]
    assert got == list(range(30_000))
    path = found.inputFiles()[0].rsplit("/", 1)[0]
    parts = [r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()]
    assert len(parts) == 4 and max(parts) < 15_000


# source divergence


def plain_audit(rows, least=3, ranks=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = {((la or ""), (so or "")) for la, so, _ in rows}
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    for la, so, text in rows:
        w = [lower(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[la or "", so or ""].update(w)
        docs[la or ""].update(set(w))
    out = set()
    for la in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[la].items() if n >= least)
        v, sources = len(kept), sorted(s for g, s in groups if g == la)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[la, s][t] for t in kept})
        p = {s: {t: 1 + math.floor(Fraction(10**9 * (c[t] + 1), sum(c[x] for x in kept) + v)) for t in kept} for s, c in [(None, whole), *((s, counts[la, s]) for s in sources)]}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], p[None][t]), t) for t in kept if counts[la, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                out |= {(la, s, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])}
    return out


def audited(df, **options):
    rows = divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_audit_on_ugly_rows(spark, ugly, nothing):
    for least in (1, 2, 3):
        assert audited(ugly, least_docs=least) == plain_audit([(r.lang, r.source, r.text) for r in ugly.collect()], least)
    assert audited(nothing) == set()


def test_audit_of_random_words(spark):
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "gamma", "Ünder", "über", "日本", "x", "y"]
    rows = [(str(rng.choice(["en", "de"])), f"s{rng.integers(5)}", " ".join(rng.choice(words, rng.integers(0, 9), p=[.4, .2, .1, .1, .1, .05, .03, .02]))) for _ in range(60)] + [("xx", "a", "only here"), ("xx", "b", ""), (None, None, "1 2")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = plain_audit(rows)
    assert audited(df) == want and any(r[0] == "xx" and r[4] == 0 for r in want)
    assert audited(df, ranks=2) == plain_audit(rows, ranks=2)


def test_audit_is_exact_for_large_counts(spark):
    got = spark.createDataFrame([(9_000_000_000_000_000, 1_000_000_000_000_000_000, 7)], "c long, n long, v long").select(divergence.scaled(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (9 * 10**15 + 1) // (10**18 + 7)


# quality


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, 3)), np.zeros(1), np.ones(1))
    x = rng.normal(size=(6, 40)) * (rng.random((6, 40)) < 0.3)
    row, at = np.nonzero(x)
    got, _ = m.sums(quality.Entries(6, row, at, x[row, at]))
    for k in range(6):
        pairs = sum(m.v[i] @ m.v[j] * x[k, i] * x[k, j] for i in range(40) for j in range(i))
        assert got[k] == pytest.approx(0.3 + m.w @ x[k] + pairs)


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.1, rng.normal(size=20), rng.normal(size=(20, 2)), np.zeros(1), np.ones(1))
    x, y = rng.normal(size=(4, 20)), np.array([0, 1, 1, 0.0])
    row, at = np.nonzero(x)
    e = quality.Entries(4, row, at, x[row, at])
    loss = lambda m: -np.mean(y * np.log(m.score(e)) + (1 - y) * np.log(1 - m.score(e)))
    new = quality.trained(m, e, y, 1e-4, batch=4)
    assert loss(new) < loss(m)
    moved = np.sign(m.w - new.w)
    for i in range(20):
        up = quality.Machine(m.w0, m.w + 1e-6 * (np.arange(20) == i), m.v, m.mean, m.scale)
        assert np.sign(loss(up) + quality.DECAY * 1e-6 * m.w[i] - loss(m)) == moved[i]


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.queries()["op13_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) >= 0.97


def test_scores_do_not_see_other_columns(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    even = F.col("doc_id") % 2 == 0
    one, name = quality.classify(docs, labels, even)
    other, _ = quality.classify(docs.withColumns({"lang": F.lit("q"), "source": F.lit(None).cast("string")}), labels.withColumn("quality", F.when(even, F.col("quality")).otherwise(1 - F.col("quality"))), even)
    assert {r.doc_id: r[name] for r in one.collect()} == {r.doc_id: r[name] for r in other.collect()}


def test_labels_of_absent_rows_take_no_place(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    slim = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "n_chars")
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("label"))
    absent = spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("label"))
    assert quality.examples(slim, known.unionByName(absent), 80).count() == 80


def test_toxic_examples_are_texts_there_are(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    absent = spark.range(10_000, 20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    one, votes = toxicity.choose_examples(docs, labels, "toxic", 30)
    other, same = toxicity.choose_examples(docs, labels.unionByName(absent.select(labels.columns)), "toxic", 30)
    assert one.count() > 30 and votes == same and set(map(tuple, one.collect())) == set(map(tuple, other.collect()))


def test_quality_on_ugly_rows(spark, ugly, nothing):
    df = ugly.withColumn("n_chars", F.when(F.col("doc_id") > 4, F.length("text").cast("long")))
    labels = spark.createDataFrame([(4, 1), (4, 0), (8, 0), (None, 1), (5, None), (77, 1)], "doc_id long, quality int")
    for given, want in ((labels, None), (labels.limit(0), 0.5)):
        scored, name = quality.classify(df, given, F.lit(True))
        assert scored.columns == [*df.columns, name]
        rows = scored.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
        assert all(0 <= r[name] <= 1 if want is None else r[name] == want for r in rows)
    assert quality.classify(nothing.withColumn("n_chars", F.lit(1).cast("long")), labels, F.lit(True))[0].collect() == []
