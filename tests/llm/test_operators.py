import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.test_queries import rows
from wayline.llm import chat, exact_dedup, lm_scoring, mixing, near_dedup, nearest, pieces, privacy, registry, substring, toxicity


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows(got, columns) == rows(want, columns)


# substring dedup


@pytest.mark.parametrize("split", [16_384, 20])
def test_repeats_equal_brute_force(spark, sf, documents, monkeypatch, split):
    monkeypatch.setattr(substring, "SPLIT", split)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.queries()["op1_substring_dedup"](spark, sf).collect()}
    table = sorted((r.doc_id, r.text) for r in documents.collect())
    want = {i: (n, k, brute.sha(t)) for (i, _), (n, k, t) in zip(table, brute.without_repeats(table), strict=True)}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_automaton_tells_the_longest_earlier_suffix():
    r = random.Random(3)
    for _ in range(200):
        a, before = substring.SuffixAutomaton(), []
        for _ in range(3):
            text = [r.choice("abc") for _ in range(r.randint(0, 12))]
            got = a.take_in(text)
            for j in range(len(text)):
                earlier = ["".join(t) for t in before] + ["".join(text[:j])]
                longest = max(n for n in range(j + 2) if n == 0 or any("".join(text[j + 1 - n : j + 1]) in e for e in earlier) or "".join(text[j + 1 - n : j + 1]) in "".join(text[:j]))
                assert got[j] == longest
            before.append(text)


def test_repeats_on_ugly_rows(ugly, nothing):
    got = substring.remove_repeats(ugly).collect()
    order = sorted(((r.doc_id, r.text) for r in ugly.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, brute.sha(r[1] or "")))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter((i, *w) for (i, _), w in zip(order, brute.without_repeats(order), strict=True))
    assert substring.remove_repeats(nothing).collect() == []


# nearest neighbours


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_recall_and_exact_scores(spark, sf, metric):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    got = defaultdict(list)
    for r in nearest.search(table, F.col("id") % 20 == 0, k=20, metric=metric).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    score = lambda a, b: float(a @ b) if metric == "ip" else -float(((a - b) ** 2).sum())
    hits = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted(((-score(x[q], v), i) for i, v in x.items() if i != q))[:20]
        hits += len({i for _, i in want} & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and all(abs(s - score(x[q], x[i])) < 1e-12 for i, s in got[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits >= 0.9 * 20 * len(got)


def test_recall_on_many_vectors(spark, monkeypatch):
    """20,000 vectors about 400 centres, their queries in several batches over several blocks."""
    monkeypatch.setattr(nearest, "QUERY_BATCH", 300)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 32))[rng.integers(0, 400, 20_000)] + 0.5 * rng.normal(size=(20_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in nearest.search(df, F.col("id") % 20 == 0, k=20).collect():
        found[r.query_id].add(r.id)
    products = x[::20].astype(np.float64) @ x.T.astype(np.float64)
    products[np.arange(len(products)), np.arange(0, len(x), 20)] = -np.inf
    want = np.argsort(-products, axis=1)[:, :20]
    assert len(found) == len(want) and sum(len(found[20 * q] & set(w.tolist())) for q, w in enumerate(want)) >= 0.95 * want.size


def test_floors_change_nothing(spark, monkeypatch):
    """Of 40 kept candidates over 20 blocks, the same come back as over one block, ties and copies among them."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1200, 6)), 1).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    found = []
    for size in (60, 8192):
        monkeypatch.setattr(nearest, "BLOCK", size)
        found.append({tuple(r) for r in nearest.search(df, F.col("id") % 20 == 0, k=20, reranked=40).collect()})
    assert found[0] == found[1] and len(found[0]) == 60 * 20


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_rows_that_codes_tell_little_of(spark, monkeypatch, metric):
    """Wide noise, near copies, lengths and offsets of many sizes: the nearest are those of brute force, with bounded codebooks."""
    monkeypatch.setattr(nearest, "SAMPLE", 512)
    monkeypatch.setattr(nearest, "ROUNDS", 2)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(3, 48))
    kinds = [rng.normal(size=(3000, 256)), np.concatenate([rng.normal(size=(900, 48)) * np.exp(3 * rng.normal(size=(900, 1))), centre[rng.integers(0, 3, 900)] + 1e-5 * rng.normal(size=(900, 48)), 1e12 * rng.normal(size=(3, 48)), 50 + 1e-3 * rng.normal(size=(600, 48))])]
    table, n = [], 0
    for x in kinds:
        table.append((np.arange(n, n + len(x)), x.astype(np.float32)))
        n += len(x)
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"vec_id": i, "embedding": x.tolist()}) for i, x in table]), "vec_id long, embedding array<float>")
    found = defaultdict(dict)
    for r in nearest.search(df, F.col("id") % 20 == 0, k=20, metric=metric).collect():
        found[r.query_id][r["rank"]] = (r.id, r.score)
    for ids, x in table:
        x = x.astype(np.float64)
        for q in np.flatnonzero(ids % 20 == 0):
            score = np.cumsum(x * x[q] if metric == "ip" else -((x - x[q]) ** 2), axis=1)[:, -1]
            score[q] = -np.inf
            want = np.lexsort((ids, -score))[:20]
            assert [found[ids[q]][k] for k in range(1, 21)] == [(ids[w], score[w]) for w in want]


def test_doubles_are_not_cut(spark):
    v = [(0, [1.0, 0.0]), (1, [1 + 1e-12, 0.0]), (2, [1 + 2e-12, 3.0]), (3, [1e200, 0.0])]
    got = nearest.search(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("id") == 0, k=20).collect()
    assert sorted((r["rank"], r.id, r.score) for r in got) == [(1, 3, 1e200), (2, 2, 1 + 2e-12), (3, 1, 1 + 1e-12)]


def test_lengths_and_repeated_ids(spark):
    v = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (20, [1.0, 1.0, 1.0]), (3, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 3.0])]
    got = nearest.search(spark.createDataFrame(v, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == [(0, 1, 0, 0.0), (0, 1, 1, 0.5), (0, 2, 0, 0.0), (0, 2, 1, 0.0), (20, 1, 3, 3.0), (20, 2, 3, 2.0)]


def test_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, 0.5]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "class": F.lit("c"), "v": F.lit(0)})
    got = nearest.search(df, F.col("id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 8, 0.5)]
    assert nearest.search(df.limit(0), F.col("id") % 20 == 0).collect() == []


# pieces


def test_pieces_equal_the_library(spark, documents, ugly, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for df in (documents, ugly):
        want = Counter((r.doc_id, *sp.encode(r.text or ""), sp.decode(sp.encode(r.text or ""))) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, *r.ids, r.decoded) for r in pieces.encode_decode(df, pieces.model_path()).collect()) == want
    assert pieces.encode_decode(nothing, pieces.model_path()).collect() == []
    m = pieces.PieceModel(open(pieces.model_path(), "rb").read())
    r = random.Random(1)
    parts = [*map(chr, range(32, 127)), *"äöüéñ▁中文😀\n\t\r\x00", "▁▁", "the", "ing", " the", "<s>", "<0x0A>", "  "]
    for k in range(3000):
        t = "".join(r.choice(parts if k % 2 else parts[65:90] + [" "]) for _ in range(r.randint(0, 50)))
        ids = sp.encode(t)
        assert list(np.frombuffer(m.roundtrip(t)[0], np.int32)) == ids and m.roundtrip(t)[1] == sp.decode(ids)
    for _ in range(500):
        ids = [r.randrange(0, 400) for _ in range(r.randint(0, 8))]
        assert m.decode(ids) == sp.decode(ids)
    lists = spark.createDataFrame([(1, [1, 400, None]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(lists, pieces.model_path()).collect()} == {1: sp.decode([1, 400]), 2: ""}


def test_texts_are_decoded_from_their_ids():
    """All ids of a text, also of chunks that are known: with other names of the tokens other texts come back."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    m = pieces.PieceModel(open(pieces.model_path(), "rb").read())
    taken, inner = [], m.inner
    m.inner = lambda ids: taken.append(list(ids)) or inner(ids)
    texts = ["the house", "the house the house", "中 the 😀 house\n", "", " ", "house\u0000"]
    for t in texts:
        assert m.roundtrip(t)[1] == sp.decode(sp.encode(t)) and taken.pop() == sp.encode(t)
    m.shown = [f" {i}" for i in range(len(m.text))]
    for t in texts[:2]:
        assert m.roundtrip(t)[1] == " ".join(map(str, sp.encode(t)))


def test_searches_ask_for_few_tokens_and_frequent_chunks_once(documents, monkeypatch):
    """A search draws the longest tokens and their beginnings, not all tokens of all places; a chunk in steady use stays known."""
    import sentencepiece

    monkeypatch.setattr(pieces, "MEMO", 40)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    m = pieces.PieceModel(open(pieces.model_path(), "rb").read())
    drawn, searched, search, search_ids = [], Counter(), m.search, m.search_ids

    class Counted:
        def iter_long(self, text, *start):
            for found in search.iter_long(text, *start):
                drawn.append(found)
                yield found

        def iter(self, text):
            for found in search.iter(text):
                drawn.append(found)
                yield found

    def counted(text):
        searched[text] += 1
        return search_ids(text)

    m.search, m.search_ids = Counted(), counted
    words = sorted({w for r in documents.limit(300).collect() for w in (r.text or "").split(" ") if w.isalpha() and len(w) < 30})[:3000]
    n = 0
    for w in words:
        ids = sp.encode("often " + w)
        assert list(np.frombuffer(m.roundtrip("often " + w)[0], np.int32)) == ids
        n += len(ids)
    assert len(words) > 1000 and searched[pieces.MARK + "often"] == 1 and len(drawn) < 2 * n


# language-model scores


def test_scores_on_ugly_rows(spark, ugly, nothing):
    got = lm_scoring.score_documents(ugly).collect()
    assert len(got) == len(ugly.collect()) and all(np.isfinite(r.log_score) for r in got)
    assert {r.log_score for r in got if r.n_words == 0} == {0.0}
    assert lm_scoring.score_documents(nothing).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_equals_its_definition(spark, order):
    texts = ["a b c d", "a b c", "b c d e", "x", "", "a b x"]
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), order=order).collect()}
    grams = lambda t, n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    for i, t in enumerate(texts):
        rest = [s.split() for k, s in enumerate(texts) if k != i]
        count = lambda g: sum(grams(s, len(g))[tuple(g)] for s in rest)  # noqa: B023, E731
        total = max(1, sum(map(len, rest)))
        want = 0.0
        w = t.split()
        for k in range(len(w)):
            n = min(order, k + 1)
            penalty = 1.0
            while n > 1 and not count(w[k + 1 - n : k + 1]):
                n, penalty = n - 1, penalty * 0.4
            want += np.log(penalty * (max(count(w[k : k + 1]), 1) / total if n == 1 else count(w[k + 1 - n : k + 1]) / count(w[k + 1 - n : k])))
        assert got[i].n_words == len(w) and got[i].log_score == pytest.approx(want)


def test_order_of_three_counts_longer_contexts(spark, sf):
    two, three = ({r.doc_id: r for r in registry.queries()[q](spark, sf).collect()} for q in ("op4_lm_score_order2", "op4_lm_score"))
    assert two.keys() == three.keys() and all(two[i].n_words == three[i].n_words and two[i].n_seen >= three[i].n_seen for i in two)
    assert sum(r.n_seen for r in three.values()) > 0 and any(two[i].log_score != three[i].log_score for i in two)


# toxicity


def all_cosines(index):
    """examples x words: the unit vectors, from the postings."""
    full = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        part = slice(index.starts[t], index.starts[t + 1])
        full[index.place[part], t] = index.weight[part]
    return full


def test_words_are_the_matches_of_the_pattern(ugly):
    import re

    texts = ["".join(map(chr, range(256))), "".join(f"a{chr(k)}b" for k in range(0x3000)), *(r.text or "" for r in ugly.collect())]
    for text in [*texts, *(t.lower() for t in texts), *(f"x{chr(k)}y{chr(k)}" for k in range(256))]:
        assert toxicity.words(text) == toxicity.any_words(text) == re.findall(r"\w+", text)


def test_words_in_use_come_first_where_they_are_looked_up(spark):
    docs = spark.createDataFrame([(k, " ".join(["zebra", f"a{k}", *(["yak"] if k % 2 else [])])) for k in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    index = toxicity.learn(docs, labels)
    sizes = np.diff(index.starts)[list(index.terms.values())]
    assert list(index.terms)[:2] == ["zebra", "yak"] and list(sizes) == sorted(sizes, reverse=True)
    at, w = index.vector("yak Zebra zebra unheard")
    assert {list(index.terms)[list(index.terms.values()).index(k)] for k in at} == {"yak", "zebra"} and w @ w == pytest.approx(1)


def test_neighbours_are_exact_and_held_out_rows_are_told(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    small = toxicity.learn(docs.filter("doc_id < 2000"), labels)
    assert len(small.ids) > 3 * toxicity.BLOCK and small.leans.any() and not small.leans.all()
    full = all_cosines(small)
    assert np.allclose((full**2).sum(1)[(full > 0).any(1)], 1)
    texts = [r.text or "" for r in docs.filter("doc_id >= 2000").limit(400).collect()] + ["", "zzzz"]
    for text, (_, places, cosines) in zip(texts, small.nearest(texts), strict=True):
        at, w = small.vector(text)
        exact = full[:, at] @ w
        want = np.lexsort((np.arange(len(exact)), -np.round(exact, 9)))[: toxicity.NEAREST]
        want = want[exact[want] > 0]
        assert places.tolist() == want.tolist() and np.allclose(cosines, exact[want], atol=1e-9)
    got = registry.queries()["op5_toxicity"](spark, d).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert right >= 0.85 * sum(r.predicted for r in got) and right >= 0.85 * sum(r.toxic == 1 for r in got)
    for low, high in ((0.0, 0.1), (0.1, 0.6), (0.6, 1.01)):  # calibration
        part = [r for r in got if low <= r.score < high]
        assert abs(np.mean([r.score for r in part]) - np.mean([r.toxic for r in part])) < 0.15


def test_score_is_the_share_of_weighted_votes(spark):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} text number{i} of{i} these", i % 2) for i in range(0, 60)]
    rows += [(101, "quartz zebra never seen elsewhere", 1), (103, "lagoon otter never seen elsewhere", 0)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert {101, 103} <= {r[0] for r in learned}
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, rows[-2][1]), (1001, rows[-1][1]), (1002, "unheard"), (101, "quartz zebra never seen elsewhere, again")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert (got[1000].evidence[0].doc_id, got[1000].evidence[0].cosine) == (101, 1.0) and got[1000].score > toxicity.THRESHOLD
    assert (got[1001].evidence[0].doc_id, got[1001].evidence[0].cosine) == (103, 1.0) and got[1001].score < got[1000].score
    index = toxicity.learn(docs, labels)
    assert len(index.ids) == len({r[0] for r in learned}) and index.leans[index.terms["vile"]] and not index.leans[index.terms["kind"]]
    for i, leaning in ((1000, False), (1, True), (1002, False)):
        votes = [(e.label, e.cosine**2 * (toxicity.FLOOR + e.shared)) for e in got[i].evidence]
        want = (sum(v for y, v in votes if y) + toxicity.SMOOTHING * index.rate[leaning]) / (sum(v for _, v in votes) + toxicity.SMOOTHING)
        assert got[i].score == pytest.approx(min(1.0, want))
    assert got[1002].evidence == []
    lean = {w: index.lean[t] for w, t in index.terms.items() if index.leans[t]}
    text = {r[0]: r[1] for r in rows}
    for e in got[1].evidence:
        mine, its = ({w for w in text[i].split() if w in lean} for i in (1, e.doc_id))
        assert e.shared == pytest.approx(sum(lean[w] for w in mine & its) / sum(lean[w] for w in mine | its) if mine | its else 1)


def test_words_weigh_as_tf_idf(spark):
    texts = ["vile vile word", "kind word", "word of calm", "vile calm"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    index = toxicity.learn(docs, labels)
    for text in texts:
        at, w = index.vector(text)
        seen = [t for t in index.terms if t in text.split()]
        raw = {t: (1 + np.log(text.split().count(t))) * (np.log(5 / (1 + sum(t in x.split() for x in texts))) + 1) for t in seen}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        assert {t: w[list(at).index(index.terms[t])] for t in seen} == pytest.approx({t: v / norm for t, v in raw.items()})


def test_toxicity_on_ugly_rows(spark, ugly, nothing):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(ugly, labels).collect()
    assert len(got) == ugly.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score_toxicity(ugly, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, labels).collect() == []
    assert toxicity.drop_toxic(ugly, labels.limit(0)).collect() == ugly.collect() and toxicity.drop_toxic(nothing, labels).columns == ugly.columns


# exact dedup


def test_exact_groups(spark, ugly, nothing):
    for support in (0.001, 0.2):
        got = exact_dedup.duplicate_groups(ugly, support=support).collect()
        by = defaultdict(list)
        for r in got:
            by[r.text_sha256].append(r)
        assert len(got) == ugly.count() and all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
        assert sorted(len(g) for g in by.values()) == [1, 1, 1, 1, 1, 1, 1, 2, 3, 3]
        assert {r.keep_id for r in by[brute.sha("one")]} == {4}
        kept = exact_dedup.drop_exact_duplicates(ugly, support=support)
        assert kept.columns == ugly.columns and kept.count() == len(by)
    assert exact_dedup.duplicate_groups(nothing).collect() == [] and exact_dedup.drop_exact_duplicates(nothing).collect() == []
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert exact_dedup.drop_exact_duplicates(hot).agg(F.count("*"), F.min("doc_id")).first() == (2001, 0)


# near duplicates


def test_components_equal_brute_force(spark, sf, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op7_near_dedup"](spark, sf).collect()}
    assert got == brute.near_components([(r.doc_id, r.text) for r in documents.collect()])


def test_a_group_of_edited_copies(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(250):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            w[r.randrange(len(w))] = f"x{k}_{r.randrange(99999)}"
        texts.append(" ".join(w[: r.choice([150, 150, 120])]))
    table = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    want = brute.near_components(table)
    assert got == want and 1 < len({c for _, c in want.values()}) < 250


def test_sketches_fill_and_agree_as_sets_do():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 400, 4000)]
    s = near_dedup.sketches(sets)
    assert (s != near_dedup._OPEN).all()
    a = np.unique(r.integers(0, 2**63, 700).astype(np.uint64))
    agree = [(lambda x: (x[0] == x[1]).mean())(near_dedup.sketches([a[:600], a[k:]])) for k in (0, 100, 300)]
    assert np.allclose(agree, [600 / 700, 500 / 700, 300 / 700], atol=0.09)


def test_near_on_ugly_rows(ugly, nothing):
    got = near_dedup.near_duplicates(ugly).collect()
    assert len(got) == ugly.count() and {(r.doc_id, r.component_id) for r in got if r.n_shingles == 0} == {(1, 1), (2, 2), (3, 3), (None, None)}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4} and {r.component_id for r in got if r.doc_id in (-9, 10)} == {-9}
    assert near_dedup.near_duplicates(nothing).collect() == []
    kept = near_dedup.drop_near_duplicates(ugly)
    assert kept.columns == ugly.columns and near_dedup.drop_near_duplicates(nothing).collect() == []
    rows_ = list(enumerate((r.doc_id, r.text) for r in ugly.select("doc_id", "text").collect()))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected_kept([r for _, r in rows_])


def expected_kept(rows_):
    """[(id, text)] -> what drop_near_duplicates keeps: of each component one of the rows of the smallest id, and of those the
    class with the smallest number; so here only components whose choice is clear."""
    of = brute.near_components(list(enumerate(t for _, t in rows_)))
    groups = defaultdict(list)
    for k, (n, c) in of.items():
        groups[c if n else ("none", k)].append(rows_[k])
    return Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())


def test_shared_and_missing_ids_lose_nothing(spark):
    r = random.Random(4)
    text = lambda: [f"w{r.randrange(10**9)}" for _ in range(80)]
    edited = lambda w, k: " ".join([*w[:k], f"new{k}", *w[k + 1 :]])
    a, b, c, d = text(), text(), text(), text()
    rows_ = [(1, " ".join(a)), (2, edited(a, 40)), (2, " ".join(b)), (None, edited(a, 10)), (None, edited(b, 50)), (None, " ".join(c)), (None, edited(c, 20)), (7, " ".join(d)), (7, " ".join(d)), (7, " ".join(d).upper()), (9, " ".join(d))]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    of = brute.near_components(list(enumerate(t for _, t in rows_)))
    least = defaultdict(list)
    for k, (_, g) in of.items():
        least[g] += [rows_[k][0]] if rows_[k][0] is not None else []
    want = Counter((rows_[k][0], n, min(least[g], default=None)) for k, (n, g) in of.items())
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df).collect()) == want
    assert len({g for _, g in of.values()}) == 4
    kept = near_dedup.drop_near_duplicates(df).collect()
    assert len(kept) == 4 and {(x.doc_id, x.text) for x in kept} >= {(1, " ".join(a)), (2, " ".join(b))} and [x.doc_id for x in kept].count(7) == 1 and [x.doc_id for x in kept].count(None) == 1


# personal data


def test_spans_equal_the_patterns(spark, sf, documents, ugly, nothing):
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice(r.choice(["0123456789.- ", "a@.b-%+ ", "0123.@+()- ", "01+ .-()", "4 -0@a."])) for _ in range(r.randint(0, 40)))
        assert [s for s in privacy.find_spans(t) if s[0] in privacy.BASE] == brute.base_spans(t)
    texts = {x.doc_id: x.text or "" for x in documents.collect()}
    for x in registry.queries()["op8_personal_data"](spark, sf).collect():
        want = brute.base_spans(texts[x.doc_id])
        assert x.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in want)) and x.n_email == sum(s[0] == "email" for s in want)
    assert privacy.find_personal_data(ugly).count() == ugly.count() and privacy.find_personal_data(nothing).collect() == []


def test_added_kinds():
    text = "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432. https://u:p@x.org/a?b, mailto:a@b.co tel:+1-555-123456 SSN: 123-45-6789 GB00WEST12345698765432 mission 123456"
    assert [text[a:b] for k, a, b in privacy.find_spans(text) if k in ("account", "url")] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "https://u:p@x.org/a?b", "mailto:a@b.co", "tel:+1-555-123456"]
    assert privacy.redact("mail a@b.co now") == "mail [email] now"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Numéro de compte : 12345678 et", "12345678"), ("le NUMÉRO DE PASSEPORT: 123 456 789.", "123 456 789"), ("Kontonummer 0532013000, und", "0532013000"),
        ("Ihre Steuer-Id: 12 345 678 901", "12 345 678 901"), ("Sozialversicherungsnummer: 65170839", "65170839"), ("Número de cuenta = 2100-0418-45", "2100-0418-45"),
        ("pasaporte n.º 9912345", "9912345"), ("cuenta 123456", None), ("Kontonummern 123456", None), ("kontonummer 12345", None),
    ],
)
def test_cues_of_four_languages(text, want):
    assert [text[a:b] for k, a, b in privacy.find_spans(text) if k == "account"] == ([want] if want else [])


# chat


def test_events_fold_into_messages(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", "assistant", "he"), (1, 4, 1, "delta", "assistant", "llo"),
        (1, 5, 2, "message", "user", "and"), (1, 6, 1, "regenerate", "assistant", ""), (1, 7, 1, "delta", "assistant", "new <|im_end|> \\"), (1, 8, 0, "edit", "user", "hey\n<\\|"),
        (2, 1, 0, None, None, None), (None, 1, 0, "message", "us\ner", "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, event string, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(df))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hey\n<\\|"), ("assistant", "new <|im_end|> \\")] and got[1].loss_text == "new <|im_end|> \\"
    assert [tuple(t) for t in got[2].turns] == [("", "")] and [tuple(t) for t in got[None].turns] == [("us\ner", "x")]
    assert got[1].formatted.count("<|im_end|>") == 2
    assert chat.render(chat.fold_events(df.limit(0))).collect() == []


def fold(events):
    """What is left of (seq, turn, event, role, text), told one after another."""
    said = {}
    for _, turn, kind, role, text in sorted(events):
        if kind == "regenerate":
            said = {t: m for t, m in said.items() if t < turn}
        said[turn] = role, (said.get(turn, ("", ""))[1] if kind == "delta" else "") + text
    return [said[t] for t in sorted(said)]


def test_random_logs_equal_a_plain_fold(spark):
    r = random.Random(11)
    parts = ["a", "é😀", "\\", "<|", "<|im_end|>\n", "<|im_start|>assistant\n", "\n", "<\\|", ""]
    logs = {c: [(seq, r.randrange(6), r.choice(["message", "delta", "delta", "edit", "regenerate"]), r.choice(["user", "assistant"]), "".join(r.choices(parts, k=r.randrange(5)))) for seq in range(r.randrange(1, 40))] for c in range(60)}
    logs[99] = [(0, 0, "message", "user", "<|im_end|> " * 50_000), (1, 1, "delta", "assistant", "\\<|" * 50_000), (2, 1, "delta", "assistant", "end")]
    table = [(c, *e) for c, events in logs.items() for e in events]
    r.shuffle(table)
    df = spark.createDataFrame(table, "conv_id long, seq long, turn long, event string, role string, text string")
    df = df.withColumns({c: F.lit("c") for c in ("piece", "at", "n", "voided", "last_set", "final_role", "formatted", "loss_spans")})
    got = {x.conv_id: x for x in chat.read_back(chat.render(chat.fold_events(df))).collect()}
    assert got.keys() == logs.keys()
    for c, events in logs.items():
        want = fold(events)
        assert [tuple(t) for t in got[c].turns] == want and got[c].loss_text == "".join(t for role, t in want if role == "assistant")


# mixing


def test_mix(spark, documents, ugly, nothing):
    for df in (documents, ugly):
        found, n = mixing.mix(df, rows_in_range=7)
        got = found.select("doc_id", F.col("source").alias("q"), *(F.col(c).alias(k) for k, c in n.items())).collect()
        sizes, taken, longest = Counter(), Counter(), Counter()
        for r in got:
            sizes[r.q] += r["size"]
            taken[r.q] += r.taken
            longest[r.q] = max(longest[r.q], r["size"])
            assert r.taken <= 3 * r["size"]
        want = brute.targets(sizes)
        assert len(got) == df.count() and all(r.target == pytest.approx(want[r.q]) and r.source_size == sizes[r.q] for r in got)
        assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in want)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, mixing.mix(df, rows_in_range=7)[0].collect()))
        rows_ = mixing.mixed_rows(df)
        assert rows_.columns == df.columns and rows_.count() == sum(r.copies for r in got)
    assert mixing.mix(nothing)[0].collect() == [] and mixing.mixed_rows(nothing).collect() == []


@pytest.mark.parametrize("sizes", [{"a": 0, "b": 5}, {"a": 1, "b": 1000, "c": 10, None: 7}, {"a": 3}, {"a": 0, "b": 0}])
def test_targets_equal_resharing(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, rows long, size long"))
    assert {r.source: r.target for r in got.collect()} == {s: pytest.approx(t) for s, t in brute.targets(sizes).items()}


def test_word_hashes_see_words():
    texts = ["one Two\tone", None, "", " one", "é\x85é two"]
    from wayline.llm._hashing import slices, word_hashes

    ((_, _, data, offsets),) = list(slices(pa.array(texts)))
    h, at = word_hashes(data, offsets, lower=True)
    assert at.tolist() == [0, 3, 3, 3, 4, 6] and h[0] == h[2] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 3
