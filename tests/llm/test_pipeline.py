import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm import brute
from wayline.llm import mixing, pieces, registry


def test_each_stage_against_a_plain_version(spark, sf, documents):
    import sentencepiece

    stages, docs = dict(corpus_pipeline.STAGES), documents
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    key = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())

    clean = stages["toxicity"](spark, docs, sf)
    bad = {r.doc_id for r in registry.queries()["op5_toxicity"](spark, sf).filter("predicted = 1").collect()}
    assert clean.columns == docs.columns and key(clean) == Counter({k: n for k, n in key(docs).items() if k[0] not in bad})

    once = stages["exact_dedup"](spark, clean, sf)
    first = {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())

    apart = stages["near_dedup"](spark, once, sf)
    want = {i for i, (_, c) in brute.near_components([(r.doc_id, r.text) for r in once.collect()]).items() if i == c}
    assert {r.doc_id for r in apart.collect()} == want

    mixed = stages["mixing"](spark, apart, sf)
    found, n = mixing.mix(apart)
    times = {r.doc_id: r[n["copies"]] for r in found.collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in times.items() if c})

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r.doc_id: r.text or "" for r in apart.collect()}
    out = stages["sentencepiece"](spark, mixed, sf).collect()
    assert len(out) == mixed.count() and all(r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in random.Random(1).sample(out, 50))

    run = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.ids_sha256) for r in run.collect()) == Counter((r.doc_id, r.ids_sha256) for r in out)


def test_pipeline_on_ugly_and_empty_tables(spark, sf, ugly, nothing):
    """Each stage row by row, on nulls, blanks, repeated ids and rows and very long texts."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for df in (ugly, nothing):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, sf), name)
            old, new = rows(before), rows(docs) if name != "sentencepiece" else None
            if new is not None:
                assert docs.columns == df.columns and set(new) <= set(old), name
            if name == "toxicity":
                assert new == old  # nothing here is toxic
            elif name == "exact_dedup":
                assert Counter(plain(t) for _, t, *_ in new.elements()) == Counter({plain(t) for _, t, *_ in old})
            elif name == "near_dedup":
                apart = brute.near_components([(k, t) for k, (_, t, *_) in enumerate(old.elements())])
                assert new.total() == sum(k == c for k, (_, c) in apart.items())
            elif name == "mixing":
                found, n = mixing.mix(before)
                copies = Counter()
                for r in found.collect():
                    copies[r.doc_id, r.text, r.lang, r.source] += r[n["copies"]]
                assert new == +copies
            else:
                assert Counter((i, *sp.encode(t or "")) for i, t, *_ in old.elements()) == Counter((r.doc_id, *r.ids) for r in docs.collect())
        assert (docs.count() > 0) == (df is ugly)
