"""The stage near_dedup finds candidates by operator 3's deletion variants; bands are beside them, not in their place."""

import random

import corpus_pipeline
from cairn.llm import minhash, simhash
from tests.llm.test_near_dedup import slow_classes


def documents(spark, texts):
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def copies():
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(3000)]
    out = [rng.choices(vocab, k=900) for _ in range(8)]
    near = [[*w[:-2], "other", "end"] for w in out]
    return [" ".join(w) for w in out + near]


def test_deletion_variants_find_what_bands_miss(spark):
    """One band of 64 rows takes equal signatures only; links then come from SimHash, and none without it."""
    texts = copies()
    docs, want = documents(spark, texts), slow_classes(texts)
    assert want == [*range(8)] * 2
    classes = lambda **by: [r.class_id for r in sorted(minhash.near_duplicates(docs, minhash.MinHash(bands=1, **by)).collect())]
    found = classes(bits=4)
    prints = {r.doc_id: r.component_id for r in simhash.components(docs, 4, 5).collect()}
    assert [prints[i] for i in range(16)] == found
    assert sum(a == b for a, b in zip(found, want)) >= 14
    assert classes() != found


def test_links_are_checked_exactly(spark):
    """Texts of one SimHash, by one shingle that outvotes the others, are no near copies unless their sets are alike."""
    same = " ".join(["a b c d e"] * 200)
    texts = [f"{same} {' '.join(f'{k}{i}' for i in range(60))}" for k in "pqr"]
    docs = documents(spark, texts)
    assert len({r.component_id for r in simhash.components(docs, 4, 5).collect()}) == 1
    assert sorted(r.class_id for r in minhash.near_duplicates(docs, corpus_pipeline.NEAR).collect()) == slow_classes(texts) == [0, 1, 2]


def test_stage_has_its_step(spark, monkeypatch):
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, bits=4, *a: asked.append(bits) or links(distinct, bits, *a))
    texts = copies()
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(spark, texts), "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in got.collect()) == list(range(8)) and asked == [4]
