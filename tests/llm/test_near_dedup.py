import random

import pytest

import corpus_pipeline
from cairn.llm import minhash


def grams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_classes(texts):
    """The least index of each text's class, by the Jaccard likeness of all pairs."""
    sets, least = [grams(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                a, b = least[i], least[j]
                least = [min(a, b) if c in (a, b) else c for c in least]
    return least


def texts_of(rng):
    vocab = [f"Word{i}" for i in range(3000)]
    out = [" ".join(rng.choices(vocab, k=rng.choice([3, 5, 12, 60, 200, 600]))) for _ in range(40)]
    for t in out[:40] * 4:
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w).lower())
    # 16 of 20 and 15 of 20 runs in common
    line = [f"x{i}" for i in range(22)]
    return [*out, " ".join(line), " ".join([*line[:20], "y", "z"]), " ".join(line[:19]), None, "", " \n"]


@pytest.mark.parametrize("block", [minhash.BLOCK, 4])
def test_stage_keeps_one_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = texts_of(random.Random(11))
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "/root/testdata/sf0.001")
    want = slow_classes(texts)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want)) and len(set(want)) > 60
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, corpus_pipeline.NEAR).collect()} == dict(enumerate(want))


def test_ids_that_repeat(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(3, a), (5, a + " more"), (5, "c d e f g h"), (None, None), (None, ""), (None, "q r s t"), (7, "u v"), (7, "u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text or "") for r in minhash.one_of_each(docs).collect())
    assert got == [(-1, ""), (-1, "q r s t"), (3, a), (5, "c d e f g h"), (7, "u v")]
    assert minhash.one_of_each(docs.limit(0)).count() == 0
