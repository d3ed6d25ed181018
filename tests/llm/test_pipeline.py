"""Each stage of the pipeline, and run(), against plain Python over the same rows."""

import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import base, mixing, quality, simhash, suffix
from tests.llm.test_near_dedup import slow_classes
from tests.llm.test_operators import M64, budgets, slow_mix

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)
SPACE = rb"[^\x20\x09-\x0d]+"


def slow_score(text, model):
    """The factorisation machine's score of one text: features by loops, every pair of features by itself."""
    raw, p = (text or "").encode(), model.params
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = re.findall(SPACE, lower)
    code = lambda w: slow_mix((sum((c + 1) * pow(base._BASE, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & M64)
    hashes = [code(w) for w in words]
    counts = collections.Counter(h >> (64 - p.bits) for h in hashes)
    x = {k: math.sqrt(c) / math.sqrt(len(words)) for k, c in counts.items()}
    n, n_words = max(1, len(raw)), max(1, len(words))
    part = lambda test: sum(map(test, raw)) / n
    letter, capital, digit = (lambda c: 97 <= c <= 122), (lambda c: 65 <= c <= 90), (lambda c: 48 <= c <= 57)
    shares = [part(letter), part(capital), part(digit), part(lambda c: 33 <= c <= 126 and not (letter(c) or capital(c) or digit(c))), part(lambda c: c in (9, 11, 12, 13, 32)), part(lambda c: c >= 128)]
    levels = [math.sqrt(s) for s in shares]
    levels.append(min(1, math.sqrt(part(lambda c: c == 10)) * 2))
    levels.append(min(1, sum(map(len, words)) / n_words / 16))
    levels.append(1 - len(counts) / n_words)
    levels.append(math.sqrt(sum(a == b for a, b in zip(hashes, hashes[1:])) / n_words))
    levels.append(math.sqrt(sum(len(w) > 14 for w in words) / n_words))
    levels.append(min(1, math.log2(len(raw) + 1) / 20))
    for k, v in enumerate(levels):
        x[(1 << p.bits) + quality.LEVELS * k + min(quality.LEVELS - 1, int(v * quality.LEVELS))] = 0.3
    at, value = np.array(list(x)), np.array(list(x.values()))
    v = model.v[at].astype(float) * value[:, None]
    return 1 / (1 + math.exp(-(model.bias + model.w[at].astype(float) @ value + np.triu(v @ v.T, 1).sum())))


def slow_cut(texts, length=100):
    """Texts without bytes of windows met before; spans give way to characters."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i + 1] += 1
                gone[i + length + 1] -= 1
            seen.add(w)
        gone = np.concatenate([[0], np.cumsum(gone)[1:-1] > 0, [0]]).astype(int)
        edges = np.flatnonzero(np.diff(gone))
        kept, at = b"", 0
        inside = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
        for a, z in edges.reshape(-1, 2).tolist():
            while inside(a):
                a += 1
            while inside(z):
                z -= 1
            kept, at = kept + raw[at:a], z
        out.append(None if t is None else (kept + raw[at:]).decode())
    return out


def slow_mixed(rows, spec):
    """Of (doc_id, text, lang, source) those that the mix takes once."""
    tokens, leaf = {}, {}
    for d, t, lang, source in rows:
        number = re.search(r"\d{1,9}", source or "")
        leaf[d] = ("d?" if number is None else f"d{int(number.group()) % 4}", lang or "?", source or "?")
        tokens.setdefault(leaf[d], []).append((hashlib.md5(f"{d}/{spec.seed}/0".encode()).hexdigest()[:13], d, len(re.findall(r"[^ \t\n\r]+", t or ""))))
    total = {p: sum(n for _, _, n in x) for p, x in tokens.items()}
    got = budgets(total, spec, int(spec.fraction * sum(total.values())))
    out = set()
    for p, x in tokens.items():
        run = 0
        for _, d, n in sorted(x):
            run += n
            if run > got[p] and total[p]:
                break
            out.add(d)
    return out


def slow_run(rows, model):
    """doc_id: (n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, text, lang, source) in order of doc_id."""
    rows = [r for r in rows if slow_score(r[1], model) >= quality.THRESHOLD]
    rows = [rows[i] for i, k in enumerate(slow_classes([r[1] for r in rows])) if i == k]
    rows = [(r[0], t, *r[2:]) for r, t in zip(rows, slow_cut([r[1] for r in rows]))]
    chosen = slow_mixed(rows, mixing.Mix(mixing.WEIGHTS, corpus_pipeline.FRACTION))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for d, t, *_ in rows:
        if d in chosen:
            ids = library.encode(t or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            out[d] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    everything = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {d: slow_score(r.text, model) for d, r in everything.items()}
    for r in quality.score(docs, model).collect():
        assert r.score == pytest.approx(scores[r.doc_id], abs=1e-4)
    good = STAGES["quality"](spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {d for d, s in scores.items() if s >= quality.THRESHOLD} and 0 < len(kept) < len(everything)

    one = STAGES["near_dedup"](spark, good, SF).cache()
    ids = sorted(kept)
    assert {r.doc_id for r in one.collect()} == {ids[k] for k in slow_classes([everything[d].text for d in ids])}

    cut = STAGES["repeats"](spark, one, SF).cache()
    ids = sorted(r.doc_id for r in one.collect())
    want = dict(zip(ids, slow_cut([everything[d].text for d in ids])))
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = STAGES["mix"](spark, cut, SF).cache()
    assert mixed.columns == docs.columns
    chosen = slow_mixed([(r.doc_id, r.text, r.lang, r.source) for r in cut.collect()], mixing.Mix(mixing.WEIGHTS, corpus_pipeline.FRACTION))
    assert {r.doc_id for r in mixed.collect()} == chosen and len(chosen) < len(ids)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    last = STAGES["bpe"](spark, mixed, SF).collect()
    assert {r.doc_id for r in last} == chosen
    for r in last:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = slow_run(sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()), model)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


#: Names that stages use inside, or that need quotes.
NAMES = ["n_bytes", "spans", "kept", "key", "label", "score", "__score", "__kept", "__null", "tie", "size", "z", "row", "h", "set", "node", "n", "epoch", "p0", "budget", "a.b", "c0", "component_id"]


def odd(spark):
    common = "The committee met on Tuesday and spoke about the river, the bridge and the old road to the mill for two hours. "
    rows = [(3, None), (3, "same words here today"), (3, "same words here today"), (None, None), (None, common * 3), (None, common * 3), (1, ""), (2, common + "é" * 150), (4, "x" * 300_000), (5, " ".join(f"w{i}" for i in range(40_000)))]
    table = spark.createDataFrame([(d, t, "en", None, 7, *range(len(NAMES))) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in NAMES))
    return table.repartition(4)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_clashing_names(spark, name):
    docs = odd(spark)
    out = STAGES[name](spark, docs, SF)
    got = out.collect()
    if name == "bpe":
        assert sorted(r.doc_id or -1 for r in got) == [-1, -1, -1, 1, 2, 3, 3, 3, 4, 5]
        return
    assert out.columns == docs.columns and out.schema == docs.schema
    assert all([r[c] for c in NAMES] == list(range(len(NAMES))) for r in got)
    texts = collections.Counter((r.doc_id, r.text) for r in got)
    before = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    if name == "repeats":
        assert len(got) == 10 and texts[(3, None)] == 1 and texts[(None, None)] == 1
        # equal rows are one document and share its result; only the runs of x repeat in one text
        assert texts[(3, "same words here today")] == 2 and all(r.n_chars == (7 if r.text is None else len(r.text)) for r in got)
        assert next(len(r.text) for r in got if r.doc_id == 4) == 1
    elif name == "near_dedup":
        assert texts == {(1, ""): 1, (2, docs.filter("doc_id = 2").first().text): 1, (3, "same words here today"): 1, (4, "x" * 300_000): 1, (5, docs.filter("doc_id = 5").first().text): 1, (None, docs.filter("doc_id is null and text is not null").first().text): 1}
    else:
        assert all(texts[k] in (0, before[k]) for k in before) and texts.keys() <= before.keys()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = STAGES[name](spark, docs, SF)
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (None, "q r s t"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'src1' as source", "9L as n_chars")
    got = sorted(((r.doc_id or -1, r.text or "") for r in simhash.one_of_each(docs).collect()))
    assert got == [(-1, "q r s t"), (1, "a b c d e f"), (3, "")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    assert suffix.without_repeats(docs).count() == 6 and suffix.without_repeats(docs.limit(0)).count() == 0


def test_labels_bound_rows(spark):
    """One labelled doc_id with very many rows sends one of them; null ids and no documents send none."""
    docs = spark.range(3000).selectExpr("if(id < 2900, 1L, if(id < 2950, null, id)) as doc_id", "concat('some text ', id) as text")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2960, 0), (None, 1), (77777, 1)], "doc_id long, quality int")
    seen = []
    train, quality.train = quality.train, lambda i, x, o, y, p: seen.append(y.tolist()) or train(i, x, o, y, p)
    try:
        model = quality.fit(docs, labels, quality.FmParams(max_rows=10))
        quality.fit(docs.limit(0), labels)
    finally:
        quality.train = train
    assert len(seen) == 1 and len(seen[0]) <= 2
    got = quality.score(docs, model).collect()
    assert len(got) == 3000 and all(0 <= r.score <= 1 for r in got)
