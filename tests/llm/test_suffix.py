import hashlib
import random

import numpy as np
import pytest

from cairn.llm import base, suffix


def slow(texts, length=100):
    """texts: bytes in order of doc; kept bytes, removed, spans."""
    seen, out = {}, []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            else:
                seen[w] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["th", "the", "ons", "é", "tion", "er", " ", ". ", "ab"]
    fresh = lambda k: "".join(rng.choice(words) for _ in range(k))
    common = [fresh(60) for _ in range(4)]
    texts = ["", None, "short", "x" * 99, "x" * 100, "y" * 350, "ab" * 300, "z" * 101 + "q" + "z" * 101]
    for _ in range(n):
        t = "".join(rng.choice([fresh(rng.randrange(5, 90)), rng.choice(common), rng.choice(common)[rng.randrange(20) :]]) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.3:
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice("éx.") + t[k + 1 :]
        texts.append(t)
    texts += texts[10:25]
    rng.shuffle(texts)
    return texts


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, n int").repartition(5)
    out = suffix.cut_repeats(docs, **more)
    return [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out.collect()]


@pytest.mark.parametrize("most", [suffix.SEGMENTS, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(spark, seed, most):
    texts = made(seed)
    want = [(i, *w) for i, w in enumerate(slow([(t or "").encode() for t in texts]))]
    assert sorted(run(spark, [(i, t, 0, 1) for i, t in enumerate(texts)], most=most)) == want


def test_repeated_rows_and_null_ids(spark):
    texts = made(3, 20)
    rows = [(i, t, 0, 1) for i, t in enumerate(texts)]
    want = [(i, *w) for i, w in enumerate(slow([(t or "").encode() for t in texts]))]
    rows[-1] = (None, texts[-1], 0, 1)
    want[-1] = (None, *want[-1][1:])
    got = run(spark, rows + rows[5:9])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want + want[5:9], key=key)
    assert run(spark, []) == []


def test_window_classes():
    rng = random.Random(4)
    line = bytes(rng.choice(b"ab") for _ in range(400))
    texts, offsets, counts = [], [], []
    for _ in range(50):
        a = rng.randrange(0, 200)
        n = rng.randrange(1, 60)
        texts.append(line[a : a + n + 99])
        counts.append(n)
        offsets.append((200 - a) % 3 + 3 * rng.randrange(5))
    seg, number, cls = suffix.window_classes(texts, np.array(offsets), np.array(counts))
    by = {}
    for s, k, c in zip(seg, number, cls):
        by.setdefault(c, set()).add(texts[s][k : k + 100])
    assert all(len(w) == 1 for w in by.values())
    assert len(by) == len({texts[s][k : k + 100] for s, k in zip(seg, number)})


#: Added to the bytes of a text, this leaves a polynomial hash in ``base`` modulo 2^64 as it is (a short lattice vector).
UNSEEN = [5, 1, 4, -2, -1, 1, -1, -3, 2, 0, 0, -2, 1, 6, 3, -5, -2, 1, -1, 1]


def test_equal_quick_hashes_are_no_repeat(spark):
    """Two different texts of 100 bytes with the same anchor, whose quick hashes are the same."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        one = rng.integers(ord("h"), ord("t"), 100).astype(np.uint8)
        two = one.copy()
        two[:20] += np.array(UNSEEN).astype(np.uint8)
        (h,), _, _, _, _ = suffix.segments(one, np.array([0, 100]))
        (g,), _, _, _, _ = suffix.segments(two, np.array([0, 100]))
        if h == g:
            break
    edge = np.array([0]), np.array([100])
    assert h == g and (one != two).any() and base.span_hashes(one, *edge) == base.span_hashes(two, *edge)
    texts = [one.tobytes().decode(), two.tobytes().decode(), two.tobytes().decode()]
    want = [(i, *w) for i, w in enumerate(slow([t.encode() for t in texts]))]
    assert [w[2] for w in want] == [0, 0, 100]
    assert sorted(run(spark, [(i, t, 0, 1) for i, t in enumerate(texts)])) == want


@pytest.mark.parametrize("length", [5, 12, 50, 110, 300])
def test_other_lengths(spark, length):
    texts = made(length, 40)
    want = [(i, *w) for i, w in enumerate(slow([(t or "").encode() for t in texts], length))]
    assert sorted(run(spark, [(i, t, 0, 1) for i, t in enumerate(texts)], length=length, most=1000)) == want
    with pytest.raises(ValueError):
        suffix.gram_of(4)


def test_clashing_names(spark):
    names = ["doc_id", "text", "n_bytes", "spans", "kept", "key", "null", "tie", "a.b", "TEXT2", "n_chars", "__key", "c0"]
    texts = made(7, 10)
    rows = [(i, t, *range(i, i + 11)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in names))
    got = sorted(suffix.without_repeats(docs).collect())
    assert suffix.without_repeats(docs).columns == names
    cut = {r.doc_id: r.kept.decode(errors="ignore") for r in suffix.cut_repeats(docs, trim=True).collect()}
    for row, r in zip(rows, got):
        assert r[2:10] == row[2:10] and r[11:] == row[11:] and r[1] == (None if row[1] is None else cut[row[0]])


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, suffix.op10_suffix_dedup(spark, sf).collect())) == sorted(con.sql(suffix.SQL).fetchall())
