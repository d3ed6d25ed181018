import random

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash
from cairn.operators.components import connected_components


def slow_print(text):
    words = bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """pairs: (doc_id, fp)"""
    left, out = set(range(len(pairs))), {}
    while left:
        group, front = set(), [left.pop()]
        while front:
            i = front.pop()
            group.add(i)
            near = [j for j in left if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 4]
            left.difference_update(near)
            front += near
        least = min((pairs[i][0] for i in group if pairs[i][0] is not None), default=None)
        out.update((i, least) for i in group)
    return out


def test_texts(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    texts = [None, "", " \t\n", "One", "two Words", "ÄB äB \x85x \x1cy", *base, *base[:5]]
    for t in base[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(None if i == 9 else i, t, "x", 2) for i, t in enumerate(texts)] + [(4, "two Words", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.components(docs).collect()
    pairs = [(d, slow_print(t)) for d, t, *_ in rows]
    want = slow_components(pairs)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(((d, p, want[i]) for i, (d, p) in enumerate(pairs)), key=key)
    assert simhash.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("plan", [None, simhash.Layout(5, 2), simhash.Layout(6, 3)])
@pytest.mark.parametrize("block", [4096, 8])
def test_links_are_whole(spark, plan, block):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(3):
            w = v
            for b in rng.sample(range(64), rng.randint(1, 6)):
                w ^= 1 << b
            values.add(w)
    hub = rng.getrandbits(64)
    values |= {hub ^ 1 << a ^ 1 << b for a in range(0, 64, 5) for b in range(0, 64, 7)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    near = connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, plan, block))
    got = {}
    for r in near.collect():
        got.setdefault(r.component, set()).add(r.node % (1 << 64))
    want = {}
    for i, c in slow_components([(i, v) for i, v in enumerate(values)]).items():
        want.setdefault(c, set()).add(values[i])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_majority_of_long_texts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 3000, np.uint64)
    sizes = np.array([0, 1, 255, 256, 0, 2488])
    got = simhash.majority(h, sizes)
    ends = np.cumsum(sizes)
    for g, a, b in zip(got.tolist(), ends - sizes, ends):
        assert g == sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h[a:b]) > b - a)
