import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from cairn.llm import audio, chat, minhash, mixing, quality, sharding

TEXTS = ["", None, "a", "x" * 192, "Hello world. " * 40, "é" * 300, "same text here", "same text here", "y z " * 9000]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, ["en", None][i % 2], ["src1", "src2", None][i % 3], 5, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, size int, score double").repartition(3)


def test_audio(spark):
    got = {r.doc_id: r for r in audio.audio_features(audio.store_media(docs(spark))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        full = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        table = audio.read_tensors(r.features)
        assert table.column("tensor").combine_chunks().to_numpy_ndarray().shape[1:] == (32, 16)
        assert table.column("end_s")[-1].as_py() == pytest.approx((r.n_frames + 1) * 64 / 16000)
    assert got[6].features == got[7].features
    assert audio.audio_features(audio.store_media(docs(spark, []))).count() == 0


def test_audio_alone_or_together():
    p = audio.AudioParams()
    rng = np.random.default_rng(2)
    clips = [bytes(rng.integers(0, 256, 192 * k, np.uint8)) for k in (1, 3, 7, 50, 2)]
    front = audio.Frontend(p)
    for clip, (t, n, s) in zip(clips, front.features(clips)):
        ((u, m, v),) = front.features([clip])
        assert n == m and (t == u).all() and (s == v).all()
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * np.arange(192 * 50) / 24000)).astype(np.uint8).tobytes()
    y = front.resample([tone]).ravel()[200:-200]
    assert abs(np.argmax(np.abs(np.fft.rfft(y * np.hanning(len(y))))) * 16000 / len(y) - 1000) < 20


def draw(doc, path, weight):
    h = int(hashlib.md5(f"{doc}/{path}".encode()).hexdigest()[:13], 16)
    return -math.log((h + 0.5) / 2.0**52) / weight


def shard_of(doc, leaves):
    """Down the tree by plain loops."""
    path = ""
    for level in range(3):
        weight = {}
        for leaf in leaves:
            if (".".join(leaf.paths[level].split(".")[:level])) == path:
                weight[leaf.paths[level]] = weight.get(leaf.paths[level], 0.0) + leaf.weight
        path = min(weight, key=lambda p: draw(doc, p, weight[p]))
    return int(path.split(".")[2])


def test_sharding(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    leaves = sharding.tree(16)
    got = sharding.number(sharding.assign(rows, leaves, sharding.grow(leaves)), 5).collect()
    by = {}
    for r in got:
        want = shard_of(r.doc_id, leaves)
        assert r.shard == want
        assert r.grown_shard in (want, 16) and r.grown_shard == shard_of(r.doc_id, sharding.grow(leaves))
        assert r.text_crc32 == zlib.crc32(str(r.doc_id % 7).encode())
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 16
    assert all(130 < len(s) < 250 for s in by.values())
    other = sharding.number(sharding.assign(rows, leaves, sharding.grow(leaves)), 1).collect()
    assert sorted((r.doc_id, r.slot) for r in got) == sorted((r.doc_id, r.slot) for r in other)
    assert 0.03 < sum(r.grown_shard == 16 for r in got) / 3000 < 0.09
    assert sorted(r.size for r in sharding.assign(docs(spark), sharding.tree(4)).collect()) == sorted(len((t or "").encode()) + 1 for t in TEXTS)


@pytest.mark.parametrize("weight", [3.0, 0.2])
def test_sharding_moves_rows_only_where_weights_change(spark, weight):
    leaves = sharding.tree(16)
    changed = [sharding.Leaf(x.shard, x.region, x.rack, weight if x.shard == 5 else 1.0) for x in leaves]
    got = sharding.assign(spark.range(4000).selectExpr("id as doc_id", "'' as text"), leaves, changed).collect()
    region, rack = ({x.shard: getattr(x, level) for x in leaves} for level in ("region", "rack"))
    if weight < 1:  # what shrinks by this is what grows the other way round
        moves = [(r.grown_shard, r.shard) for r in got]
    else:
        moves = [(r.shard, r.grown_shard) for r in got]
    assert 50 < sum(a != b for a, b in moves) < 2000
    for a, b in moves:
        if region[a] != region[b]:
            assert region[b] == region[5]
        elif rack[a] != rack[b]:
            assert rack[b] == rack[5]
        elif a != b:
            assert b == 5
    assert all(a == b for a, b in moves if region[b] != region[5])


def test_sharding_odd_rows(spark):
    leaves = sharding.tree(3, 2)
    same = [(7, "x")] * 40 + [(None, None)] * 5 + [(None, "y")]
    table = spark.createDataFrame(same, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot", "3 as `a.b`")
    got = sharding.number(sharding.assign(table, leaves), 6).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 46 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and {r.grown_shard for r in got} == {None}
    assert sharding.number(sharding.assign(table.limit(0), leaves), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.descend(sharding.F.col("doc_id"), [sharding.Leaf(0, 0, 0, 0.0)])


def share(amount, weights, room):
    """Split ``amount`` by weight, one full child after the other."""
    out, left, open_ = [0] * len(room), min(amount, sum(room)), [i for i in range(len(room)) if room[i] > 0 and weights[i] > 0]
    while left > 0 and open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] - out[i] <= left * weights[i] / total]
        for i in full:
            left -= room[i]
            out[i] = room[i]
            open_.remove(i)
        if full:
            continue
        for i in open_:
            out[i] = int(left * weights[i] / total)
        spare = left - sum(out[i] for i in open_)
        for i in sorted(open_, key=lambda i: (-weights[i], i)):
            more = min(spare, room[i] - out[i])
            out[i] += more
            spare -= more
        break
    return out


def budgets(leaves, mix, amount):
    """Tokens of each leaf path of ``leaves`` (path to tokens), down the tree."""
    out = {}

    def down(prefix, amount, below):
        if len(prefix) == 3:
            out[prefix] = amount
            return
        names = sorted({p[: len(prefix) + 1] for p in below})
        under = {n: {p: t for p, t in below.items() if p[: len(n)] == n} for n in names}
        for n, a in zip(names, share(amount, [float(mix.weights.get(n, 1.0)) for n in names], [sum(under[n].values()) * mix.max_epochs for n in names])):
            down(n, a, under[n])

    down((), amount, leaves)
    return out


def got_budgets(spark, leaves, spec):
    table = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "p0 string, p1 string, p2 string, tokens long")
    return {tuple(r[:3]): r.budget for r in mixing.budgets(table, spec).select(*mixing.PATHS, "budget").collect()}


def test_shares(spark):
    def got(amount, weights, room):
        rows = [("p", f"{i:03d}", r, float(w), amount) for i, (w, r) in enumerate(zip(weights, room))]
        out = mixing.share(spark.createDataFrame(rows, "p string, name string, room long, weight double, amount long"), ["p"], "name")
        return [r.got for r in sorted(out.collect(), key=lambda r: r.name)]

    assert got(100, [1, 1, 2], [10, 100, 100]) == [10, 30, 60]
    assert got(1000, [1, 1], [10, 20]) == [10, 20]
    assert got(7, [1, 1, 1, 0], [5, 0, 5, 9]) == [4, 0, 3, 0] == share(7, [1, 1, 1, 0], [5, 0, 5, 9])
    rng = random.Random(3)
    for n in (3, 12, 40):
        weights, room = [rng.choice([0, 1, 2, 2.5, 7]) for _ in range(n)], [rng.choice([0, 3, 50, 400, 5000]) for _ in range(n)]
        for amount in (0, 17, sum(room) // 3, sum(room) * 2):
            assert got(amount, weights, room) == share(amount, weights, room)


def test_budgets(spark):
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "y", "3"): 1000}
    spec = mixing.Mix(fraction=200 / 1110)
    assert got_budgets(spark, leaves, spec) == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("b", "y", "3"): 100}
    rng = random.Random(5)
    leaves = {(f"d{i % 4}", f"l{i % 3}", f"s{i}"): rng.choice([0, 5, 80, 900]) for i in range(60)}
    for weights, fraction, epochs in (({}, 0.5, 1), ({("d0",): 5.0, ("d0", "l1"): 3.0, ("d1", "l0", "s9"): 9.0}, 0.8, 3), ({("d2",): 0.0}, 0.9, 1)):
        spec = mixing.Mix(weights, fraction, epochs)
        assert got_budgets(spark, leaves, spec) == budgets(leaves, spec, int(fraction * sum(leaves.values())))


@pytest.mark.parametrize("bucket", [1 << 14, 20])
def test_mix_takes_prefixes(spark, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = [(i, " ".join(["w"] * (i % 11)), "en", f"src{i % 2}", i) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    spec = mixing.Mix({("d0",): 3.0}, 0.8, 2)
    got = {}
    for r in mixing.mix(table, spec, epoch="epoch").collect():
        got.setdefault(r.source, []).append((r.epoch, r.doc_id))
    tokens = {s: sum(i % 11 for i in range(600) if i % 2 == s) for s in (0, 1)}
    want = budgets({(f"d{s}", "en", f"src{s}"): n for s, n in tokens.items()}, spec, int(0.8 * sum(tokens.values())))
    for s, n in tokens.items():
        whole, rest = divmod(want[(f"d{s}", "en", f"src{s}")], n)
        chosen, run = [(e, i) for e in range(whole) for i in range(600) if i % 2 == s], 0
        for i in sorted((i for i in range(600) if i % 2 == s), key=lambda i: hashlib.md5(f"{i}/{spec.seed}/{whole}".encode()).hexdigest()[:13]):
            run += i % 11
            if run > rest:
                break
            chosen.append((whole, i))
        assert sorted(got[f"src{s}"]) == sorted(chosen)
    assert mixing.mix(docs(spark, []), spec).count() == 0
    assert mixing.mix(docs(spark), mixing.Mix(fraction=1.0)).count() == len(TEXTS)


def test_mix_odd_rows(spark):
    names = ["doc_id", "text", "lang", "source", "n", "tie", "p0", "whole", "a.b", "__domain", "k"]
    rows = [(None, "a b c", None, None), (None, "a b c", None, None), (4, None, "en", "src1"), (4, "x y", "en", "src1"), (4, "x y", "en", "src1"), (5, "", "de", "web")]
    table = spark.createDataFrame([(*r, *range(7)) for r in rows], ", ".join(f"`{c}` {'string' if c in ('text', 'lang', 'source') else 'long'}" for c in names))
    for fraction in (0.0, 0.4, 0.7, 1.0):
        got = mixing.mix(table, mixing.Mix(fraction=fraction))
        assert got.columns == names
        counts = {}
        for r in got.collect():
            counts[tuple(r[:4])] = counts.get(tuple(r[:4]), 0) + 1
            assert tuple(r[4:]) == tuple(range(7))
        # repeated rows stay or go together
        assert all(n == rows.count(k) for k, n in counts.items())
        if fraction == 1.0:
            assert sum(counts.values()) == 6


def test_mix_many_leaves(spark):
    """As many leaves as documents: no cap."""
    table = spark.range(3000).selectExpr("id as doc_id", "'a' as text", "'en' as lang", "concat('host', id) as source")
    got = mixing.mix(table, mixing.Mix(fraction=0.5)).count()
    assert got == 1500


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", chat.TRICKY), (1, 1, "assistant", None), (None, 0, "sys:t\\em", "### x </turn>\n"), (2, 3, None, "z" * 3000), (2, 4, "assistant", "\\" * 5)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.fold_events(chat.as_events(table)), row_chars=500)
    got = {r.conv_id: r for r in chat.read_chats(out).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_chats(chat.format_chats(chat.fold_events(chat.as_events(table.limit(0))))).count() == 0
    with pytest.raises(ValueError):
        list(chat.parse("### user: no end"))


def test_quality(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "of", "river", "stone", "walks"], 30)) for _ in range(150)]
    bad = [" ".join(["BUY!!!"] * 20) + str(i) for i in range(50)]
    table = docs(spark, [*good, *bad, *TEXTS])
    labels = spark.createDataFrame([*((i, 1) for i in range(150)), *((150 + i, 0) for i in range(50)), (None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert len(got) == 200 + len(TEXTS) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= quality.THRESHOLD) == (i < 150) for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.95
    assert got[206] == got[207] and got[200] == got[201]
    assert quality.score(table, quality.fit(table, labels.limit(0))).first().score == 0.5
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and kept.count() == sum(s >= quality.THRESHOLD for s in got.values())


def test_pair_identity():
    rng = np.random.default_rng(3)
    m = quality.Model(quality.FmParams(), 0.1, rng.normal(size=50).astype("f4"), rng.normal(size=(50, 4)).astype("f4"))
    i, x = np.array([3, 7, 9]), np.array([0.5, 1.0, 2.0], np.float32)
    slow = 0.1 + m.w[i] @ x + sum(m.v[a] @ m.v[b] * x[p] * x[q] for p, a in enumerate(i) for q, b in enumerate(i) if p < q)
    assert m.raw(i, x, np.array([0, 3]))[0] == pytest.approx(slow, rel=1e-5)


def slow_bands(clip, p, exact=True):
    """Log-mel bands, energy and segments of one clip by plain loops; without ``exact`` no coefficient is rounded."""
    near = (lambda v, unit: np.rint(v * unit)) if exact else (lambda v, unit: v * unit)
    x = np.array([b - 128.0 for b in clip])
    wide, taps = max(p.up, p.down), p.half_taps * max(p.up, p.down)
    y = []
    for m in range(len(x) * p.up // p.down):
        total = 0.0
        for i in range(max(0, (m * p.down - taps) // p.up), min(len(x), (m * p.down + taps) // p.up + 1)):
            k = m * p.down - i * p.up
            if abs(k) <= taps:
                total += x[i] * near(np.sinc(k / wide) * (0.5 + 0.5 * np.cos(np.pi * k / (taps + 1))) * p.up / wide, 1024)
        y.append(total)
    size = 2 * p.hop
    t = np.arange(size)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * (t + 0.5) / size)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (e / 2595) - 1) for e in np.linspace(mel(60.0), mel(p.out_rate / 2), p.n_mels + 2)]
    bands, energy = [], []
    for start in range(0, len(y) - size + 1, p.hop):
        frame = np.array(y[start : start + size])
        power = []
        for b in range(1, p.hop + 1):
            re, im = (sum(frame * near(f(2 * np.pi * b * t / size) * window, 65536)) for f in (np.cos, np.sin))
            power.append((re * re + im * im) * 2.0**-44)
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            freq = [(b + 1) * p.out_rate / size for b in range(p.hop)]
            w = [max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for f in freq]
            if not any(w):
                w[min(range(p.hop), key=lambda b: abs(freq[b] - mid))] = 1.0
            row.append(sum(a * b for a, b in zip(power, w)))
        bands.append([np.rint(np.log2(v + 1) * 32) for v in row])
        energy.append(int(np.rint(np.log2(sum(row) + 1) * 256)))
    mean, active, segments = sum(energy) // len(energy), False, []
    for k, e in enumerate(energy):
        if not active and e - mean >= p.on * 256:
            active = True
            segments.append([k, len(energy)])
        elif active and e - mean < -p.off * 256:
            active = False
            segments[-1][1] = k
    return np.array(bands), segments


def test_audio_against_loops():
    p, rng = audio.AudioParams(), np.random.default_rng(6)
    loud = lambda n: rng.integers(0, 256, n)
    quiet = lambda n: rng.integers(126, 131, n)
    clips = [np.concatenate(c).astype(np.uint8).tobytes() for c in ([loud(192)], [quiet(960), loud(1152), quiet(768), loud(960)], [loud(480), quiet(1440)], [np.full(384, 32)])]
    clips.append(("some text, as bytes. " * 100).encode()[:1920])
    found = 0
    for clip, (tensors, n, segments) in zip(clips, audio.Frontend(p).features(clips)):
        want, parts = slow_bands(clip, p)
        got = tensors.reshape(-1, p.n_mels)
        assert n == len(want) and np.abs(got[:n] - want).max() <= 1 and not got[n:].any()
        assert segments.tolist() == parts
        found += len(parts)
        free, _ = slow_bands(clip, p, exact=False)
        assert np.abs(got[:n] - free)[free > 200].max(initial=0) <= 2
    assert found >= 3


def test_audio_is_stored(spark):
    """Tensors and spans are read from files; odd rows have them too."""
    table = spark.createDataFrame([(None, None, 1, 2), (4, "x" * 500, 1, 2), (4, "x" * 500, 1, 2)], "doc_id long, text string, media int, `a.b` int")
    stored = audio.audio_features(audio.store_media(table))
    assert stored.inputFiles() and all("audio" in f for f in stored.inputFiles())
    got = stored.collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == [(-1, 0), (4, 500), (4, 500)]
    for r in got:
        spans = audio.read_tensors(r.features)
        assert spans.column("start_s")[0].as_py() == 0.0 and r.n_frames == r.payload_bytes * 2 // 3 // 64 - 1


M64 = (1 << 64) - 1


def slow_mix(h):
    for _ in range(2):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & M64
    return h ^ h >> 32


def slow_signature(text, p=minhash.MinHash()):
    """The signature of one text with Python's integers, word by word; also the set of its runs of words."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    runs = [words[i : i + p.shingle] for i in range(max(1, len(words) - p.shingle + 1))] if words else []
    step, base = 0x9FB21C651E98DF25, 0x9E3779B97F4A7C15
    hashes = set()
    for run in runs:
        h = 0
        for w in run:
            one = slow_mix((sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & M64)
            h = slow_mix((h * step + one) & M64)
        hashes.add(h)
    if not hashes:
        return [0xFFFF] * p.perms, set()
    return [slow_mix(min((h * int(a) + int(b)) & M64 for h in hashes)) >> 48 for a, b in zip(*p.coefficients())], {tuple(r) for r in runs}


def test_minhash_edits(spark):
    rng = random.Random(9)
    vocab = [f"Word{i}" for i in range(400)]
    texts = [*TEXTS, *(" ".join(rng.choices(vocab, k=k)) for k in (4, 5, 6, 90, 400)), "  \n\t", "A b"]
    texts += [" ".join([*texts[12].split()[:80], "x", "y"])]
    got = {r.doc_id: r for r in minhash.compare_edits(docs(spark, texts)).collect()}
    n = len(texts)
    like = lambda x, y: max(0.0, (sum(a == b for a, b in zip(x, y)) / 64 - 2**-16) / (1 - 2**-16))
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % n] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        (own, mine), (new, theirs), (nxt, _) = slow_signature(t), slow_signature(edited), slow_signature(after)
        assert np.frombuffer(got[i].fingerprint, "<u2").tolist() == own
        assert np.frombuffer(got[i].edited_fingerprint, "<u2").tolist() == new
        assert got[i].near_next == pytest.approx(like(own, nxt)) and got[i].near_edited == pytest.approx(like(own, new))
        if mine | theirs:
            assert abs(got[i].near_edited - len(mine & theirs) / len(mine | theirs)) < 0.25
    assert got[7].near_next == 1.0 and got[1].near_next == 1.0
    assert minhash.compare_edits(docs(spark, [])).count() == 0


def test_minhash_odd_rows(spark):
    rows = [(None, "a b c"), (None, None), (3, "x y z"), (3, "x y z"), (3, "other words"), (2, "")]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, tie int, `set` int, `a.b` int")
    got = minhash.compare_edits(table).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((d or -1, len(t or "")) for d, t in rows)
    # descending ids, nulls last, the first after the last; rows of one id by a hash of their texts
    key = lambda r: (r[0] is None, -(r[0] or 0), np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64))
    line = sorted(rows, key=key)
    want = []
    for (d, t), (_, after) in zip(line, line[1:] + line[:1]):
        t, half = t or "", len(t or "") // 2
        want.append((d or -1, hashlib.sha256((t[: len(t) - half] + (after or "")[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted(want)


def test_minhash_query(spark):
    """Classes beside fingerprints, against the Jaccard likeness of all pairs."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {d: slow_signature(t)[1] for d, t in texts.items()}
    got = {r.doc_id: r for r in minhash.op4_minhash(spark, sf).collect()}
    assert got.keys() == texts.keys()
    least = {d: d for d in texts}
    for d in texts:
        for e in texts:
            both = len(sets[d] & sets[e])
            if d < e and 5 * both >= 4 * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((least[d], least[e]))
                least = {k: a if v == b else v for k, v in least.items()}
    assert {d: r.class_id for d, r in got.items()} == least and len(set(least.values())) < len(texts)


def test_minhash_near_duplicates(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{k}" for k in rng.integers(0, 500, 200)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:190], "tail"]) for b in base[:3]] + [" ".join(base[0]), "", None]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {**{i: i for i in range(6)}, 6: 0, 7: 1, 8: 2, 9: 0, 10: 10, 11: 10}
