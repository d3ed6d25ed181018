"""Document fingerprints (4): MinHash with universal hash permutations in numpy.

A text's shingles are runs of five words (A-Z lower-cased, cut at ASCII white space; fewer words make one shingle). Each
of ``perms`` permutations ``a * x + b`` modulo 2^64 (a odd) gives the least image of the shingles, of which 16 mixed bits
are kept. The share of equal components, corrected for chance, estimates the Jaccard likeness of the shingle sets.

``near_duplicates`` joins bands of the signature in Spark and verifies links by the exact Jaccard likeness of the sets;
equal sets are one class from the start, keys over the same documents count once, links within a band key come out as a
spanning forest, and keys of many documents are dealt to pairs of blocks. A pair of likeness J shares a key of r rows in
one of b bands with probability 1 - (1 - J^r)^b: at 0.8, 0.9998 with 16 bands of 4, and all but 5 in 10^8 with 32. With
``bits``, operator 3's deletion-variant signatures find candidates first, and bands those that it misses. The
registered query has both: fingerprints beside edited texts, and each document's class.

Edge cases: a null or empty text, or one of white space, has no shingles; all such are alike (likeness 1) and unlike any
other; equal texts have equal fingerprints; repeated rows stay rows; a null ``doc_id`` sorts last in descending order,
rows of one ``doc_id`` by a hash of their texts; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import base, simhash
from cairn.operators.components import connected_components

#: Documents, and shingles of theirs, of a band key that a task compares at once.
BLOCK = 4096
GRAMS = 1 << 21
#: Bits of the filter that says whose texts may be asked for; its size is fixed, so it can be broadcast whatever the input.
FILTER = 1 << 26


@dataclass(frozen=True)
class MinHash:
    perms: int = 64
    shingle: int = 5
    bands: int = 16
    threshold: float = 0.8
    seed: int = 5
    #: Where it is set, texts whose SimHash over the same shingles links at so many bits are candidates too.
    bits: int | None = None

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, np.iinfo(np.uint64).max, (2, self.perms), np.uint64, endpoint=True)
        return a | np.uint64(1), b


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeats included, and the offsets of the texts."""
    small = base.LOWER[data]
    starts, ends, first = base.words(small, offsets)
    hashes = base.span_hashes(small, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return base.shingle_hashes(hashes, first, size)


def signatures(h: np.ndarray, offsets: np.ndarray, p: MinHash) -> np.ndarray:
    """(n, perms) uint16; a text without shingles has all ones."""
    n = len(offsets) - 1
    out = np.full((n, p.perms), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        for k, (a, b) in enumerate(zip(*p.coefficients())):
            out[full, k] = (base.mix(np.minimum.reduceat(h * a + b, at)) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows of signatures, 0 to 1: the share of equal components beyond chance."""
    chance = 2.0**-16
    return np.maximum(0.0, ((x == y).mean(axis=-1) - chance) / (1 - chance))


def texts_signatures(column: pa.Array, p: MinHash) -> np.ndarray:
    return signatures(*shingles_of(*base.flat(column), p.shingle), p)


def set_of(grams: np.ndarray) -> bytes:
    """The name of a set of shingles (sorted hashes)."""
    return hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()


def set_names(h: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The name of each text's set of shingles, and its size."""
    sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return [set_of(s) for s in sets], [len(s) for s in sets]


_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("set", pa.binary()), ("n", pa.int64()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
EDITED = "kind int, part int, row long, doc_id long, tie long, n_chars long, edited_sha256 string, set binary, n long, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"


def edit(text: str, after: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(rows: list[tuple], texts: list[str], after: list[str], own: np.ndarray, following: np.ndarray, p: MinHash, part: int) -> pa.RecordBatch:
    """Of rows (row, doc_id, tie, set, n) with their texts, and those after them, what ``compare_edits`` returns."""
    edited = [edit(t, a) for t, a in zip(texts, after)]
    other = texts_signatures(pa.array(edited, pa.string()), p)
    n, (row, ids, ties, names, sizes) = len(rows), zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(row, pa.int64()), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array([s.tobytes() for s in own], pa.binary()), pa.array([s.tobytes() for s in other], pa.binary()),
        pa.array(likeness(own, other)), pa.array(likeness(own, following)), pa.nulls(n, pa.string()),
    ], schema=_SCHEMA)


def compare_edits(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """Every document with its fingerprint, the fingerprint of its edited text and their likeness; see ``edit``.

    Columns: row (a number of its own), doc_id, tie (hash of the text), n_chars, edited_sha256, set and n (name and size
    of the set of shingles), fingerprint, edited_fingerprint, near_edited, near_next.

    The document after one is the next in descending ``doc_id``, after the last the first. Documents are dealt by ranges
    of ``doc_id``, texts compressed, and stream by in order; the last of each range meets the first of the next in a
    second, small step.
    """

    def run(batches):
        from pyspark import TaskContext

        part, held, place = TaskContext.get().partitionId(), None, 0
        edge = lambda kind, r, t: pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "row": r[0], "doc_id": r[1], "tie": r[2], "text": t}], schema=_SCHEMA)
        for batch in base.unpacked(batches, keep=("doc_id", "tie")):
            texts = batch.column("text").to_pylist()
            found = shingles_of(*base.flat(batch.column("text")), p.shingle)
            sig = signatures(*found, p)
            numbers = [(part << 40) + k for k in range(place, place + len(texts))]
            rows, place = list(zip(numbers, batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), *set_names(*found))), place + len(texts)
            if held is None:
                yield edge(1, rows[0], texts[0])
            else:
                rows, texts, sig = [held[0], *rows], [held[1], *texts], np.concatenate([held[2], sig])
            if len(rows) > 1:
                yield _compared(rows[:-1], texts[:-1], texts[1:], sig[:-1], sig[1:], p, part)
            held = rows[-1], texts[-1], sig[-1:]
        if held is not None:
            yield edge(2, held[0], held[1])

    out = base.durable(base.dealt(docs, descending=True).mapInArrow(run, EDITED), "edits")
    heads, tails = out.filter("kind = 1"), out.filter("kind = 2")
    # one row a range, without texts
    ranges = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    meets = tails.select("part", "row", "doc_id", "tie", "text").join(ranges, "part").join(heads.select(F.col("part").alias("next"), F.col("text").alias("after")), "next")

    def close(batches):
        for b in base.text_steps(batches):
            found = shingles_of(*base.flat(b.column("text")), p.shingle)
            rows = list(zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "tie")), *set_names(*found)))
            yield _compared(rows, b.column("text").to_pylist(), b.column("after").to_pylist(), signatures(*found, p), texts_signatures(b.column("after"), p), p, -1)

    last = meets.select("row", "doc_id", "tie", "text", "after").mapInArrow(close, EDITED)
    return out.filter("kind = 0").unionByName(last).drop("kind", "part", "text")


def band_keys(sig: np.ndarray, p: MinHash) -> np.ndarray:
    """(n, bands): a 64-bit key of each band of the signatures."""
    rows = sig.reshape(len(sig), p.bands, p.perms // p.bands).astype(np.uint64)
    out = np.tile(np.arange(1, p.bands + 1, dtype=np.uint64), (len(sig), 1))
    for j in range(rows.shape[2]):
        out = base.mix(out * np.uint64(0x9FB21C651E98DF25) + rows[:, :, j])
    return out


def _shared(batches):
    """Of rows in the order of ``key`` those whose key others have too, with their number and hashes of the key's nodes."""

    def runs(k, node, n):
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        c = np.diff(np.append(heads, len(k)))
        h = node.view(np.uint64)
        x = np.bitwise_xor.reduceat(base.mix(h + np.uint64(0x9E3779B97F4A7C15)), heads)
        y = np.add.reduceat(base.mix(h ^ np.uint64(0x9FB21C651E98DF25)), heads)
        many = np.repeat(c > 1, c)
        found = [np.repeat(v, c)[many] for v in (c, np.add.reduceat(n, heads), x.view(np.int64), y.view(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (k[many], node[many], *found)], ["key", "node", "c", "grams", "x", "y"])

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("key", "node", "n")]
        if held:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        # the last run may go on in the next batch
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[cut:] for c in cols]
        if cut:
            yield runs(*(c[:cut] for c in cols))
    if held:
        yield runs(*held)


def signed(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """Durable table of every document's (row, doc_id, tie, set, n, fingerprint), with ``bits`` also its SimHash ``fp``; see
    ``compare_edits``."""
    names = ["doc_id", "tie", "set", "n", "fingerprint", *(["fp"] if p.bits is not None else [])]

    def run(batches):
        for batch in base.text_steps(batches):
            flat = base.flat(batch.column("text"))
            found = shingles_of(*flat, p.shingle)
            sets, sizes = set_names(*found)
            prints = [s.tobytes() for s in signatures(*found, p)]
            own = [batch.column("doc_id"), batch.column("tie"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            if p.bits is not None:
                own.append(pa.array(simhash.fingerprints_of(*flat, p.shingle).view(np.int64)))
            yield pa.RecordBatch.from_arrays(own, names)

    table = base.tied(docs).mapInArrow(run, "doc_id long, tie long, set binary, n long, fingerprint binary" + (", fp long" if p.bits is not None else ""))
    return base.durable(table.withColumn("row", F.monotonically_increasing_id()), "minhash", small=True)


def classes(docs: DataFrame, table: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """(doc_id, set, class_id, label) of every document: links are Jaccard ``threshold`` or more, ``label`` names the class.

    ``table`` has a row (row, doc_id, tie, set, n, fingerprint, and fp with ``bits``) for each of ``docs``, as ``signed`` makes them.
    """

    def keyed(batches):
        for batch in batches:
            prints = base.flat(batch.column("fingerprint"))[0].view(np.uint16).reshape(-1, p.perms)
            keys = band_keys(prints, p)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), p.bands)) for c in ("node", "n")] + [pa.array(keys.ravel().view(np.int64))], ["node", "n", "key"])

    # equal sets are one node, named by the row that stands for all of them; an empty one has no keys
    sets = base.durable(table.groupBy("set").agg(F.min("doc_id").alias("least"), F.min("row").alias("node")), "sets")
    heads = table.filter("n > 0").withColumnRenamed("row", "node").join(sets.select("node").hint("merge"), "node")
    index = heads.select("node", "n", "fingerprint").mapInArrow(keyed, "node long, n long, key long")
    if p.bits is not None:
        # a SimHash component is a key: whatever its links connect is compared, so that none is lost with a link that fails
        linked = simhash.labels(heads.select(F.col("node").alias("doc_id"), "fp"), p.bits).select("fp", F.xxhash64(F.lit("simhash"), "label").alias("key"))
        index = index.unionByName(heads.select("node", "n", "fp").join(linked, "fp").select("node", "n", "key"))
    shared = base.durable(index.repartition(base.scan_parts(docs), "key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long, c long, grams long, x long, y long"), "shared", small=True)
    # keys over the same documents are compared once
    counts = shared.groupBy("key").agg(*(F.first(c).alias(c) for c in ("c", "grams", "x", "y"))).groupBy("c", "grams", "x", "y").agg(F.min("key").alias("key"))
    counts = counts.select("key", F.greatest(F.ceil(F.col("c") * 2 / BLOCK), F.ceil(F.col("grams") * 2 / GRAMS)).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = shared.select("key", "node").join(counts, "key").select("node", "key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))).alias("pair"))
    # texts travel, compressed, not shingles; of a doc_id with several texts the one whose set is asked for
    asked = base.durable(dealt.join(table.select(F.col("row").alias("node"), "doc_id", "tie", "set"), "node").select(F.xxhash64("key", "pair").alias("key"), "node", F.col("doc_id").alias("d"), F.col("tie").alias("t"), "set"), "asked", small=True)
    texts = texts_of(base.tied(docs), asked.select(F.xxhash64("d", "t").alias("h")))
    full = texts.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("key", "node", "set", "doc_id", "size", "z")

    def links(batches):
        now, nodes, held = None, [], []

        def close():
            a, b = jaccard_forest(nodes, held, p.threshold)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in base.unpacked(batches, keep=("key", "node", "set")):
            h, o = shingles_of(*base.flat(batch.column("text")), p.shingle)
            for k, node, name, i, j in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "set")), o[:-1].tolist(), o[1:].tolist()):
                if k != now:
                    if len(nodes) > 1:
                        yield close()
                    now, nodes, held = k, [], []
                grams = np.unique(h[i:j])
                # repeated rows come in a row, a text of the same hash has another set
                if (not nodes or nodes[-1] != node) and set_of(grams) == name:
                    nodes.append(node)
                    held.append(grams)
        if len(nodes) > 1:
            yield close()

    near = connected_components(full.repartition(base.scan_parts(docs), "key").sortWithinPartitions("key", "node").mapInArrow(links, "a long, b long"))
    named = sets.join(near, "node", "left").select("set", "least", F.coalesce("component", "node").alias("label"))
    heads = named.groupBy("label").agg(F.min("least").alias("class_id"))
    out = base.durable(table.select("doc_id", "set").join(named.join(heads, "label").select("set", "class_id", "label"), "set"), "classes")
    for done in (sets, shared, asked):
        base.drop_durable(done)
    return out


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, tie, size, z) of the rows (doc_id, tie, text) whose xxhash64(doc_id, tie) is in ``wanted`` (h), and of few
    others: a bitmap of ``FILTER`` bits lets them through."""
    bit = F.shiftrightunsigned("h", 64 - FILTER.bit_length() + 1)
    words = wanted.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("x")).toArrow()
    bitmap = np.zeros(FILTER // 64, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("x").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        known, shift = shared.value, np.uint64(64 - FILTER.bit_length() + 1)
        for batch in batches:
            at = batch.column("h").to_numpy().view(np.uint64) >> shift
            hit = known[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            yield from base.pack_texts([batch.filter(pa.array(hit.astype(bool)))], ("doc_id", "tie"))
        base.trim()

    return rows.select("doc_id", "tie", F.xxhash64("doc_id", "tie").alias("h"), "text").mapInArrow(run, "doc_id long, tie long, size long, z binary")


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """(doc_id, class_id) of every document: the smallest doc_id reached by links of Jaccard ``threshold`` or more."""
    table = signed(docs, p)
    out = classes(docs, table, p).select("doc_id", "class_id")
    base.drop_durable(table)
    return out


def one_of_each(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, that of smallest doc_id, with all its columns.

    Of repeated rows, and of a class without any doc_id, the row whose text has the smallest hash stays.
    """

    def names(column: pa.Array) -> pa.Array:
        return pa.array(set_names(*shingles_of(*base.flat(column), p.shingle))[0], pa.binary())

    table = signed(docs, p)
    found = classes(docs, table, p).select("doc_id", F.col("set").alias("key"), F.col("class_id").alias("component_id"), "label")
    base.drop_durable(table)
    return base.heads_of(docs, found, names, T.BinaryType())


def jaccard_forest(nodes: list[int], sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Links that connect what is connected by a Jaccard likeness of ``threshold`` or more."""
    size = np.array([len(s) for s in sets], np.int64)
    found, code = np.unique(np.concatenate(sets), return_inverse=True)
    inside, code = np.zeros(len(found), bool), code.astype(np.int32)
    del found
    start = np.concatenate([[0], np.cumsum(size)])
    rest, flat, a, b = np.arange(len(sets)), code, [], []
    while len(rest):
        i, rest, flat = int(rest[0]), rest[1:], flat[size[rest[0]] :]
        front = [i]
        while front and len(rest):
            i = front.pop()
            own = code[start[i] : start[i + 1]]
            inside[own] = True
            n = size[rest]
            both = np.add.reduceat(inside[flat], np.cumsum(n) - n, dtype=np.int64)
            inside[own] = False
            near = both >= threshold * (size[i] + n - both)
            if near.any():
                new = rest[near].tolist()
                a += [nodes[i]] * len(new)
                b += [nodes[j] for j in new]
                front += new
                rest, flat = rest[~near], flat[np.repeat(~near, n)]
    return a, b


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    compared = compare_edits(docs)
    found = classes(docs, compared).select(F.col("doc_id").alias("d"), F.col("set").alias("s"), "class_id").distinct()
    out = compared.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("set") == F.col("s")))
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
