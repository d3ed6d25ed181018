"""SimHash near-dedup (3): deletion-variant signatures.

Fingerprints of 64 bits that differ in at most ``bits`` places are found without trying pairs. A fingerprint is cut into
few segments, so few that one of them (or one joint choice of ``chosen`` of them) differs in at most one bit. For every
choice and every bit of it, the index has the choice with that bit as a wildcard: two fingerprints that differ in at
most one bit of a choice have an index key in common. Equal keys meet in one place and are verified on all 64 bits.

``layout`` picks the cut from the number of different fingerprints: three segments of 21 bits up to four million, two of
five (about 25 bits) to 2^28 and three of six (about 32 bits) beyond, so that keys stay rare as the corpus grows.

Equal fingerprints are one node from the start. Within a key, links come out as a spanning forest, not as all pairs, and
a segment value that many fingerprints share is dealt to pairs of blocks of bounded size.

Edge cases: a null or empty text, or one of white space, has the fingerprint zero and links like any other; fewer words
than a shingle make one shingle; repeated rows stay rows; a null ``doc_id`` keeps its row but names no component, unless
all documents of it have none (then null); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import base
from cairn.operators.components import connected_components

SEED = 42
#: Fingerprints of one key that a task compares at once; longer keys are dealt to pairs of blocks.
BLOCK = 4096
#: Fingerprints of a key up to which all its pairs are verified at once.
FEW = 24


@dataclass(frozen=True)
class Layout:
    segments: int
    chosen: int

    def choices(self) -> list[list[int]]:
        """The bit positions of each choice of segments."""
        edges = [64 * k // self.segments for k in range(self.segments + 1)]
        return [[b for s in pick for b in range(edges[s], edges[s + 1])] for pick in combinations(range(self.segments), self.chosen)]


def layout(n_fingerprints: int, bits: int = 4) -> Layout:
    """Fewest variants whose keys stay rare; one choice differs by at most one bit if ``bits`` bits differ in all."""
    if n_fingerprints <= 1 << 22:
        return Layout(bits // 2 + 1, 1)
    chosen = 2 if n_fingerprints <= 1 << 28 else 3
    return Layout(bits + chosen - 1, chosen)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """SimHash of each text: bit i is set if it is in over half the XXH64 values (seed 42) of its word shingles."""
    digest, raw = xxhash.xxh64_intdigest, data.tobytes()
    parts, sizes = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        found = raw[a:b].lower().split()
        if not found:
            sizes.append(0)
            continue
        line = b" ".join(found)
        stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        start = np.concatenate([[0], stop[:-1]])
        n = max(1, len(found) - shingle + 1)
        ends = (stop[shingle - 1 :] if len(found) >= shingle else stop[-1:]) - 1
        parts.append(np.fromiter([digest(line[i:j], SEED) for i, j in zip(start[:n].tolist(), ends.tolist())], np.uint64, n))
        sizes.append(n)
    return majority(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64))


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group the bits that are set in over half of its words; zero for an empty group."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    first = np.cumsum(n) - n
    # sums of 255 words fit the eight byte lanes of one word
    blocks = -(-n // 255)
    at = np.cumsum(blocks) - blocks
    starts = np.repeat(first - 255 * at, blocks) + 255 * np.arange(blocks.sum())
    got = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
        for byte in range(8):
            got |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = got
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text, as a signed long."""

    def run(batches):
        for batch in base.text_steps(batches):
            fp = fingerprints_of(*base.flat(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return base.columns(docs, "doc_id", text="text").mapInArrow(run, "doc_id long, fp long")


def forest(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected by distances of at most ``bits``: one fewer than the nodes of each component."""
    rest, a, b = x, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            f = front.pop()
            near = np.bitwise_count(rest ^ f) <= bits
            if near.any():
                new = rest[near]
                a.append(np.full(len(new), f))
                b.append(new)
                front.extend(new)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def run_links(key: np.ndarray, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys."""
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(heads, len(key)))
    few = np.repeat(size <= FEW, size)
    own = np.repeat(np.arange(len(heads)), size)
    a, b = [], []
    for d in range(1, int(min(FEW, size.max()))):
        i = np.flatnonzero(few[:-d] & (own[d:] == own[:-d]))
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= bits]
        a.append(x[i])
        b.append(x[i + d])
    for k in np.flatnonzero(size > FEW):
        p, q = forest(x[heads[k] : heads[k] + size[k]], bits)
        a.append(p)
        b.append(q)
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def links(distinct: DataFrame, bits: int = 4, plan: Layout | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints ``fp`` that connect whatever is linked at ``bits`` or fewer bits."""
    plan = plan or layout(distinct.count(), bits)
    choices = plan.choices()
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    mask = [signed(sum(1 << b for b in c)) for c in choices]
    near = F.array(*(F.lit(m).cast("long") for m in mask))
    wild = [F.array(*(F.lit(signed(1 << b)).cast("long") for b in c)) for c in choices]
    # segment values that many share; every key over one of them is dealt to pairs of blocks
    value = distinct.select(F.posexplode(F.transform(near, lambda m: F.col("fp").bitwiseAND(m))).alias("choice", "value"))
    hot = base.durable(value.groupBy("choice", "value").count().filter(F.col("count") > block // 2), "hot")
    key = lambda choice, bit, value: F.xxhash64(choice, bit, value.bitwiseAND(F.bitwise_not(bit)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), w.alias("bits")) for k, w in enumerate(wild)))).alias("c")
    index = distinct.select("fp", each).select("fp", "c.choice", F.explode("c.bits").alias("bit")).select(key(F.col("choice"), F.col("bit"), F.col("fp").bitwiseAND(near[F.col("choice")])).alias("key"), "fp")
    if not hot.isEmpty():
        bit_of = F.array(*wild)
        keys = hot.select("choice", "value", "count", F.explode(bit_of[F.col("choice")]).alias("bit")).select(key(F.col("choice"), F.col("bit"), F.col("value")).alias("key"), F.ceil(4 * F.col("count") / block).alias("n")).groupBy("key").agg(F.max("n").alias("n"))
        own = F.pmod(F.xxhash64("fp"), F.col("n"))
        dealt = index.join(keys, "key", "left").select("key", "fp", F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)) - 1), lambda o: F.least(o, own) * F.col("n") + F.greatest(o, own))).alias("pair"))
        index = dealt.select("fp", "key", F.explode("pair").alias("pair")).select(F.xxhash64("key", "pair").alias("key"), "fp")

    def run(batches):
        held: list = []
        for batch in batches:
            k, x = (batch.column(n).to_numpy() for n in ("key", "fp"))
            if held:
                k, x = np.concatenate([held[0], k]), np.concatenate([held[1], x])
            # the last run may go on in the next batch
            cut = int(np.searchsorted(k, k[-1]))
            held = [k[cut:], x[cut:]]
            if cut:
                yield _pairs(*run_links(k[:cut], x[:cut].view(np.uint64), bits))
        if held:
            yield _pairs(*run_links(held[0], held[1].view(np.uint64), bits))

    return index.repartition(base.scan_parts(distinct), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def labels(prints: DataFrame, bits: int = 4, plan: Layout | None = None) -> DataFrame:
    """(fp, component_id, label) of the different fingerprints of (doc_id, fp); ``label`` names the component."""
    distinct = base.durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    near = connected_components(links(distinct.select("fp"), bits, plan))
    classes = distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    heads = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    return classes.join(heads, "label").select("fp", "component_id", "label")


def components(docs: DataFrame, bits: int = 4, shingle: int = 4, plan: Layout | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every document: the smallest doc_id that links of at most ``bits`` bits reach."""
    prints = base.durable(fingerprints(docs, shingle), "simhash", small=True)
    return prints.join(labels(prints, bits, plan).drop("label"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, that of smallest doc_id, with all its columns.

    Of repeated rows, and of a component without any doc_id, the row whose text has the smallest hash stays.
    """
    prints = base.durable(fingerprints(docs, shingle), "simhash", small=True)
    found = base.durable(prints.join(labels(prints, bits), "fp").select("doc_id", "fp", "component_id", "label"), "components")

    def prints_of(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints_of(*base.flat(column), shingle).view(np.int64))

    return base.heads_of(docs, found.withColumnRenamed("fp", "key"), prints_of, T.LongType())


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
