"""Shared pieces of the training-data operators: durable tables, flat text buffers, word hashes.

Nothing outside :mod:`cairn.llm` imports this module.
"""

from __future__ import annotations

import bisect
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.durable import drop_durable, durable, scan_parts, shared_dir  # noqa: F401
from cairn.plans.ship import ship

#: Bytes of text that one vectorised step holds at once (a longer document is one step of its own).
STEP_BYTES = 1 << 20


def columns(df: DataFrame, *names: str, text: str | None = None) -> DataFrame:
    """Only the named columns, the text as a non-null string; other columns, clashing names included, stay behind."""
    whole, places = by_place(df)
    out = [F.col(places[n]).alias(n) for n in names]
    if text:
        out.append(F.coalesce(F.col(places[text]), F.lit("")).alias("text"))
    return whole.select(*out)


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where it is printable, the next from 256 on elsewhere."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by place (c0, c1, ...), and each column's new name.

    Helper columns of other names then clash with none of ``df``'s, whatever they are called; ``toDF`` gives names back.
    """
    ship(df.sparkSession)
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def text_steps(batches, most: int = STEP_BYTES):
    """Slices of Arrow batches whose ``text`` column holds at most ``most`` bytes (or one row)."""
    try:
        yield from _text_steps(batches, most)
    finally:
        trim()


def trim() -> None:
    """Give freed memory back at a task's end: Python workers live on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _steps(sizes: np.ndarray, most: int):
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def _text_steps(batches, most: int):
    for batch in batches:
        sizes = pc.binary_length(pc.fill_null(batch.column("text"), "")).to_numpy(zero_copy_only=False)
        for start, stop in _steps(sizes, most):
            yield batch.slice(start, stop - start)


def tied(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text); ``tie`` is the XXH64 of the text."""
    return columns(docs, "doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")


#: Rows for each range that a sample of the order has about.
SAMPLE = 64


def dealt(docs: DataFrame, descending: bool = False) -> DataFrame:
    """(doc_id, tie, size, z): texts compressed one by one, dealt to as many tasks as read ``docs`` by ranges of doc_id and
    sorted in them, nulls first (``descending``: last); rows of one doc_id by the hash of their texts, and rows that are
    equal in both in any order, over several ranges where they are many.

    Bounds come from a sample of the keys whose size goes with the number of ranges, so that texts are compressed once.
    """
    parts, n = scan_parts(docs), docs.count()
    salt = F.xxhash64(F.monotonically_increasing_id()).alias("salt")
    keys = lambda b: zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "salt")))
    place = (lambda d, t, s: (d is None, -(d or 0), t, s)) if descending else (lambda d, t, s: (d is not None, d or 0, t, s))
    fraction = min(1.0, SAMPLE * parts / max(n, 1))
    few = tied(docs.sample(fraction, seed=3) if fraction < 1 else docs).select("doc_id", "tie", salt).toArrow()
    picked = sorted(place(*k) for k in keys(few))
    bounds = [picked[len(picked) * k // parts] for k in range(1, parts)] if picked else []

    def run(batches):
        for batch in batches:
            part = [bisect.bisect_right(bounds, place(*k)) for k in keys(batch)]
            yield from pack_texts([batch.append_column("part", pa.array(part, pa.int32()))], ("doc_id", "tie", "salt", "part"))
        trim()

    rows = tied(docs).select("doc_id", "tie", salt, "text").mapInArrow(run, "doc_id long, tie long, salt long, part int, size long, z binary")
    order = [F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("salt")]
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).select("doc_id", "tie", "size", "z")


def pack_texts(batches, keep: tuple[str, ...]):
    """The columns ``keep`` of Arrow batches, each text's bytes (``size``) and its compressed form (``z``)."""
    codec = pa.Codec("zstd", 1)
    for batch in _text_steps(batches, STEP_BYTES):
        data, o = flat(batch.column("text"))
        raw = data.tobytes()
        z = [codec.compress(raw[a:b], asbytes=True) if b > a else b"" for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(o)), pa.array(z, pa.binary())], [*keep, "size", "z"])


def unpacked(batches, most: int = STEP_BYTES, keep: tuple[str, ...] = ("doc_id",)):
    """The columns ``keep`` and the text of Arrow batches with ``size`` and ``z``, in steps of ``most`` bytes (or one row)."""
    codec = pa.Codec("zstd")
    try:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for start, stop in _steps(sizes, most):
                part = batch.slice(start, stop - start)
                texts = [codec.decompress(z.as_buffer(), n, asbytes=True) if n else b"" for z, n in zip(part.column("z"), sizes[start:stop].tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])
    finally:
        trim()


def heads_of(docs: DataFrame, found: DataFrame, key_of, kind: T.DataType) -> DataFrame:
    """Of each ``label`` of found (doc_id, key, component_id, label) one row of ``docs``: that of doc_id component_id.

    ``key_of`` gives the keys of a column of texts. Among several rows that whose text has the smallest hash stays.
    """
    heads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    odd = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(heads).alias("head")).filter("head and (n > 1 or doc_id is null)")
    kept = found.filter(heads)
    whole, places = by_place(docs)
    id_ = F.col(places["doc_id"]).cast("long")
    if odd.isEmpty():
        return whole.join(kept.select(F.col("doc_id").alias("kept")), id_ == F.col("kept"), "left_semi").toDF(*docs.columns)
    # ids do not tell rows apart: deal the rows of smallest doc_id by label
    names = ["text" if c == places["text"] else c for c in whole.columns]
    rows = whole.toDF(*names)

    def run(batches):
        for batch in text_steps(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, key_of(batch.column("text"))], [*names, "key"])

    keyed = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("key", kind)]))
    kept = kept.select(F.col("doc_id").alias("kept"), F.col("key").alias("k"), "label").distinct()
    near = keyed.join(kept, id_.eqNullSafe(F.col("kept")) & (F.col("key") == F.col("k")))
    first = Window.partitionBy("label").orderBy(F.xxhash64("text"))
    return near.withColumn("place", F.row_number().over(first)).filter("place = 1").select(*names).toDF(*docs.columns)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array, and the n + 1 offsets of its rows."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        width = np.int32
    else:
        width = np.int64
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


#: ASCII white space: space, tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes, and for each document the index of its first word (n + 1 of them).

    Words never cross documents.
    """
    solid = ~SPACE[data]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    have = _TABLES.get("p")
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 4096)
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        _TABLES["p"], _TABLES["i"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _TABLES["p"][:n], _TABLES["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that lets every bit of the input reach every bit of the output."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial modulo 2^64 from prefix sums, then mixed with the length."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of a document, in order, and the n + 1 offsets of the documents.

    A document of fewer words has one shingle, of all of them; one of none has none.
    """
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(n_words, size), count)
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = j < length
        w = word_hash[np.where(inside, at + j, 0)] if len(word_hash) else np.zeros(len(at), np.uint64)
        out = np.where(inside, mix(out * np.uint64(0x9FB21C651E98DF25) + w), out)
    return out, offsets
