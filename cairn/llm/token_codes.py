"""Token-ID output (2): directly addressable codes.

The ids of a shard of documents are cut into ``chunk_bits`` wide chunks, least significant first. Level 0 has the first
chunk of every id, level k + 1 those of the ids that go on after level k; a bitmap beside each level says which go on,
and a rank directory counts the set bits before every 512th position. Token i is read by one probe a level:
``chunk = level[i]; if bitmap[i]: i = rank(i); next level``. No block is decoded for it.

``write_token_files`` deals documents by ranges of ``doc_id``, so that file after file holds them in ascending order; rows
that are equal in id and text may be dealt to several ranges. Each task writes plain files of shards, end to end, through
Spark's committer (a lost or doubled task leaves no files). ``TokenFile`` reads single tokens from such a file: a few
bytes a level, wherever it lies. ``read_token_files`` decodes whole files.

A shard: header (magic, chunk bits, levels, documents, bytes in all), document ids with null flags, token offsets, then
each level's length, chunks, bitmap and rank directory; last the numbers of its task, of the task's tokens before it and
of its own, in decimal digits, and a line feed.

Edge cases: a null or empty text has the end id only; a null ``doc_id`` sorts first and stays null; repeated rows are
documents of their own, and rows of one ``doc_id`` are in the order of a hash of their texts; an empty table gives no
files and no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import base
from cairn.llm.wordcache import WordCoder, by_pieces, plain_pieces

MAGIC = b"DACS"
RANK_STEP = 512
#: Tokens after which a shard ends (a longer document is a shard of its own), and shards of a file.
SHARD_TOKENS, FILE_SHARDS = 1 << 19, 8
END_ID = 2
HEAD, TAIL = "<4sHHQQ", 50


def pack(ids: np.ndarray, chunk_bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap bytes, rank directory) of ``ids``."""
    if chunk_bits not in (8, 16):
        raise ValueError("chunk_bits is 8 or 16")
    kind, levels, rest = {8: np.uint8, 16: np.dtype("<u2")}[chunk_bits], [], ids.astype(np.uint64)
    while True:
        chunk = (rest & np.uint64((1 << chunk_bits) - 1)).astype(kind)
        high = rest >> np.uint64(chunk_bits)
        more = high != 0
        steps = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(steps)])[:-1].astype("<u4") if len(more) else np.zeros(0, "<u4")
        levels.append((chunk, np.packbits(more, bitorder="little"), ranks))
        if not more.any():
            return levels
        rest = high[more]


def shard_bytes(doc_ids: list, ids: list[np.ndarray], chunk_bits: int = 8, part: int = 0, before: int = 0) -> bytes:
    """One shard, without the line feed after it."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    levels = pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32), chunk_bits)
    null = np.array([d is None for d in doc_ids], np.uint8)
    out = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), offsets.tobytes()]
    for chunk, bitmap, ranks in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    out.append(f"{part:010d}{before:020d}{int(offsets[-1]):020d}".encode())
    size = struct.calcsize(HEAD) + sum(map(len, out))
    return b"".join([struct.pack(HEAD, MAGIC, chunk_bits, len(levels), len(doc_ids), size), *out])


def _head(raw: bytes) -> tuple[int, int, int, int]:
    """Chunk bits, levels, documents and bytes of a shard."""
    magic, *rest = struct.unpack_from(HEAD, raw)
    if magic != MAGIC:
        raise ValueError("not a shard of directly addressable codes")
    return tuple(rest)


class Shard:
    """A view of a shard's bytes: ``shard[i]`` is token i, ``decode()`` all of them."""

    def __init__(self, blob: bytes):
        self.bits, n_levels, n, self.size = _head(blob)
        at = struct.calcsize(HEAD)
        self.doc_ids, at = np.frombuffer(blob, "<i8", n, at), at + 8 * n
        self.null, at = np.frombuffer(blob, np.uint8, n, at).astype(bool), at + n
        self.offsets, at = np.frombuffer(blob, "<u8", n + 1, at).astype(np.int64), at + 8 * (n + 1)
        kind, self.levels = np.dtype("<u2") if self.bits == 16 else np.dtype(np.uint8), []
        for _ in range(n_levels):
            (m,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunk, at = np.frombuffer(blob, kind, m, at), at + m * kind.itemsize
            bitmap, at = np.frombuffer(blob, np.uint8, -(-m // 8), at), at - (-m // 8)
            ranks, at = np.frombuffer(blob, "<u4", -(-m // RANK_STEP), at), at + 4 * -(-m // RANK_STEP)
            self.levels.append((chunk, bitmap, ranks))
        tail = bytes(blob[at : at + TAIL])
        self.part, self.before = int(tail[:10]), int(tail[10:30])

    def __len__(self) -> int:
        return int(self.offsets[-1])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bitmap, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            low = i // RANK_STEP * RANK_STEP
            i, shift = int(ranks[i // RANK_STEP]) + _ones(bitmap[low >> 3 : (i >> 3) + 1].tobytes(), i - low), shift + self.bits
        raise ValueError("a code goes on after the last level")

    def decode(self) -> np.ndarray:
        value = None
        for chunk, bitmap, _ in reversed(self.levels):
            own = chunk.astype(np.uint32)
            if value is not None:
                own[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)] |= value << np.uint32(self.bits)
            value = own
        return value if value is not None else np.zeros(0, np.uint32)


def _ones(bitmap: bytes, n: int) -> int:
    """Set bits among the first ``n``."""
    return (int.from_bytes(bitmap, "little") & ((1 << n) - 1)).bit_count()


def shards_of(blob):
    """The shards of a file's bytes."""
    view, at = memoryview(blob), 0
    while at < len(view):
        shard = Shard(view[at:])
        yield shard
        at += shard.size + 1


class TokenFile:
    """Tokens of one file by their place in it, read from an open binary file by seeking: ``TokenFile(f)[i]``."""

    def __init__(self, file):
        self.file, self.shards, at, first = file, [], 0, 0
        end = file.seek(0, 2)
        while at < end:
            bits, n_levels, n, size = _head(self._read(at, struct.calcsize(HEAD)))
            level, levels = at + struct.calcsize(HEAD) + 9 * n + 8 * (n + 1), []
            for _ in range(n_levels):
                (m,) = struct.unpack("<Q", self._read(level, 8))
                chunks = level + 8
                bitmap = chunks + m * bits // 8
                ranks = bitmap - (-m // 8)
                levels.append((chunks, bitmap, ranks))
                level = ranks + 4 * -(-m // RANK_STEP)
            n_tokens = int(self._read(level, TAIL)[30:])
            self.shards.append((first, bits // 8, levels))
            first, at = first + n_tokens, at + size + 1
        self.n = first

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first, width, levels = self.shards[bisect.bisect_right(self.shards, i, key=lambda s: s[0]) - 1]
        i, value, shift = i - first, 0, 0
        for chunks, bitmap, ranks in levels:
            value |= int.from_bytes(self._read(chunks + i * width, width), "little") << shift
            low = i // RANK_STEP * RANK_STEP
            bits = self._read(bitmap + (low >> 3), (i >> 3) - (low >> 3) + 1)
            if not bits[-1] >> (i & 7) & 1:
                return value
            i, shift = int.from_bytes(self._read(ranks + i // RANK_STEP * 4, 4), "little") + _ones(bits, i - low), shift + 8 * width
        raise ValueError("a code goes on after the last level")


_CACHES: dict = {}


def is_word_level(tok) -> bool:
    """Whether the library gives a few telling words the same ids by the short way as by the whole one."""
    for w in ("Hello,World's", "it'll!!", "ab12cd", "\u00c9t\u00e9\u00bd\u00df", "o'REILLY_x", "%$#'s't"):
        short = [t.id for p in plain_pieces(w) for t in tok.model.tokenize(p.encode().decode("latin-1").translate(dict(enumerate(base.byte_letters()))))]
        if short != tok.encode(w, add_special_tokens=False).ids:
            return False
    return tok.encode("a b", add_special_tokens=False).ids == tok.encode("a", add_special_tokens=False).ids + tok.encode("b", add_special_tokens=False).ids


def library_cache(vocab: str) -> WordCoder:
    """A cache whose misses the tokenizers library encodes; one a worker and vocabulary, kept between tasks."""
    if vocab not in _CACHES:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(vocab)
        tok.no_truncation()
        tok.no_padding()

        model, letter = tok.model, dict(enumerate(base.byte_letters()))

        def general(words: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(words, add_special_tokens=False)]

        def pieces(new: list[str]) -> list[bytes]:
            cut = model.tokenize
            return [array("I", [t.id for t in cut(w if w.isascii() else w.encode().decode("latin-1").translate(letter))]).tobytes() for w in new]

        # pieces can go straight to the library's model where what comes before it is the normal form and byte letters
        _CACHES[vocab] = WordCoder(by_pieces(pieces, general), most=400_000) if is_word_level(tok) else WordCoder(general, cut=False)
    return _CACHES[vocab]


def write_token_files(docs: DataFrame, vocab: str, end_id: int = END_ID, chunk_bits: int = 8, path: str | None = None) -> DataFrame:
    """Files of all documents, each with ``end_id`` appended, in the folder ``path`` (else one of the shared folder): a
    table of Spark's ``binaryFile`` source."""

    def run(batches):
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), library_cache(vocab)
        tail = np.array([end_id], np.uint32)
        doc_ids, ids, size, before = [], [], 0, 0

        def row():
            blob = shard_bytes(doc_ids, ids, chunk_bits, part, before)
            # any bytes, as the text source writes them as they are
            column = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(blob)], np.int32)), pa.py_buffer(blob)])
            return pa.RecordBatch.from_arrays([column], ["value"])

        for batch in base.unpacked(batches, 4 * base.STEP_BYTES):
            flat, o = cache.column(batch.column("text"))
            for d, a, b in zip(batch.column("doc_id").to_pylist(), o.tolist(), o[1:].tolist()):
                x = np.concatenate([flat[a:b], tail])
                if ids and size + len(x) > SHARD_TOKENS:
                    yield row()
                    before, doc_ids, ids, size = before + size, [], [], 0
                doc_ids.append(d)
                ids.append(x)
                size += len(x)
        if ids:
            yield row()

    spark = docs.sparkSession
    path = path or f"{base.shared_dir(spark)}/cairn/tokens-{uuid.uuid4().hex}"
    base.dealt(docs).mapInArrow(run, "value string").write.option("maxRecordsPerFile", FILE_SHARDS).option("lineSep", "\n").text(path)
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")


def local_path(path: str) -> str | None:
    """The path that Python opens of a file in a mounted folder; None of one that only Spark opens."""
    return unquote(urlsplit(path).path) if path.startswith("file:") else path if path.startswith("/") else None


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, middle_id) of every document, all from the files' bytes.

    ``middle_id`` is the id at half the document's length, rounded down, which is read alone. A shard knows the tokens
    before it in its task; those of the tasks before come from a running sum over one small row a writing task. Files in a
    mounted folder are opened by path and read shard by shard, others come whole through Spark.
    """
    base.ship(files.sparkSession)

    def rows_of(s: Shard) -> pa.RecordBatch:
        ids = memoryview(s.decode().astype("<u4").view(np.uint8))
        o, n = s.offsets.tolist(), np.diff(s.offsets)
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(o, o[1:])]
        middle = [s[i] for i in (s.offsets[:-1] + n // 2).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=s.null), pa.array(np.full(len(n), s.part)), pa.array(s.offsets[:-1] + s.before), pa.array(n), pa.array(crc, pa.int64()), pa.array(middle, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32", "middle_id"])

    def by_path(batches):
        # a shard at a time, whatever the size of the file
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open(local_path(path), "rb") as f:
                    while head := f.read(struct.calcsize(HEAD)):
                        yield rows_of(Shard(head + f.read(_head(head)[3] + 1 - len(head))))

    def by_content(batches):
        for batch in batches:
            for blob in batch.column("content"):
                yield from map(rows_of, shards_of(blob.as_buffer()))

    kinds = "doc_id long, part long, place long, n_tokens long, ids_crc32 long, middle_id long"
    local = all(local_path(p) for p in files.inputFiles()[:1])
    rows = files.select("path").mapInArrow(by_path, kinds) if local else files.select("content").mapInArrow(by_content, kinds)
    # dealt by task once, for the sums and for the rows
    rows = rows.repartition("part")
    parts = rows.groupBy(F.col("part").alias("p")).agg(F.max(F.col("place") + F.col("n_tokens")).alias("n"))
    order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("p", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return rows.join(starts, F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "middle_id")


def op2_token_codes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")))
