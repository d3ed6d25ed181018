"""Suffix-array dedup (10): repeated strings of ``length`` bytes by distributed difference-cover suffix sorting.

A byte goes if a string of ``length`` (100) bytes that covers it also starts earlier: in a smaller doc_id, or earlier in
the same document. Strings are judged on the input and never cross documents.

1. *Cover.* The classical cover takes positions by their residue modulo 3, the same in every text, so it has to hold two
   residues. Here residues count from anchors that the content sets: of every window of ``length`` bytes the position
   whose ``GRAM``-byte string has the least hash, the leftmost of equals. Equal windows have equal anchors at equal
   offsets, so one residue covers. A segment is the stretch of windows that share an anchor.
2. *Segments that cannot repeat leave.* Segments go to the task of their anchor's hash (after each map task has put equal
   segments together, so that a very common line is one row a task). A hash met once has no equal window anywhere; of
   equal segments all but the first are repeats as a whole; of different segments with the same anchor the first of each
   goes on. This loses nothing: what leaves has been decided.
3. *Suffix sorting* of those: triples of bytes at covered positions are sorted and named, then triples of names (9, 27,
   81 bytes), then pairs that overlap (96 bytes); other positions sort by their bytes up to a covered position and its
   name. Neighbours in this order with equal prefixes of ``length`` bytes are one class, and its first window stays.
   Anchors with very many different segments are dealt to several tasks; what is first in each then meets by content.
4. Spans of each document are joined and cut out.

Sorting the suffixes of all bytes would write several times the input; README.md has the figures.

Edge cases: a null or empty text has nothing to remove; texts under ``length`` bytes stay whole; rows with equal doc_id
and text are one document and all get its result; of equal doc_ids with different texts the one of smaller SHA-256 is
earlier; a null doc_id comes last; an empty table gives an empty table; other columns, whatever their names, are carried
along where asked for and not read.
"""

from __future__ import annotations

import gc
import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import base

LENGTH = 100
#: Anchors that a map task puts together at once.
FLUSH = 200_000
#: Different segments of an anchor that one task sorts at once; more are dealt to several tasks.
SEGMENTS = 1 << 14
#: Bytes of segments that are sorted at once (whole groups: one may be more).
CHUNK = 1 << 20


def settle(df: DataFrame, name: str) -> DataFrame:
    """A durable table, after which the shuffle files behind it can go."""
    out = base.durable(df, name)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def gram_of(length: int, gram: int | None = None) -> int:
    """The length of an anchor's string: 37 of 100 bytes, but so long that a segment's windows number 255 at most."""
    if length < 5:
        raise ValueError("repeated strings have five bytes or more")
    gram = max(length - length * 64 // 100 + 1, length - 254) if gram is None else gram
    if not 1 <= gram <= length or length - gram > 254:
        raise ValueError("an anchor's string fits the window, and a segment has 255 windows at most")
    return gram


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int | None = None, key: bytes = b""):
    """Stretches of windows that share an anchor: anchor hash, digest (two words), first window, windows, offset of the anchor."""
    none, gram = np.zeros(0, np.int64), gram_of(length, gram)
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    if not windows.sum():
        return none.view(np.uint64), np.zeros((0, 2), np.int64), none, none, none
    n, width = len(data), length - gram + 1
    up, down = base._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    grams = base.mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    least = grams & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(grams), dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: done - width], least[width - done :])
    starts = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)))
    count = np.diff(np.append(head, len(anchor)))
    first = starts[head]
    return grams[anchor[head]], digests(data, first, first + count - 1 + length, key), first, count, anchor[head] - first


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """128-bit keyed BLAKE2b of each byte span, as two words."""
    raw, fresh = memoryview(np.ascontiguousarray(data)), hashlib.blake2b(digest_size=16, key=key)

    def digest(span) -> bytes:
        h = fresh.copy()
        h.update(span)
        return h.digest()

    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), "<i8").reshape(-1, 2)


def pack(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 16 | count << 8 | offset


def unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return loc >> 16, loc >> 8 & 255, loc & 255


MARKS = "kind int, h long, seg long, doc_id long, loc long"
FOUND = f"{MARKS}, more long"
REPEAT, OPEN = 1, 0


def _marks(kind, h, seg, doc, loc, more=None) -> pa.RecordBatch:
    """Marks, with ``more`` (the digest's other half) the rows of ``FOUND``. A repeat needs no digest any more."""
    words = [h, seg, doc, loc, *([] if more is None else [more])]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in words)], ["kind", "h", "seg", "doc_id", "loc", "more"][: len(words) + 1])


def find_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of all documents; those that repeat one of the same task are marked so at once."""
    secret = secrets.token_bytes(32)

    def run(batches):
        held, size = [], 0

        def flush():
            h, seg, more, doc, loc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((loc, doc, more, seg, h))
            h, seg, more, doc, loc = h[order], seg[order], more[order], doc[order], loc[order]
            first = np.append(True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1]) | (more[1:] != more[:-1]))
            lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            # a copy of the same document (a repeated row) is no earlier place
            again = ~first & ((doc != doc[lead]) | (loc != loc[lead]))
            yield _marks(OPEN, h[first], seg[first], doc[first], loc[first], more[first])
            if again.any():
                # dealt by place, not by hash
                none = np.zeros(int(again.sum()), np.int64)
                yield _marks(REPEAT, base.mix(doc[again].view(np.uint64) + loc[again].view(np.uint64)), none, doc[again], loc[again], none)

        for batch in base.text_steps(batches):
            data, o = base.flat(batch.column("text"))
            h, digest, start, count, offset = segments(data, o, length, gram, secret)
            if len(h):
                row = np.searchsorted(o, start, side="right") - 1
                held.append((h, digest[:, 0], digest[:, 1], batch.column("doc_id").to_numpy()[row], pack(start - o[row], count, offset)))
                size += len(h)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, FOUND)


def resolve_segments(found: DataFrame, parts: int) -> DataFrame:
    """Marks: segments that repeat an earlier one, and first ones whose anchor has others (``OPEN``)."""

    def run(batches):
        last = None  # h, digest, doc, loc of the first of the run at hand; whether it has gone out
        for b in batches:
            kind, h, seg, more, doc, loc = (b.column(c).to_numpy() for c in ("kind", "h", "seg", "more", "doc_id", "loc"))
            pas = kind == REPEAT
            if pas.any():
                yield _marks(REPEAT, np.zeros_like(h[pas]), seg[pas], doc[pas], loc[pas])
            if pas.all():
                continue
            h, seg, more, doc, loc = (x[~pas] for x in (h, seg, more, doc, loc))
            gone = False
            if last is not None:
                h, seg, more, doc, loc = (np.concatenate([[a], x]) for a, x in zip(last[:5], (h, seg, more, doc, loc)))
                gone = last[5]
            same_h = h[1:] == h[:-1]
            first = np.append(True, ~same_h | (seg[1:] != seg[:-1]) | (more[1:] != more[:-1]))
            lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            again = ~first & ((doc != doc[lead]) | (loc != loc[lead]))
            # an anchor with different segments: all their firsts are open
            head_h = np.flatnonzero(np.append(True, ~same_h))
            kinds = np.add.reduceat(first.astype(np.int64), head_h)
            many = np.repeat(kinds > 1, np.diff(np.append(head_h, len(h))))
            if gone:
                stop = head_h[1] if len(head_h) > 1 else len(h)
                many[:stop] = True
            out = first & many
            if gone:
                out[0] = False
            if again.any():
                none = np.zeros(int(again.sum()), np.int64)
                yield _marks(REPEAT, none, none, doc[again], loc[again])
            if out.any():
                yield _marks(OPEN, h[out], seg[out], doc[out], loc[out])
            k = lead[-1]
            last = h[k], seg[k], more[k], doc[k], loc[k], bool(out[k] or many[k])

    return found.repartition(parts, "h").sortWithinPartitions("kind", "h", "seg", "more", "doc_id", "loc").mapInArrow(run, MARKS)


def names(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the different ones, from 1 on."""
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.append(True, s[1:] != s[:-1]))
    return out


def window_classes(texts: list[bytes], offset: np.ndarray, count: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the windows of segments by difference cover: segment and number of each window, and its class.

    Segment s has ``count[s]`` windows, and its anchor lies ``offset[s]`` bytes after the first.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # every anchor at a multiple of 3; 0 (no byte) between segments, long enough that no name reaches over
    lead = -offset % 3
    room = (size + lead + length + 2) // 3 * 3
    at = np.cumsum(room) - room + lead
    # names of so many bytes at covered positions; up to four bytes of a window are left beside them
    named = (length - 2) // 3 * 3
    t = np.zeros(int(room.sum()) + 3 * (named + 3), np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)
    t[place] = flat.astype(np.int64) + 1
    name = names(t[0::3] << 18 | t[1::3] << 9 | t[2::3])
    have = 3

    def longer(*shifts: int) -> np.ndarray:
        out, padded = name, np.concatenate([name, np.zeros(max(shifts), np.int64)])
        for k in shifts:
            out = names(out << 32 | padded[k : k + len(name)])
        return out

    while 3 * have <= named:  # 9, 27, 81 bytes
        name = longer(have // 3, 2 * (have // 3))
        have *= 3
    if named > 2 * have:
        name = longer(have // 3, (named - have) // 3)
    elif named > have:  # 96 bytes of 100
        name = longer((named - have) // 3)
    seg = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    start = at[seg] + number
    covered = (start + 2) // 3 * 3
    ahead = covered - start
    # bytes before the covered position and after its name
    extra = np.zeros(len(seg), np.int64)
    for k in range(length - named):
        extra = extra << 9 | t[np.where(k < ahead, start + k, covered + named + k - ahead)]
    key = names(name[covered // 3] << 2 | ahead) << 36 | extra
    return seg, number, names(key)


def repeats_in(texts: list[bytes], offset: np.ndarray, count: np.ndarray, length: int = LENGTH):
    """Segment, number and repeat flag of each window; the first of a class is no repeat. Segments are in order of place."""
    seg, number, cls = window_classes(texts, offset, count, length)
    first = np.full(int(cls.max()) + 1, len(cls))
    np.minimum.at(first, cls, np.arange(len(cls)))
    return seg, number, first[cls] != np.arange(len(cls))


SPANS = "doc_id long, start long, n long, window binary"


def sort_open(marks: DataFrame, docs: DataFrame, length: int, parts: int, most: int = SEGMENTS) -> DataFrame:
    """Runs of repeated windows (doc_id, start, n) among the open segments, and windows whose anchor was dealt to several
    tasks and that are first in theirs (with their bytes)."""
    open_ = marks.filter(F.col("kind") == OPEN)
    hot = base.durable(open_.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("h", F.ceil(F.col("c") / most * 2).cast("long").alias("tasks")), "hot")
    lists = open_.groupBy("doc_id").agg(F.collect_list(F.struct("h", "seg", "loc")).alias("open"))

    def fetch(batches):
        for b in base.text_steps(batches):
            data, o = base.flat(b.column("text"))
            raw, lists = data.tobytes(), b.column("open")
            edge = np.asarray(lists.offsets)
            row = np.repeat(np.arange(len(lists)), np.diff(edge))
            values = lists.flatten()
            h, seg, loc = (values.field(k).to_numpy() for k in range(3))
            start, count, _ = unpack(loc)
            a = o[row] + start
            text = [raw[i:j] for i, j in zip(a.tolist(), (a + count - 1 + length).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(seg), pa.array(b.column("doc_id").to_numpy()[row]), pa.array(loc), pa.array(text, pa.binary())], ["h", "seg", "doc_id", "loc", "text"])

    rows = docs.join(lists, "doc_id").select("doc_id", "text", "open").mapInArrow(fetch, "h long, seg long, doc_id long, loc long, text binary")
    if hot.isEmpty():
        rows = rows.withColumn("tasks", F.lit(1).cast("long"))
    else:
        rows = rows.join(hot, "h", "left").withColumn("tasks", F.coalesce("tasks", F.lit(1).cast("long")))
    rows = rows.withColumn("part", F.pmod(F.col("seg"), F.col("tasks")))

    def run(batches):
        now, held, size = None, [], 0

        def chunk(group):
            doc, loc, tasks, text = (np.concatenate(x) for x in zip(*group))
            # in order of place: parts of one anchor may meet here
            order = np.lexsort((loc, doc))
            doc, loc, tasks, text = doc[order], loc[order], tasks[order], text[order]
            start, count, offset = unpack(loc)
            seg, number, again = repeats_in(text.tolist(), offset, count, length)
            head = np.flatnonzero(again & ~np.append(False, again[:-1] & (seg[1:] == seg[:-1])))
            tail = np.flatnonzero(again & ~np.append(again[1:] & (seg[1:] == seg[:-1]), False))
            kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("window", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(doc[seg[head]]), pa.array(start[seg[head]] + number[head]), pa.array(tail - head + 1), pa.nulls(len(head), pa.binary())], schema=pa.schema(kinds))
            split = np.flatnonzero(~again & (tasks[seg] > 1))
            for k in range(0, len(split), 10_000):
                w = split[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(doc[seg[w]]), pa.array(start[seg[w]] + number[w]), pa.array(np.ones(len(w), np.int64)), pa.array([text[s][n : n + length] for s, n in zip(seg[w].tolist(), number[w].tolist())], pa.binary())], schema=pa.schema(kinds))

        for b in batches:
            h, part, doc, loc, tasks = (b.column(c).to_numpy() for c in ("h", "part", "doc_id", "loc", "tasks"))
            text = np.empty(len(h), object)
            text[:] = b.column("text").to_pylist()
            heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
            for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(h)]):
                group = (h[i], part[i])
                if group != now and size >= CHUNK:
                    yield from chunk(held)
                    held, size = [], 0
                now = group
                held.append((doc[i:j], loc[i:j], tasks[i:j], text[i:j]))
                size += sum(map(len, text[i:j]))
        if held:
            yield from chunk(held)
        base.trim()

    return rows.repartition(parts, "h", "part").sortWithinPartitions("h", "part", "doc_id", "loc").select("h", "part", "doc_id", "loc", "tasks", "text").mapInArrow(run, SPANS)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents under dense numbers in order of (doc_id, text hash), nulls last; equal rows share one."""
    keyed = docs.withColumn("tie", F.unhex(F.sha2("text", 256)))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    keys = keyed.select("doc_id", "tie").distinct()
    sorted_ = keys.repartitionByRange(base.scan_parts(docs), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int64)), pa.array(np.arange(n, n + len(b)))], ["doc_id", "tie", "part", "place"])
            n += len(b)

    placed = base.durable(sorted_.mapInArrow(run, "doc_id long, tie binary, part long, place long"), "places")
    bases = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ids = placed.join(bases, "part").select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), (F.col("base") + F.col("place")).alias("number"))
    return base.durable(keyed.join(ids, keyed.doc_id.eqNullSafe(ids.d) & (keyed.tie == ids.t)).select("number", "doc_id", "text"), "numbered")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None, most: int = SEGMENTS) -> DataFrame:
    """Runs of repeated windows of (doc_id, text) with unique doc_ids: ``n`` windows from ``start`` on."""
    parts, gram = base.scan_parts(docs), gram_of(length, gram)
    marks = settle(resolve_segments(find_segments(docs, length, gram), parts), "marks")
    sorted_ = settle(sort_open(marks, docs, length, parts, most), "sorted")
    runs = [sorted_.filter("window is null").select("doc_id", "start", "n")]
    split = sorted_.filter("window is not null")
    least = split.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    runs.append(split.join(least, "window").filter("struct(doc_id, start) > least").select("doc_id", "start", "n"))
    loc = F.col("loc")
    runs.append(marks.filter(F.col("kind") == REPEAT).select("doc_id", F.shiftright(loc, 16).alias("start"), F.shiftright(loc, 8).bitwiseAND(255).alias("n")))
    return runs[0].union(runs[1]).union(runs[2])


def cover(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans that runs of windows cover."""
    order = np.argsort(starts)
    a, b = starts[order], (starts + counts - 1 + length)[order]
    reach = np.maximum.accumulate(b)
    head = np.append(True, a[1:] > reach[:-1])
    return a[head], np.append(reach[:-1][head[1:]], reach[-1])


SPAN_LIST = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def cut_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), gram: int | None = None, most: int = SEGMENTS, trim: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, its length in bytes (``n_bytes``), the ``spans`` that repeat and the bytes that
    are left (``kept``).

    With ``trim`` spans shrink to whole characters.
    """
    whole, places = base.by_place(docs)
    text = F.coalesce(whole[places["text"]], F.lit("")).alias("text")
    number = whole[places["doc_id"]].cast("long")
    held = [places[c] for c in keep]
    lean = whole.select(number.alias("doc_id"), text)
    odd = lean.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        runs = repeated_spans(lean, length, gram, most)
        rows = whole.select(number.alias("key"), text, *held)
    else:
        numbered = _numbered(lean)
        runs = repeated_spans(numbered.groupBy(F.col("number").alias("doc_id")).agg(F.first("text").alias("text")), length, gram, most)
        ids = numbered.select(F.col("number").alias("key"), F.col("doc_id").alias("d"), F.unhex(F.sha2("text", 256)).alias("t")).distinct()
        rows = whole.select(number.alias("id"), text, F.unhex(F.sha2(text, 256)).alias("tie"), *held)
        rows = rows.join(ids, F.col("id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("key", "text", *held)
    lists = runs.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list((F.shiftleft("start", 8).bitwiseOR(F.col("n")))).alias("runs"))
    joined = rows.join(lists, "key", "left").drop("key")
    schema = whole.select(*held).schema.add("n_bytes", "long").add("spans", SPAN_LIST).add("kept", "binary")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in base.text_steps(batches):
            data, o = base.flat(b.column("text"))
            raw, kept, spans = data.tobytes(), [], []
            for a, z, runs in zip(o[:-1].tolist(), o[1:].tolist(), b.column("runs").to_pylist()):
                if not runs:
                    kept.append(raw[a:z])
                    spans.append([])
                    continue
                r = np.array(runs, np.int64)
                begin, end = cover(r >> 8, r & 255, length)
                if trim:
                    own = np.append(data[a:z] & 0xC0 != 0x80, True)  # first bytes of characters
                    for k in range(3):
                        begin = np.where(own[begin], begin, begin + 1)
                        end = np.where(own[end], end, end - 1)
                spans.append([{"start": i, "end": j} for i, j in zip(begin.tolist(), end.tolist())])
                edge = [0, *(x for s in zip(begin.tolist(), end.tolist()) for x in s), z - a]
                kept.append(b"".join(raw[a + i : a + j] for i, j in zip(edge[::2], edge[1::2])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in held), pa.array(np.diff(o)), pa.array(spans, kind), pa.array(kept, pa.binary())], [*held, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, schema).toDF(*keep, "n_bytes", "spans", "kept")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated spans cut out of their texts; ``n_chars``, if there, counts what is left.

    A span that begins or ends within a character gives way to it, so that texts stay valid; null texts stay null.
    """
    whole, places = base.by_place(docs)
    named = {places["doc_id"]: "doc_id", places["text"]: "text"}
    rows = whole.toDF(*(named.get(c, c) for c in whole.columns))
    names_ = rows.columns
    cut = cut_repeats(rows.withColumn("null", F.col("text").isNull()), length, (*names_, "null"), trim=True)
    text = F.when(F.col("null"), F.lit(None)).otherwise(F.decode("kept", "UTF-8"))
    out = {"text": text}
    if count := places.get("n_chars"):
        out[count] = F.when(F.col("null"), F.col(count)).otherwise(F.length(text).cast(rows.schema[count].dataType))
    return cut.select(*((out[c] if c in out else F.col(c)).alias(c) for c in names_)).toDF(*docs.columns)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The query in DuckDB's SQL: every window of 100 bytes by its content. For doc_ids that are unique and not null.
SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS MATERIALIZED (
  SELECT doc_id, b, substr(h, 2 * b + 1, 1222) AS h, least(n - 99 - b, 512) AS k
  FROM (SELECT doc_id, h, n, unnest(range(0, n - 99, 512)) AS b FROM d WHERE n >= 100)
), w AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1 AS again
  FROM (SELECT doc_id, b + i AS s, substr(h, 2 * i + 1, 200) AS x FROM (SELECT doc_id, b, h, unnest(range(k)) AS i FROM pieces))
), runs AS (
  SELECT doc_id, s, s - lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) > 100 AS head FROM w WHERE again
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS z
  FROM (SELECT doc_id, s, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM runs) GROUP BY doc_id, g
), edges AS (
  SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS gone FROM spans GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE
    list_aggregate(list_transform(range(len(a) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE z[i] END) + 1, 2 * ((CASE WHEN i = len(a) THEN n ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE z[i] END)))), 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN edges USING (doc_id)
"""
