"""Quality classifier (6): a factorisation machine.

Features of a text: hashed words (square-root counts, scaled to unit length), statistics of its structure cut into
levels, and the level of its length as metadata. Score: ``sigmoid(b + w.x + pairs)`` where the interactions of all pairs
``sum_{i<j} <v_i, v_j> x_i x_j`` are computed in linear time as half of ``sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2``.

It is fitted with AdaGrad on at most ``max_rows`` labelled rows (by hash of doc_id, the same whatever the partitioning;
one row a doc_id, that of the least features); features come from the executors, the driver sees that bounded sample
only. The model, of fixed size, goes to the scoring tasks. Labels, language, source and doc_id are never inputs of a
score.

Edge cases: a null or empty text has the features of its structure only and still a score; equal texts have equal
scores; labels of unknown documents and null labels are left out, of several the greatest counts; without a single
usable label every score is 0.5; repeated rows are scored each; a null ``doc_id`` is scored and never learnt from; an
empty table gives an empty table; other columns, whatever their names, are kept where asked for and not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import base

#: Score from which a document counts as good.
THRESHOLD = 0.3


@dataclass(frozen=True)
class FmParams:
    bits: int = 16  # of a word's hash
    rank: int = 8
    visits: int = 60_000  # of rows in training: a small sample is gone over more often,
    most_epochs: int = 100  # so many times at most
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-4
    max_rows: int = 12_000
    seed: int = 11


#: Structure statistics: shares of bytes and words, each cut into ``LEVELS`` levels.
STATS = ("letters", "capitals", "digits", "signs", "spaces", "high", "lines", "word_length", "repeats", "stutter", "long_words", "length")
LEVELS = 16
_GROUP = np.zeros(256, np.int64)  # 0 other
_GROUP[97:123] = 1
_GROUP[65:91] = 2
_GROUP[48:58] = 3
_GROUP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_GROUP[[32, 9, 11, 12, 13]] = 5
_GROUP[10] = 6
_GROUP[128:] = 7


def features(data: np.ndarray, offsets: np.ndarray, p: FmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature index, value and row offsets of each text. The statistics are the last ``len(STATS)`` of a row."""
    n = len(offsets) - 1
    starts, ends, first = base.words(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    hashes = base.span_hashes(base.LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    bucket = (hashes >> np.uint64(64 - p.bits)).astype(np.int64)
    again = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    key, count = np.unique(doc << p.bits | bucket, return_counts=True)
    row, index = key >> p.bits, key & ((1 << p.bits) - 1)
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, count, n))
    value = value / norm[row]
    size = np.diff(offsets)
    groups = np.zeros((n, 8))
    owner = np.repeat(np.arange(n), size)
    if len(data):
        groups = np.bincount(owner * 8 + _GROUP[data], minlength=8 * n).reshape(n, 8)
    total, n_words = np.maximum(size, 1), np.diff(first)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(n_words, 1)
    long = np.bincount(doc[length > 14], minlength=n) / np.maximum(n_words, 1)
    repeats = 1 - np.bincount(row, minlength=n) / np.maximum(n_words, 1)
    stutter = np.bincount(doc[1:][again], minlength=n) / np.maximum(n_words, 1)
    shares = [groups[:, k] / total for k in (1, 2, 3, 4, 5, 7)]
    levels = [*(np.sqrt(s) for s in shares), np.minimum(1, np.sqrt(groups[:, 6] / total) * 2), np.minimum(1, mean / 16), repeats, np.sqrt(stutter), np.sqrt(long), np.minimum(1, np.log2(size + 1) / 20)]
    stat = np.stack([np.minimum(LEVELS - 1, (x * LEVELS).astype(np.int64)) for x in levels], 1)
    stat += (1 << p.bits) + LEVELS * np.arange(len(STATS))
    all_rows = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
    order = np.argsort(all_rows, kind="stable")
    out = np.concatenate([index, stat.ravel()])[order], np.concatenate([value, np.full(n * len(STATS), 0.3)])[order]
    return out[0].astype(np.int32), out[1].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=n))]).astype(np.int64)


@dataclass
class Model:
    params: FmParams
    bias: float
    w: np.ndarray = field(repr=False)
    v: np.ndarray = field(repr=False)

    def raw(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, offsets[:-1], axis=0, dtype=np.float64)
        q = np.add.reduceat(vx * vx, offsets[:-1], axis=0, dtype=np.float64)
        return self.bias + np.add.reduceat(self.w[index] * value, offsets[:-1], dtype=np.float64) + 0.5 * (s * s - q).sum(axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(*features(data, offsets, self.params)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def empty_model(p: FmParams) -> Model:
    n = (1 << p.bits) + LEVELS * len(STATS)
    return Model(p, 0.0, np.zeros(n, np.float32), np.random.default_rng(p.seed).normal(0, 0.05, (n, p.rank)).astype(np.float32) * 0)


def train(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, y: np.ndarray, p: FmParams) -> Model:
    """Fit by AdaGrad on the logistic loss, rare labels weighted up to at most a quarter of the weight."""
    n = (1 << p.bits) + LEVELS * len(STATS)
    rng = np.random.default_rng(p.seed)
    m = Model(p, 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, p.rank)).astype(np.float32))
    gw, gv, gb = np.full(n, 1e-2, np.float32), np.full((n, p.rank), 1e-2, np.float32), 1e-2
    size = np.diff(offsets)
    for _ in range(max(1, min(p.most_epochs, p.visits // max(1, len(y))))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), p.batch):
            rows = order[k : k + p.batch]
            c = size[rows]
            o = np.concatenate([[0], np.cumsum(c)])
            at = np.repeat(offsets[rows] - o[:-1], c) + np.arange(o[-1])
            i, x = index[at], value[at]
            vx = m.v[i] * x[:, None]
            s = np.add.reduceat(vx, o[:-1], axis=0)
            raw = m.bias + np.add.reduceat(m.w[i] * x, o[:-1]) + 0.5 * (s * s - np.add.reduceat(vx * vx, o[:-1], axis=0)).sum(axis=1)
            err = (sigmoid(raw) - y[rows]) / len(rows)
            e = np.repeat(err, c).astype(np.float32)
            used, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, e * x, len(used)).astype(np.float32) + p.decay * m.w[used]
            part = (e * x)[:, None] * (np.repeat(s, c, axis=0) - vx)
            by = np.argsort(inv, kind="stable")
            dv = np.add.reduceat(part[by], np.flatnonzero(np.append(True, np.diff(inv[by]) != 0)), axis=0) + p.decay * m.v[used]
            db = float(err.sum())
            gb += db * db
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.bias -= p.rate * db / gb**0.5
            m.w[used] -= p.rate * dw / np.sqrt(gw[used])
            m.v[used] -= p.rate * dv / np.sqrt(gv[used])
    return m


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text is a multiple of 5."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, p: FmParams = FmParams()) -> Model:
    """A model of ``labels.quality`` from the labelled documents that are not held out, ``max_rows`` at most."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("y"))
    # the bound holds before any text is touched
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.max_rows)
    rows = base.columns(docs, "doc_id", text="text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in base.text_steps(batches):
            i, x, o = features(*base.flat(batch.column("text")), p)
            pack = lambda a, kind: pa.array([a[b:e].astype(kind).tobytes() for b, e in zip(o[:-1].tolist(), o[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), pack(i, "<i4"), pack(x, "<f4")], ["doc_id", "y", "i", "x"])

    # rows, not only labels, are bounded: one a doc_id leaves the executors
    found = rows.mapInArrow(run, "doc_id long, y int, i binary, x binary").groupBy("doc_id", "y").agg(F.min(F.struct("i", "x")).alias("f")).select("doc_id", "y", "f.i", "f.x")
    got = sorted(found.collect(), key=lambda r: r.doc_id)
    if not got:
        return empty_model(p)
    index, value = np.frombuffer(b"".join(r.i for r in got), "<i4"), np.frombuffer(b"".join(r.x for r in got), "<f4")
    offsets = np.concatenate([[0], np.cumsum([len(r.i) // 4 for r in got])])
    return train(index, value, offsets, np.array([r.y for r in got], np.float64), p)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns by place (see ``by_place``) and ``score``."""
    whole, places = base.by_place(docs)
    names = ["text" if c == places["text"] else c for c in whole.columns]
    rows = whole.toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast((model.params, model.bias, model.w, model.v))

    def run(batches):
        m = Model(*shared.value)
        for batch in base.text_steps(batches):
            s = m.score(*base.flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(s, 12))], [*names, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every whole text in the column ``out``."""
    whole, places = base.by_place(docs)
    lean = whole.select(*(F.col(places[c]) for c in dict.fromkeys((*keep, "text")))).toDF(*dict.fromkeys((*keep, "text")))
    scored = _scored(lean, model)
    return scored.select(*scored.columns[: len(dict.fromkeys(keep))], "score").toDF(*dict.fromkeys(keep), out)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    return _scored(docs, model).filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)


def op6_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
