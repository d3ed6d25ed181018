"""Media columns (1): WAV storage, polyphase resampling, log-mel filterbanks, energy segmentation.

``store_media`` writes one mono 8-bit RIFF/WAVE clip a document to a durable binary column; ``audio_features`` reads
such a column. A clip goes through

1. rational polyphase resampling (24 kHz to 16 kHz by default; windowed-sinc prototype, one branch a phase),
2. frames of 128 samples at hop 64 (half overlapped), Hann window, power spectrum, triangular mel bands, log2,
3. hysteresis segmentation of frame energy: a segment opens at ``on`` above the clip's mean and closes at ``off`` below.

The bands are stored as Arrow ``fixed_shape_tensor`` values of 32 x 16 int16 with the time span of each, one Arrow IPC
stream a clip, in a durable table beside the segments; digests are those of the stored streams. Filter and transform coefficients are rounded to integers, so that every sum is exact in floating point:
equal clips give equal tensors whatever batch or executor they fall into.

Edge cases: a null or empty text is a clip of 192 spaces (silence of one level); repeated rows give repeated clips;
a null ``doc_id`` passes through; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import base

#: A payload is padded with spaces to a positive multiple of this.
UNIT = 192
#: Bytes before the samples: RIFF, fmt, a chunk with the unpadded length, data.
HEADER = 12 + 24 + 16 + 8


@dataclass(frozen=True)
class AudioParams:
    rate: int = 24_000
    up: int = 2
    down: int = 3
    half_taps: int = 8  # zero crossings of the prototype on either side
    hop: int = 64  # a frame is two hops
    n_mels: int = 16
    frames: int = 32  # of a tensor
    on: float = 0.25  # log2 energy above the clip's mean that opens a segment
    off: float = 0.25  # below the mean that closes it

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def wav_bytes(samples: bytes, n_bytes: int, rate: int) -> bytes:
    size = HEADER - 8 + len(samples)
    return b"".join([
        struct.pack("<4sI4s", b"RIFF", size, b"WAVE"),
        struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8),
        struct.pack("<4sIQ", b"nbyt", 8, n_bytes),
        struct.pack("<4sI", b"data", len(samples)),
        samples,
    ])


def wav_read(clip: bytes) -> tuple[bytes, int, int]:
    """Samples, unpadded length and rate of a clip; walks the chunks, so that extra ones do no harm."""
    kind, _, wave = struct.unpack_from("<4sI4s", clip)
    if kind != b"RIFF" or wave != b"WAVE":
        raise ValueError("not a RIFF/WAVE clip")
    at, samples, n_bytes, rate = 12, b"", None, 0
    while at + 8 <= len(clip):
        name, size = struct.unpack_from("<4sI", clip, at)
        body = at + 8
        if name == b"fmt ":
            rate = struct.unpack_from("<I", clip, body + 4)[0]
        elif name == b"nbyt":
            n_bytes = struct.unpack_from("<Q", clip, body)[0]
        elif name == b"data":
            samples = clip[body : body + size]
        at = body + size + (size & 1)
    return samples, len(samples) if n_bytes is None else n_bytes, rate


def store_media(docs: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """Durable table (doc_id, media): every whole text as the 8-bit samples of a WAV clip."""

    def encode(batches):
        for batch in base.text_steps(batches):
            data, o = base.flat(batch.column("text"))
            raw, clips = data.tobytes(), []
            for a, b in zip(o[:-1].tolist(), o[1:].tolist()):
                n = b - a
                full = max(UNIT, -(-n // UNIT) * UNIT)
                clips.append(wav_bytes(raw[a:b].ljust(full, b" "), n, params.rate))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(clips, pa.binary())], ["doc_id", "media"])

    return base.durable(base.columns(docs, "doc_id", text="text").mapInArrow(encode, "doc_id long, media binary"), "media")


class Frontend:
    """The integer filter banks of one parameter set."""

    def __init__(self, p: AudioParams):
        self.p = p
        self.block_in, self.block_out = p.down * 16, p.up * 16
        wide = max(p.up, p.down)
        self.halo = p.half_taps * wide // p.up + 1
        # prototype at the common rate; branch k of the polyphase bank holds its taps k, k + up, ...
        n = np.arange(-p.half_taps * wide, p.half_taps * wide + 1)
        proto = np.sinc(n / wide) * (0.5 + 0.5 * np.cos(np.pi * n / (p.half_taps * wide + 1))) * p.up / wide
        span = self.block_in + 2 * self.halo
        bank = np.zeros((span, self.block_out), np.float32)
        for out in range(self.block_out):
            for i in range(span):
                tap = out * p.down - (i - self.halo) * p.up
                if abs(tap) <= p.half_taps * wide:
                    bank[i, out] = np.rint(1024 * proto[tap + p.half_taps * wide])
        self.bank = bank
        size = 2 * p.hop
        t, bins = np.arange(size), np.arange(1, p.hop + 1)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * (t + 0.5) / size)
        angle = 2 * np.pi * np.outer(bins, t) / size
        self.dft = np.rint(65536 * np.concatenate([np.cos(angle), np.sin(angle)]) * window)
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        freq = bins * p.out_rate / size
        edges = 700 * (10 ** (np.linspace(mel(60.0), mel(p.out_rate / 2), p.n_mels + 2) / 2595) - 1)
        self.bands = []
        for m in range(p.n_mels):
            lo, mid, hi = edges[m : m + 3]
            w = np.maximum(0, np.minimum((freq - lo) / (mid - lo), (hi - freq) / (hi - mid)))
            if not w.any():  # a band narrower than a bin takes the nearest one
                w[np.argmin(np.abs(freq - mid))] = 1.0
            self.bands.append([(int(k), float(w[k])) for k in np.flatnonzero(w)])

    def resample(self, clips: list[bytes]) -> np.ndarray:
        """Resampled clips end to end, one row a block; integers. Silence surrounds every clip."""
        b = self.block_in
        n_blocks = [len(c) // b for c in clips]
        total = sum(n_blocks) + len(clips) + 1
        x = np.zeros((total, b), np.float32)
        keep = np.ones(total, bool)
        keep[0], at = False, 1
        for c, n in zip(clips, n_blocks):
            x[at : at + n] = np.frombuffer(c, np.uint8).reshape(n, b)
            x[at : at + n] -= 128
            keep[at + n] = False
            at += n + 1
        wide = np.concatenate([x[:-2, b - self.halo :], x[1:-1], x[2:, : self.halo]], axis=1) if self.halo <= b else None
        if wide is None:
            raise ValueError("filter longer than a block")
        return wide[keep[1:-1]] @ self.bank

    def features(self, clips: list[bytes]):
        """Per clip: tensors (n, frames, n_mels) int16, number of frames, segments as frame ranges."""
        p = self.p
        y = self.resample(clips).reshape(-1, p.hop).astype(np.float64)
        hops = np.array([len(c) // self.block_in * self.block_out // p.hop for c in clips])
        ends = np.cumsum(hops)
        last = np.zeros(len(y), bool)
        last[ends - 1] = True
        left, right = self.dft[:, : p.hop] @ y.T, self.dft[:, p.hop :] @ y.T
        spec = (left[:, :-1] + right[:, 1:])[:, ~last[:-1]]
        power = spec[: p.hop] ** 2 + spec[p.hop :] ** 2
        power *= 2.0**-44
        bands = np.empty((p.n_mels, power.shape[1]), np.int16)
        total = np.zeros(power.shape[1])
        for m, taps in enumerate(self.bands):
            acc = np.zeros(power.shape[1])
            for k, w in taps:
                acc += power[k] * w
            total += acc
            bands[m] = np.rint(np.log2(acc + 1) * 32)
        energy = np.rint(np.log2(total + 1) * 256).astype(np.int64)
        n_frames = hops - 1
        first = np.concatenate([[0], np.cumsum(n_frames)])
        mean = np.add.reduceat(energy, first[:-1]) // n_frames
        off_mean = energy - np.repeat(mean, n_frames)
        mark = np.where(off_mean >= p.on * 256, 1, np.where(off_mean < -p.off * 256, -1, 0))
        head = first[:-1]
        mark[head] = np.where(mark[head] == 0, -1, mark[head])
        held = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
        active = mark[held] > 0
        before = np.concatenate([[False], active[:-1]])
        before[head] = False
        after = np.concatenate([active[1:], [False]])
        after[first[1:] - 1] = False
        opens, closes = np.flatnonzero(active & ~before), np.flatnonzero(active & ~after) + 1
        own = np.searchsorted(opens, first)
        bands = bands.T
        for i in range(len(clips)):
            n = int(n_frames[i])
            t = np.zeros((-(-n // p.frames) * p.frames, p.n_mels), np.int16)
            t[:n] = bands[first[i] : first[i + 1]]
            s = slice(own[i], own[i + 1])
            yield t.reshape(-1, p.frames, p.n_mels), n, np.stack([opens[s], closes[s]], 1) - first[i]


def tensor_stream(tensors: np.ndarray, n_frames: int, p: AudioParams) -> bytes:
    """Arrow IPC stream: column ``tensor`` (fixed_shape_tensor) with ``start_s`` and ``end_s`` of each."""
    k = np.arange(len(tensors))
    start = k * p.frames * p.hop / p.out_rate
    end = (np.minimum((k + 1) * p.frames, n_frames) + 1) * p.hop / p.out_rate
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(tensors), pa.array(start), pa.array(end)], ["tensor", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    """The table of one clip's tensors; ``column('tensor').combine_chunks().to_numpy_ndarray()`` has their values."""
    return pa.ipc.open_stream(stream).read_all()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, features binary, n_frames long, segments array<struct<start_s: double, end_s: double>>"


def audio_features(media: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """Durable table of the clips' digests, tensors (see ``read_tensors``) and segments, from (doc_id, media)."""

    base.ship(media.sparkSession)

    def run(batches):
        front = Frontend(params)
        sec = params.hop / params.out_rate
        for batch in batches:
            clips = batch.column("media")
            sizes = np.cumsum(np.diff(base.flat(clips)[1]))
            start = 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + (1 << 18), side="right")))
                part = clips.slice(start, stop - start).to_pylist()
                read = [wav_read(c) for c in part]
                cols: list[list] = [[] for _ in range(9)]
                for clip, (payload, n, _), (tensors, n_frames, seg) in zip(part, read, front.features([r[0] for r in read])):
                    for c, v in zip(cols, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(clip), hashlib.sha256(clip).hexdigest(), tensor_stream(tensors, n_frames, params), n_frames, [{"start_s": a * sec, "end_s": (b + 1) * sec} for a, b in seg.tolist()])):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
                ids = batch.column("doc_id").slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.strip().split(" ")[0] for x in FEATURES.split(", ")[:9]] + ["segments"])
                start = stop

    return base.durable(media.select("doc_id", "media").mapInArrow(run, FEATURES), "audio")


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = audio_features(store_media(docs))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.sha2("features", 256).alias("feature"), "n_frames", F.size("segments").cast("long").alias("n_segments"))
