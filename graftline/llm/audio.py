"""Audio columns: lossless 8-bit WAV storage and log-mel features.

Features of a clip: polyphase resampling to the analysis rate, overlapped log-mel
filterbanks, and hysteresis segmentation of the frame energy.  The filterbank
frames are cut into tensors of one fixed shape (``frames`` x ``mels`` float16, the
last one filled up with zeros), each with its time span.  Tasks store a clip's
tensors as an Arrow stream whose column has Arrow's fixed-shape tensor type, and
every later reader works from the stored streams.  Clips are computed in blocks of
frames, so a long one needs little more memory than its bytes and its tensors.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stash import stash
from . import text as tx

UNIT = 576
FILL = b"\xff"


@dataclass(frozen=True)
class AudioFeatures:
    rate: int = 16_000
    target: int = 12_000
    #: Filter taps of each polyphase branch.
    taps: int = 16
    window: int = 300
    hop: int = 120
    fft: int = 512
    mels: int = 32
    #: Frames of one tensor.
    frames: int = 64
    #: Decibels over the clip's median energy at which a segment opens, and under which it closes.
    open_db: float = 1.5
    close_db: float = 0.5


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with bytes 255 to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8")
    return raw + FILL * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(samples: bytes, rate: int = 16_000) -> bytes:
    """One channel of unsigned 8-bit PCM."""
    pad = b"\0" if len(samples) % 2 else b""
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples); walks the chunks and takes the first data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def _branches(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low pass, one row of reversed taps for each phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / up, 1 / down)
    h = cut * np.sinc(cut * t) * np.kaiser(n, 8.0)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int, taps: int = 16, first: int = 0, count: int | None = None) -> np.ndarray:
    """Polyphase resampling: output m is phase (m * down) % up at input (m * down) // up.

    ``first`` and ``count`` ask for a part of the outputs; bytes are read as unsigned 8-bit samples.
    """
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    count = -(-len(x) * up // down) - first if count is None else count
    if count <= 0:
        return np.zeros(0, np.float32)
    branch, half = _branches(up, down, taps), taps // 2
    low, high = first * down // up - (taps - 1 - half), (first + count - 1) * down // up + half + 1
    part = x[max(0, low) : high]
    part = (part.astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else part.astype(np.float32)
    part = np.pad(part, (max(0, -low), max(0, high - len(x))))
    if up == down:
        return part[taps - 1 - half :][:count].copy()
    view = np.lib.stride_tricks.sliding_window_view(part, taps)
    out = np.empty(count, np.float32)
    for k in range(min(up, count)):
        at = (first + k) * down
        own = out[k::up]
        own[:] = view[at // up - first * down // up :: down][: len(own)] @ branch[at % up]
    return out


@lru_cache(maxsize=8)
def _mel_bank(target: int, fft: int, mels: int) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(target / 2), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * target / fft
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return np.ascontiguousarray(bank.T).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int, p: AudioFeatures, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies as float16, frame energy in dB), so many frames at once.

    Every sample is in a frame; the last frame is filled up with silence.
    """
    g = math.gcd(rate, p.target)
    total = -(-len(samples) * (p.target // g) // (rate // g))
    n = 1 + max(0, -(-(total - p.window) // p.hop))
    hann = np.hanning(p.window).astype(np.float32)
    bank = _mel_bank(p.target, p.fft, p.mels)
    mel, energy = np.empty((n, p.mels), np.float16), np.empty(n, np.float32)
    for a in range(0, n, block):
        b = min(n, a + block)
        first, size = a * p.hop, (b - 1 - a) * p.hop + p.window
        x = resample(samples, rate, p.target, p.taps, first, min(size, total - first))
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, size - len(x))), p.window)[:: p.hop] * hann
        power = np.abs(np.fft.rfft(frames, p.fft, axis=1)).astype(np.float32) ** 2
        mel[a:b] = np.log(power @ bank + 1e-6)
        energy[a:b] = 10 * np.log10((frames * frames).mean(axis=1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, p: AudioFeatures) -> list[tuple[int, int]]:
    """(first frame, end frame) of runs that open at the high and close under the low threshold."""
    mid = np.median(energy)
    state = np.where(energy >= mid + p.open_db, 1, np.where(energy < mid + p.close_db, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(last >= 0, state[last], 0)
    step = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def to_arrow(mel: np.ndarray, p: AudioFeatures) -> bytes:
    """An Arrow stream of (start_ms, end_ms, valid, tensor): the frames cut into tensors of one fixed shape."""
    n, ms = -(-len(mel) // p.frames), 1000 / p.target
    body = np.zeros((n * p.frames, p.mels), np.float16)
    body[: len(mel)] = mel
    first = np.arange(n) * p.frames
    valid = np.minimum(p.frames, len(mel) - first)
    tensors = pa.FixedSizeListArray.from_arrays(pa.array(body.ravel()), p.frames * p.mels)
    kind = pa.fixed_shape_tensor(pa.float16(), (p.frames, p.mels))
    columns = [pa.array(first * p.hop * ms), pa.array(((first + valid - 1) * p.hop + p.window) * ms), pa.array(valid.astype(np.int32)), pa.ExtensionArray.from_storage(kind, tensors)]
    batch = pa.RecordBatch.from_arrays(columns, names=["start_ms", "end_ms", "valid", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(stored: bytes | pa.Buffer) -> pa.RecordBatch:
    """The batch of a stored stream; its tensor column's ``to_numpy_ndarray`` is tensors x frames x mels."""
    return pa.ipc.open_stream(stored).read_next_batch()


def media_table(docs: DataFrame, rate: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a WAV file, written to the shared folder.

    Null and empty texts give one unit of fill; repeated rows are stored as often as
    they occur, null ids stay null, and an empty table gives an empty one.  Other
    columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 256):
            texts = batch.column(1).to_pylist()
            media = [to_wav(payload(t), rate) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stash(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


_SPANS = "array<struct<start_ms:double,end_ms:double>>"
_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long"
STORED = f"{_DIGEST}, segments {_SPANS}, tensors binary"


def features(media: DataFrame, p: AudioFeatures = AudioFeatures()) -> DataFrame:
    """The columns of ``STORED``, computed from the stored media alone and written to the shared folder.

    ``tensors`` is an Arrow stream of fixed-shape tensors with their time spans
    (``from_arrow``), ``segments`` the spans of the hysteresis segmentation.  Equal
    media give equal rows: every clip is computed by itself.  An empty table gives an
    empty result.
    """
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), span, pa.binary()]
    names = [f.split()[0] for f in STORED.split(", ")]
    ms = 1000 / p.target

    def one(clip: bytes) -> tuple:
        rate, samples = from_wav(clip)
        mel, energy = log_mel(np.frombuffer(samples, np.uint8), rate, p)
        spoken = [{"start_ms": a * p.hop * ms, "end_ms": ((b - 1) * p.hop + p.window) * ms} for a, b in segments(energy, p)]
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(clip), hashlib.sha256(clip).hexdigest(), len(mel), spoken, to_arrow(mel, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 64):
            rows = [one(m.as_buffer().to_pybytes()) for m in batch.column(2)]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return stash(media.select("doc_id", "n_bytes", "media").mapInArrow(run, STORED), "tensors")


def summary(stored: DataFrame) -> DataFrame:
    """Stored rows with (n_tensors, mel_mean) in place of the tensors, read back from their Arrow streams."""
    kept = [f.split()[0] for f in f"{_DIGEST}, segments {_SPANS}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 64):
            count, mean = [], []
            for x in batch.column(len(kept)):
                own = from_arrow(x.as_buffer())
                frames = own.column(3).to_numpy_ndarray()
                real = np.arange(frames.shape[1]) < own.column(2).to_numpy()[:, None]
                count.append(len(frames))
                mean.append(frames[real].mean(axis=0, dtype=np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(count, pa.int32()), pa.array(mean, pa.list_(pa.float64()))], names=[*kept, "n_tensors", "mel_mean"])

    return stored.select(*kept, "tensors").mapInArrow(run, f"{_DIGEST}, segments {_SPANS}, n_tensors int, mel_mean array<double>")


def tensor_rows(stored: DataFrame) -> DataFrame:
    """(doc_id, start_ms, end_ms, valid, values), one row for each stored tensor, its values row after row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, x in zip(batch.column(0), batch.column(1), strict=True):
                own = from_arrow(x.as_buffer())
                values = own.column(3).storage
                flat = pa.array(np.asarray(values.flatten()).astype(np.float32))
                lists = pa.ListArray.from_arrays(np.arange(len(own.column(0)) + 1, dtype=np.int32) * values.type.list_size, flat)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(lists), pa.int64()), *own.columns[:3], lists], names=["doc_id", "start_ms", "end_ms", "valid", "values"])

    return stored.select("doc_id", "tensors").mapInArrow(run, "doc_id long, start_ms double, end_ms double, valid int, values array<float>")
