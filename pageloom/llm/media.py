"""Audio columns: 8-bit WAV, polyphase resampling, overlapped log-mel frames, energy segments, fixed-shape tensors.

``encode_wav`` turns bytes into a mono WAV file losslessly (one unsigned 8-bit sample per byte). ``audio_features`` reads the
stored file back, resamples it by up/down with a polyphase filter, takes overlapping windows, log-mel energies and segments of
speech-like energy with hysteresis, and stores the frames as an Arrow IPC stream of a fixed_shape_tensor column, one row per
block of frames with its time span.

Defined results. Null or empty payloads are padded like any other, so that every row has at least one frame. Equal payloads
give equal files, tensors and segments: each is computed by itself. A stored value that isn't such a WAV file gives null
features and an ``error``. Other columns pass by ``keep`` only; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = 44


def padded_payload(text: Column, multiple: int = 192) -> Column:
    """The text's UTF-8 bytes and as many spaces (32) as it takes to a positive multiple."""
    raw = F.coalesce(text, F.lit("")).cast("string").cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(multiple)).otherwise(F.pmod(-n, F.lit(multiple)))
    return F.concat(raw, F.repeat(F.lit(" "), pad.cast("int")).cast("binary"))


def _le(n: Column, width: int) -> Column:
    """n as little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]))


def encode_wav(payload: Column, rate: int = 8000) -> Column:
    """A RIFF/WAVE file, PCM, mono, 8 bits, whose samples are the payload's bytes."""
    n = F.octet_length(payload).cast("long")
    fmt = F.lit(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data")
    return F.concat(F.lit(b"RIFF"), _le(n + 36, 4), fmt, _le(n, 4), payload)


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a file written by encode_wav."""
    if len(media) < HEADER or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a PCM WAV file")
    _, kind, channels, rate, _, _, bits = struct.unpack_from("<IHHIIHH", media, 16)
    (n,) = struct.unpack_from("<I", media, 40)
    if (kind, channels, bits) != (1, 1, 8) or len(media) < HEADER + n:
        raise ValueError("not a whole mono 8-bit PCM file")
    return rate, media[HEADER : HEADER + n]


@dataclass(frozen=True)
class Features:
    """Parameters. With the defaults 192 bytes at 8 kHz give one frame at 6 kHz."""

    up: int = 3
    down: int = 4
    taps: int = 16
    window: int = 144
    hop: int = 72
    fft: int = 256
    mels: int = 32
    low_hz: float = 60.0
    floor: float = 1e-6
    high_db: float = 3.0
    low_db: float = -3.0
    block: int = 16


@lru_cache(maxsize=8)
def _polyphase(p: Features) -> np.ndarray:
    """(inputs, up): what each of `up` outputs takes from `down` inputs and `taps` after them; a windowed sinc."""
    n = p.down + p.taps
    at = np.arange(n)[:, None] - (p.taps / 2 + np.arange(p.up) * p.down / p.up)[None, :]
    cut = min(1.0, p.up / p.down)
    h = cut * np.sinc(cut * at) * np.where(np.abs(at) <= p.taps / 2, 0.5 + 0.5 * np.cos(2 * np.pi * at / p.taps), 0)
    return (h / h.sum(axis=0)).astype(np.float32)


@lru_cache(maxsize=8)
def _mel(p: Features, rate: float) -> np.ndarray:
    """(bins, mels) triangular filters, equally spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(p.low_hz), mel(rate / 2), p.mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(p.fft, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1]))).astype(np.float32)


#: Frames whose spectra are held at once.
CHUNK = 8192


def resample(x: np.ndarray, p: Features) -> np.ndarray:
    blocks = -(-len(x) // p.down)
    padded = np.zeros(blocks * p.down + p.taps, np.float32)
    padded[p.taps // 2 : p.taps // 2 + len(x)] = x
    rows = np.lib.stride_tricks.as_strided(padded, (blocks, p.down + p.taps), (4 * p.down, 4))
    return (rows @ _polyphase(p)).reshape(-1)


def segments(db: np.ndarray, p: Features) -> list[tuple[int, int]]:
    """[first frame, last frame + 1) of spans that begin above the median by high_db and end below it by low_db."""
    rel = db - np.median(db)
    mark = np.where(rel >= p.high_db, 1, np.where(rel < p.low_db, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def logmel(samples: bytes, rate: int, p: Features) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies as float16 and each frame's energy in dB; the last frame is zero-padded, so that every sample is in one."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x, p)
    y = np.pad(y, (0, p.window - len(y) if len(y) < p.window else (p.window - len(y)) % p.hop))
    frames, shape, bank = np.lib.stride_tricks.sliding_window_view(y, p.window)[:: p.hop], np.hanning(p.window).astype(np.float32), _mel(p, rate * p.up / p.down)
    mel, db = np.empty((len(frames), p.mels), np.float16), np.empty(len(frames))
    for k in range(0, len(frames), CHUNK):  # the spectra of a long text are never held all at once
        power = np.abs(np.fft.rfft(frames[k : k + CHUNK] * shape, p.fft)) ** 2
        mel[k : k + CHUNK] = np.log(power.astype(np.float32) @ bank + np.float32(p.floor))
        db[k : k + CHUNK] = 10 * np.log10(power.sum(axis=1) + p.floor)
    return mel, db


def tensor_stream(mel: np.ndarray, rate: int, p: Features) -> bytes:
    """An Arrow IPC stream: start_ms, end_ms, frames, logmel fixed_shape_tensor<halffloat, [block, mels]>; the last block is zero-padded."""
    blocks = -(-len(mel) // p.block)
    full = np.zeros((blocks * p.block, p.mels), np.float16)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float16(), (p.block, p.mels))
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), p.block * p.mels))
    used = np.minimum(p.block, len(mel) - np.arange(blocks) * p.block)
    ms = 1000 * p.down / (rate * p.up)
    start = np.arange(blocks) * p.block * p.hop
    batch = pa.RecordBatch.from_arrays([pa.array(start * ms), pa.array((start + (used - 1) * p.hop + p.window) * ms), pa.array(used.astype(np.int32)), tensors], names=["start_ms", "end_ms", "frames", "logmel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def audio_features(df: DataFrame, *, media: str = "media", keep: tuple[str, ...] = ("doc_id",), params: Features | None = None) -> DataFrame:
    """keep, media, samples binary (read back), frames int, tensors binary (Arrow IPC), spans array<struct<start_ms, end_ms>>, error string."""
    p = params or Features()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)).to_pylist():
                try:
                    if value is None:
                        raise ValueError("null")
                    rate, samples = decode_wav(value)
                    mel, db = logmel(samples, rate, p)
                    ms = 1000 * p.down / (rate * p.up)
                    spans = [{"start_ms": a * p.hop * ms, "end_ms": ((b - 1) * p.hop + p.window) * ms} for a, b in segments(db, p)]
                    rows.append((samples, len(mel), tensor_stream(mel, rate, p), spans, None))
                except ValueError as e:
                    rows.append((None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.binary(), pa.int32(), pa.binary(), span, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, "media", "samples", "frames", "tensors", "spans", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, F.col(media).alias("media")).mapInArrow(run, f"{fields}, media binary, samples binary, frames int, tensors binary, spans array<struct<start_ms: double, end_ms: double>>, error string")
