"""Audio media columns: log-mel tensors and energy segments of stored sound.

A payload of bytes is stored losslessly as a WAV file of 8-bit mono samples. What is read
back from the file is resampled by a polyphase windowed-sinc filter (RATE to OUT_RATE),
cut into overlapping Hann frames, and turned into log-mel energies. Frames above a low
energy level that touch a high one form segments (hysteresis). Features leave as Arrow
tensors of one fixed shape, BLOCK_FRAMES x MELS, each with the time span it covers; the
last block is padded with zeros. Long payloads are read block by block.

Edge cases: a null or empty text is one block of 64 zero bytes. Equal payloads give equal
features, as each is computed by itself. Rows that repeat a doc_id are rows of their own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import documents, utf8

RATE, UP, DOWN = 16_000, 2, 5
OUT_RATE = RATE * UP // DOWN
HALF = 12
WIN, HOP, FFT = 160, 64, 256
MELS = 24
BLOCK_FRAMES = 64
PAD = 64
FLOOR = 1e-6

SCHEMA = """doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
media_sha256 string, feature string, n_frames long, segments array<struct<start_s: double, end_s: double>>"""
ARROW_FIELDS = [
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()),
    ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
]


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD if text else PAD)


def write_wav(samples: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def read_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono PCM file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono PCM")
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@cache
def polyphase_taps() -> np.ndarray:
    """UP x (2 HALF + 1): the filter's taps for each phase of an output sample."""
    cut = min(1.0, UP / DOWN)
    t = np.arange(UP)[:, None] / UP + HALF - np.arange(2 * HALF + 1)[None, :]
    taps = np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / (HALF + 1), -1, 1)))
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Output samples begin..end-1 (begin a multiple of UP) of 8-bit samples; silence
    stands before and after them."""
    out = np.zeros(end - begin, np.float32)
    for r in range(min(UP, end - begin)):
        m = begin + r
        centre, phase = m * DOWN // UP, m * DOWN % UP
        count = (end - m + UP - 1) // UP
        lo, hi = centre - HALF, centre + (count - 1) * DOWN + HALF + 1
        x = np.zeros(hi - lo, np.float32)
        a, b = max(lo, 0), min(hi, len(samples))
        if b > a:
            x[a - lo : b - lo] = (samples[a:b].astype(np.float32) - 128) / 128
        out[r::UP] = sliding_window_view(x, 2 * HALF + 1)[::DOWN] @ polyphase_taps()[phase]
    return out


@cache
def mel_filters() -> np.ndarray:
    """(FFT / 2 + 1) x MELS triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * OUT_RATE / FFT
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@cache
def _window() -> np.ndarray:
    return np.hanning(WIN + 1)[:-1].astype(np.float32)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """frames x MELS log-mel energies, and each frame's energy in decibel."""
    n_out = max(-(-len(samples) * UP // DOWN), 1)
    frames = 1 + max(0, -(-(n_out - WIN) // HOP))
    mels, power = np.zeros((frames, MELS), np.float32), np.zeros(frames, np.float32)
    step = 8192
    for at in range(0, frames, step):
        n = min(step, frames - at)
        y = resample(samples, at * HOP, at * HOP + (n - 1) * HOP + WIN)
        cut = sliding_window_view(y, WIN)[::HOP] * _window()
        spectrum = np.fft.rfft(cut, FFT)
        energy = spectrum.real**2 + spectrum.imag**2
        mels[at : at + n] = np.log(energy @ mel_filters() + FLOOR)
        power[at : at + n] = 10 * np.log10(np.einsum("ij,ij->i", cut, cut) / WIN + FLOOR)
    return mels, power


def hysteresis(power: np.ndarray) -> np.ndarray:
    """n x 2 frame ranges: runs above the mean that somewhere rise over the mean by one
    standard deviation."""
    low, high = power.mean(), power.mean() + power.std()
    above = np.concatenate([[False], power > low, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1]).reshape(-1, 2)
    if not len(edges):
        return edges
    # What follows a run up to the next is below `low`, so it can't raise the run's peak.
    return edges[np.maximum.reduceat(power, edges[:, 0]) > high]


def tensor_blocks(mels: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors with the time span of each."""
    n = -(-len(mels) // BLOCK_FRAMES)
    padded = np.zeros((n * BLOCK_FRAMES, MELS), np.float32)
    padded[: len(mels)] = mels
    start = np.arange(n) * BLOCK_FRAMES
    last = np.minimum(start + BLOCK_FRAMES, len(mels)) - 1
    batch = pa.record_batch(
        {
            "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, BLOCK_FRAMES, MELS)),
            "start_s": pa.array(start * HOP / OUT_RATE),
            "end_s": pa.array((last * HOP + WIN) / OUT_RATE),
            "frames": pa.array(last + 1 - start),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(blocks: bytes) -> pa.Table:
    return pa.ipc.open_stream(blocks).read_all()


def audio_features(docs: DataFrame, media: bool = False, tensors: bool = False) -> DataFrame:
    """Digests, feature summary and segments of each row's sound; on demand also the stored
    file (media) and the tensors (an Arrow stream, see read_tensors)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            out: list[dict] = []
            held = 0
            for doc_id, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                stored = write_wav(payload_of(data[a:b].tobytes()))
                read = read_wav(stored)
                mels, power = log_mel(np.frombuffer(read, np.uint8))
                spans = hysteresis(power)
                seconds = [{"start_s": float(p * HOP / OUT_RATE), "end_s": float(((q - 1) * HOP + WIN) / OUT_RATE)} for p, q in spans.tolist()]
                mean = ",".join(f"{v:.3f}" for v in mels.mean(0, dtype=np.float64))
                row = {
                    "doc_id": doc_id,
                    "n_bytes": b - a,
                    "payload_bytes": len(read),
                    "payload_sha256": hashlib.sha256(read).hexdigest(),
                    "tail_crc32": zlib.crc32(read[-PAD:]),
                    "media_bytes": len(stored),
                    "media_sha256": hashlib.sha256(stored).hexdigest(),
                    "feature": f"{len(mels)}x{MELS};{mean};{len(spans)}:{int((spans[:, 1] - spans[:, 0]).sum())}",
                    "n_frames": len(mels),
                    "segments": seconds,
                }
                if media:
                    row["media"] = stored
                if tensors:
                    row["tensors"] = tensor_blocks(mels)
                out.append(row)
                held += len(stored)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    extra = ["media"] * media + ["tensors"] * tensors
    kinds = SCHEMA + "".join(f", {c} binary" for c in extra)
    schema = pa.schema([*ARROW_FIELDS, *((c, pa.binary()) for c in extra)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, kinds)


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(documents(spark, sf_dir)).drop("segments", "n_frames")
