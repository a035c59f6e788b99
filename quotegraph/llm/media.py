"""WAV columns and spectral-peak fingerprints.

Bytes become unsigned 8-bit mono samples of a WAV payload, made by the standard library's wave
module and stored as a binary column of a table; features come from what is read back from there.
A short-time Fourier transform of the samples gives, per frame, the strongest bin of each band. One
that is above its frame's mean and no weaker than its band's in the frames before and after is a
peak. Each peak is paired with the next few, and each pair is a code (bin, bin, frames between) at a
time, as in landmark fingerprinting. Times and codes are arrays; frames are worked off in blocks, so
a long payload needs no more memory than a block and its pairs.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quotegraph.plans.shared import materialize

#: Samples of a frame and from one to the next; frames that a pair may span, and pairs of a peak; frames of a block.
UNIT, RATE, FRAME, HOP, REACH, PAIRS, BLOCK = 576, 16000, 192, 96, 7, 3, 4096
BANDS = ((1, 9), (9, 25), (25, 49), (49, 97))
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\xff")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of a WAV file made by :func:`to_wav`; raises on another layout."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def spectrum(samples: bytes, first: int, n: int) -> np.ndarray:
    """Log power of ``n`` frames (frames x bins) from the frame ``first`` on."""
    data = np.frombuffer(samples, np.uint8)
    block = np.lib.stride_tricks.sliding_window_view(data, FRAME)[first * HOP : (first + n - 1) * HOP + 1 : HOP].astype(np.float32)
    block -= 128
    block *= _WINDOW
    parts = np.fft.rfft(block, axis=1)
    return np.log1p(parts.real**2 + parts.imag**2)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers, rising) and bins of the spectral peaks."""
    frames = max(0, (len(samples) - FRAME) // HOP + 1)
    times, bins = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, frames, BLOCK):
        n, low = min(BLOCK, frames - at), max(0, at - 1)
        power = spectrum(samples, low, min(frames, at + n + 1) - low)  # with a frame before and one after
        mean, every, own = power.mean(1), np.arange(len(power)), slice(at - low, at - low + n)
        for first, end in BANDS:
            best = power[:, first:end].argmax(1) + first
            height = power[every, best]
            around = np.concatenate(([-1.0], height, [-1.0]))
            strong = np.flatnonzero(((height > mean) & (height >= around[:-2]) & (height >= around[2:]))[own])
            times.append(strong + at)
            bins.append(best[own][strong])
    t, b = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((b, t))
    return t[order], b[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs, in time order: each peak with the first PAIRS of those 1 to REACH frames later."""
    t, b = peaks(samples)
    after = np.searchsorted(t, t, "right")
    times, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(PAIRS):
        other = np.minimum(after + step, max(0, len(t) - 1))
        gap = t[other] - t
        near = np.flatnonzero((after + step < len(t)) & (gap <= REACH))
        times.append(t[near])
        codes.append((b[near] << 11) | (b[other[near]] << 4) | gap[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def stored_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` of each row of ``docs`` (doc_id, text): its text's bytes, padded, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                data = [(t or "").encode("utf-8") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(map(len, data), pa.int64()), "media": pa.array([to_wav(padded(d)) for d in data], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """The facts and the fingerprint of each row of ``stored`` (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part, rows = b.slice(at, 64), []
                for media in part.column("media").to_pylist():
                    samples = from_wav(media)
                    times, codes = fingerprint(samples)
                    digest = hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()[:16]
                    feature = f"pairs={len(codes)};codes={len(np.unique(codes))};sha={digest}"
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, times, codes))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes"]
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>")


def media_columns(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of stored media (doc_id, n_bytes, media), written to the shared folder, and the facts and fingerprints of what is read back.

    Columns of the latter: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (number of pairs, of distinct codes, and a digest of the time-coded
    arrays), times, codes. A null text is an empty one: 576 bytes of padding. Equal texts have equal
    values; repeated rows, and rows without an id, give rows of their own. Only doc_id and text are
    read, whatever else the table has; an empty table gives an empty result. A WAV file holds at
    most 4 GiB; Spark's own limit on a cell is below that.
    """
    stored = materialize(stored_media(docs), "media")
    return stored, media_features(stored)
