"""Media columns: texts as 8-bit WAV files, read by the wave module, with spectral-peak pair fingerprints.

A short-time Fourier transform is taken of the samples; in each frame the strongest bins of each band are peaks if they
stand out, and each peak is paired with peaks of the next frames. A pair is hashed from its two bins and their distance
in time and stored with its anchor's frame: two arrays of equal length, times and hashes.

Cases: null and empty texts give 64 zero samples, which have no peaks and so empty arrays; texts of any length are read
in blocks of frames; an empty table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import shared

UNIT, RATE = 64, 8000
FRAME, HOP = 256, 128
#: Bands of bins, one peak each at most; a peak is AHEAD frames before its partners at most.
BANDS = ((2, 8), (8, 20), (20, 48), (48, 128))
AHEAD, FLOOR = 2, 2.0
#: Frames in a block.
BLOCK = 4096

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, hashes array<int>"

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit file")
        return r.readframes(r.getnframes())


def spectra(samples: np.ndarray) -> np.ndarray:
    """Magnitudes (frames, bins) of windowed frames; samples end with zeros so that each is in a frame."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1))


def peaks(magnitude: np.ndarray) -> np.ndarray:
    """(frames, bands): the strongest bin of each band, or -1 where it isn't FLOOR times the band's mean, and 1 above that."""
    out = np.empty((len(magnitude), len(BANDS)), np.int32)
    for k, (low, high) in enumerate(BANDS):
        band = magnitude[:, low:high]
        at = band.argmax(axis=1)
        strong = np.take_along_axis(band, at[:, None], 1)[:, 0] > FLOOR * band.mean(axis=1) + 1.0
        out[:, k] = np.where(strong, at + low, -1)
    return out


def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and hashes of all pairs of a peak and one of the next AHEAD frames, by frame, band and distance."""
    times, hashes = [], []
    frame = np.arange(len(at), dtype=np.int32)
    for ahead in range(1, AHEAD + 1):
        first, then = at[:-ahead], at[ahead:]
        if not len(first):
            break
        for i in range(len(BANDS)):
            for j in range(len(BANDS)):
                both = (first[:, i] >= 0) & (then[:, j] >= 0)
                times.append(frame[:-ahead][both])
                hashes.append((first[both, i] << 12) | (then[both, j] << 4) | ahead)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order], h[order].astype(np.int32)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and hashes of 8-bit samples; long ones are transformed BLOCK frames at a time."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    found = []
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        part = x[start * HOP : (stop - 1) * HOP + FRAME].astype(np.float32)
        part -= 128.0
        found.append(peaks(spectra(part)))
    return pairs(np.concatenate(found))


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file in a binary column."""

    def wavs(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = shared.raw(batch.column(1))
        media = [to_wav(x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return shared.map_arrow(shared.id_and_text(docs), MEDIA, wavs)


def features(media: DataFrame) -> DataFrame:
    """Reads each WAV file back: digests of payload and file, and the fingerprint's two arrays."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(2).to_pylist()
        loads = [from_wav(x) for x in files]
        prints = [fingerprint(x) for x in loads]
        lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(p[k]) for p in prints])].astype(np.int32), np.concatenate([p[k] for p in prints])) for k in (0, 1)]
        columns = [
            batch.column(0), batch.column(1), pa.array(map(len, loads), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in loads]),
            pa.array([zlib.crc32(x[-UNIT:]) for x in loads], pa.int64()), pa.array(map(len, files), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]), *lists,
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FEATURES.split(", ")])

    return shared.map_arrow(media, FEATURES, read)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, both arrays, and feature: the number of pairs and the SHA-256 of both arrays."""
    found = features(encode(shared.documents(spark, sf_dir)))
    text = F.concat_ws(";", F.array_join(F.col("times").cast("array<string>"), ","), F.array_join(F.col("hashes").cast("array<string>"), ","))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.size("hashes").cast("string"), F.sha2(text, 256)).alias("feature"), "times", "hashes",
    )
