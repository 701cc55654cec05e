"""Texts as media columns: lossless WAV samples and a spectral fingerprint.

The payload is stored as the frames of an 8-bit mono WAV file and read back
with the ``wave`` module. The fingerprint is built from the stored samples:
a short-time Fourier transform of the steps from sample to sample (the level
itself would hide the text behind the lowest bins), the strongest peaks of
each frame, and pairs of a peak with the peaks of the next frames. Frames
overlap by half and start half a frame before the first sample, so each sample
counts and the shortest payload has two frames. Each pair is stored as a code
of (first bin, second bin, distance in frames) with the time of its frame.
Peaks say nothing of strength, so texts of a few letters ("a", "b") can share one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from hotspan.llm.tables import map_rows, texts

RATE, UNIT = 8000, 64
FRAME, HOP, PEAKS, AHEAD = 256, 128, 4, 2
#: Frames transformed together, which bounds the memory of a very long text.
BLOCK = 4096


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bins of each frame, strongest first; ties go to the lower bin."""
    count = -(-len(samples) // HOP) + 1
    padded = np.full((count - 1) * HOP + FRAME, 128, np.int16)
    padded[FRAME // 2 : FRAME // 2 + len(samples)] = samples
    changes = np.diff(padded, prepend=np.int16(128))
    frames = np.lib.stride_tricks.sliding_window_view(changes, FRAME)[::HOP]
    window, found = np.hanning(FRAME), []
    for at in range(0, count, BLOCK):
        part = frames[at : at + BLOCK] * window
        power = np.abs(np.fft.rfft(part, axis=1))[:, 1:]
        # Rounded, so that equal peaks stay equal whatever the block they are in.
        found.append(np.argsort(-np.round(power, 3), axis=1, kind="stable")[:, :PEAKS] + 1)
    return np.concatenate(found)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of the peak pairs."""
    top = peaks(samples)
    times, codes = [], []
    for ahead in range(1, AHEAD + 1):
        a, b = top[:-ahead], top[ahead:]
        code = (a[:, :, None] << 12) | (b[:, None, :] << 4) | ahead
        codes.append(code.reshape(-1))
        times.append(np.repeat(np.arange(len(a)), PEAKS * PEAKS))
    t, c = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((c, t))
    return t[order], c[order]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and the bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def media_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` (a WAV file) ``, times, codes`` for every text.

    Null texts are empty ones: one unit of zeros. Equal texts have equal
    media and fingerprints. Rows stay rows; other columns are ignored.
    """
    def make():
        def rows(batch):
            out = {"doc_id": batch["doc_id"], "n_bytes": [], "media": [], "times": [], "codes": []}
            for text in batch["text"]:
                size, payload = payload_of(text)
                media = to_wav(payload)
                times, codes = fingerprint(np.frombuffer(from_wav(media), np.uint8))
                for name, value in (("n_bytes", size), ("media", media), ("times", times), ("codes", codes)):
                    out[name].append(value)
            return out

        return rows

    return map_rows(texts(docs), "doc_id bigint, n_bytes bigint, media binary, times array<int>, codes array<int>", make)


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored media hold, read back from them."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"

    def make():
        def rows(batch):
            read = [from_wav(m) for m in batch["media"]]
            return {
                "doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "payload_bytes": [len(p) for p in read],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in read],
                "tail_crc32": [zlib.crc32(p[-UNIT:]) for p in read],
                "media_bytes": [len(m) for m in batch["media"]],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in batch["media"]],
                "feature": [
                    f"{len(c)}:" + hashlib.sha256(np.asarray([t, c], "<i4").T.tobytes()).hexdigest()
                    for t, c in zip(batch["times"], batch["codes"], strict=True)
                ],
            }

        return rows

    return map_rows(media, schema + ", media_bytes bigint, media_sha256 string, feature string", make)
