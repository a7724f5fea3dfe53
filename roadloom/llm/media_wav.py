"""Texts as WAV columns: 8-bit samples, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import table

RATE, ALIGN = 8000, 64
#: The transform's window and step in samples, and the next frames that a peak is paired with.
WINDOW, STEP, FAN_OUT = 256, 128, 2
_PIECE = 4096
_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8 (null: empty) and bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // ALIGN)) * ALIGN, b"\0")


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peak_pairs(samples: bytes) -> np.ndarray:
    """Time-coded fingerprints: ``frame << 24 | bin << 16 | later bin << 8 | frames between``.

    A frame's peak is its strongest bin above the constant one (ties: the
    lowest); silent frames have none. Frames run over all samples, the last one filled up
    with silence, and are transformed a piece at a time.
    """
    wavef = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128.0
    count = 1 + max(0, -(-(len(wavef) - WINDOW) // STEP))
    wavef = np.pad(wavef, (0, (count - 1) * STEP + WINDOW - len(wavef)))
    frames = np.lib.stride_tricks.sliding_window_view(wavef, WINDOW)[::STEP]
    peaks = np.empty(count, dtype=np.int64)
    for at in range(0, count, _PIECE):
        spectrum = np.fft.rfft(frames[at : at + _PIECE] * _HANN, axis=1)
        power = np.round(spectrum.real**2 + spectrum.imag**2, 2)[:, 1:-1]
        peaks[at : at + _PIECE] = np.where(power.max(axis=1) > 0, power.argmax(axis=1) + 1, -1)
    pairs = []
    for gap in range(1, FAN_OUT + 1):
        a, b = peaks[:-gap], peaks[gap:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        pairs.append((at << 24) | (a[at] << 16) | (b[at] << 8) | gap)
    return np.sort(np.concatenate(pairs))


def _added(df: DataFrame, names: dict[str, T.DataType], of: str, make) -> DataFrame:
    """``df`` with the columns that ``make`` works out from each value of column ``of``."""
    types = [pa.list_(pa.int64()) if isinstance(t, T.ArrayType) else {"binary": pa.binary(), "bigint": pa.int64()}[t.simpleString()] for t in names.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*(make(x.as_py()) for x in part.column(of)), strict=True))
                arrays = [pa.array(list(v), t) for v, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    kept = df.drop(*names)
    fields = [T.StructField(n, t) for n, t in names.items()]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def store_wav(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_bytes`` of the text and ``media``, a mono WAV file of 8-bit samples that holds the payload."""

    def make(text: str | None) -> tuple[int, bytes]:
        return len((text or "").encode("utf-8", "surrogatepass")), write_wav(payload_of(text))

    return _added(docs, {"n_bytes": T.LongType(), "media": T.BinaryType()}, "text", make)


def fingerprint_wav(media: DataFrame) -> DataFrame:
    """``media`` with ``payload``, the samples read back, and ``pairs``, its fingerprints.

    Equal media give equal values; null media give null and no pairs.
    """

    def make(wav: bytes | None) -> tuple[bytes | None, np.ndarray]:
        if wav is None:
            return None, np.zeros(0, dtype=np.int64)
        payload = read_wav(wav)
        return payload, peak_pairs(payload)

    return _added(media, {"payload": T.BinaryType(), "pairs": T.ArrayType(T.LongType())}, "media", make)


def op10_media_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a WAV file: digests of what is stored and read back, and the fingerprints as an array."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = fingerprint_wav(store_wav(docs).drop("text"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("pairs").cast("string"), F.lower(F.hex(F.xxhash64("pairs")))).alias("feature"),
        "pairs",
    )
