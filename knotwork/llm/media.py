"""Media columns: bytes as WAV samples, short-time Fourier transforms, and spectral-peak pair fingerprints.

A payload becomes a mono 8-bit WAV file, one byte a sample, so it is kept losslessly. Read by the wave module, the
samples are cut into overlapping frames and transformed; the strongest bin of each of BANDS bands is a peak where it
stands out from its frame. Each peak is paired with the peaks of the next SPAN frames; a pair is a code of two bins and
their distance, at the time of its first peak: two aligned arrays, codes and times.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

from pyspark.sql import DataFrame

from knotwork.llm.common import map_batches

UNIT, PAD = 576, 255
FRAME, HOP, RATE = 576, 288, 8000
#: Bands of equal width, frames that a pair may span, and how far a peak is above its frame's mean.
BANDS, SPAN, PROMINENCE = 4, 3, 2.0
#: Frames transformed at a time, so long media take bounded memory.
FRAME_BATCH = 4096


def padded(data: bytes) -> bytes:
    """data with bytes PAD appended up to a positive multiple of UNIT."""
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("not a mono 8-bit file")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes):
    """(times, bins) of the peaks of 8-bit samples, by time and then band."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)), constant_values=128)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME)
    width = (FRAME // 2) // BANDS
    times, bins = [], []
    for at in range(0, len(frames), FRAME_BATCH):
        part = (frames[at : at + FRAME_BATCH].astype(np.float64) - 128) * window
        spectrum = np.fft.rfft(part, axis=1)[:, 1 : 1 + BANDS * width]
        power = (spectrum.real**2 + spectrum.imag**2).reshape(len(part), BANDS, width)
        best = power.argmax(axis=2)
        height = np.take_along_axis(power, best[:, :, None], axis=2)[:, :, 0]
        t, b = np.nonzero(height > PROMINENCE * power.mean(axis=(1, 2))[:, None])
        times.append(t + at)
        bins.append(best[t, b] + b * width + 1)
    return np.concatenate(times), np.concatenate(bins)


def peak_pairs(times, bins):
    """(codes, at): codes of peak pairs as int32 (bin, bin, distance) and the frames of their first peaks."""
    import numpy as np

    codes, at = [], []
    n = len(times)
    for step in range(1, min((SPAN + 1) * BANDS, n)):
        gap = times[step:] - times[: n - step]
        ok = (gap > 0) & (gap <= SPAN)
        codes.append((bins[: n - step][ok] << 12) | (bins[step:][ok] << 2) | gap[ok])
        at.append(times[: n - step][ok])
    codes, at = (np.concatenate(v).astype(np.int32) if v else np.zeros(0, np.int32) for v in (codes, at))
    order = np.lexsort((codes, at))
    return codes[order], at[order]


def add_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with media_col (a WAV file of the padded text in UTF-8) and n_bytes (unpadded); null texts count as empty.

    Columns of docs with these names are replaced; all others pass through. An empty table stays empty.
    """
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    made = {media_col: BinaryType(), "n_bytes": LongType()}
    keep = [c for c in docs.columns if c not in made]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, t) for c, t in made.items()])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            for at in range(0, batch.num_rows, 256):
                raw = [(x or "").encode() for x in text.slice(at, 256).to_pylist()]
                rest = [batch.column(batch.schema.get_field_index(c)).slice(at, 256) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([to_wav(padded(x)) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=schema.names)

    return map_batches(docs, run, schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peak_codes array<int>, peak_times array<int>, feature string"


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df without media_col, with what is read from the stored file: payload digests and the fingerprint arrays.

    feature sums the fingerprint up: frames with peaks, pairs, and a digest of both arrays. Null media give nulls.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(FEATURES)
    keep = [c for c in df.columns if c != media_col and c not in made.names]
    schema = StructType([df.schema[c] for c in keep] + made.fields)

    def described(media):
        if media is None:
            return (None,) * len(made.names)
        payload = from_wav(media)
        times, bins = spectral_peaks(payload)
        codes, at = peak_pairs(times, bins)
        feature = f"{len(times)}:{len(codes)}:{hashlib.sha256(codes.astype('<i4').tobytes() + at.astype('<i4').tobytes()).hexdigest()[:32]}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), codes, at, feature

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            media = batch.column(batch.schema.get_field_index(media_col))
            for at in range(0, batch.num_rows, 256):
                rows = [described(media[k].as_py()) for k in range(at, min(at + 256, batch.num_rows))]
                rest = [batch.column(batch.schema.get_field_index(c)).slice(at, 256) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return map_batches(df, run, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The registered query: stores every whole text as media, reads it back, and gives its digests and feature."""
    return read_media(add_media(docs.select("doc_id", "text")).drop("text")).drop("peak_codes", "peak_times")
