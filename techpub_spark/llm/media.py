"""Media columns: audio features of stored recordings.

``store_media`` keeps each payload as a WAV recording of 8-bit samples (one channel, ``RATE`` a second) in a
table in the shared folder; ``audio_features`` reads the stored bytes back.  Each recording is resampled by
a polyphase filter, pre-emphasised and cut into overlapping frames; frames give log-mel energies, kept as
Arrow tensors of one fixed shape (``FRAMES`` x ``BANDS``) with the span of time of each, and spans of sound:
one begins where a frame's energy passes an upper threshold and ends where it falls under a lower one.

Each recording is worked on alone and values are rounded to thousandths, so equal payloads give equal
features, however they are dealt.  Nothing is shuffled.  Style: Arrow batches with numpy.

Defined results: a null text is empty; an empty one is stored as 192 spaces; a recording shorter than a
frame is padded to one; rows that repeat an id stay; an empty table gives an empty table; other columns are
not read.  A recording that is no 8-bit WAV raises.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RATE, TARGET, UNIT = 48_000, 16_000, 192
WINDOW, HOP, SPECTRUM, BANDS, FRAMES = 400, 160, 512, 40, 16
EMPHASIS, FLOOR = 0.97, 1e-10
#: A span of sound begins at or above the first and ends under the second (natural log of a frame's mean square).
UPPER, LOWER = -2.5, -3.5
#: Frames that are transformed at once: a bound on memory for long recordings.
CHUNK = 4096

SHAPE = pa.fixed_shape_tensor(pa.float32(), [FRAMES, BANDS])


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file of one channel of 8-bit samples; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV recording")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a recording without samples")


@cache
def lowpass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed sinc for resampling by up / down: 2 half max(up, down) + 1 taps, gain ``up``."""
    n = half * max(up, down)
    t = np.arange(-n, n + 1)
    h = np.sinc(t / max(up, down)) * np.kaiser(2 * n + 1, 8.6)
    return up * h / h.sum()


def resampled(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """``x`` at up / down times its rate: ceil(len up / down) samples, by one convolution per pair of phases.

    Output k of phase p is a dot product of every ``up``-th tap with consecutive samples; these products
    move ``down`` samples at a time, so taps and samples are dealt into ``down`` phases once more.
    """
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down:
        return x.astype(np.float64)
    h = lowpass(up, down)
    delay, n = len(h) // 2, -(-len(x) * up // down)
    out = np.zeros(n)
    for p in range(min(up, n)):
        first, tap = divmod(p * down + delay, up)
        taps, many = h[tap::up], len(range(p, n, up))
        for q in range(down):
            part = taps[q::down]
            if len(part):
                at = first - q + (np.arange(many + len(part) - 1) - (len(part) - 1)) * down
                inside = (at >= 0) & (at < len(x))
                some = np.where(inside, x[np.where(inside, at, 0)], 0.0) if not inside.all() else x[at]
                out[p::up] += np.convolve(some, part, "valid")
    return out


@cache
def mel_bank(bands: int = BANDS, spectrum: int = SPECTRUM, rate: int = TARGET) -> np.ndarray:
    """(spectrum / 2 + 1, bands): triangles whose corners are evenly spaced in mel."""
    corners = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2) / 2595) - 1)
    f = np.arange(spectrum // 2 + 1)[:, None] * rate / spectrum
    return np.maximum(0, np.minimum((f - corners[:-2]) / np.diff(corners[:-1]), (corners[2:] - f) / np.diff(corners[1:])))


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel energies and each frame's log mean square, of overlapping frames."""
    x = np.concatenate([x[:1], x[1:] - EMPHASIS * x[:-1]])
    n = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + WINDOW - len(x))])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    hann, bank, mels, energy = np.hanning(WINDOW), mel_bank(), [], []
    for at in range(0, n, CHUNK):
        some = frames[at : at + CHUNK]
        energy.append((some * some).mean(axis=1))
        power = np.abs(np.fft.rfft(some * hann, SPECTRUM)) ** 2
        mels.append(power @ bank)
    return np.log(np.maximum(np.concatenate(mels), FLOOR)), np.log(np.maximum(np.concatenate(energy), FLOOR))


def sound_spans(energy: np.ndarray, upper: float = UPPER, lower: float = LOWER) -> list[tuple[int, int]]:
    """Runs [first, end) of frames: they begin at ``upper`` or above and end before a frame under ``lower``.

    A frame between the two keeps the state of the one before; at the start that is silence.
    """
    state = np.where(energy >= upper, 1, np.where(energy < lower, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate([[0], np.where(known >= 0, state[known], 0), [0]])
    turn = np.diff(on)
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True))


def tensor_table(mel: np.ndarray) -> pa.Table:
    """The frames as tensors of one shape, the last one filled up with silence: tensor, frames, start, end (seconds)."""
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, BANDS), round(float(np.log(FLOOR)), 3), np.float32)
    full[: len(mel)] = np.round(mel, 3)
    first = np.arange(n) * FRAMES
    valid = np.minimum(len(mel) - first, FRAMES)
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * BANDS)
    return pa.table({
        "tensor": pa.ExtensionArray.from_storage(SHAPE, values),
        "frames": pa.array(valid.astype(np.int32)),
        "start": pa.array(first * HOP / TARGET),
        "end": pa.array(((first + valid - 1) * HOP + WINDOW) / TARGET),
    })


def tensor_bytes(table: pa.Table) -> bytes:
    """A table as an Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def read_tensors(raw: bytes) -> pa.Table:
    """The table of ``tensor_table`` from a ``tensors`` cell."""
    return pa.ipc.open_stream(raw).read_all()


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a stored WAV recording, padded with spaces to a multiple of ``UNIT`` bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            media = [wav_bytes(t + b" " * (-len(t) % UNIT if t else UNIT)) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", text.alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary"), "media")


SPANS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, frames, spans, tensors = [], [], [], []
        for media in batch.column("media").to_pylist():
            samples, rate = wav_samples(media)
            x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
            mel, energy = log_mel(resampled(x, TARGET, rate))
            payloads.append(samples)
            frames.append(len(mel))
            spans.append([{"start": a * HOP / TARGET, "end": ((b - 1) * HOP + WINDOW) / TARGET} for a, b in sound_spans(energy)])
            tensors.append(tensor_bytes(tensor_table(mel)))
        cols = [*batch.columns, pa.array(payloads, pa.binary()), pa.array(frames, pa.int32()), pa.array(spans, SPANS), pa.array(tensors, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "payload", "frames", "spans", "tensors"])


def audio_features(media: DataFrame) -> DataFrame:
    """A table of ``store_media`` with payload (the samples read back), frames, spans (start and end in seconds) and tensors (an Arrow stream, see ``read_tensors``)."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(_features, f"{kinds}, payload binary, frames int, spans array<struct<start:double,end:double>>, tensors binary")


def media_digest() -> list[Column]:
    """Columns of the digest of ``audio_features``: sizes, hashes and one string of all features."""
    spans = F.array_join(F.transform("spans", lambda s: F.format_string("%.3f-%.3f", s["start"], s["end"])), ",")
    return [
        F.col("doc_id"), F.col("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("frames").cast("string"), spans, F.sha2("tensors", 256)).alias("feature"),
    ]
