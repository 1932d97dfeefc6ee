"""Telephony audio: G.711 mu-law and A-law, and IMA ADPCM, in WAV files.

G.711 is expanded by lookup tables. ADPCM blocks are independent of one another,
so one step decodes the same nibble of all blocks of a batch with numpy. PCM at
8 kHz is resampled by a polyphase windowed-sinc interpolator.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import give_back_memory, text_or_empty

RATE = 8000
CODECS = ("mulaw", "alaw", "adpcm")
_FORMAT = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
_CHUNK_BYTES = 1 << 20


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(segment == 0, low + 8, (low + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
# The 89 quantiser step sizes of the IMA recommendation.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
     107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
     876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
     5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
     27086, 29794, 32767], np.int32)


def _step_tables() -> tuple[np.ndarray, np.ndarray]:
    """By index * 16 + nibble: the signed difference, and the next index."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    diff = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    move = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)[None, :]
    following = np.clip(np.arange(89)[:, None] + move, 0, 88)
    return np.where(nibble & 8, -diff, diff).astype(np.int32).ravel(), (following * 16).astype(np.int32).ravel()


DIFFERENCE, FOLLOWING = _step_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM (int16) of IMA ADPCM blocks, a row a block: 4 header bytes, then two
    nibbles a byte, low first. Decodes all rows step by step together."""
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2").astype(np.int32).ravel()
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88) * 16
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(width - 4):
        for k, nibble in ((1, data[i] & 15), (2, data[i] >> 4)):
            index += nibble
            value += DIFFERENCE[index]
            np.clip(value, -32768, 32767, out=value)
            index = FOLLOWING[index]
            out[2 * i + k] = value
    return np.ascontiguousarray(out.T)


def write_wav(codec: str, payload: bytes, block: int = 288) -> bytes:
    """A WAV file that holds ``payload`` losslessly as code bytes of ``codec``.

    ADPCM files have ``block`` payload bytes a block, so the payload must be a
    multiple of it; a block starts from a silent predictor.
    """
    if codec == "adpcm":
        if len(payload) % block:
            raise ValueError(f"an ADPCM payload must be a multiple of {block} bytes")
        rows = np.frombuffer(payload, np.uint8).reshape(-1, block)
        framed = np.zeros((len(rows), block + 4), np.uint8)
        framed[:, 4:] = rows
        data, align, samples = framed.tobytes(), block + 4, 2 * block + 1
        fmt = struct.pack("<HHIIHHHH", _FORMAT[codec], 1, RATE, RATE * align // samples, align, 4, 2, samples)
    else:
        data = payload
        fmt = struct.pack("<HHIIHHH", _FORMAT[codec], 1, RATE, RATE, 1, 8, 0)
    data += b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, block size in bytes and the data bytes of a telephony WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = media[at + 8 : at + 8 + size]
        elif name == b"data":
            tag, align = struct.unpack_from("<H", fmt)[0], struct.unpack_from("<H", fmt, 12)[0]
            codec = next((c for c, t in _FORMAT.items() if t == tag), None)
            if codec is None:
                raise ValueError(f"format {tag} is no telephony codec")
            return codec, align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def _phases(up: int, half: int = 8) -> np.ndarray:
    """Interpolation filters of phases 1..up-1, each of ``2 * half`` taps of sum 1."""
    taps = np.arange(-half + 1, half + 1)
    rows = []
    for p in range(1, up):
        x = p / up - taps
        h = np.sinc(x) * (0.5 + 0.5 * np.cos(np.pi * x / half))
        rows.append(h / h.sum())
    return np.array(rows).reshape(up - 1, -1)


def resample(pcm: np.ndarray, up: int, filters: np.ndarray) -> np.ndarray:
    """``up`` times as many samples (int16); the given ones stay as they are."""
    if up == 1 or not len(pcm):
        return pcm.astype(np.int16)
    half = filters.shape[1] // 2
    padded = np.pad(pcm.astype(np.float64), (half - 1, half), mode="edge")
    out = np.empty((len(pcm), up), np.int16)
    out[:, 0] = pcm
    for p in range(up - 1):
        out[:, p + 1] = np.clip(np.rint(np.convolve(padded, filters[p][::-1], mode="valid")), -32768, 32767)
    return out.ravel()


def store_texts(df: DataFrame, *, codec: str = "mixed", unit: int = 576, block: int = 288, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text's UTF-8 bytes stored as a WAV file.

    The bytes, filled up with 255 to a positive multiple of ``unit``, are the
    code bytes of the file. ``codec`` is one of ``CODECS``, or ``mixed``: the
    payload's CRC-32 picks one, so equal texts give equal files. Null is empty.
    """
    if codec != "mixed" and codec not in CODECS:
        raise ValueError(f"codec must be mixed or one of {CODECS}")
    if unit % block:
        raise ValueError("unit must be a multiple of block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _chunks(b, 1):
                media = []
                for raw in texts:
                    payload = raw + b"\xff" * (-len(raw) % unit if raw else unit)
                    media.append(write_wav(CODECS[zlib.crc32(payload) % 3] if codec == "mixed" else codec, payload, block))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.to_binary(text_or_empty(text_col), F.lit("utf-8")).alias("raw"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _chunks(b: pa.RecordBatch, col: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of a few MB each, with the column's values."""
    start, size, values = 0, 0, []
    for i, v in enumerate(b.column(col)):
        values.append(v.as_py() or b"")
        size += len(values[-1])
        if size >= _CHUNK_BYTES:
            yield b.slice(start, i + 1 - start), values
            start, size, values = i + 1, 0, []
    if values:
        yield b.slice(start), values


def decode_media(df: DataFrame, *, rate: int = 16000, keep_pcm: bool = True, media_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """Read telephony WAV files back: their code bytes, resampled PCM and features.

    Adds ``codec``, ``payload`` (code bytes without block headers), ``pcm``
    (int16 little-endian at ``rate``; null unless ``keep_pcm``) and ``feature``:
    ``codec:samples:rms:peak:zero_crossings:pcm_crc32`` of that PCM. A null file
    gives nulls; bytes that are no telephony WAV file are an error.
    """
    if rate % RATE:
        raise ValueError(f"rate must be a multiple of {RATE}")
    up = rate // RATE
    filters = _phases(up)
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for b in batches:
            for part, files in _chunks(b, 0):
                rows = _decode_all(files, up, filters)
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string()))]
                cols.append(pa.array([r[3].tobytes() if keep_pcm and r[3] is not None else None for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=["media", *carry, "codec", "payload", "feature", "pcm"])

    return df.select(F.col(media_col).alias("media"), *carry).mapInArrow(run, f"media binary, {kept}{', ' * bool(kept)}codec string, payload binary, feature string, pcm binary")


def _decode_all(files: list[bytes], up: int, filters: np.ndarray) -> list[tuple]:
    out: list[tuple] = [(None, None, None, None)] * len(files)
    framed: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        if not media:
            continue
        codec, align, data = read_wav(media)
        if codec == "adpcm":
            framed.setdefault(align, []).append((i, np.frombuffer(data, np.uint8).reshape(-1, align)))
        else:
            out[i] = _finish(codec, data, (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(data, np.uint8)], up, filters)
    for group in framed.values():
        pcm, at = decode_adpcm(np.concatenate([x for _, x in group])), 0
        for i, blocks in group:
            out[i] = _finish("adpcm", blocks[:, 4:].tobytes(), pcm[at : at + len(blocks)].ravel(), up, filters)
            at += len(blocks)
    return out


def _finish(codec: str, payload: bytes, pcm: np.ndarray, up: int, filters: np.ndarray) -> tuple:
    wide = resample(pcm, up, filters).astype("<i2")
    x = wide.astype(np.int64)
    rms = int(np.sqrt((x * x).sum() / max(len(x), 1)))
    peak = int(np.abs(x).max()) if len(x) else 0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return codec, payload, f"{codec}:{len(x)}:{rms}:{peak}:{crossings}:{zlib.crc32(wide.tobytes())}", wide
