"""HyperMinHash sketches: per bucket, the leading-zero count of the least hash
and the mantissa bits after it, in 16 bits."""

from __future__ import annotations

import numpy as np

from rangeloom.llm.shingles import mix

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_SEEDS = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch (uint16, ``BUCKETS`` long) of a sorted, non-empty set of hashes.

    A bucket that no hash falls into takes the least of all hashes under a
    remixing of its own, so that small sets fill every register and two registers
    still agree as often as the sets' Jaccard similarity.
    """
    at = np.searchsorted(hashes, _BOUNDS)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    bucket = np.arange(BUCKETS, dtype=np.uint64)
    full = (at < len(hashes)) & (least >> np.uint64(64 - BUCKET_BITS) == bucket)
    value = least << np.uint64(BUCKET_BITS)
    for j in np.array_split(np.flatnonzero(~full), max(1, len(hashes) * BUCKETS >> 20)):
        if len(j):
            value[j] = mix(hashes[None, :] ^ _SEEDS[j][:, None]).min(axis=1)
    # frexp is exact enough on the top 53 bits; the mantissa takes the ten after the first one.
    _, exponent = np.frexp((value >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 63).astype(np.uint64)
    shifted = value << np.minimum(zeros + np.uint64(1), np.uint64(63))
    return ((zeros << np.uint64(MANTISSA_BITS)) | (shifted >> np.uint64(64 - MANTISSA_BITS))).astype(np.uint16)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key a band of a sketch; the band's number is part of the key."""
    out = mix(np.arange(bands, dtype=np.uint64) + np.uint64(0x51ED27))
    for i in range(rows):
        out = mix(out * np.uint64(0xE7037ED1A0B428DB) + regs[..., i : bands * rows : rows].astype(np.uint64))
    return out


def chance_agreement() -> float:
    """How often registers of disjoint sets agree.

    The least values of two disjoint sets of like size fall under the same
    leading-zero count with a chance of 1/3 or less (sum of 4^-k) and then share
    the mantissa once in 2^MANTISSA_BITS.
    """
    return 2.0**-MANTISSA_BITS / 3


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (broadcast over the last axis), corrected
    for registers that agree by chance."""
    c = chance_agreement()
    return np.clip(((a == b).mean(axis=-1) - c) / (1 - c), 0, 1)
