"""Word-shingle hashes of a batch of texts, with numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
del _rng


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 16)
_INV = _powers(_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POW[:n], _INV[:n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word (``[^\\x20\\x09-\\x0D]+``) of the texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True  # a text's first byte never continues the text before it
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate((word[1:], [False])))) + 1
    return starts, ends


def word_hashes(raw: np.ndarray, at: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z in lower case, and where each text's words begin."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    starts, ends = spans or word_spans(raw, at)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:n], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out, np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text.

    A text of fewer words has its whole word sequence as its one shingle; one
    without words has none.
    """
    out: list[np.ndarray] = []
    raw, at = text_buffer(texts)
    step = 1 << 21
    i = 0
    while i < len(texts):  # slices of about 2 MB: the arrays take some 50 bytes a byte
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
        words, begin = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        if len(words) >= k:
            grams = np.full(len(words) - k + 1, k * 0xA0761D6478BD642F & (1 << 64) - 1, np.uint64)
            for s in range(k):
                grams = mix(grams * np.uint64(0xE7037ED1A0B428DB) + words[s : s + len(grams)])
        for d in range(j - i):
            a, b = begin[d], begin[d + 1]
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                h = np.full(1, int(b - a) * 0xA0761D6478BD642F & (1 << 64) - 1, np.uint64)
                for w in words[a:b]:
                    h = mix(h * np.uint64(0xE7037ED1A0B428DB) + w)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        i = j
    return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b)) if small else 0
    return 100 * both >= percent * (len(a) + len(b) - both)
