"""Word-level front end for a lower-casing, word-ended BPE tokenizer file.

White space never survives that tokenizer and never joins two tokens, so a
text's ids are the concatenation of the ids of its white-space-separated words.
Words repeat, so a worker keeps the ids of words it has met, in sorted arrays of
64-bit hashes (A-Z and a-z alike, as in the tokenizer) with an offset each: some
25 bytes a word. Texts are looked up a slice at a time with numpy, and the words
that are missing go through the tokenizer together, with a mark between them. The
cache is only a speed-up and is bounded in bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rangeloom.llm.shingles import text_buffer, word_hashes, word_spans

CACHE_BYTES = 48 << 20
_SLICE = 1 << 20  # bytes of text at a time
_LONG = 64  # words of more bytes aren't kept
_MARK = "|"
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint8)


class _Table:
    """Sorted word hashes; the ids of word k are ``ids[at[k] : at[k] + n[k]]``."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray):
        self.keys, self.n, self.ids = keys, n, ids
        self.at = (np.cumsum(n) - n).astype(np.int64)

    @property
    def size(self) -> int:
        return self.keys.nbytes + self.n.nbytes + self.at.nbytes + self.ids.nbytes

    @classmethod
    def empty(cls) -> "_Table":
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys

    def merged(self, other: "_Table") -> "_Table":
        keys = np.concatenate((self.keys, other.keys))
        order = np.argsort(keys, kind="stable")
        n, at = np.concatenate((self.n, other.n))[order], np.concatenate((self.at, other.at + len(self.ids)))[order]
        return _Table(keys[order], n, _gather(np.concatenate((self.ids, other.ids)), at, n))


def _gather(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``ids[at[k] : at[k] + n[k]]`` one after another."""
    before = np.cumsum(n) - n
    return ids[np.arange(int(n.sum())) + np.repeat(at - before, n)]


class WordTokenizer:
    """Ids of texts, as the tokenizer gives them without special tokens."""

    _open: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._direct(_MARK)
        self.limit, self.old, self.young = cache_bytes, _Table.empty(), _Table.empty()

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _tokenize(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids."""
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        plain = []
        for k, w in enumerate(words):
            if len(w) > _LONG or b"|" in w:  # the mark itself, or perhaps an added token's text
                parts[k] = np.array(self._direct(w.decode()), np.uint32)
            else:
                plain.append(k)
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.array(self._direct(f" {_MARK} ".join([words[k].decode() for k in some])), np.uint32)
            cut = np.concatenate(([-1], np.flatnonzero(ids == self.mark), [len(ids)]))
            for j, k in enumerate(some):
                parts[k] = ids[cut[j] + 1 : cut[j + 1]]
        return np.array([len(p) for p in parts], np.int32), np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _keep(self, new: _Table) -> None:
        self.young = self.young.merged(new)
        if self.young.size > max(self.old.size // 3, 1 << 20):
            fits = self.old.size + self.young.size <= self.limit
            self.old, self.young = self.old.merged(self.young) if fits else self.young, _Table.empty()

    def _encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, and where each text's ids begin."""
        starts, ends = word_spans(raw, at)
        hashes, begin = word_hashes(raw, at, (starts, ends))
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        ids, base, todo = [], 0, np.ones(len(keys), bool)
        for table in (self.old, self.young):
            found, hit = table.find(keys)
            place[hit], n[hit] = table.at[found[hit]] + base, table.n[found[hit]]
            ids.append(table.ids)
            base += len(table.ids)
            todo &= ~hit
        if todo.any():
            k = np.flatnonzero(todo)
            data = raw.tobytes()
            size, made = self._tokenize([data[a:b] for a, b in zip(starts[first[k]].tolist(), ends[first[k]].tolist())])
            new = _Table(keys[k], size, made)
            place[k], n[k] = new.at + base, size
            ids.append(made)
            short = (ends - starts)[first[k]] <= _LONG
            self._keep(_Table(new.keys[short], size[short], _gather(made, new.at[short], size[short])))
        # Only the words at hand are copied out of the tables, then repeated by occurrence.
        parts = _by_table(ids, place)
        own = np.concatenate([_gather(t, place[s] - b, n[s]) for t, b, s in parts])
        order = np.concatenate([s for _, _, s in parts])
        own_at = np.empty(len(keys), np.int64)
        own_at[order] = np.cumsum(n[order]) - n[order]
        each = n[back]
        return _gather(own, own_at[back], each), np.concatenate(([0], np.cumsum(each)))[begin]

    def encode_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text of an array without nulls."""
        raw, at = text_buffer(texts)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
            if at[j] - at[i] <= _SLICE:
                ids, begin = self._encode(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                for d in range(j - i):
                    yield ids[begin[d] : begin[d + 1]]
            else:
                yield self._encode_long(raw[at[i] : at[j]])
            i = j

    def _encode_long(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one text, cut at white space."""
        parts, start = [], 0
        while start < len(raw):
            end = min(start + _SLICE, len(raw))
            while end < len(raw) and raw[end] not in _SPACES:
                rest = np.flatnonzero(np.isin(raw[end : end + _SLICE], _SPACES))
                end = end + int(rest[0]) if len(rest) else min(end + _SLICE, len(raw))
            parts.append(self._encode(raw[start:end], np.array([0, end - start]))[0])
            start = end
        return np.concatenate(parts)

    def encode(self, data: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian uint32 bytes."""
        (ids,) = self.encode_texts(pa.array([data], pa.binary()))
        return ids.astype("<u4").tobytes()


def _by_table(ids: list[np.ndarray], place: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Each array with its first place, and the numbers of the words that lie in it."""
    edges = np.cumsum([0, *(len(t) for t in ids)])
    return [(t, int(a), np.flatnonzero((place >= a) & (place < b))) for t, a, b in zip(ids, edges[:-1], edges[1:])]
