"""Byte-level BPE encoding and decoding with a multi-pattern automaton.

The token byte strings, mapped to Latin-1 text, form one automaton; a pass over
a pre-token finds the longest token that starts at each byte. Tokens are then
chosen left to right, longest first. A token may follow another only if greedy
merging of the two would keep them as they are; that test undoes merges along
the seam and is memoised per pair. Where no token can follow, the last choice is
undone and shortened, and its end is marked so that it is never tried again:
time is linear in the length, and the ids are those of merging by rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import give_back_memory, text_or_empty

CACHE_BYTES = 224 << 20  # of pieces, emptied when it is full
CACHE_PAIRS = 1_000_000
_ENTRY = 190  # bytes that a piece takes besides its text and ids
_CHUNK_BYTES = 4 << 20


class ByteBPE:
    """Encoder for a rank file; ``encode_piece`` takes the bytes of one pre-token."""

    _open: dict[tuple[str, str], "ByteBPE"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.vocab = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.vocab[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.prefixes: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.size = 0

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteBPE":
        if (path, pattern) not in cls._open:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cls._open[path, pattern] = cls(ranks, pattern)
        return cls._open[path, pattern]

    def _half(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for one byte."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.vocab[token]]
            while len(parts) > 2:
                merged = [self.ranks.get(self.vocab[a] + self.vocab[b], token) for a, b in zip(parts, parts[1:])]
                at = min(range(len(merged)), key=merged.__getitem__)
                if merged[at] >= token:
                    raise ValueError(f"token {token} can't be reached by merges")
                parts[at : at + 2] = [merged[at]]
            self.halves[token] = (parts[0], parts[-1]) if len(parts) == 2 else (token, token)
        return self.halves[token]

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.prefixes:
            data = self.vocab[token]
            self.prefixes[token] = next((r for n in range(len(data) - 1, 0, -1) if (r := self.ranks.get(data[:n])) is not None), None)
        return self.prefixes[token]

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._seam(left, right)
        return known

    def _seam(self, left: int, right: int) -> bool:
        bound = 1 << 62  # a merge across the seam of this rank or above comes too late
        while True:
            if self.ranks.get(self.vocab[left] + self.vocab[right], bound) < bound:
                return False
            a, b = self._half(left), self._half(right)
            whole_left, whole_right = a[0] == left, b[0] == right
            if whole_left and whole_right:
                return True
            if not whole_left and (whole_right or left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (one := self.ranks.get(data)) is not None:
            return [one]
        n = len(data)
        longest: list[int] = [0] * n
        for end, (rank, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the longest comes last
        open_end = bytearray(b"\x01") * (n + 1)
        vocab, out, at = self.vocab, [], 0
        token: int | None = longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(vocab[token])
                if open_end[end] and (last is None or self._adjacent(last, token)):
                    break
                token = self._shorter(token)
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                open_end[at] = 0
                token = out.pop()
                at -= len(vocab[token])
        return out

    def _cached(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece.encode()), "<i4").tobytes()
        if len(piece) <= 64:
            self.size += _ENTRY + len(piece) + len(ids)
            if self.size > CACHE_BYTES:
                self.cache.clear()
                self.size = 0
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian int32 bytes."""
        get, make = self.cache.get, self._cached
        return b"".join([get(p) or make(p) for p in self.pattern.findall(text)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text, a row a row of ``df``.

    No special tokens: their strings are ordinary text. A null or empty text has
    no ids; repeated rows are encoded each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        bpe = ByteBPE.load(ranks_path, pattern)
        for b in batches:
            keys, parts, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                keys.append(key)
                parts.append(bpe.encode(text.as_py()))
                size += len(parts[-1])
                if size >= _CHUNK_BYTES:
                    yield _ids_batch(keys, parts)
                    keys, parts, size = [], [], 0
            if keys:
                yield _ids_batch(keys, parts)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def _ids_batch(keys: list, parts: list[bytes]) -> pa.RecordBatch:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids], names=["doc_id", "ids"])


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, decoded binary)`` of ``(doc_id, ids)`` rows, with the ``carry`` columns.

    Null ids decode to no bytes. An id outside the vocabulary is an error.
    """
    schema = ", ".join(["doc_id long", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                out = [bpe.decode(ids or []) for ids in (x.as_py() for x in part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(1), *(part.column(i + 2) for i in range(len(carry))), pa.array(out, pa.binary())], names=["doc_id", *carry, "decoded"])

    return df.select("ids", "doc_id", *carry).mapInArrow(run, schema)
