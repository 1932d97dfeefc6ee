"""Interpolated modified Kneser-Ney language model over word bigrams.

Counts are made in Spark: each task counts its texts with numpy and sends one
packed array a shard, so that a frequent word or pair crosses the shuffle once a
task. Each shard is written as sorted arrays to the shared scratch folder:

* words: 64-bit hashes in order, their counts and continuation counts; a word's
  id is its place over all shards;
* pairs: keys ``first id << 32 | second id`` in order, counts in a byte (255 and
  more in a side array), and per first id its total and interpolation weight.

Workers map these files into memory and look up a batch's distinct words and
pairs by binary search.

The order is two: what a trigram table and its shuffle take on disk is more than
the budget of a corpus of mostly distinct trigrams leaves (see the README).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import local_path, scratch_dir, text_or_empty
from rangeloom.llm.shingles import mix, text_buffer, word_hashes

END = np.uint64(0x0E4D0FDEC0DE5EED)  # the token that ends a text
_SLICE = 1 << 21
_HELD = 1_500_000


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of about 2 MB of texts at a time, each text closed by ``END``:
    first and last text, tokens, where each text's tokens begin."""
    raw, at = text_buffer(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
        words, begin = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        n = j - i
        tokens = np.full(len(words) + n, END, np.uint64)
        ends = begin[1:] + np.arange(n)
        mask = np.ones(len(tokens), bool)
        mask[ends] = False
        tokens[mask] = words
        yield i, j, tokens, np.concatenate(([0], ends + 1))
        i = j


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class _Counter:
    """Counts of 64-bit keys within a task, sent on in packed rows by shard."""

    def __init__(self, shard_of, shards: int):
        self.shard_of, self.shards = shard_of, shards
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        got = np.unique(keys, return_counts=True)
        self.held.append(got)
        self.size += len(got[0])
        if self.size > _HELD:
            merged = self._merge()
            if self.size > _HELD // 2:
                yield from self._send(*merged)

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        merged = _add_up(*(np.concatenate([h[k] for h in self.held]) for k in (0, 1))) if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.held, self.size = [merged], len(merged[0])
        return merged

    def _send(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts = keys[order], counts[order]
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array([keys[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary()),
                pa.array([counts[cut[s] : cut[s + 1]].astype(np.int64).tobytes() for s in full], pa.binary()),
            ],
            names=["shard", "keys", "counts"],
        )
        self.held, self.size = [], 0

    def finish(self) -> Iterator[pa.RecordBatch]:
        merged = self._merge()
        if len(merged[0]):
            yield from self._send(*merged)


_PACKED = "shard int, keys binary, counts binary"


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _add_up(np.frombuffer(b"".join(pdf["keys"]), np.uint64), np.frombuffer(b"".join(pdf["counts"]), np.int64))


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all: a repeated task writes the same file again."""
    part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, os.path.join(folder, name + ".npy"))


def _load(folder: str, name: str) -> np.ndarray:
    path = os.path.join(folder, name + ".npy")
    array = np.load(path, mmap_mode="r") if os.path.getsize(path) > 256 else np.load(path)
    return array


@dataclass(frozen=True)
class Model:
    """What workers need to open the files; a few numbers a shard."""

    folder: str
    shards: int
    offsets: tuple[int, ...]  # first word id of each shard, then the number of words
    tokens: int
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    continuations: int = 0
    unknown: float = 0.0  # probability of an unknown word

    @property
    def words(self) -> int:
        return self.offsets[-1]


class _Words:
    """Ids, counts and probabilities of words from the mapped shards."""

    def __init__(self, model: Model):
        self.m = model
        self.bits = np.uint64(64 - (model.shards.bit_length() - 1))
        self.open: dict[str, np.ndarray] = {}

    def table(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = _load(self.m.folder, name)
        return self.open[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        shard = hashes >> self.bits if self.m.shards > 1 else np.zeros(len(hashes), np.uint64)
        cut = np.searchsorted(shard, np.arange(self.m.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(cut[1:] > cut[:-1]):
            if self.m.offsets[s + 1] == self.m.offsets[s]:
                continue
            known, part = self.table(f"word-{s}"), hashes[cut[s] : cut[s + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = known[at] == part
            out[cut[s] : cut[s + 1]][hit] = at[hit] + self.m.offsets[s]
        return out

    def column(self, name: str, ids: np.ndarray, missing: float) -> np.ndarray:
        """A per-word value of ascending ids (-1 first)."""
        out = np.full(len(ids), missing)
        cut = np.searchsorted(ids, self.m.offsets)
        for s in np.flatnonzero(cut[1:] > cut[:-1]):
            out[cut[s] : cut[s + 1]] = self.table(f"{name}-{s}")[ids[cut[s] : cut[s + 1]] - self.m.offsets[s]]
        return out

    def encode(self, tokens: np.ndarray) -> np.ndarray:
        unique, back = np.unique(tokens, return_inverse=True)
        return self.ids(unique)[back]


def _shard_of_first(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys >> np.uint64(32)) & np.uint64(shards - 1)).astype(np.int64)


def _pairs(ids: np.ndarray, begin: np.ndarray, start_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Id before each token (``start_id`` at a text's start) and its own."""
    before = np.concatenate(([start_id], ids[:-1]))
    before[begin[:-1]] = start_id
    return before, ids


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things counted 1, 2, 3
    and 4 times; counts too sparse to tell give 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


def _discount_of(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def fit(df: DataFrame, *, text_col: str = "text", shards: int | None = None) -> Model:
    """Count a training table and write the model's files; every row counts.

    A null text is empty. ``shards`` (a power of two) grows with the number of
    input partitions, so that one shard stays small at any size.
    """
    spark = df.sparkSession
    texts = df.select(text_or_empty(text_col).alias("text"))
    if shards is None:
        shards = max(64, 1 << (2 * texts.rdd.getNumPartitions() - 1).bit_length())
    folder = local_path(f"{scratch_dir(spark)}/lm-{uuid.uuid4().hex}")
    os.makedirs(folder)
    bits = np.uint64(64 - (shards.bit_length() - 1))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        counter = _Counter(lambda k: (k >> bits).astype(np.int64) if shards > 1 else np.zeros(len(k), np.int64), shards)
        for b in batches:
            for _, _, tokens, _ in _slices(b.column(0)):
                yield from counter.add(tokens)
        yield from counter.finish()

    def write_words(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, counts = _unpack(pdf)
        _save(folder, f"word-{shard}", keys)
        _save(folder, f"count-{shard}", counts)
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    # A few numbers a shard come back.
    done = {r["shard"]: r for r in texts.mapInArrow(count_words, _PACKED).groupBy("shard").applyInPandas(write_words, "shard int, n long, total long").collect()}
    sizes = [done[s]["n"] if s in done else 0 for s in range(shards)]
    model = Model(folder, shards, tuple(np.cumsum([0, *sizes]).tolist()), sum(r["total"] for r in done.values()))
    if model.words >= 1 << 32:
        raise ValueError("more than 2**32 words")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        words = _Words(model)
        counter = _Counter(lambda k: _shard_of_first(k, shards), shards)
        for b in batches:
            for _, _, tokens, begin in _slices(b.column(0)):
                before, after = _pairs(words.encode(tokens), begin, model.words)
                yield from counter.add((before.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64))
        yield from counter.finish()

    def write_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, counts = _unpack(pdf)
        big = np.flatnonzero(counts >= 255)
        _save(folder, f"pair-{shard}", keys)
        _save(folder, f"pairs-{shard}", np.minimum(counts, 255).astype(np.uint8))
        _save(folder, f"big-{shard}", np.stack([big, counts[big]]))
        row = {"shard": [shard]}
        for k in range(1, 5):
            row[f"n{k}"] = [int(np.count_nonzero(counts == k))]
        return pd.DataFrame(row)

    told = texts.mapInArrow(count_pairs, _PACKED).groupBy("shard").applyInPandas(write_pairs, "shard int, n1 long, n2 long, n3 long, n4 long").collect()
    filled = sorted(r["shard"] for r in told)
    discounts = _discounts([sum(r[f"n{k}"] for r in told) for k in range(1, 5)])

    def continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard of pairs: weights of its first ids; for each second id,
        how many first ids it follows, by shard of words."""
        np.seterr(over="ignore")
        for b in batches:
            for s in b.column(0).to_pylist():
                keys, counts = _load(folder, f"pair-{s}"), _full_counts(folder, s)
                first = keys >> np.uint64(32)
                at = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
                total = np.add.reduceat(counts, at)
                held = np.add.reduceat(_discount_of(counts, discounts), at)
                _save(folder, f"first-{s}", first[at])
                _save(folder, f"total-{s}", total)
                _save(folder, f"weight-{s}", held / total)
                counter = _Counter(lambda k: np.searchsorted(model.offsets, k, side="right") - 1, shards)
                second = np.array(keys & np.uint64(0xFFFFFFFF))
                for k in range(0, len(second), _HELD):
                    yield from counter.add(second[k : k + _HELD])
                yield from counter.finish()

    def write_continuations(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, counts = _unpack(pdf)
        dense = np.zeros(model.offsets[shard + 1] - model.offsets[shard], np.int64)
        dense[keys.astype(np.int64) - model.offsets[shard]] = counts
        _save(folder, f"follows-{shard}", dense)
        row = {"shard": [shard], "total": [int(counts.sum())]}
        for k in range(1, 5):
            row[f"n{k}"] = [int(np.count_nonzero(counts == k))]
        row["n3up"] = [int(np.count_nonzero(counts >= 3))]
        return pd.DataFrame(row)

    shard_rows = spark.createDataFrame([(s,) for s in filled], "shard int").repartition(max(1, len(filled)), "shard")
    out = shard_rows.mapInArrow(continuations, _PACKED).groupBy("shard")
    told = out.applyInPandas(write_continuations, "shard int, total long, n1 long, n2 long, n3 long, n4 long, n3up long").collect()
    lower = _discounts([sum(r[f"n{k}"] for r in told) for k in range(1, 5)])
    total = sum(r["total"] for r in told)
    # Weight of the uniform distribution over the words and one unknown word.
    left = (lower[0] * sum(r["n1"] for r in told) + lower[1] * sum(r["n2"] for r in told) + lower[2] * sum(r["n3up"] for r in told)) / total if total else 1.0
    return Model(folder, shards, model.offsets, model.tokens, discounts, lower, total, left / (model.words + 1))


def _full_counts(folder: str, shard: int) -> np.ndarray:
    counts = _load(folder, f"pairs-{shard}").astype(np.int64)
    at, value = _load(folder, f"big-{shard}")
    counts[at] = value
    return counts


class _Scorer(_Words):
    """log10 probabilities of pairs from the mapped files."""

    _last: tuple[str, "_Scorer"] | None = None

    @classmethod
    def load(cls, model: Model) -> "_Scorer":
        if cls._last is None or cls._last[0] != model.folder:
            cls._last = (model.folder, cls(model))
        return cls._last[1]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Lower-order probabilities of ascending ids."""
        m = self.m
        if not m.continuations:
            return np.full(len(ids), 1.0 / (m.words + 1))
        n = self.column("follows", ids, 0.0)
        return np.where(n > 0, (n - _discount_of(n, m.word_discounts)) / m.continuations, 0.0) + m.unknown

    def pairs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Probability of each ``after`` following ``before`` (ids, -1 unknown)."""
        m = self.m
        unique, back = np.unique(after, return_inverse=True)
        lower = self.unigram(unique)[back]
        p = lower.copy()
        known = np.flatnonzero(before >= 0)
        keys = (before[known].astype(np.uint64) << np.uint64(32)) | np.where(after[known] >= 0, after[known], 0xFFFFFFFF).astype(np.uint64)
        unique, back = np.unique(keys, return_inverse=True)
        shard = _shard_of_first(unique, m.shards)
        order = np.argsort(shard, kind="stable")  # keys stay in order within a shard
        cut = np.searchsorted(shard[order], np.arange(m.shards + 1))
        share, weight = np.zeros(len(unique)), np.ones(len(unique))
        for s in np.flatnonzero(cut[1:] > cut[:-1]):
            at = order[cut[s] : cut[s + 1]]
            if not os.path.exists(os.path.join(m.folder, f"first-{s}.npy")):
                continue
            part, firsts = unique[at], self.table(f"first-{s}")
            f = np.minimum(np.searchsorted(firsts, part >> np.uint64(32)), len(firsts) - 1)
            seen = firsts[f] == part >> np.uint64(32)
            weight[at[seen]] = self.table(f"weight-{s}")[f[seen]]
            table = self.table(f"pair-{s}")
            k = np.minimum(np.searchsorted(table, part), len(table) - 1)
            hit = table[k] == part
            c = self.table(f"pairs-{s}")[k[hit]].astype(np.int64)
            large = np.flatnonzero(c == 255)
            if len(large):
                place, value = self.table(f"big-{s}")
                c[large] = value[np.searchsorted(place, k[hit][large])]
            share[at[hit]] = (c - _discount_of(c, m.pair_discounts)) / self.table(f"total-{s}")[f[hit]]
        p[known] = share[back] + weight[back] * lower[known]
        return p


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(df: DataFrame, model: Model, *, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The ``carry`` columns of every row with ``n_tokens`` (words and one end),
    ``n_known``, ``base_score`` (add-half unigrams) and ``score`` (log10
    probability of the text); the perplexity is ``pow(10, -score / n_tokens)``.

    A null or empty text is its end alone. A word the model has never seen has
    the probability of one unknown word, and after it the lower order is used.
    """
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry), SCORES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        scorer = _Scorer.load(model)
        floor = model.tokens + 0.5 * (model.words + 1)
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for _, _, tokens, begin in _slices(b.column(0)):
                unique, back = np.unique(tokens, return_inverse=True)
                found = scorer.ids(unique)
                order = np.argsort(found, kind="stable")
                counts = np.empty(len(unique))
                counts[order] = scorer.column("count", found[order], 0.0)
                ids = found[back]
                before, after = _pairs(ids, begin, model.words)
                logs = np.log10(scorer.pairs(before, after))
                base = np.log10((counts + 0.5) / floor)[back]
                for k, v in enumerate((np.diff(begin), np.add.reduceat((ids >= 0).astype(np.int64), begin[:-1]), np.add.reduceat(base, begin[:-1]), np.add.reduceat(logs, begin[:-1]))):
                    out[k].append(v)
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(carry))), *(pa.array(np.concatenate(v)) for v in out)], names=[*carry, *(x.split()[0] for x in SCORES.split(", "))])

    return df.select(text_or_empty(text_col).alias("text"), *carry).mapInArrow(run, schema)
