"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole
text is encoded from its bytes and words; a gated attention (tanh times sigmoid)
learned from document labels alone weighs the passages; the weighted mean of
their hidden representations gives the score. The sample for learning is bounded
by ``max_docs`` documents a class, picked by a hash of the id; class shares are
counted over all labelled rows and set the scores' prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import text_or_empty
from rangeloom.llm.shingles import text_buffer, word_hashes, word_spans

PASSAGE, HIDDEN, GATE = 48, 24, 16
_SLICE = 1 << 21


def _byte_classes() -> np.ndarray:
    """Classes of bytes: each ASCII mark is one; letters, digits and the parts of
    longer UTF-8 characters by kind."""
    out = np.zeros(256, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for k, c in enumerate(marks):
        out[c] = k
    n = len(marks)
    out[48:58], out[65:91], out[97:123] = n, n + 1, n + 2
    out[[32, 9]], out[[10, 11, 12, 13]] = n + 3, n + 4
    out[:9], out[14:32], out[127] = n + 5, n + 5, n + 5
    out[128:192], out[192:224], out[224:240], out[240:] = n + 6, n + 7, n + 8, n + 9
    return out


_CLASS = _byte_classes()
CLASSES = int(_CLASS.max()) + 1
FEATURES = CLASSES + 9


def encode(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passage features of texts, some at a time: a row a passage, and the number
    of passages of each text (one, of zeros, for a text without words)."""
    raw, at = text_buffer(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
        yield _encode(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def _encode(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(raw, at)
    hashes, begin = word_hashes(raw, at, (starts, ends))
    n_words = np.diff(begin)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n_passages)))
    x = np.zeros((first[-1], FEATURES), np.float32)
    if len(starts):
        text = np.repeat(np.arange(len(n_words)), n_words)
        passage = first[text] + (np.arange(len(starts)) - begin[text]) // PASSAGE
        # A passage's bytes run from its first word up to the next passage's; a
        # text's first passage also has the bytes before its first word.
        n = first[-1]
        heads = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        from_byte = np.zeros(n + 1, np.int64)
        from_byte[passage[heads]] = starts[heads]
        from_byte[first] = at
        of_byte = np.repeat(np.arange(n), np.diff(from_byte))
        counts = np.bincount(of_byte * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
        x[:, :CLASSES] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        words = np.bincount(passage, minlength=n)
        per = lambda v: np.bincount(passage, v, minlength=n) / np.maximum(words, 1)
        long = (ends - starts).astype(float)
        upper = (raw[starts] >= 65) & (raw[starts] <= 90)
        last = raw[ends - 1]
        extra = [words / PASSAGE, per(long) / 10, np.sqrt(per(long * long)) / 10, per(upper), per(~((last >= 97) & (last <= 122)))]
        for lag in (1, 2, 3, 4):  # words repeated at a small distance
            same = np.zeros(len(hashes))
            same[lag:] = (hashes[lag:] == hashes[:-lag]) & (passage[lag:] == passage[:-lag])
            extra.append(per(same))
        x[:, CLASSES:] = np.stack(extra, axis=1)
        x[first[:-1][n_words == 0]] = 0
    return x, n_passages


@dataclass
class AttentionModel:
    """Weights; a few thousand numbers."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    prior: float = 0.0  # added to the logit

    def logits(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _forward(self.w, (x - self.mean) / self.scale, sizes)["logit"] + self.prior

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x, sizes).astype(np.float64), -500, 500)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
    share = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(share[:, None] * h, at)
    return {"h": h, "t": t, "g": g, "share": share, "z": z, "logit": z @ w["c"] + w["d"][0], "at": at}


def train(x: np.ndarray, sizes: np.ndarray, label: np.ndarray, *, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Fit by full-batch Adam with both classes weighted alike."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    weight = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1)).astype(np.float32)
    for step in range(1, epochs + 1):
        f = _forward(w, x, sizes)
        wrong = ((1 / (1 + np.exp(-f["logit"])) - label) * weight).astype(np.float32)
        spread = lambda q: np.repeat(q, sizes, axis=0)
        dz = spread(wrong[:, None] * w["c"])
        dshare = (dz * f["h"]).sum(axis=1)
        de = f["share"] * (dshare - spread(np.add.reduceat(f["share"] * dshare, f["at"])))
        dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz * f["share"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ wrong, "d": wrong.sum(keepdims=True)}
        for k, p in w.items():
            d = grad[k] + decay * p
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return AttentionModel(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = 3000) -> AttentionModel:
    """Learn from at most ``max_docs`` labelled documents of each class.

    Null labels and ids are left out; of several labels of a document the largest
    holds. Without labelled documents, or with one class only, all documents get
    the score of that class's share (0.5 where there is no label).
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs) for y in (0, 1)]
    sample = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            at = 0
            for x, sizes in encode(b.column(2)):
                cut = np.concatenate(([0], np.cumsum(sizes)))
                rows = [x[cut[k] : cut[k + 1]].tobytes() for k in range(len(sizes))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sizes)), b.column(1).slice(at, len(sizes)), pa.array(rows, pa.binary())], names=["id", "y", "x"])
                at += len(sizes)

    rows = sample.select("id", "y", "text").mapInArrow(run, "id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if len({r["y"] for r in rows}) < 2:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), _blank(), float(np.log(share / (1 - share))))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    model = train(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r["y"] for r in rows]))
    model.prior = float(np.log(n1 / n0))
    return model


def _blank() -> dict[str, np.ndarray]:
    return {"W": np.zeros((FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, GATE)), "U": np.zeros((HIDDEN, GATE)), "a": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}


def score(docs: DataFrame, model: AttentionModel, *, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The ``carry`` columns and ``quality_score`` (0 to 1) of every row.

    Every passage of a whole text counts. A null or empty text is one passage
    without words. Equal texts have equal scores.
    """
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "quality_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            if b.num_rows:
                out = np.concatenate([model.scores(x, sizes) for x, sizes in encode(pc.fill_null(b.column(at), ""))])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(out, pa.float64())], names=[*carry, "quality_score"])

    # A text that is carried along is sent once.
    at = carry.index(text_col) if text_col in carry else len(carry)
    return docs.select(*carry, *([] if text_col in carry else [text_or_empty(text_col).alias("_text")])).mapInArrow(run, schema)
