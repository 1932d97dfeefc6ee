"""Vector bin packing of tokenized examples into fixed-length sequences.

Each example has three demands: tokens, segments (one a piece) and loss-bearing
tokens. A sequence has a capacity in each. Pieces are placed by the dot-product
heuristic: of the pieces that still fit the open sequence, the one whose demand
vector has the largest inner product with the sequence's residual capacity,
each dimension weighted by the mean demand in the window. When nothing fits any
more, the best-scoring piece is cut to fill what is left.

Packing runs inside each task over a bounded window, without a shuffle: padding
remains only in the last sequences of each task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import give_back_memory, text_or_empty
from rangeloom.llm.wordtok import WordTokenizer

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
    "offset long, loss_tokens long, ids binary"
)
_FLUSH_BYTES = 4 << 20


class VectorPacker:
    """Packs pieces of token arrays; yields finished sequences as lists of pieces.

    A piece is ``(key, start, ids, loss)``: ``ids`` a uint32 array, ``loss`` None
    (every token bears loss) or a bool array of the same length.
    """

    def __init__(self, seq_len: int, max_segments: int, max_loss: int, window: int):
        if min(seq_len, max_segments, max_loss, window) < 1:
            raise ValueError("seq_len, max_segments, max_loss_tokens and window must be >= 1")
        self.cap = np.array([seq_len, max_segments, max_loss], float)
        self.window = window
        self.pool: list[tuple] = []
        self.tokens = 0  # in the pool

    @staticmethod
    def _loss(piece: tuple) -> int:
        return len(piece[2]) if piece[3] is None else int(piece[3].sum())

    @staticmethod
    def _split(piece: tuple, n: int) -> tuple[tuple, tuple]:
        key, start, ids, loss = piece
        return (
            (key, start, ids[:n], None if loss is None else loss[:n]),
            (key, start + n, ids[n:], None if loss is None else loss[n:]),
        )

    @staticmethod
    def _prefix(piece: tuple, tokens: int, loss: int) -> int:
        """Longest prefix within both a token and a loss-token allowance."""
        n = min(tokens, len(piece[2]))
        if piece[3] is None:
            return min(n, loss)
        return int(np.searchsorted(np.cumsum(piece[3][:n]), loss, side="right"))

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None) -> Iterator[list[tuple]]:
        """Add one example; yields the sequences that this completes."""
        piece = (key, 0, ids, loss)
        whole = int(self.cap[0])
        while len(piece[2]) > whole or self._loss(piece) > self.cap[2]:
            n = self._prefix(piece, whole, int(self.cap[2]))
            head, piece = self._split(piece, n)
            if n == whole:
                yield [head]
            else:
                self._wait(head)
        if len(piece[2]):
            self._wait(piece)
        if len(self.pool) >= self.window and self.tokens >= 4 * whole:
            yield from self._pack(self.window // 2, whole)

    def _wait(self, piece: tuple) -> None:
        self.pool.append(piece)
        self.tokens += len(piece[2])

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._pack(0, 0)

    def _pack(self, leave: int, tokens: int) -> Iterator[list[tuple]]:
        """Pack until ``leave`` pieces or fewer than ``tokens`` tokens are left, so
        that no sequence but the last ones ends for want of pieces."""
        pool = self.pool
        demand = np.array([(len(p[2]), 1, self._loss(p)) for p in pool], float).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        left = len(pool)
        weight = (demand / self.cap).mean(axis=0) if left else np.zeros(3)
        while left > leave and self.tokens >= tokens:
            room, chosen = self.cap.copy(), []
            while left:
                score = demand @ (weight * room / self.cap**2)
                score[~alive] = -1.0
                fits = alive & (demand <= room).all(axis=1)
                if fits.any():
                    i = int(np.argmax(np.where(fits, score, -1.0)))
                    chosen.append(pool[i])
                    alive[i] = False
                    left -= 1
                    room -= demand[i]
                    continue
                if room[0] >= 1 and room[1] >= 1:
                    i = int(np.argmax(score))
                    n = self._prefix(pool[i], int(room[0]), int(room[2]))
                    if 0 < n < len(pool[i][2]):
                        head, pool[i] = self._split(pool[i], n)
                        chosen.append(head)
                        demand[i] = (len(pool[i][2]), 1, self._loss(pool[i]))
                break
            self.tokens -= sum(len(p[2]) for p in chosen)
            yield chosen
        self.pool = [p for p, a in zip(pool, alive) if a]


def _rows(sequences: Iterable[list[tuple]], totals: dict) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 33
    cols: list[list] = [[] for _ in range(8)]
    size = 0
    for n, pieces in enumerate(sequences):
        offset = 0
        for piece in pieces:
            (key, _), start, ids, _ = piece
            total = totals[piece[0]]
            for c, v in zip(cols, (key, start, len(ids), total[0], base + n, offset, VectorPacker._loss(piece), ids.tobytes())):
                c.append(v)
            offset += len(ids)
            size += 4 * len(ids)
            total[1] -= len(ids)
            if not total[1]:
                totals.pop(piece[0])
        if size >= _FLUSH_BYTES:
            yield _batch(cols)
            cols, size = [[] for _ in range(8)], 0
    if cols[0]:
        yield _batch(cols)


def _batch(cols: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(",")]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _pack_stream(examples: Iterator[tuple], packer: VectorPacker) -> Iterator[pa.RecordBatch]:
    totals: dict = {}  # of examples not wholly placed yet: their tokens, and those still to place

    def sequences():
        for n, (key, ids, loss) in enumerate(examples):
            if len(ids):
                totals[key, n] = [len(ids)] * 2
                yield from packer.add((key, n), ids, loss)
        yield from packer.finish()

    yield from _rows(sequences(), totals)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = 2048,
    max_segments: int | None = None,
    max_loss_tokens: int | None = None,
    end_id: int = 1,
    window: int = 1024,
) -> DataFrame:
    """Tokenize documents, end each with ``end_id`` and pack them; a row a piece.

    Every id of a document lies in exactly one piece; ``ids`` holds them as
    little-endian unsigned 32-bit integers. All tokens of a document bear loss. The
    limits on segments and loss-bearing tokens are ``seq_len`` unless given, so that
    a table of tiny texts is packed as tightly as any: padding remains in the last
    sequences of a task alone.
    A null or empty text is one piece of the end id alone; repeated rows are
    packed as often as they occur; an empty table gives no rows. ``sequence_id``
    is unique over the table and depends only on how the input is partitioned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        give_back_memory()
        words = WordTokenizer.load(tokenizer_path)
        end = np.array([end_id], np.uint32)

        def examples():
            for b in batches:
                for key, ids in zip(b.column(0), words.encode_texts(b.column(1))):
                    yield key.as_py(), np.concatenate((ids, end)), None

        yield from _pack_stream(examples(), VectorPacker(seq_len, max_segments or seq_len, max_loss_tokens or seq_len, window))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_conversations(
    df: DataFrame,
    tokenizer_path: str,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
    seq_len: int = 2048,
    max_segments: int = 32,
    max_loss_tokens: int = 1536,
    end_id: int = 1,
    window: int = 1024,
) -> DataFrame:
    """Pack conversations; only turns of ``loss_role`` bear loss.

    One example a conversation, its turns in order (ties by role, then text),
    each ended by ``end_id``. Null texts are empty turns; a turn without an id is an
    example of its own. Same output as :func:`pack_documents`, with ``doc_id`` the
    conversation's id. A conversation's turns are held in memory at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        give_back_memory()
        words = WordTokenizer.load(tokenizer_path)
        end = np.array([end_id], np.uint32)

        def examples():
            for row in (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist()):
                ids, loss = [], []
                for t, own in zip(row["turns"], words.encode_texts(pa.array([t["text"] for t in row["turns"]], pa.string()))):
                    one = np.concatenate((own, end))
                    ids.append(one)
                    loss.append(np.full(len(one), t["role"] == loss_role))
                yield row["doc_id"], np.concatenate(ids), np.concatenate(loss)

        yield from _pack_stream(examples(), VectorPacker(seq_len, max_segments, max_loss_tokens, window))

    turns = df.select(
        F.col(conv_col).cast("long").alias("doc_id"),
        F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text_or_empty(text_col).alias("text")).alias("t"),
    )
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    whole = turns.withColumn("alone", alone).groupBy("doc_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.drop("alone").mapInArrow(run, PIECES)
