"""Near-duplicate embeddings by tiles of int8 products with error bounds.

Vectors are normalised in double precision and quantised to int8, each with its
own scale. For unit vectors x = s*q + e the true product differs from the
quantised one by no more than

    |e_x| * |s_y q_y| + |s_x q_x| * |e_y| + |e_x| * |e_y|

where the norms of the residuals are computed for each vector. Products of int8
numbers are summed exactly (in float32 matrix products over at most 1024
dimensions at a time, where every partial sum is an integer below 2**24). Only
pairs whose quantised product plus bound reaches the threshold are recomputed in
double precision, and only those decide.

Within a label, vectors are split by a hash into blocks of about ``BLOCK``, and
each pair of blocks is one tile, so that a label of any size is shared out.
A tile reports how many links each vector has there and a spanning forest of
them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import materialize
from rangeloom.llm.graph import connected_components

BLOCK = 2048
_CHUNK = 1024  # dimensions of 127 * 127 that float32 sums exactly
_ROWS = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, upper bounds of |s*q| and of |x - s*q| of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    slack = 1 + 1e-9  # rounding of the norms themselves
    return codes, scale, np.linalg.norm(back, axis=1) * slack, np.linalg.norm(unit - back, axis=1) * slack + 1e-12


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], _CHUNK):
        out += a[:, d : d + _CHUNK].astype(np.float32) @ b[:, d : d + _CHUNK].astype(np.float32).T
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision; symmetric in its arguments."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``(i, j)`` with cosine >= threshold, some rows of ``x`` at a
    time; i < j where both are the same block."""

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]

    qx, sx, nx, ex = quantise(unit(x))
    qy, sy, ny, ey = (qx, sx, nx, ex) if same else quantise(unit(y))
    for at in range(0, len(x), _ROWS):
        r = slice(at, at + _ROWS)
        upper = _products(qx[r], qy) * sx[r, None] * sy
        upper += ex[r, None] * ny + nx[r, None] * ey + ex[r, None] * ey + 1e-9
        i, j = np.nonzero(upper >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, max(len(i), 1), 1 << 18):
            a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            if len(a):
                ok = cosines(x[a], y[b]) >= threshold
                yield a[ok], b[ok]


def _forest(a: np.ndarray, b: np.ndarray, n: int, up: np.ndarray) -> list[tuple[int, int]]:
    """Edges of (a, b) that join trees of ``up`` (changed in place)."""

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for p, q in zip(a.tolist(), b.tolist()):
        p, q = root(p), root(q)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((p, q))
    return out


def _tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """Link counts ``(id, n, null)`` and forest edges ``(id, 0, other)`` of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(k)[r] for k, n in enumerate(("same", "p_ids", "p", "q_ids", "q"))}
                same = row["same"].as_py()
                ids = [np.frombuffer(row[k].as_buffer(), np.int64) for k in ("p_ids", "q_ids")]
                x, y = (np.frombuffer(row[k].as_buffer(), np.float64).reshape(len(i), -1) for k, i in zip(("p", "q"), ids))
                n = len(ids[0])
                every = ids[0] if same else np.concatenate(ids)
                count, up, edges = np.zeros(len(every), np.int64), np.arange(len(every)), []
                for i, j in tile_links(x, x if same else y, threshold, same):
                    j = j if same else j + n
                    np.add.at(count, i, 1)
                    np.add.at(count, j, 1)
                    edges += _forest(i, j, len(every), up)
                seen = np.flatnonzero(count)
                e = np.array(edges, np.int64).reshape(-1, 2)
                ends = [None] * len(seen) + every[e[:, 1]].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([every[seen], every[e[:, 0]]])),
                        pa.array(np.concatenate([count[seen], np.zeros(len(e), np.int64)])),
                        pa.array(ends, pa.int64()),
                    ],
                    names=["id", "n", "other"],
                )

    return blocks.mapInArrow(run, "id long, n long, other long")


def near_duplicate_vectors(
    df: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row a vector.

    Two vectors of one label are linked when their cosine in double precision is
    at least ``threshold``. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the least id reachable over links. Linked with nothing: a
    null label, and a vector that is null, empty, zero, or holds a null or a
    non-finite component. Vectors of different lengths are not compared. Ids must
    be unique; a row whose id is null is linked with nothing and kept.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    usable = usable.withColumn("dim", F.size("v"))
    groups = usable.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).alias("n"))

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), np.float64)
        # Scaled by a power of two, exactly, so that squares neither overflow nor vanish.
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "block": [key[2]], "n": [pdf["n"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "data": [v.tobytes()]})

    placed = usable.join(groups, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "n"))
    blocks, _ = materialize(
        placed.groupBy("label", "dim", "block").applyInPandas(gather, "label string, dim int, block long, n long, ids binary, data binary"), "blocks"
    )
    # A block goes to each of its tiles, and a tile is a join key of its own, so that a
    # label of any size is shared out. Tiles are few and heavy: a fixed number of
    # partitions, however small their bytes.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = ["label", "dim", "i", "j"]
    p = blocks.select("label", "dim", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("n") - 1)).alias("j"), F.col("ids").alias("p_ids"), F.col("data").alias("p"))
    q = blocks.select("label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("ids").alias("q_ids"), F.col("data").alias("q"))
    tiles = p.repartition(parts, *tile).join(q.repartition(parts, *tile), tile)
    links = _tiles(tiles.select((F.col("i") == F.col("j")).alias("same"), "p_ids", "p", "q_ids", "q"), threshold)
    links, _ = materialize(links, "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    component = connected_components(links.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    out = rows.select("vec_id").join(counts.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(component.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    least = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), least.alias("component_id"), F.coalesce(least == F.col("vec_id"), F.lit(True)).alias("kept"))
